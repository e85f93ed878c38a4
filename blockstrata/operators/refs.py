"""Reference counts, space accounting, slabs and allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata import config as C
from blockstrata.functions import layout as L
from blockstrata.functions.checks import valid_location
from blockstrata.operators.ordering import ranks
from blockstrata.runtime import cut


def counts(block_map: DataFrame) -> DataFrame:
    """References to each physical block."""
    return block_map.filter(F.col("pbn") != C.ZERO_PBN).groupBy("pbn").agg(F.count("*").alias("refs"))


def counts_from_journal(entries: DataFrame) -> DataFrame:
    """References by summing increments and decrements."""
    return entries.groupBy("pbn").agg(F.sum("delta").alias("refs"))


def saturated(counted: DataFrame) -> DataFrame:
    """Counts as stored, at most MAX_REFS, and what did not fit."""
    return counted.withColumns({"stored": F.least("refs", F.lit(C.MAX_REFS).cast("long")), "refused": F.greatest(F.col("refs") - C.MAX_REFS, F.lit(0).cast("long"))})


def available(counted: DataFrame) -> DataFrame:
    """References that each block can still take."""
    r = F.col("refs")
    return counted.withColumn("available", F.when(r == C.PROVISIONAL, C.MAX_REFS - 1).otherwise(F.greatest(F.lit(C.MAX_REFS) - r, F.lit(0).cast("long"))))


def rebuild(block_map: DataFrame, last_lbn: int) -> DataFrame:
    """References recounted from valid entries within the logical space; others are dropped."""
    ok = (F.col("state") != 0) & valid_location(F.col("pbn"), F.col("state")) & (F.col("lbn") < last_lbn)
    return counts(block_map.filter(ok))


def space(slabs: DataFrame, map_pages: int, physical_blocks: int) -> DataFrame:
    """Data and overhead from slabs (data_blocks, free_blocks)."""
    s = slabs.agg(F.sum("data_blocks").alias("slab_data"), F.sum(F.col("data_blocks") - F.col("free_blocks")).alias("allocated"))
    return s.select((F.col("allocated") - map_pages).alias("data"), (F.lit(physical_blocks) - F.col("slab_data") + map_pages).alias("overhead"))


def recovery_order(slabs: DataFrame) -> DataFrame:
    """Every slab with its place from 0: clean slabs first, then the emptiest, then the lowest number."""
    rank = F.when(F.col("is_clean"), 0).otherwise(1 << 40) - F.col("hint").cast("long")
    return ranks(slabs.withColumns({"_rank": rank, "_all": F.lit(0)}), "_all", ["_rank", "slab"], "place").drop("_rank", "_all")


def best_slab(slabs: DataFrame, unopened_class: int) -> DataFrame:
    """The slab that allocation opens next."""
    p = L.slab_priority(F.col("free_blocks"), F.col("unopened"), unopened_class)
    return slabs.withColumn("priority", p).orderBy(F.desc("priority"), "slab").limit(1)


def first_free(counters: DataFrame, cursor: int) -> DataFrame:
    """Per slab, the first free offset from ``cursor`` on, else the first of all."""
    free = F.col("count") == 0
    return counters.groupBy("slab").agg(F.coalesce(F.min(F.when(free & (F.col("sbn") >= cursor), F.col("sbn"))), F.min(F.when(free, F.col("sbn")))).alias("sbn"))


def rotor(requests: DataFrame, zones: int, number: str = "number") -> DataFrame:
    """Zone of each allocation: so many in each before the next."""
    return requests.withColumn("zone", F.call_function("div", F.col(number), F.lit(C.ALLOCATIONS_PER_ZONE)) % zones)


def allocate(first: DataFrame, base: int = 1, parts: int | None = None) -> DataFrame:
    """A physical block for each row of ``first`` in the order of ``place``.

    Rows are dealt by ranges of ``place`` and sorted within each; numbers go on from the
    counts of the ranges before, so no task sorts all rows. The dealt rows are kept in the
    shared folder, for their counts and their numbers must come from the same ranges.
    """
    n = [parts] if parts else []
    own = cut(first.repartitionByRange(*n, F.col("place")).sortWithinPartitions("place").withColumn("_at", F.monotonically_increasing_id()))
    own = own.select(*first.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    return own.join(F.broadcast(before), "_part").withColumn("pbn", F.col("_before") + F.col("_nth") + base).drop("_part", "_nth", "_before")
