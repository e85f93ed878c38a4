"""Write-ahead journals: increments and decrements, bounds, gaps and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata import config as C
from blockstrata.functions.checks import congruent_block
from blockstrata.operators.ordering import ranks


def transitions(writes: DataFrame) -> DataFrame:
    """Each write with the mapping that it replaces (null for the first)."""
    return writes.withColumn("old_pbn", F.lag("pbn").over(Window.partitionBy("lbn").orderBy("point")))


def entries(writes: DataFrame) -> DataFrame:
    """lbn, pbn, point, delta: an increment of the new mapping, then a decrement of the old one."""
    t = transitions(writes)
    ops = F.array(F.struct(F.col("pbn").alias("pbn"), F.lit(1).alias("delta")), F.struct(F.col("old_pbn").alias("pbn"), F.lit(-1).alias("delta")))
    return t.select("lbn", "point", F.explode(ops).alias("e")).select("lbn", "e.pbn", "point", "e.delta").filter("pbn is not null")


def numbered(entries_: DataFrame, number: str = "number") -> DataFrame:
    """Place of each entry by its number: journal block, sector and position."""
    n = F.col(number)
    place = n % C.JOURNAL_ENTRIES_PER_BLOCK
    return entries_.withColumns({"block": F.call_function("div", n, F.lit(C.JOURNAL_ENTRIES_PER_BLOCK)), "sector": 1 + F.call_function("div", place, F.lit(C.JOURNAL_ENTRIES_PER_SECTOR)), "position": place % C.JOURNAL_ENTRIES_PER_SECTOR})


def bounds(blocks: DataFrame) -> DataFrame:
    """Tail and both heads over congruent blocks (``ok``)."""
    own = blocks.filter("ok")
    return own.agg(F.max("seq").alias("tail"), F.max("map_head").alias("map_head"), F.max("slab_head").alias("slab_head"))


def contiguous(blocks: DataFrame, head: int) -> DataFrame:
    """Blocks from ``head`` on, up to the first that is missing, bad or, not being the last, short.

    Only the first gap is looked for: a running count would put all blocks in one task,
    so the first number that lacks a good predecessor is found by a join and a minimum.
    """
    good = blocks.filter((F.col("seq") >= head) & F.col("ok"))
    full = good.filter(F.col("count") == C.JOURNAL_ENTRIES_PER_BLOCK).select((F.col("seq") + 1).alias("seq"), F.lit(True).alias("led"))
    stop = good.join(full, "seq", "left").filter(F.col("led").isNull() & (F.col("seq") > head)).agg(F.min("seq").alias("stop"))
    start = good.agg(F.min("seq").alias("first"))
    return good.crossJoin(F.broadcast(stop)).crossJoin(F.broadcast(start)).filter((F.col("first") == head) & (F.col("stop").isNull() | (F.col("seq") < F.col("stop")))).drop("stop", "first")  # one row each


def reap_horizon(locks: DataFrame) -> DataFrame:
    """The first block still locked; all before it can be reused."""
    return locks.agg(F.min(F.when(F.col("locks") > 0, F.col("seq"))).alias("head"), F.max("seq").alias("tail"))


def missing_decrements(entries_: DataFrame, block_map: DataFrame) -> DataFrame:
    """lbn and target of the decrement that a crash lost: slots whose last entry is an increment.

    The target is the second latest increment's mapping, or the stored one where only one increment is left.
    ``entries_`` has lbn, pbn, point and delta; an increment precedes its decrement.
    """
    last = entries_.groupBy("lbn").agg(F.max(F.struct("point", (-F.col("delta")).alias("down"))).alias("last"))
    nth = F.row_number().over(Window.partitionBy("lbn").orderBy(F.desc("point"), F.desc("pbn")))
    two = entries_.filter("delta > 0").select("lbn", "point", "pbn").withColumn("nth", nth).filter("nth <= 2")  # ranked before the shuffle already
    before = two.groupBy("lbn").agg(F.count("*").alias("ups"), F.max_by("pbn", "nth").alias("prior"))
    open_ = last.filter("last.down < 0").join(before, "lbn").join(block_map.select("lbn", F.col("pbn").alias("stored")), "lbn", "left")
    return open_.select("lbn", F.when(F.col("ups") > 1, F.col("prior")).otherwise(F.col("stored")).alias("target")).filter("target is not null")


def load(blocks: DataFrame, nonce: int, kind: int, size: int) -> DataFrame:
    """The blocks of a circular journal (seq, nonce, kind, place) that were written where they stand, by this volume."""
    return blocks.filter(congruent_block(F.col("seq"), F.col("nonce"), F.col("kind"), F.col("place"), nonce, kind, size))


def appended(queued: DataFrame, batch: str, seq: str, number: str = "number") -> DataFrame:
    """Number of each entry in the journal: waiting batches in turn, in each its decrements before its increments, then by arrival."""
    order = queued.withColumn("_up", F.when(F.col("delta") > 0, 1).otherwise(0)).withColumn("_all", F.lit(0))
    return ranks(order, "_all", [batch, "_up", seq], number).drop("_up", "_all")


def commits(entries_: DataFrame, number: str = "number") -> DataFrame:
    """Entries of each journal block, and whether it is committed because it is full or because the journal is idle."""
    own = numbered(entries_, number).groupBy("block").agg(F.count("*").alias("entries"))
    return own.withColumn("reason", F.when(F.col("entries") == C.JOURNAL_ENTRIES_PER_BLOCK, "full").otherwise("idle"))


def lock_counters(references: DataFrame) -> DataFrame:
    """References (lock, zone_type, zone, delta) that each zone still holds on each journal block."""
    return references.groupBy("lock", "zone_type", "zone").agg(F.sum("delta").alias("held"))


def locks(counters: DataFrame) -> DataFrame:
    """seq and locks of each journal block: the zones that hold it, for ``reap_horizon``."""
    return counters.groupBy(F.col("lock").alias("seq")).agg(F.count_if(F.col("held") > 0).alias("locks"))


def scrub(slabs: DataFrame, counts: DataFrame, entries_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dirty slabs in the order of scrubbing (place from 0) with their new state, and the counts after their journals."""
    dirty = slabs.filter(~F.col("is_clean"))
    hint = dirty.withColumns({"_rank": -F.col("hint").cast("long"), "_all": F.lit(0)})
    order = ranks(hint, "_all", ["_rank", "slab"], "place").select("slab", "place", F.lit("rebuilt").alias("state"))
    own = entries_.join(dirty.select("slab"), "slab", "left_semi")
    return order, replay_slab(counts, own)


def replay_slab(counts: DataFrame, entries_: DataFrame) -> DataFrame:
    """Counts (slab, sbn, count, commit) after the journal entries (slab, sbn, delta, point) that came after each commit point.

    Only blocks that have a commit point are looked up; where none has, entries are summed before they are dealt.
    """
    e = entries_.join(counts.filter("commit is not null").select("slab", "sbn", "commit"), ["slab", "sbn"], "left").filter(F.col("commit").isNull() | (F.col("point") > F.col("commit")))
    d = e.groupBy("slab", "sbn").agg(F.sum("delta").alias("delta"))
    return counts.join(d, ["slab", "sbn"], "full").select("slab", "sbn", (F.coalesce("count", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("count"))


def usage(entries_: DataFrame) -> DataFrame:
    """Logical blocks in use by the entries: increments less decrements of mapped blocks."""
    return entries_.agg(F.sum(F.when(F.col("pbn") != C.ZERO_PBN, F.col("delta")).otherwise(0)).alias("logical_used"), F.count_if(F.col("delta") > 0).alias("increments"))
