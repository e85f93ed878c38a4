"""Logical-to-physical mapping: latest entries, reads, discards, tree pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata import config as C
from blockstrata.functions import layout as L
from blockstrata.functions.checks import valid_location
from blockstrata.operators.refs import allocate


def latest(journal: DataFrame, *keys: str, value: str = "pbn", point: str = "point") -> DataFrame:
    """The last value of each key by point; equal points take the larger value. Partial aggregation, no window."""
    return journal.groupBy(*keys).agg(F.max_by(value, F.struct(point, value)).alias(value))


def put(block_map: DataFrame, writes: DataFrame) -> DataFrame:
    """The map after writes (lbn, pbn, point): latest of each block, others as they were."""
    return block_map.join(latest(writes, "lbn").withColumnRenamed("pbn", "new"), "lbn", "full").select("lbn", F.coalesce("new", "pbn").alias("pbn"))


def discard(block_map: DataFrame, gone: DataFrame) -> DataFrame:
    """The map without the discarded blocks."""
    return block_map.join(gone.select("lbn"), "lbn", "left_anti")


def get(reads: DataFrame, block_map: DataFrame) -> DataFrame:
    """Each read with pbn, state and outcome: mapped, zero, unmapped or invalid."""
    out = reads.join(block_map, "lbn", "left")
    kind = F.when(F.col("pbn").isNull(), "unmapped").when(~valid_location(F.col("pbn"), F.col("state")), "invalid").when(F.col("pbn") == C.ZERO_PBN, "zero").otherwise("mapped")
    return out.withColumn("outcome", kind)


def fetch(mapped: DataFrame, physical: DataFrame) -> DataFrame:
    """Rows with ``pbn`` and the data stored there, null where nothing is."""
    return mapped.join(physical, "pbn", "left")


def read_back(reads: DataFrame, block_map: DataFrame, physical: DataFrame, blank) -> DataFrame:
    """Outcome and data of each read; what is unmapped or zero reads as ``blank``, an invalid mapping as null."""
    out = fetch(get(reads, block_map), physical)
    return out.withColumn("data", F.when(F.col("outcome").isin("unmapped", "zero"), blank).when(F.col("outcome") == "mapped", F.col("data")))


def partial_write(old, new, at, length):
    """A block with ``length`` bytes from ``at`` replaced."""
    return F.overlay(old, new, at + 1, length)


def forest(block_map: DataFrame, last_lbn: int, roots: int = C.ROOTS) -> DataFrame:
    """Entries that a traversal keeps, by root: valid and within the logical space."""
    ok = valid_location(F.col("pbn"), F.col("state")) & (F.col("state") != 0) & (F.col("lbn") < last_lbn)
    return block_map.withColumns({"root": L.root_of(F.col("lbn"), roots), "kept": ok})


def traverse(block_map: DataFrame, last_lbn: int, callback, schema: str, roots: int = C.ROOTS) -> DataFrame:
    """Apply a function of pandas batches to every entry that a traversal keeps."""
    return forest(block_map, last_lbn, roots).filter("kept").drop("kept").mapInPandas(callback, schema)


def allocate_pages(lbns: DataFrame, have: DataFrame, base: int, roots: int = C.ROOTS) -> DataFrame:
    """The tree pages (root, height, page) that writes need beyond those there, with a block each from ``base`` on, parents first."""
    new = tree_pages(lbns, roots).join(have, ["root", "height", "page"], "left_anti")
    place = F.struct((-F.col("height")).alias("down"), "root", "page")
    return allocate(new.withColumn("place", place), base).select("root", "height", "page", "pbn")


def tree_pages(lbns: DataFrame, roots: int = C.ROOTS) -> DataFrame:
    """Pages of each height that the blocks need."""
    path = L.tree_path(F.col("lbn"), roots)
    rows = lbns.select(L.root_of(F.col("lbn"), roots).alias("root"), F.explode(F.array(*[F.struct(F.lit(h).alias("height"), p.alias("page")) for h, (p, _) in enumerate(path)])).alias("x"))
    return rows.select("root", "x.height", "x.page").distinct()


def grow(block_map: DataFrame, old_blocks: int, new_blocks: int) -> DataFrame:
    """Interior pages to add at each height when the logical space grows."""
    if new_blocks < old_blocks:
        raise C.ConfigError("a volume can only grow")
    one = block_map.sparkSession.range(1)
    a, b = L.forest_levels(F.lit(old_blocks).cast("long")), L.forest_levels(F.lit(new_blocks).cast("long"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(h).alias("height"), ((y - x) * C.ROOTS).alias("pages")) for h, (x, y) in enumerate(zip(a, b, strict=True))])).alias("x")).select("x.height", "x.pages")
