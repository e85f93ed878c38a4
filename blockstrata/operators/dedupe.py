"""Deduplication of blocks: names, verification, reference limits, zero elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata import config as C
from blockstrata.operators.ordering import ranks


def totals(blocks: DataFrame, zero=None) -> DataFrame:
    """Blocks, distinct names and zero blocks. ``blocks`` has name; ``zero`` is a predicate."""
    return blocks.agg(F.count("*").alias("blocks"), F.countDistinct("name").alias("names"), F.count_if(zero if zero is not None else F.lit(False)).alias("zeros"))


def first_copies(blocks: DataFrame, order: list[str]) -> DataFrame:
    """name, copies and the place (a struct of ``order``) of each name's first block.

    Aggregated before the shuffle, so a name that a third of all blocks share costs a row a task.
    """
    return blocks.groupBy("name").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))


def dedup_map(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Every block with the place of the first block of its name and whether it is a duplicate."""
    first = first_copies(blocks, order)
    out = blocks.join(first, "name")  # a hot name's blocks can be split, the other side has one row for it
    return out.withColumn("is_duplicate", F.struct(*order) != F.col("first"))


def with_copies(blocks: DataFrame, order: list[str], limit: int = C.MAX_REFS) -> DataFrame:
    """Every block with the number of the stored copy that it refers to: each copy takes ``limit`` references in arrival order."""
    return ranks(blocks, "name", order, "nth").withColumn("copy_no", F.call_function("div", F.col("nth"), F.lit(limit))).drop("nth")


def copies_needed(blocks: DataFrame, key: str = "name", limit: int = C.MAX_REFS) -> DataFrame:
    """References and stored copies of each key, without numbering its blocks."""
    return blocks.groupBy(key).agg(F.count("*").alias("refs")).withColumn("copies", F.call_function("div", F.col("refs") + (limit - 1), F.lit(limit)))


def candidates(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Each block with what the index holds for its name, if anything."""
    return blocks.join(index.select("name", F.col("pbn").alias("candidate")), "name", "left").withColumn("found", F.col("candidate").isNotNull())


def verify(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates compared in full with what is stored: outcome is new, dup or stale."""
    out = found.join(stored.select(F.col("pbn").alias("candidate"), F.col("data").alias("stored")), "candidate", "left")
    return out.withColumn("outcome", F.when(~F.col("found"), "new").when(F.col("data") == F.col("stored"), "dup").otherwise("stale"))


def collisions(blocks: DataFrame, data: str = "data") -> DataFrame:
    """Names under which different contents arrived."""
    return blocks.groupBy("name").agg(F.countDistinct(data).alias("contents")).filter("contents > 1")


def zero_elimination(blocks: DataFrame, zero) -> DataFrame:
    """Blocks with ``pbn`` 0 where they are zero, null where they must be stored."""
    return blocks.withColumn("pbn", F.when(zero, F.lit(C.ZERO_PBN).cast("long")))


def shared_keys(keys: DataFrame, *by: str) -> DataFrame:
    """Index keys of more than one name: each such name needs a full entry."""
    return keys.groupBy(*by).agg(F.countDistinct("name").alias("names")).filter("names > 1")


def outcomes(blocks: DataFrame, index: DataFrame, stored: DataFrame, order: list[str], limit: int = C.MAX_REFS) -> DataFrame:
    """What becomes of each block (name, data): new, dup, stale, collision or rollover.

    The first block of a name is new, a dup of what the index names, or stale if that
    differs. Later ones are dups of the first, collisions if they differ from it, and
    rollovers where a copy runs out of references.
    """
    lead = blocks.groupBy("name").agg(F.min_by("data", F.struct(*order)).alias("lead"))
    own = ranks(blocks, "name", order, "nth").join(lead, "name")
    seen = verify(candidates(own, index), stored)
    later = F.when(F.col("data") != F.col("lead"), "collision").when(F.col("nth") % limit == 0, "rollover").otherwise("dup")
    return seen.withColumn("outcome", F.when(F.col("nth") == 0, F.col("outcome")).otherwise(later)).drop("nth", "lead", "stored")
