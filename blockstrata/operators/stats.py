"""Statistics: counters, snapshots, status and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bio_stats(requests: DataFrame) -> DataFrame:
    """Requests in, acknowledged and in progress by operation (``done`` marks an acknowledged one)."""
    out = requests.groupBy("op").agg(F.count("*").alias("came"), F.count_if("done").alias("acknowledged"))
    return out.withColumn("in_progress", F.col("came") - F.col("acknowledged"))


def zone_tally(counters: DataFrame) -> DataFrame:
    """Sums over zones of each counter (zone, counter, value)."""
    return counters.groupBy("counter").agg(F.sum("value").alias("value"))


def snapshot(blocks: DataFrame, block_map: DataFrame, zero) -> DataFrame:
    """One row: blocks written, unique, duplicate and zero, logical and physical blocks in use."""
    b = blocks.agg(F.count("*").alias("written"), F.count_if(zero).alias("zeros"), F.countDistinct(F.when(~zero, F.col("name"))).alias("unique_blocks"))
    m = block_map.agg(F.count("*").alias("logical_used"), F.countDistinct("pbn").alias("physical_used"))
    return b.crossJoin(m).withColumn("duplicates", F.col("written") - F.col("zeros") - F.col("unique_blocks"))  # one row each


def rows_of(stats: DataFrame) -> DataFrame:
    """A row for each counter of a one-row record: counter, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in stats.columns])
    return stats.select(F.explode(pairs).alias("s")).select("s.counter", "s.value")


def as_text(stats: DataFrame) -> DataFrame:
    """The record as one JSON line."""
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("stats"))


def status(device: str, mode: str, recovery: str, index: str, compression: bool, used: DataFrame, total: int) -> DataFrame:
    """The status line as one row; ``used`` has one number."""
    line = (("device", device), ("mode", mode), ("recovery", recovery), ("index", index), ("compression", "online" if compression else "offline"))
    c = used.columns[0]
    return used.select(*[F.lit(v).alias(k) for k, v in line], F.col(c).alias("used_blocks"), F.lit(total).cast("long").alias("total_blocks"))
