"""Recovery after a crash and rebuild of damaged metadata, as chains of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.operators import journal as J
from blockstrata.operators import mapping as M
from blockstrata.operators import refs as R


@dataclass(frozen=True)
class Recovered:
    """What a recovery leaves: the map, counts, the decrements it added and the usage."""

    block_map: DataFrame
    counts: DataFrame
    added: DataFrame
    usage: DataFrame


def crash_recovery(blocks: DataFrame, entries: DataFrame, block_map: DataFrame, counts: DataFrame, head: int) -> Recovered:
    """Replay journal entries (block, lbn, pbn, point, delta) of the contiguous range of ``blocks``.

    ``counts`` has slab, sbn, count and commit; a physical block is slab * 2^16 + sbn here.
    """
    end = J.contiguous(blocks, head).agg(F.max("seq").alias("_end"))  # one row; no block from the head to it is missing
    good = entries.crossJoin(F.broadcast(end)).filter((F.col("block") >= head) & (F.col("block") <= F.col("_end"))).drop("_end")
    lost = J.missing_decrements(good, block_map)
    ups = good.filter("delta > 0")
    new_map = M.put(block_map, ups.select("lbn", "pbn", "point"))
    place = lambda pbn: [F.shiftright(pbn, 16).alias("slab"), (F.col(pbn) % 65536).alias("sbn")]
    replay = good.select(*place("pbn"), "delta", "point")
    extra = lost.groupBy(*place("target")).agg(F.sum(F.lit(-1)).alias("extra"))
    after = J.replay_slab(counts, replay).join(extra, ["slab", "sbn"], "full").select("slab", "sbn", (F.coalesce("count", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("count"))
    return Recovered(new_map, after, lost, J.usage(good))


def rebuild(entries: DataFrame, valid, block_map: DataFrame, last_lbn: int) -> Recovered:
    """Read-only rebuild: damaged entries are skipped, counts come from the map alone."""
    good = entries.filter(valid & (F.col("delta") > 0))
    new_map = M.put(block_map.select("lbn", "pbn"), good.select("lbn", "pbn", "point")).withColumn("state", F.lit(1))
    counts = R.rebuild(new_map, last_lbn)
    return Recovered(new_map, counts, entries.filter(~valid), new_map.agg(F.count_if(F.col("pbn") != 0).alias("logical_used")))
