"""Packing of compressed fragments into blocks: best fit over a fixed number of bins."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata import config as C


def pack_sizes(sizes: list[int], bins: int = C.PACKER_BINS, area: int = C.FRAGMENT_AREA, slots: int = C.SLOTS) -> list[tuple[int, int]]:
    """(block, slot) of each fragment in arrival order; block -1 if it is not packed.

    A fragment goes to the fullest bin with room for it. Without one, the fullest bin is
    written first, unless the fragment is as large as what that bin holds: then it is
    not packed. A bin is written when it has all its slots or no room left; a bin of one
    fragment is not compressed. At the end all bins are written.
    """
    out = [(-1, -1)] * len(sizes)
    order = [(area, b) for b in range(bins)]  # free space and bin, the fullest first
    held: list[list[int]] = [[] for _ in range(bins)]
    blocks = 0

    def write(b: int) -> None:
        nonlocal blocks
        if len(held[b]) > 1:
            for slot, i in enumerate(held[b]):
                out[i] = (blocks, slot)
            blocks += 1
        held[b] = []

    for i, size in enumerate(sizes):
        if size >= area:
            continue
        k = next((k for k, (free, _) in enumerate(order) if free >= size), None)
        if k is None:
            if size >= area - order[0][0]:
                continue
            k = 0
        free, b = order.pop(k)
        if free < size:
            write(b)
            free = area
        held[b].append(i)
        free -= size
        if len(held[b]) == slots or free == 0:
            write(b)
            free = area
        insort(order, (free, b))
    for _, b in order:
        write(b)
    return out


def pack(fragments: DataFrame, group: str, seq: str = "seq", size: str = "size") -> DataFrame:
    """block and slot of each fragment (group, seq, size) within its group: a zone and flush generation.

    Arrival order decides, so a group is folded on one task; a flush generation bounds it.
    """

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(seq, "ascending")]))
        placed = pack_sizes(rows[size].to_pylist())
        return rows.append_column("block", pa.array([b for b, _ in placed], pa.int64())).append_column("slot", pa.array([s for _, s in placed], pa.int64()))

    return fragments.select(F.col(group).cast("long"), F.col(seq).cast("long"), F.col(size).cast("long")).groupBy(group).applyInArrow(fold, f"{group} long, {seq} long, {size} long, block long, slot long")


def build_blocks(fragments: DataFrame, *group: str) -> DataFrame:
    """Size table and data area of each packed block (``group``, block, slot, data)."""
    f = fragments.filter("block >= 0").groupBy(*group, "block").agg(F.array_sort(F.collect_list(F.struct("slot", "data"))).alias("f"))  # 14 fragments at most
    empty = F.unhex(F.lit(""))
    return f.select(*group, "block", F.transform("f", lambda x: F.length(x["data"])).alias("sizes"), F.aggregate("f", empty, lambda a, x: F.concat(a, x["data"])).alias("area"))
