"""Content names and compression that Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from blockstrata import config as C

_U = np.uint64
# Fixed values of the 128-bit Murmur3 hash for 64-bit machines.
_C1, _C2, _A1, _A2, _F1, _F2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F), _U(0x52DCE729), _U(0x38495AB5), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << _U(n) | x >> _U(64 - n)


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(33)) * _F1
    x = (x ^ x >> _U(33)) * _F2
    return x ^ x >> _U(33)


def murmur128(blocks: list[bytes], seed: int = C.NAME_SEED) -> list[bytes]:
    """128-bit Murmur3 of each block, blocks of one length side by side."""
    out: list = [None] * len(blocks)
    by_length: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if b is not None:
            by_length.setdefault(len(b), []).append(i)
    for length, rows in by_length.items():
        words = -(-length // 16) * 2
        x = np.frombuffer(b"".join(blocks[i].ljust(words * 8, b"\0") for i in rows), dtype="<u8").reshape(len(rows), words)
        h1 = np.full(len(rows), seed, dtype=_U)
        h2 = h1.copy()
        for k in range(0, length // 16 * 2, 2):
            h1 = (_turn(h1 ^ _turn(x[:, k] * _C1, 31) * _C2, 27) + h2) * _U(5) + _A1
            h2 = (_turn(h2 ^ _turn(x[:, k + 1] * _C2, 33) * _C1, 31) + h1) * _U(5) + _A2
        if length % 16:  # the padded tail; what is zero leaves the hashes as they are
            h1 = h1 ^ _turn(x[:, -2] * _C1, 31) * _C2
            h2 = h2 ^ _turn(x[:, -1] * _C2, 33) * _C1
        h1, h2 = h1 ^ _U(length), h2 ^ _U(length)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        h1 = h1 + h2
        h2 = h2 + h1
        both = np.stack([h1, h2], axis=1).astype("<u8")
        for i, row in zip(rows, both, strict=True):
            out[i] = row.tobytes()
    return out


def murmur_name(data: Column) -> Column:
    """The 16-byte name of each binary block."""

    @arrow_udf("binary")
    def name(s: pa.Array) -> pa.Array:
        return pa.array(murmur128(s.to_pylist()), pa.binary())

    return name(data)


def compressed_size(data: Column) -> Column:
    """LZ4 size of each block, or one more than a block where it is no use."""

    @arrow_udf("long")
    def size(s: pa.Array) -> pa.Array:
        return pa.array([None if b is None else n if (n := len(pa.compress(b, codec="lz4_raw", asbytes=True))) <= C.MAX_FRAGMENT else C.BLOCK_BYTES + 1 for b in s.to_pylist()], pa.int64())

    return size(data)


def compress(data: Column) -> Column:
    """LZ4 form of each block; called nondeterministic, so that a filter on its length does not make it a second time."""

    @arrow_udf("binary")
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if b is None else pa.compress(b, codec="lz4_raw", asbytes=True) for b in s.to_pylist()], pa.binary())

    return run.asNondeterministic()(data)


def fragment(sizes: Column, area: Column, slot: Column) -> Column:
    """One fragment of a compressed block, found by the sizes of those before it."""
    from pyspark.sql import functions as F

    start = F.aggregate(F.slice(sizes, F.lit(1), slot), F.lit(0), lambda a, x: a + x)
    return F.substring(area, start + 1, F.element_at(sizes, slot + 1))


def decompress(data: Column, size: int = C.BLOCK_BYTES) -> Column:
    """The block of each LZ4 fragment; null where it does not give a whole block."""

    @arrow_udf("binary")
    def run(s: pa.Array) -> pa.Array:
        def one(b):
            try:
                out = pa.decompress(b, decompressed_size=size, codec="lz4_raw", asbytes=True)
            except OSError:
                return None
            return out if len(out) == size else None

        return pa.array([None if b is None else one(b) for b in s.to_pylist()], pa.binary())

    return run(data)
