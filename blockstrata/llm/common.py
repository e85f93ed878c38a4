"""Pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.runtime import arrow_batches, ship


def map_rows(df: DataFrame, columns: list, schema: str, make: Callable, rows: int = 2000) -> DataFrame:
    """Run ``make()(list, list, ...) -> dict of columns`` over Arrow batches of ``columns``.

    ``make`` is called once in each task; what it returns gets one Python list of at most
    ``rows`` values for each column and gives a dict of lists (or Arrow arrays) in the order of ``schema``.
    """
    spark = df.sparkSession
    ship(spark)
    arrow_batches(spark)
    src = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                out = fn(*(c.to_pylist() for c in b.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for (v, t) in zip(out.values(), types, strict=True)], names=list(out))

    types = [_ARROW[x.split()[-1]] for x in schema.split(", ")]
    return src.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text as a string, all other columns left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, unpaired surrogates become replacement marks."""
    return b"" if text is None else text.encode("utf-8", "replace")


#: Ids that may be broadcast at most, some 20 MB of them in memory.
BROADCAST_IDS = 500_000


def only_ids(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``.

    A counted, small list of ids is broadcast, so the texts stay where they are; a
    longer one meets them in a shuffle.
    """
    from blockstrata.runtime import cut

    ids = cut(ids.select("doc_id"))
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_semi")


def common_rows(a: list, b: list) -> list[int]:
    """Bits of a longest common subsequence after each element of ``a``: bit j is 0 where column j + 1 gains one."""
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        out.append(row)
    return out


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists."""
    return len(b) - common_rows(a, b)[-1].bit_count() if a and b else 0


def common_pairs(u: list, v: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists."""
    if u == v:
        return [(i, i) for i in range(len(u))]
    rows = [(1 << len(v)) - 1, *common_rows(u, v)]
    out, i, j = [], len(u), len(v)
    while i and j:
        if rows[i] >> j - 1 & 1:  # the last column gains nothing
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:  # it gained as much without the last element
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


class WordHashes:
    """64-bit hashes of the words of texts, whole batches of bytes at a time.

    ``table`` translates each byte; what becomes a space lies between words. A word's
    hash is a sum of its bytes' random numbers times powers of an odd number, taken from
    running sums and so without a step for each word.
    """

    HOLD = 1 << 20
    _M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

    def __init__(self, table: bytes, seed: int = 3):
        self.table = table
        self.value = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.value[32] = 0
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.power, self.root = self._powers(self.HOLD + 2)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.multiply.accumulate(np.full(n, b, dtype=np.uint64)) for b in (self.base, self.inverse))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes of each text's words, in order."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in texts:
            raw = utf8(t).translate(self.table)
            if len(raw) > self.HOLD:  # a long text in parts that end where words do
                out += self._hash(held) if held else []
                held, size, at, parts = [], 0, 0, []
                while at < len(raw):
                    stop = raw.find(b" ", at + self.HOLD)
                    stop = len(raw) if stop < 0 else stop
                    parts += self._hash([raw[at:stop]])
                    at = stop
                out.append(np.concatenate(parts))
                continue
            if held and size + len(raw) > self.HOLD:
                out += self._hash(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw) + 1
        return out + self._hash(held) if held else out

    def _hash(self, raw: list[bytes]) -> list[np.ndarray]:
        a = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        if len(a) > len(self.power):
            self.power, self.root = self._powers(len(a) + len(a) // 2)
        edge = np.flatnonzero(np.diff(a != 32, prepend=False))  # where words begin and, in turn, end
        start, stop = edge[::2], edge[1::2]
        run = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(self.value[a] * self.power[: len(a)], out=run[1:])
        h = (run[stop] - run[start]) * self.root[start]
        h = (h ^ (h >> np.uint64(30))) * self._M1
        h = (h ^ (h >> np.uint64(27))) * self._M2
        h ^= h >> np.uint64(31)
        ends = np.cumsum([len(x) + 1 for x in raw])
        return np.split(h, np.searchsorted(start, ends[:-1]))
