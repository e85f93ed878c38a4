r"""Token ids in binary files, packed by an adaptive context-mixing range coder.

A file holds segments, one for each row, in ascending document order: the ids of whole
documents cut into blocks of BLOCK ids. A segment's head names its ids, the most frequent
first, how often each range of them comes, and the id that follows each context most
often. Each block starts anew from what the head says and has its own checksum, so
blocks are coded and read side by side, one in each lane of the arrays below.

The model mixes three predictions of the next id. Order 2 and order 1 each give the id
that their context was followed by lately, with a confidence; order 0 gives a
distribution over all ids from adaptive counts of up to 384 ranges of like frequency. The joint
confidence of the two contexts picks a pair of adaptive weights: the mass on the order-2
id, and the mass of the rest on the order-1 id. What is left goes to order 0. One
interval of the mixture codes one id, in integer arithmetic alone, so that any machine
reads what another wrote. The range coder has 64 bits, renormalises by 32 and carries
into words already written.

``encode_ids`` and ``decode_ids`` code one segment with arrays, all blocks at once, and
define the format. The files of a DataFrame are coded by ``TokenCoder.java``, a block after
the other, on the executors' JVMs: the same bytes in about a tenth of the time.

Defined results: null and empty texts hold the end id alone; repeated rows follow one
another; a null document id comes first; an empty table makes an empty file; extra
columns are ignored; a block whose checksum fails raises ValueError, in a DataFrame a
failure of the job.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata.llm.common import arrow_batches, id_text, ship
from blockstrata.llm.pieces import PieceMemory
from blockstrata.runtime import cut, java_column, remove, shared_dir

#: Ids in a block, ids in a segment at least, and bits of an id.
BLOCK, SEGMENT, BITS = 2048, 1 << 21, 16
_TOTAL, _BASE = 24, 20  # bits of the mixture's and of order 0's interval
_ROOM = 15 << 20  # of the mixture, for the two context predictions
_ONE, _HALF = 1 << 10, 1 << 11  # slots of the order-1 and order-2 contexts
_HIT = 24  # what a coded id adds to its range's count
_PRIOR = 3072  # of all counts together, as a block begins
_MAGIC = b"BSTK0002"
_WHITE, _JOINED = "\t\n\x0b\x0c\r ", 128  # what may begin a piece that follows another; new pieces encoded as one text
_JAVA = Path(__file__).with_name("TokenCoder.java")


def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id and width of each range, and the range of each id: 64 single ids, then 32 ranges an octave."""
    first = [*range(64), *((32 + m) << (e - 5) for e in range(6, BITS) for m in range(32))]
    width = np.diff([*first, 1 << BITS])
    return np.array(first, dtype=np.int64), width.astype(np.int64), np.repeat(np.arange(len(first)), width)


_FIRST, _WIDTH, _RANGE = _ranges()
_SHIFT = np.array([int(w).bit_length() - 1 for w in _WIDTH], dtype=np.int32)
_RANGE = _RANGE.astype(np.int16)
_SHARE, _FAN = (1 << 24) - 1, 16


class _Start:
    """What the head of a segment says: its ids by frequency, and how each block's model starts."""

    def __init__(self, alphabet: np.ndarray, count: np.ndarray, one: np.ndarray, two: np.ndarray):
        self.alphabet, self.count, self.one, self.two = (np.asarray(x, dtype="<u2") for x in (alphabet, count, one, two))

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Start, np.ndarray]:
        """The start for these ids, and the ids as their places by frequency."""
        often = np.bincount(ids, minlength=1)
        alphabet = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
        place = np.zeros(len(often), dtype=np.int64)
        place[alphabet] = np.arange(len(alphabet))
        x = place[ids]
        n = -(-(int(_RANGE[len(alphabet) - 1]) + 1) // _FAN) * _FAN
        count = 1 + np.bincount(_RANGE[x], minlength=n) * _PRIOR // len(x)
        before = np.concatenate([np.zeros(2, np.int64), x])
        return cls(alphabet, count, _followers(_slot1(before[1:-1]), x, _ONE), _followers(_slot2(before[1:-1], before[:-2]), x, _HALF)), x

    def pack(self) -> bytes:
        parts = (self.alphabet, self.count, self.one, self.two)
        body = zlib.compress(np.array([len(x) for x in parts], dtype="<u4").tobytes() + b"".join(x.tobytes() for x in parts), 6)
        body += b"\0" * (-len(body) % 4)
        return np.array([len(body)], dtype="<u4").tobytes() + body

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[_Start, int]:
        end = at + 4 + int(np.frombuffer(data, dtype="<u4", count=1, offset=at)[0])
        body = zlib.decompressobj().decompress(data[at + 4 : end])
        ends = 16 + 2 * np.cumsum(np.frombuffer(body, dtype="<u4", count=4))
        return cls(*(np.frombuffer(body[i:j], dtype="<u2") for i, j in zip([16, *ends[:-1].tolist()], ends.tolist(), strict=True))), end


def _slot1(prev1: np.ndarray) -> np.ndarray:
    return prev1 * 40503 >> 4 & (_ONE - 1)


def _slot2(prev1: np.ndarray, prev2: np.ndarray) -> np.ndarray:
    return (prev1 * 40503 ^ prev2 * 30011) >> 3 & (_HALF - 1)


def _followers(slot: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The most frequent follower of each slot, the smaller of equals; the most frequent id where the slot does not occur."""
    pair, often = np.unique(slot << BITS | x, return_counts=True)
    order = np.lexsort((pair, -often, pair >> BITS))
    slots = pair[order] >> BITS
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][: len(slots)])
    out = np.zeros(n, dtype=np.int64)
    out[slots[first]] = pair[order[first]] & ((1 << BITS) - 1)
    return out


class _Model:
    """The models of many lanes. ``n`` below is the number of lanes still in use, from the first."""

    def __init__(self, lanes: int, start: _Start):
        self.lane = np.arange(lanes, dtype=np.int64)
        # both orders in one array, so that each step below serves the two at once: row 0 is order 1, row 1 order 2
        self.table = np.concatenate([np.tile(start.one.astype(np.int32), lanes), np.tile(start.two.astype(np.int32), lanes)])
        self.base = np.stack([self.lane * _ONE, lanes * _ONE + self.lane * _HALF])
        state = np.arange(128)
        first = (state // 16 * 2 + 1) * 65535 // 18 << 16 | (state // 2 % 8 * 2 + 1) * 65535 // 18
        self.weights = np.tile(first.astype(np.uint32), lanes)  # 16 bits for order 2, 16 for order 1
        self.n = len(start.count)
        self.shift = _SHIFT[: self.n]
        self.room = (1 << _BASE) - int(_FIRST[self.n - 1] + _WIDTH[self.n - 1])
        self.count = np.tile(start.count.astype(np.int32), (lanes, 1))
        self.counts = self.count.ravel()
        self.prev1 = np.zeros(lanes, dtype=np.int64)
        self.prev2 = np.zeros(lanes, dtype=np.int64)
        self.base0, self.base_w = self.lane * self.n, self.lane * 128
        self.rebuild(lanes)

    def rebuild(self, n: int) -> None:
        """Order 0's intervals from its counts; every id keeps a share. A cell is start and share in one number."""
        c = self.count[:n]
        share = (self.room // c.sum(axis=1)).astype(np.int32)
        q = 1 + (c * share[:, None] >> self.shift)
        cum = np.zeros((n, self.n), dtype=np.int32)
        np.cumsum((q << self.shift)[:, :-1], axis=1, out=cum[:, 1:])
        self.cells = (cum.astype(np.int64) << 24 | q).ravel()
        self.coarse = np.ascontiguousarray(cum[:, ::_FAN])
        self.fine = cum.reshape(-1, _FAN)

    def cell_of(self, lanes: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The cell of order 0 that holds each value, by comparing with every 16th start and then with 16."""
        w = v.astype(np.int32)[:, None]
        row = lanes * (self.n // _FAN) + (self.coarse[lanes] <= w).sum(axis=1) - 1
        return row * _FAN + (self.fine[row] <= w).sum(axis=1) - 1

    def predict(self, n: int) -> None:
        """The two predicted ids and their masses, for the ids that follow."""
        self.at = np.empty((2, n), dtype=np.int64)
        self.at[0] = _slot1(self.prev1[:n])
        self.at[1] = _slot2(self.prev1[:n], self.prev2[:n])
        self.at += self.base[:, :n]
        self.entry = self.table[self.at]
        self.c, self.conf = self.entry & 0xFFFF, self.entry >> 16
        self.c1, self.c2 = self.c
        same = self.c1 == self.c2
        self.state = self.base_w[:n] + ((self.conf[1] << 4) + (self.conf[0] << 1) + same)
        both = self.weights[self.state]
        self.w = np.empty((2, n), dtype=np.int32)
        self.w[0], self.w[1] = both & np.uint32(0xFFFF), both >> np.uint32(16)
        self.f2 = self.w[1].astype(np.int64) * 237 + 256
        self.f1 = ((_ROOM - self.f2) * self.w[0] >> 16) + 1
        self.f1[same] = 0

    def learn(self, n: int, ids: np.ndarray, ranges: np.ndarray) -> None:
        """Move the weights, contexts and counts towards the ids that came, which lie in these ranges."""
        x = ids.astype(np.int32)
        hit = self.c == x
        move = hit * np.int32(65535) - self.w >> 5
        move[0] *= ~hit[1]
        move += self.w
        low, high = move.view(np.uint32)
        self.weights[self.state] = high << np.uint32(16) | low
        missed = np.where(self.conf > 1, self.entry - ((self.conf + 1 >> 1) << 16), x)
        self.table[self.at] = np.where(hit, np.minimum(self.entry + 65536, 7 * 65536 + x), missed)
        self.counts[self.base0[:n] + ranges] += _HIT
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids


def _due(t: int) -> bool:
    """Whether order 0 is rebuilt before id t."""
    return t in (16, 32, 64, 128) or t and t % 256 == 0


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: header, then length and checksum of each block, then the blocks."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= (1 << BITS) - 1):
        raise ValueError(f"ids must be below {(1 << BITS) - 1}")
    lanes = -(-len(ids) // block)
    head = _MAGIC + np.array([len(ids), block], dtype="<u8").tobytes()
    if not lanes:
        return head
    own = ids.astype("<u4")
    start, ids = _Start.of(ids)
    head += start.pack()
    sums = np.array([zlib.crc32(own[k * block : (k + 1) * block].tobytes()) for k in range(lanes)], dtype="<u4")
    last = len(ids) - (lanes - 1) * block
    grid = np.zeros(lanes * block, dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    ranges = _RANGE[grid]
    inside = (grid - _FIRST[ranges]).astype(np.int32)
    model = _Model(lanes, start)
    low, rng = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    words = np.zeros((block * 25 // 32 + 4, lanes), dtype=np.uint64)
    flat, pos = words.ravel(), np.zeros(lanes, dtype=np.int64)
    u32, u24 = np.uint64(32), np.uint64(_TOTAL)
    for t in range(min(block, len(ids))):
        n = lanes if t < last else lanes - 1
        if _due(t):
            model.rebuild(n)
        model.predict(n)
        x = grid[t, :n]
        f2, f1 = model.f2, model.f1
        h2, h1 = x == model.c2, x == model.c1
        cell = model.cells[model.base0[:n] + ranges[t, :n]]
        q = cell & _SHARE
        c = (cell >> 24) + inside[t, :n] * q
        rest = (1 << _TOTAL) - f2 - f1
        lo = c * rest >> _BASE
        start = np.where(h2, 0, np.where(h1, f2, f2 + f1 + lo)).astype(np.uint64)
        freq = np.where(h2, f2, np.where(h1, f1, ((c + q) * rest >> _BASE) - lo)).astype(np.uint64)
        unit = rng[:n] >> u24
        was = low[:n].copy()
        low[:n] += start * unit
        rng[:n] = freq * unit
        carry = np.flatnonzero(low[:n] < was)
        flat[(pos[carry] - 1) * lanes + carry] += np.uint64(1)
        out = np.flatnonzero(rng[:n] < np.uint64(1 << 32))
        flat[pos[out] * lanes + out] = low[out] >> u32
        low[out] <<= u32
        rng[out] <<= u32
        pos[out] += 1
        model.learn(n, x, ranges[t, :n])
    every = np.arange(lanes)
    flat[pos * lanes + every] = low >> u32
    flat[(pos + 1) * lanes + every] = low & np.uint64(0xFFFFFFFF)
    for j in range(int(pos.max()) + 1, 0, -1):
        words[j - 1] += words[j] >> u32
    body = words.astype("<u4").T
    size = pos + 2
    return head + size.astype("<u4").tobytes() + sums.tobytes() + b"".join(body[k, :s].tobytes() for k, s in enumerate(size.tolist()))


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a segment as unsigned 32-bit integers, every block checked."""
    if data[:8] != _MAGIC:
        raise ValueError("not a token segment")
    total, block = (int(v) for v in np.frombuffer(data, dtype="<u8", count=2, offset=8))
    lanes = -(-total // block)
    if not lanes:
        return np.empty(0, dtype="<u4")
    begin, at = _Start.unpack(data, 24)
    size = np.frombuffer(data, dtype="<u4", count=lanes, offset=at).astype(np.int64)
    sums = np.frombuffer(data, dtype="<u4", count=lanes, offset=at + 4 * lanes)
    words = np.concatenate([np.frombuffer(data, dtype="<u4", offset=at + 8 * lanes), np.zeros(4, dtype="<u4")]).astype(np.uint64)
    if len(words) != size.sum() + 4:
        raise ValueError("a token segment is cut short")
    pos = np.cumsum(size) - size
    u32, u24 = np.uint64(32), np.uint64(_TOTAL)
    code = words[pos] << u32 | words[pos + 1]
    pos = pos + 2
    rng = np.full(lanes, 2**64 - 1, dtype=np.uint64)
    last = total - (lanes - 1) * block
    model = _Model(lanes, begin)
    grid = np.zeros((block, lanes), dtype=np.int64)
    for t in range(min(block, total)):
        n = lanes if t < last else lanes - 1
        if _due(t):
            model.rebuild(n)
        model.predict(n)
        f2, f1 = model.f2, model.f1
        unit = rng[:n] >> u24
        v = np.minimum((code[:n] // unit).astype(np.int64), (1 << _TOTAL) - 1)
        h2, h1 = v < f2, (v >= f2) & (v < f2 + f1)
        x = np.where(h2, model.c2, model.c1).astype(np.int64)
        start, freq = np.where(h2, 0, f2), np.where(h2, f2, f1)
        k = np.flatnonzero(~(h2 | h1))
        rest = (1 << _TOTAL) - f2[k] - f1[k]
        u = v[k] - f2[k] - f1[k]
        w = ((u + 1 << _BASE) - 1) // rest
        at = model.cell_of(k, w)
        cell = model.cells[at]
        q, r = cell & _SHARE, at - k * model.n
        c = cell >> 24
        off = np.minimum((w - c) // q, _WIDTH[r] - 1)
        x[k] = _FIRST[r] + off
        c += off * q
        lo = c * rest >> _BASE
        start[k], freq[k] = f2[k] + f1[k] + lo, ((c + q) * rest >> _BASE) - lo
        code[:n] -= start.astype(np.uint64) * unit
        rng[:n] = freq.astype(np.uint64) * unit
        m = np.flatnonzero(rng[:n] < np.uint64(1 << 32))
        code[m] = code[m] << u32 | words[np.minimum(pos[m], len(words) - 1)]
        rng[m] <<= u32
        pos[m] += 1
        grid[t, :n] = x
        model.learn(n, x, _RANGE[x])
    ids = begin.alphabet[np.minimum(np.ascontiguousarray(grid.T).ravel()[:total], len(begin.alphabet) - 1)].astype("<u4")  # a broken block may name more
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != sums[k]:
            raise ValueError(f"block {k} of a token segment fails its checksum")
    return ids


def segments(spark: SparkSession, ids: Column, block: int = BLOCK) -> Column:
    """``encode_ids`` of binaries that hold ids as little-endian unsigned 16-bit integers."""
    return java_column(spark, _JAVA, "blockstrata.TokenCoder$Write", "binary", ids, F.lit(block))


def segment_ids(spark: SparkSession, payload: Column) -> Column:
    """``decode_ids`` of segments, as binaries of little-endian unsigned 32-bit integers."""
    return java_column(spark, _JAVA, "blockstrata.TokenCoder$Read", "binary", payload)


class Tokens:
    """Ids of texts from a tokenizer file, remembering recent pieces between white space."""

    def __init__(self, path: str, limit: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = PieceMemory(self._new, limit)
        added = {i: len(a.content.encode()) for i, a in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | added
        self.width = np.zeros(max(vocabulary, default=0) + 1, dtype=np.int64)  # bytes of each id; a byte is one character of a token
        self.width[list(vocabulary)] = list(vocabulary.values())

    def _new(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces. Those that follow one another as in a text are encoded as one, and cut by the bytes of their ids."""
        out: list = [None] * len(pieces)
        rows = [k for k, p in enumerate(pieces) if p[0] in _WHITE and not p[-1].isspace()]
        parts = [rows[k : k + _JOINED] for k in range(0, len(rows), _JOINED)]
        for part, e in zip(parts, self._ids(["".join([pieces[k] for k in part]) for part in parts]), strict=True):
            have = np.cumsum(self.width[e])
            want = np.cumsum([len(pieces[k].encode()) for k in part])
            at = np.searchsorted(have, want) + 1
            if at[-1] == len(have) and (have[at - 1] == want).all():
                i = 0
                for k, j in zip(part, at.tolist(), strict=True):
                    out[k], i = e[i:j], j
        alone = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(alone, self._ids([pieces[k] for k in alone]), strict=True):
            out[k] = ids
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. No piece of a byte-level tokenizer crosses the places where texts are cut."""
        ids, sizes = self.memory.ids(texts)
        return np.split(ids.astype("<u4", copy=False), np.cumsum(sizes)[:-1]) if len(texts) else []


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The tokenizer of a worker process, made once."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: Callable[[], str], end_id: int = 2, segment: int = SEGMENT, block: int = BLOCK) -> None:
    """Write the ids of all documents, each with an end id, in ascending doc_id order.

    Parts follow one another by id range. Spark's commit protocol keeps exactly one
    copy of each part, whichever tasks are run again.
    """
    spark = docs.sparkSession
    ship(spark)
    arrow_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        from pyspark import TaskContext

        own, part, seq = tokens(vocabulary()), TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0

        def flush():
            flat = np.concatenate(parts)
            if flat.max() >= (1 << BITS) - 1:
                raise ValueError(f"ids must be below {(1 << BITS) - 1}")
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([flat.astype("<u2").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_ids", "lengths", "ids"])

        for b in batches:
            for k in range(0, b.num_rows, 500):
                few = b.slice(k, 500)
                for i, v in zip(few.column(0).to_pylist(), own.encode(few.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    parts.append(np.concatenate([v, end]))
                    held += len(parts[-1])
                    if held >= segment:
                        yield flush()
                        ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    plain = rows.mapInArrow(run, "part int, seq int, doc_ids array<long>, lengths array<long>, ids binary")
    plain.select("part", "seq", "doc_ids", "lengths", segments(spark, F.col("ids"), block).alias("payload")).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, offset (in its segment), ids of each document in a token file."""
    return _read(spark, path, "ids array<long>", lambda v: pa.array(v.tolist(), pa.int64()), pa.list_(pa.int64()))


def _read(spark: SparkSession, path: str, column: str, make: Callable, kind: pa.DataType) -> DataFrame:
    ship(spark)
    arrow_batches(spark)

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):  # a segment at a time
                part, seq, ids, lengths, data = (c[n].as_py() for c in b.columns)
                all_ids, stop = np.frombuffer(data, dtype="<u4"), np.cumsum(lengths)
                start = stop - lengths
                for at in range(0, len(ids), 1000):
                    k = range(at, min(at + 1000, len(ids)))
                    got = [make(all_ids[start[j] : stop[j]]) for j in k]
                    cols = [pa.array([part] * len(k), pa.int32()), pa.array([seq] * len(k), pa.int32()), pa.array([ids[j] for j in k], pa.int64()), pa.array(start[at : at + len(k)], pa.int64()), pa.array([lengths[j] for j in k], pa.int64()), pa.array([g.tolist() if isinstance(g, pa.Array) else g for g in got], kind)]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_id", "offset", "n_tokens", column.split(" ")[0]])

    rows = spark.read.parquet(path).select("part", "seq", "doc_ids", "lengths", segment_ids(spark, F.col("payload")).alias("ids"))
    return rows.mapInArrow(run, f"part int, seq int, doc_id long, offset long, n_tokens long, {column}")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq and ``base``, the ids in the file before each segment. The payload is not read."""
    seg = spark.read.parquet(path).select("part", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = seg.groupBy("part").agg(F.sum("n").alias("n"))  # as many rows as the file has parts
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    return seg.withColumn("inner", inner).join(before, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("base"))


def round_trip(docs: DataFrame, vocabulary: Callable[[], str], end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write a token file and give doc_id, start, n_tokens, ids_crc32 of each document as read from it.

    Without a ``path`` the file lies in the shared folder and is removed once it is read.
    """
    spark = docs.sparkSession
    file = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, file, vocabulary, end_id)
    rows = _read(spark, file, "ids_crc32 long", lambda v: zlib.crc32(v.tobytes()), pa.int64())
    out = rows.join(segment_starts(spark, file), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    if path:
        return out
    out = cut(out)
    remove(spark, file)
    return out
