"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece (one match of the split pattern) is merged by always joining the leftmost of
its lowest-ranked neighbour pairs. The leaves of a segment tree are byte positions;
a leaf holds the rank of the pair that begins there, an inner node the position of
the leftmost minimum below it. A merge updates the leaves of the live neighbours, each
along one path to the root. Pieces that are not known yet are merged side by side:
pieces of like size share one array of trees, and each step makes one merge in every
piece that has one left.

Texts are cut where a run of white space begins after other characters. No match of
the split pattern crosses such a place, so what lies between can be encoded on its own
and kept in a bounded memory of recent pieces (``pieces``).

Defined results: null and empty text give no ids; whole texts are encoded however
long; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockstrata.llm.common import id_text, map_rows, utf8
from blockstrata.llm.pieces import PieceMemory

#: Above every rank.
_NONE = np.int64(1) << 22
#: Fewer pieces of like size are merged one by one.
FEW = 12
#: Leaves of the trees that are merged side by side; a leaf takes some 60 bytes.
SIDE = 1 << 18
#: Pieces that a worker remembers where ids are shipped; other stages run in the same workers.
KEPT = 500_000


class Ranks:
    """The ranks of one vocabulary and the pairs of ids that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.rank.items()}
        width = max(self.bytes) + 1
        self.width = np.int64(width)
        left, right, to = [], [], []
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        key = np.array(left, dtype=np.int64) * width + np.array(right, dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.int64(2) ** 62)
        self.to = np.append(np.array(to, dtype=np.int64)[order], _NONE)
        self.pairs: dict | None = None
        self.byte_id = np.array([self.rank[bytes([c])] for c in range(256)], dtype=np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; negative ids never pair."""
        k = a * self.width + b
        i = np.searchsorted(self.key, k)
        return np.where((self.key[i] == k) & (a >= 0) & (b >= 0), self.to[i], _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int64)
            elif p:
                sizes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                out[i] = np.empty(0, dtype=np.int64)
        for size, members in sizes.items():
            if len(members) < FEW:
                for i in members:
                    out[i] = self._merge_one(pieces[i], size)
                continue
            step = max(1, SIDE // size)
            for at in range(0, len(members), step):
                self._merge(pieces, members[at : at + step], size, out)
        return out

    def _merge(self, pieces: list[bytes], members: list[int], size: int, out: list) -> None:
        """Merge pieces of up to ``size`` bytes (a power of two), a tree of ``size`` leaves each."""
        m = len(members)
        length = np.array([len(pieces[i]) for i in members], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces[i].ljust(size, b"\0") for i in members), dtype=np.uint8).reshape(m, size)
        pos = np.arange(size)
        ids = np.where(pos < length[:, None], self.byte_id[flat], -1)
        after = np.full((m, size), -1, dtype=np.int64)
        after[:, :-1] = ids[:, 1:]
        # a node's value is rank * size + position: its minimum is the leftmost lowest rank
        tree = np.empty((m, 2 * size), dtype=np.int64)
        tree[:, size:] = self.pair(ids, after) * size + pos
        for level in range(size.bit_length() - 2, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        nxt = np.tile(pos + 1, (m, 1))
        prv = np.tile(pos - 1, (m, 1))
        end = length.copy()
        live = np.flatnonzero(tree[:, 1] < _NONE * size)
        while len(live):
            top = tree[live, 1]
            at = top % size
            ids[live, at] = top // size
            gone = nxt[live, at]
            then = nxt[live, gone]
            ids[live, gone] = -1
            nxt[live, at] = then
            inside = then < end[live]
            prv[live[inside], then[inside]] = at[inside]
            here = np.where(inside, ids[live, np.minimum(then, size - 1)], -1)
            self._update(tree, live, gone, np.full(len(live), _NONE), size)
            self._update(tree, live, at, self.pair(ids[live, at], here), size)
            before = prv[live, at]
            has = before >= 0
            rows = live[has]
            self._update(tree, rows, before[has], self.pair(ids[rows, before[has]], ids[rows, at[has]]), size)
            live = live[tree[live, 1] < _NONE * size]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1))
        values, start = ids[kept], 0
        for i, stop in zip(members, ends.tolist(), strict=True):
            out[i] = values[start:stop]
            start = stop

    def _merge_one(self, piece: bytes, size: int) -> np.ndarray:
        """Merge one piece by a tree of ``size`` leaves in plain lists; quicker than arrays for few long pieces."""
        if self.pairs is None:
            self.pairs = dict(zip(self.key[:-1].tolist(), self.to[:-1].tolist(), strict=True))
        n, rank, none, width = len(piece), self.pairs.get, int(_NONE), int(self.width)
        ids = [int(self.byte_id[c]) for c in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none * size] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank(ids[i] * width + ids[i + 1], none) * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value * size + leaf
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:  # nothing changes above
                    return
                tree[node] = low
                node >>= 1

        while tree[1] < none * size:
            value, at = divmod(tree[1], size)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone], after[at] = value, -1, then
            update(gone, none)
            if then < n:
                before[then] = at
                update(at, rank(value * width + ids[then], none))
            else:
                update(at, none)
            if before[at] >= 0:
                update(before[at], rank(ids[before[at]] * width + value, none))
        return np.array([v for v in ids if v >= 0], dtype=np.int64)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray, size: int) -> None:
        """Set one leaf in each row and repair its path to the root."""
        node = leaf + size
        tree[rows, node] = rank * size + leaf
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes.__getitem__, ids))


class Codec:
    """Encodes texts by one vocabulary and pattern, remembering recent pieces."""

    def __init__(self, path: str, pattern: str, limit: int = 1_000_000):
        import regex

        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self.memory = PieceMemory(self._new, limit)

    def _new(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk; equal matches of the pattern are merged once."""
        matches = [self.pattern.findall(c) for c in chunks]
        place: dict[str, int] = {}
        own = [[place.setdefault(p, len(place)) for p in m] for m in matches]
        ids = [v.astype(np.uint32) for v in self.ranks.encode_pieces([utf8(p) for p in place])]
        none = np.empty(0, dtype=np.uint32)
        return [ids[k[0]] if len(k) == 1 else np.concatenate([ids[i] for i in k]) if k else none for k in own]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        ids, sizes = self.memory.ids(texts)
        return np.split(ids.astype("<u4", copy=False), np.cumsum(sizes)[:-1]) if len(texts) else []


_CODECS: dict = {}


def codec(path: str, pattern: str, limit: int = 1_000_000) -> Codec:
    """The codec of a worker process, made once."""
    key = path, pattern, limit
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern, limit)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: Callable[[], str], pattern: str) -> DataFrame:
    """doc_id, ids (array of long) and the decoded bytes of each document.

    ``vocabulary`` gives the path of the rank file on the worker that calls it.
    """

    def make():
        own = codec(vocabulary(), pattern, KEPT)

        def run(ids, texts):
            got = own.encode(texts)
            ends = np.cumsum([0, *map(len, got)])
            flat = np.concatenate(got).astype(np.int64) if got else np.empty(0, dtype=np.int64)
            # a list of numbers at a time: numbers of a whole batch would take nine times their ids
            return {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), "decoded": [own.ranks.decode(v.tolist()) for v in got]}

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, ids array<long>, decoded binary", make, rows=500)


def digest_documents(docs: DataFrame, vocabulary: Callable[[], str], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, without shipping the ids."""

    def make():
        own = codec(vocabulary(), pattern)

        def run(ids, texts):
            got = own.encode(texts)
            return {
                "doc_id": ids, "n_tokens": [len(v) for v in got], "ids_sha256": [hashlib.sha256(v.tobytes()).hexdigest() for v in got],
                "decoded_sha256": [hashlib.sha256(own.ranks.decode(v.tolist())).hexdigest() for v in got],
            }

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, rows=500)
