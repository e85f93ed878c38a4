r"""A bounded memory of encoded pieces of text, looked up whole batches at a time.

Texts are cut where white space begins after other characters; no match of a split
pattern crosses such a place, so what lies between can be encoded on its own. A piece is
known by two 64-bit hashes and its length, found from running sums over the bytes of
many texts; its ids lie in one array. So a piece that is known costs a few array
operations, however many texts are at hand, and only new ones reach the encoder.

The memory holds at most ``limit`` pieces and ``room`` ids, and starts anew beyond that;
pieces of more than ``LONGEST`` bytes are never kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from blockstrata.llm.common import utf8

#: White space beyond ASCII: a text that has any is cut by ``_CUT``, which sees all of it.
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Where a piece ends: white space behind another character.
_END = re.compile(rb"[^\t\n\x0b\x0c\r ](?=[\t\n\x0b\x0c\r ])")
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
#: Bytes of texts that are hashed together, and of a piece that is kept.
HOLD, LONGEST = 1 << 18, 4096
#: New pieces that are encoded together.
PART = 1 << 14
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Sums:
    """Hashes of stretches of a byte string from running sums."""

    def __init__(self, seed: int):
        self.value = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15 ^ seed << 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.grow(HOLD + 2)

    def grow(self, n: int) -> None:
        self.power, self.root = (np.multiply.accumulate(np.full(n, b, dtype=np.uint64)) for b in (self.base, self.inverse))

    def of(self, a: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(a) > len(self.power):
            self.grow(len(a) + len(a) // 2)
        run = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(self.value[a] * self.power[: len(a)], out=run[1:])
        h = (run[stop] - run[start]) * self.root[start] + (stop - start).astype(np.uint64) * _M2
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        return (h ^ (h >> np.uint64(31))) | np.uint64(1)  # never 0, which marks an empty slot


class PieceMemory:
    """Ids of texts by an encoder of pieces, ``encode(list of strings) -> list of arrays of ids``."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 500_000, room: int = 8_000_000):
        self.encode, self.limit, self.room = encode, limit, room
        self.one, self.two = _Sums(5), _Sums(9)
        self.bits = max(10, (2 * limit - 1).bit_length())
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.k1, self.k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.start, self.size = np.zeros(n, np.int32), np.zeros(n, np.uint16)
        self.pool, self.used, self.kept = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each piece, or where it would go, as -1 - slot."""
        mask = np.int64((1 << self.bits) - 1)
        out = (h1 >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h1))
        while len(todo):
            at = out[todo]
            k = self.k1[at]
            hit = (k == h1[todo]) & (self.k2[at] == h2[todo])
            empty = k == 0
            out[todo[empty]] = -1 - at[empty]
            todo = todo[~hit & ~empty]
            out[todo] = out[todo] + 1 & mask
        return out

    def _learn(self, h1: np.ndarray, h2: np.ndarray, ids: list) -> None:
        """Keep new, distinct pieces."""
        sizes = np.array([len(v) for v in ids], dtype=np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + total] = np.concatenate(ids) if total else 0
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.kept = self.used + total, self.kept + len(ids)
        todo = np.arange(len(h1))
        while len(todo):  # of two that want one slot one gets it, the other looks on
            at = -1 - self._find(h1[todo], h2[todo])
            self.k1[at], self.k2[at] = h1[todo], h2[todo]
            mine = (self.k1[at] == h1[todo]) & (self.k2[at] == h2[todo])
            won = np.flatnonzero(mine)
            self.start[at[won]], self.size[at[won]] = starts[todo[won]], sizes[todo[won]]
            todo = todo[~mine]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        flat, sizes = [], []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if held:
                for col, v in zip((flat, sizes), self._batch(held), strict=True):
                    col.append(v)
                held, size = [], 0

        for t in texts:
            raw = utf8(t)
            odd = bool(t) and _ODD.search(t) is not None
            if odd or len(raw) > HOLD:
                flush()
                own = self._odd(raw) if odd else self._long(raw)
                flat += own
                sizes.append(np.array([sum(map(len, own))]))
                continue
            if size + len(raw) > HOLD:
                flush()
            held.append(raw)
            size += len(raw)
        flush()
        return (np.concatenate(flat), np.concatenate(sizes)) if flat else (np.empty(0, np.uint32), np.concatenate(sizes) if sizes else np.empty(0, np.int64))

    def _odd(self, raw: bytes) -> list[np.ndarray]:
        """Ids of a text with white space beyond ASCII, in parts."""
        out, held, size = [], [], 0
        for m in _CUT.finditer(raw.decode()):
            piece = m[0].encode()
            if len(piece) > HOLD:
                out += [self._batch(held, cut=False)[0]] if held else []
                out.append(np.asarray(self.encode([m[0]])[0], dtype=np.uint32))
                held, size = [], 0
                continue
            held.append(piece)
            size += len(piece)
            if size > HOLD:
                out.append(self._batch(held, cut=False)[0])
                held, size = [], 0
        return out + ([self._batch(held, cut=False)[0]] if held else [])

    def _long(self, raw: bytes) -> list[np.ndarray]:
        """Ids of a long text, in parts that end where pieces do; a piece too long to hash goes to the encoder alone."""
        out, at = [], 0
        while at < len(raw):
            m = _END.search(raw, at + HOLD - 1)
            stop = m.start() + 1 if m else len(raw)
            if stop - at > 2 * HOLD:
                early = [x.start() + 1 for x in _END.finditer(raw, at, at + HOLD)]
                if early:
                    stop = early[-1]
                else:
                    out.append(np.asarray(self.encode([raw[at:stop].decode()])[0], dtype=np.uint32))
                    at = stop
                    continue
            out.append(self._batch([raw[at:stop]])[0])
            at = stop
        return out

    def _batch(self, raw: list[bytes], cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of byte strings; with ``cut`` they are cut into pieces, else they are pieces."""
        text = b"".join(raw)
        a = np.frombuffer(text, dtype=np.uint8)
        length = np.array([len(x) for x in raw], dtype=np.int64)
        begin = np.cumsum(length) - length
        if cut:
            space = _SPACE[a]
            first = np.zeros(len(a) + 1, bool)
            first[1:-1] = space[1:] & ~space[:-1]
            first[begin[length > 0]] = True
            start = np.flatnonzero(first[:-1])
        else:
            start = begin[length > 0]
        stop = np.append(start[1:], len(a))
        h1, h2 = self.one.of(a, start, stop), self.two.of(a, start, stop)
        if self.kept > self.limit or self.used > self.room:
            self._clear()
        slot = self._find(h1, h2)
        new = np.flatnonzero(slot < 0)
        extra: dict[int, np.ndarray] = {}
        if len(new):
            short = new[stop[new] - start[new] <= LONGEST]
            _, pick = np.unique(h1[short], return_index=True)
            pick = short[pick]
            for at in range(0, len(pick), PART):
                part = pick[at : at + PART]
                if self.kept + len(part) > self.limit * 1.9 or self.used > self.room:
                    break  # full: the rest are encoded below, and the next batch starts anew
                self._learn(h1[part], h2[part], self.encode([text[i:j].decode() for i, j in zip(start[part].tolist(), stop[part].tolist(), strict=True)]))
            slot[new] = self._find(h1[new], h2[new])
            rest = np.flatnonzero(slot < 0)
            for at in range(0, len(rest), 4096):
                part = rest[at : at + 4096]
                got = self.encode([text[i:j].decode() for i, j in zip(start[part].tolist(), stop[part].tolist(), strict=True)])
                extra.update(zip(part.tolist(), got, strict=True))
        known = np.maximum(slot, 0)
        n, src = self.size[known].astype(np.int64), self.start[known].astype(np.int64)
        pool = self.pool
        if extra:
            rows = np.array(list(extra), dtype=np.int64)
            size = np.array([len(v) for v in extra.values()], dtype=np.int64)
            n[rows], src[rows] = size, len(pool) + np.cumsum(size) - size
            pool = np.concatenate([pool, *(np.asarray(v, dtype=np.uint32) for v in extra.values())])
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) - np.repeat(ends - n - src, n)]
        own = np.zeros(len(raw), dtype=np.int64)
        np.add.at(own, np.searchsorted(begin, start, side="right") - 1, n) if len(start) < 64 else None
        if len(start) >= 64:
            own = np.bincount(np.searchsorted(begin, start, side="right") - 1, weights=n, minlength=len(raw)).astype(np.int64)
        return ids, own
