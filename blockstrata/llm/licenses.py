r"""License notices found by Patience alignment of texts with templates.

A stretch of a text is aligned with a template by anchoring on the words that occur
once in each, keeping the longest increasing subsequence of those anchors, and aligning
the gaps between them in the same way; equal words at both ends of a gap match first,
and a gap without such words is aligned by a longest common subsequence. The coverage is
the share of the template's words that were matched.

A notice is a stretch of at most twice the template's words that reaches the coverage,
whatever foreign words it holds; or of at most INTERRUPTION + 1 times as many, if no more
than INTERRUPTION words in a row are strange to the template. Stretches too poor in the
template's words, or whose longest common subsequence with it is too short, are not
aligned; both tests are exact. The first stretch that reaches the coverage is narrowed
or extended as long as that gains a matched word for less than two foreign ones, and the
search goes on behind it. Words are those of the decontamination operator (ASCII letters
in lower case, digits, everything beyond ASCII).

Defined results: null and empty texts have no notices; whole texts are scanned however
long; a notice that occurs twice is reported twice, side by side too; repeated rows give
repeated results; tables may be empty; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame

from blockstrata.llm.common import common_pairs, id_text, map_rows
from blockstrata.llm.contamination import words
from blockstrata.llm.license_texts import NOTICES, TEXTS

#: Share of a template that must be matched.
COVERAGE = 0.8
#: Foreign words in a row that a wide stretch may hold.
INTERRUPTION = 6
TEMPLATES = NOTICES | TEXTS


def rising(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops: list[int] = []
    heads: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = heads[k - 1] if k else -1
        tops[k : k + 1], heads[k : k + 1] = [v], [i]
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        at = {b[q]: q for q in range(k, m) if cb[b[q]] == 1}
        once = [(p, at[a[p]]) for p in range(i, j) if ca[a[p]] == 1 and a[p] in at]
        anchors = [once[x] for x in rising([q for _, q in once])]
        if not anchors:
            out += [(i + p, k + q) for p, q in common_pairs(a[i:j], b[k:m])]
            continue
        out += anchors
        p0, q0 = i, k
        for p, q in [*anchors, (j, m)]:
            if p > p0 and q > q0:
                todo.append((p0, p, q0, q))
            p0, q0 = p + 1, q + 1
    return sorted(out)


class Template:
    """One template's words, and the growth of common subsequences with it."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.count = Counter(self.words)
        self.full = (1 << len(self.words)) - 1
        self.where, self.back = ({}, {})
        for j, x in enumerate(self.words):
            self.where[x] = self.where.get(x, 0) | 1 << j
            self.back[x] = self.back.get(x, 0) | 1 << len(self.words) - 1 - j

    def growth(self, w: list[str], backwards: bool = False) -> list[int]:
        """Length of the longest common subsequence of the template with each beginning of ``w`` (from its end, with each end)."""
        where, row, full, out = self.back if backwards else self.where, self.full, self.full, []
        n = len(self.words)
        for x in reversed(w) if backwards else w:
            hit = row & where.get(x, 0)
            if hit:
                row = (row + hit | row - hit) & full
            out.append(n - row.bit_count())
        return out


class Finder:
    """Finds notices in texts."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, interruption: int = INTERRUPTION):
        self.templates = [t for t in (Template(n, x) for n, x in templates.items()) if t.words]
        self.coverage, self.interruption = coverage, interruption

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, stop, template, coverage) in words, by start and name."""
        if not text:
            return []
        w = words(text)
        have = set(w)
        found: list[tuple[int, int, str, float]] = []
        for t in self.templates:
            need = self.coverage * len(t.words)
            if sum(t.count[x] for x in t.count.keys() & have) >= need:
                found += self._in(w, t, need)
        return sorted(found)

    def _in(self, w: list[str], t: Template, need: float) -> list[tuple[int, int, str, float]]:
        own = [i for i, x in enumerate(w) if x in t.count]
        out = self._scan(w, own, t, need, 2 * len(t.words))
        size = 4
        while size < 2 * (self.interruption + 1):
            taken = [(0, 0), *[(s, e) for s, e, *_ in sorted(out)], (len(w), len(w))]
            for (_, lo), (hi, _) in zip(taken, taken[1:], strict=False):
                first = bisect_left(own, lo)
                inside = own[first : bisect_left(own, hi)]
                cut = [0, *[k for k in range(1, len(inside)) if inside[k] - inside[k - 1] > self.interruption + 1], len(inside)]
                for a, b in zip(cut, cut[1:], strict=False):
                    out += self._scan(w, inside[a:b], t, need, min(size, self.interruption + 1) * len(t.words))
            size *= 2
        return out

    def _scan(self, w: list[str], own: list[int], t: Template, need: float, width: int) -> list[tuple[int, int, str, float]]:
        """Notices of at most ``width`` words among the places ``own`` of the template's words, from left to right."""
        least = -(-need // 1)
        out, k, least = [], 0, int(least)
        while k + least <= len(own):
            s = own[k]
            if own[k + least - 1] - s >= width:
                k += 1
                continue
            last = bisect_left(own, s + width)
            v = t.growth([w[i] for i in own[k:last]])[-1]
            if v < least:  # so many more of the template's words must come in at the end
                far = last + least - v - 1
                if far >= len(own):
                    break
                k = max(k + 1, bisect_left(own, own[far] - width + 1))
                continue
            start, stop, got = self._narrow(w, own, t, k, least, width)
            begin = bisect_left(own, start)
            if begin > k:
                out += self._scan(w, own[k:begin], t, need, width)
            out.append((start, stop, t.name, got / len(t.words)))
            k = bisect_left(own, stop)
        return out

    def _narrow(self, w: list[str], own: list[int], t: Template, k: int, least: int, width: int) -> tuple[int, int, int]:
        """The best stretch that begins at place ``k`` or behind, and the words that its alignment matches."""

        def best(places: list[int], grown: list[int]) -> int:
            """The place at which a stretch from the other end has most matches, less half of its foreign words."""
            value = lambda i: 1.5 * grown[i] - 0.5 * abs(places[i] - places[0])
            return max((i for i, v in enumerate(grown) if v >= least), key=lambda i: (value(i), -i))

        for _ in range(16):
            last = bisect_left(own, own[k] + width)
            places = own[k:last]
            end = k + best(places, t.growth([w[i] for i in places]))
            places = own[k : end + 1][::-1]
            begin = end - best(places, t.growth([w[i] for i in reversed(places)], backwards=True))
            if begin == k:
                break
            k = begin
        start, stop = own[k], own[end] + 1
        got = len(patience(w[start:stop], t.words))
        if got < least:  # anchors that mislead: the common subsequence alone reaches the coverage
            got = t.growth(w[start:stop])[-1]
        return start, stop, got


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_notices, licenses (names in order, comma-joined), spans (name:start:stop:per cent of coverage)."""
    given = dict(templates if templates is not None else TEMPLATES)

    def make():
        finder = Finder(given, coverage)

        def run(ids, texts):
            got = [finder.find(t) for t in texts]
            return {
                "doc_id": ids, "n_notices": [len(g) for g in got], "licenses": [",".join(sorted({n for _, _, n, _ in g})) for g in got],
                "spans": [",".join(f"{n}:{s}:{e}:{int(100 * c)}" for s, e, n, c in g) for g in got],
            }

        return run

    return map_rows(id_text(docs), ["doc_id", "text"], "doc_id long, n_notices long, licenses string, spans string", make)
