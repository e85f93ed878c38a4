r"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Texts are normalised to their words (A-Z lower-cased; digits, a-z and everything
beyond ASCII make words) between single spaces. Every run of 8 item words is one
pattern of the automaton, with a space on either side; an item of fewer words is one
pattern. A text is normalised and scanned once, whole. Hits are word positions, which
map to character offsets of the original text.

Defined results: null has no words; items without words have no pattern; repeated
documents give repeated rows, repeated item ids count once, null item ids never;
tables may be empty; extra columns are ignored.

The items are the small side, but their size is checked: an automaton takes some 300
times its text, so it is split into shards of about ``max_bytes`` of item text, which
reach the driver one by one. With more than one shard the texts are scanned once for
each; what a shard finds, by a key of the text, is put together at the end, and the
documents themselves are neither written nor moved for it unless very many have hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.common import BROADCAST_IDS, arrow_batches, id_text, ship, utf8
from blockstrata.runtime import cut

WINDOW = 8
#: Item text in one automaton, some 150 MB of it; more items make more shards.
MAX_BYTES = 500_000
_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD_BYTES else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    """The normalised words of a text."""
    return [w for w in utf8(text).translate(_NORMAL).decode().split(" ") if w]


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The patterns of one item."""
    w = words(text)
    return {f" {' '.join(w[k : k + size])} " for k in range(max(1, len(w) - size + 1))} if w else set()


class Scanner:
    """The automaton, and the scan of one text."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW):
        import ahocorasick

        owners: dict[str, set[int]] = {}
        for item, text in items:
            for p in windows(text, size):
                owners.setdefault(p, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for p, ids in owners.items():
            self.automaton.add_word(p, (len(p), p.count(" ") - 1, tuple(sorted(ids))))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, hit word intervals [from, to) merged and in order, and the items."""
        w = words(text)
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.empty or not w:
            return len(w), hits, items
        norm = f" {' '.join(w)} "
        seen, at = 0, 0  # spaces before position at
        for end, (length, n, ids) in self.automaton.iter(norm):
            start = end - length + 1
            if start < at:
                seen, at = seen - norm.count(" ", start, at), start
            else:
                seen, at = seen + norm.count(" ", at, start), start
            items.update(ids)
            hits.append((seen, seen + n))
        return len(w), merge(hits), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of intervals of words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in spans]


def shard_count(items: DataFrame, max_bytes: int = MAX_BYTES) -> int:
    """Shards of the items; hashing deals unevenly, so with several each is planned at half its size."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 if total <= max_bytes else 2 * -(-total // max_bytes)


def own_items(benchmark: DataFrame) -> DataFrame:
    """item_id and text of the items that have both."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")


def shard(items: DataFrame, k: int, n: int) -> list[tuple[int, str | None]]:
    """The items of one shard."""
    return [tuple(r) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


#: Columns that a scan adds; their names keep clear of those of any input.
N_WORDS, HITS, CHARS, ITEMS = "_scan_n_words", "_scan_hits", "_scan_chars", "_scan_items"
_KEYS = ["_scan_key_1", "_scan_key_2"]


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with the columns N_WORDS, HITS (word intervals as a flat array), CHARS (their characters in the text) and ITEMS."""
    spark = docs.sparkSession
    ship(spark)
    arrow_batches(spark)
    items = own_items(benchmark)
    n = shard_count(items, max_bytes)
    df = docs.withColumns({N_WORDS: F.lit(0).cast("long")} | {c: F.array().cast("array<long>") for c in (HITS, CHARS, ITEMS)})
    if n == 1:
        return _scan(df, shard(items, 0, 1), size)
    key = {k: F.xxhash64(F.lit(k), "text") for k in _KEYS}
    texts, found = df.select("text", N_WORDS, HITS, CHARS, ITEMS), None
    for k in range(n):
        part = cut(_scan(texts, shard(items, k, n), size).filter(F.size(ITEMS) > 0).select(*[c.alias(k) for k, c in key.items()], HITS, ITEMS).distinct())
        found = part if found is None else found.unionByName(part)
    both = cut(found.groupBy(*_KEYS).agg(F.flatten(F.collect_set(HITS)).alias(HITS), F.array_distinct(F.flatten(F.collect_set(ITEMS))).alias(ITEMS)))
    small = both.count() <= BROADCAST_IDS // 10  # lists of hits are longer than ids
    rows = df.drop(HITS, ITEMS).withColumns(key).join(F.broadcast(both) if small else both, _KEYS, "left").drop(*_KEYS)
    return _scan(rows.select(*docs.columns, N_WORDS, *[F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in (HITS, CHARS, ITEMS)]), [], size)


def _scan(df: DataFrame, items: list, size: int) -> DataFrame:
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(items)  # one shard, bounded by max_bytes
    text, nw, hs, cs, its = (names.index(c) for c in ("text", N_WORDS, HITS, CHARS, ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, size)
        for b in batches:
            cols = list(b.columns)
            n_words, hits, chars, found = [], [], [], []
            for t, h, i in zip(cols[text].to_pylist(), cols[hs].to_pylist(), cols[its].to_pylist(), strict=True):
                n, spans, ids = scanner.scan(t)
                spans = merge([*zip(h[::2], h[1::2], strict=True), *spans]) if h else spans
                n_words.append(n)
                hits.append([x for s in spans for x in s])
                chars.append([x for s in offsets(t, spans) for x in s] if spans else [])
                found.append(sorted(ids.union(i)))
            cols[nw] = pa.array(n_words, pa.int64())
            cols[hs], cols[cs], cols[its] = (pa.array(x, pa.list_(pa.int64())) for x in (hits, chars, found))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit intervals of each document in words and in characters of its text."""
    df = scan_documents(id_text(docs), benchmark, max_bytes=max_bytes)
    pairs = F.sequence(F.lit(0), (F.size(HITS) / 2 - 1).cast("int"))
    n_hit = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, k: a + F.element_at(HITS, 2 * k + 2) - F.element_at(HITS, 2 * k + 1))
    return df.select(
        "doc_id", F.col(N_WORDS).alias("n_words"), F.when(F.size(HITS) > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.col(ITEMS).cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        (F.size(ITEMS) >= min_items).alias("contaminated"), F.concat_ws(",", F.col(HITS).cast("array<string>")).alias("hit_words"), F.concat_ws(",", F.col(CHARS).cast("array<string>")).alias("hit_chars"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The rows of ``docs`` with fewer than ``min_items`` items in them, with all their columns."""
    return scan_documents(docs, benchmark).filter(F.size(ITEMS) < min_items).select(*docs.columns)


def digest(items: set[int]) -> str:
    """The digest of a set of item ids, as contamination() gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
