r"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``CHUNKS * CHUNK`` positions of 16 bits. Two signatures that differ in
at most ``2 * CHUNKS - 1`` positions agree, by the pigeonhole principle, in all but at
most one position of some chunk. So every chunk gives one key for each position that
may be wrong, made of the chunk's other positions: any pair within that distance
meets under a key. Sets of shingles with a Jaccard similarity of 0.8 differ in 10 of 50
positions on average; counting chunks, 1.6 in a million such pairs meet under no key.

Sets that are equal count once. Under each key the members are compared with one hub,
the member with most copies, so a bucket costs as many comparisons as it has members.
Links are confirmed on the full sets, components are found by alternating stars.
Where members of a bucket are still in different components, what lies between the
components is compared by the full sets too, so no link between members of a bucket
is lost.

Defined results: text without words, empty or null, has no shingles and stands alone;
rows that repeat a document id count as one document with the links of all of them;
rows with a null id stand alone and have a null component; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.common import WordHashes, arrow_batches, id_text, only_ids, ship
from blockstrata.runtime import cut, release

SHINGLE = 4
CHUNKS, CHUNK = 10, 5
#: Link from this share of the union, in per cent.
PERCENT = 80
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A-Z in lower case, white space as spaces, all other bytes as they are.
_PLAIN = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Shingler:
    """Hashes the word shingles of texts."""

    def __init__(self, size: int):
        self.size, self.words = size, WordHashes(_PLAIN)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct 64-bit shingle hashes of each text, in ascending order."""
        words = self.words.of(texts)
        n = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        every = self._rolled(flat, self.size)
        out, at = [], 0
        for w, m in zip(words, n.tolist(), strict=True):
            own = every[at : at + m - self.size + 1] if m >= self.size else self._rolled(w, m)[:m and 1]
            out.append(np.unique(own))
            at += m
        return out

    @staticmethod
    def _rolled(words: np.ndarray, width: int) -> np.ndarray:
        """The hash of the ``width`` words from each place on."""
        m = max(0, len(words) - width + 1)
        x = np.full(m, width, dtype=np.uint64)
        for k in range(width):
            x = _mix((x + _M3) ^ words[k : k + m])
        return x


def signatures(sets: list[np.ndarray], k: int = CHUNKS * CHUNK, seed: int = 11) -> np.ndarray:
    """A row of k 16-bit minima for each non-empty set; rows of empty sets are 0."""
    out = np.zeros((len(sets), k), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    rng = np.random.default_rng(seed)
    salt, odd = rng.integers(0, 2**63, k, dtype=np.uint64), rng.integers(0, 2**63, k, dtype=np.uint64) | np.uint64(1)
    for j in range(k):
        y = (x ^ salt[j]) * odd[j]
        y ^= y >> np.uint64(32)
        out[full, j] = _mix(np.minimum.reduceat(y * _M1, starts)) & np.uint64(0xFFFF)
    return out


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, chunk: int = CHUNK) -> np.ndarray:
    """The keys of each signature: for each chunk and each position that may be wrong, the other positions."""
    out = np.empty((len(sig), chunks * chunk), dtype=np.uint64)
    for c in range(chunks):
        for wrong in range(chunk):
            key = np.full(len(sig), c * chunk + wrong + 1, dtype=np.uint64)
            for p in range(chunk):
                if p != wrong:
                    key = _mix((key + _M3) ^ sig[:, c * chunk + p])
            out[:, c * chunk + wrong] = key
    return out


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow over small batches of doc_id and text."""
    ship(df.sparkSession)
    arrow_batches(df.sparkSession)

    def run(batches):
        fn = make()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                if part.num_rows:
                    yield fn(part.column(0), part.column(1).to_pylist())

    return df.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the set's two sums, and its keys (none without shingles)."""

    def make():
        shingler = Shingler(shingle)

        def run(ids, texts):
            sets = shingler.sets(texts)
            keys = chunk_keys(signatures(sets)).view(np.int64)
            a = [int(np.sum(_mix(s ^ _M2), dtype=np.uint64).view(np.int64)) for s in sets]
            b = [int(np.sum(_mix(s + _M1), dtype=np.uint64).view(np.int64)) for s in sets]
            n = [len(s) for s in sets]
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([k if m else [] for k, m in zip(keys, n, strict=True)], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "keys"])

        return run

    return _map(docs, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>", make)


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the whole set of shingle hashes, for documents that have any."""

    def make():
        shingler = Shingler(shingle)

        def run(ids, texts):
            sets = [s.view(np.int64) for s in shingler.sets(texts)]
            return pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.list_(pa.int64()))], names=["id", "grams"])

        return run

    return _map(docs, "id long, grams array<long>", make).filter(F.size("grams") > 0)


def linked(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether two sets share enough of their union."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def candidate_sets(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The full sets of every document in pairs (a, b), kept in the shared folder."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return cut(full_sets(only_ids(docs, ids), shingle))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    one = pairs.join(sets.withColumnsRenamed({"id": "a", "grams": "ga"}), "a")
    two = one.join(sets.withColumnsRenamed({"id": "b", "grams": "gb"}), "b")
    return two.filter(linked(F.col("ga"), F.col("gb"), percent)).select("a", "b").distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """id and the smallest id reachable, for every id in edges (a, b), by alternating large and small stars.

    Minima are aggregated before rows meet them, so a hub's many neighbours never
    gather in one task but by a join that can be split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, last = cut(e), None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, cut(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        release(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    texts = id_text(docs)
    prints = cut(fingerprints(texts, shingle))
    same = ["n_shingles", "set_a", "set_b"]
    able = prints.filter("n_shingles > 0 and doc_id is not null")
    reps = able.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"))
    reps = cut(reps)
    keys = reps.select("rep", "copies", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.max(F.struct("copies", (-F.col("rep")).alias("minus"))).alias("top"), F.count("*").alias("n")).filter("n > 1")
    members = cut(keys.join(hubs.select("key", (-F.col("top.minus")).alias("hub")), "key").select("key", "rep", "hub"))

    tried = cut(members.filter("rep <> hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())
    sets = candidate_sets(tried, texts, shingle)
    again = able.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).filter("x <> y").select("doc_id")
    repeated = able.join(again, "doc_id", "left_semi").join(reps.select(*same, "rep"), same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = cut(confirm(tried, sets, percent).union(repeated))
    roots = components(links)

    more = cut(between(members, roots, sets, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    for done in (members, tried, sets, more):
        release(done)

    to_rep = prints.join(reps.select(*same, "rep"), same, "left")
    out = to_rep.join(roots, F.col("rep") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: Documents and shingles on one side of a comparison of groups, about.
BLOCK, BLOCK_GRAMS = 8192, 3 << 20


def between(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that still meet in a bucket, one at least for any two that have any.

    Buckets in which the same component has most members are put together, so a crowd of
    near copies is compared once and not under each of its keys. What lies outside of that
    component is compared with all members by the full sets, in blocks of bounded size.
    """
    ship(members.sparkSession)
    known = members.join(roots, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    parts = known.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", (-F.col("root")).alias("minus"))).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    groups = cut(known.join(main.select("key", (-F.col("top.minus")).alias("main")), "key").groupBy("main", "rep").agg(F.first("root").alias("root")))
    sized = groups.join(sets.select(F.col("id").alias("rep"), F.size("grams").alias("grams")), "rep")
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("grams")).otherwise(0)) / BLOCK_GRAMS)).cast("int")
    sizes = sized.groupBy("main").agg(blocks(F.col("root") != F.col("main")).alias("outer"), blocks(F.lit(True)).alias("all"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = groups.join(sizes, "main")
    left = dealt.filter("root <> main").withColumn("i", own("outer")).select("main", "rep", "root", "i", every("all").alias("j"), F.lit(True).alias("outside"))
    right = dealt.withColumn("j", own("all")).select("main", "rep", "root", every("outer").alias("i"), "j", F.lit(False).alias("outside"))
    rows = left.unionByName(right).join(sets.withColumnRenamed("id", "rep"), "rep")

    def links(table: pa.Table) -> pa.Table:
        one = np.array(table.column("outside").to_pylist(), dtype=bool)
        grams = table.column("grams").combine_chunks()
        if isinstance(grams, pa.ChunkedArray):
            grams = pa.concat_arrays(grams.chunks)
        ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        side = [[(flat[ends[k] : ends[k + 1]]) for k in np.flatnonzero(x)] for x in (one, ~one)]
        found: dict = {}
        for at in range(0, len(side[0]), 256):
            n = [np.array([len(s) for s in x], dtype=np.int64) for x in (side[0][at : at + 256], side[1])]
            both = shared_counts(side[0][at : at + 256], side[1])
            ids = [(rep[one][at : at + 256], root[one][at : at + 256]), (rep[~one], root[~one])]
            ok = (100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)) & (ids[0][1][:, None] != ids[1][1][None, :])
            for p, q in zip(*np.nonzero(ok), strict=True):
                found.setdefault((ids[0][1][p], ids[1][1][q]), (ids[0][0][p], ids[1][0][q]))
        return pa.table({c: pa.array([v[k] for v in found.values()], pa.int64()) for k, c in enumerate("ab")})

    return rows.groupBy("main", "i", "j").applyInArrow(links, "a long, b long").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``.

    Elements that many sets hold are counted by a product of 0/1 matrices, the others by their pairs of holders.
    """
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)]
    common = np.intersect1d(*flat)
    if not len(common):
        return out
    col, row = [], []
    for sets, v in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        use = common[at] == v
        col.append(at[use])
        row.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[use])
    held = [np.bincount(c, minlength=len(common)) for c in col]
    work = held[0] * held[1]
    thick = work > max(out.size >> 5, 64)
    place = np.cumsum(thick) - 1
    for lo in range(0, int(thick.sum()), 1024):
        grid = []
        for sets, c, r in zip((left, right), col, row, strict=True):
            use = thick[c] & (place[c] >= lo) & (place[c] < lo + 1024)
            g = np.zeros((len(sets), 1024), dtype=np.float32)
            g[r[use], place[c[use]] - lo] = 1
            grid.append(g)
        out += (grid[0] @ grid[1].T).astype(np.int64)
    order = np.argsort(col[1], kind="stable")
    start = np.searchsorted(col[1][order], np.arange(len(common)))
    thin = np.flatnonzero(~thick[col[0]])
    n = held[1][col[0][thin]]
    steps = np.cumsum(n)
    at = 0
    while at < len(thin):
        stop = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + most, side="right")))
        k, m = thin[at:stop], n[at:stop]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        pair = np.repeat(row[0][k], m) * len(right) + row[1][order[np.repeat(start[col[0][k]], m) + nth]]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
        at = stop
    return out
