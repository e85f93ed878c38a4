"""Exact top-k inner products by best-first search of M-trees.

Vectors are dealt to groups by their nearest pivot and groups to parts of bounded
size; each part is one M-tree. A node is a page with a router vector, a covering
radius and its distance to the parent's router; leaf entries keep their distance to
their page's router. For a query q and a router c with distance at most r to all below,
no inner product below exceeds <q,c> + |q| r. With only the parent's product known it
is at most <q,p> + |q| (d(c,p) + r), so stored distances rule entries out before
anything is computed for them. The search opens the node with the highest bound first
and ends when that is below the k-th score.

A query first searches its home group, with that k-th score then the foreign group whose
pivot ball may hold the best, and with the score reached there all others that may still
hold more. Queries come to the trees in large blocks, so a tree is read once for each
block and group. Equal vectors share one entry with the k + 1 smallest ids:
more can't be among k results.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different lengths are never compared;
repeated rows count once, and no row with the query's own id is its candidate; scores
beyond 64 bits are held at the limits; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata.llm.common import arrow_batches, ship
from blockstrata.runtime import cut

K, PAGE, FANOUT = 10, 64, 32
#: Vectors in one tree, queries in one task's block, pivots at most, and vectors that pivots are chosen from.
PART, QUERIES, PIVOTS, SAMPLE = 16_384, 16_384, 1_024, 4_096
_SAFE = 1 << 20  # below this, products of 64-bit floats are exact for up to 4096 components


def quantise(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the integer vector, of every row that takes part."""
    x = F.col("embedding")
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(sound & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v")).distinct()


class MTree:
    """A bulk-loaded M-tree over distinct integer vectors."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], page: int = PAGE, fanout: int = FANOUT):
        self.exact = not vectors.size or int(np.abs(vectors).max()) < _SAFE and vectors.shape[1] <= 4096
        x = vectors.astype(np.float64)
        self.page, self.fanout = page, fanout
        self.router, self.radius, self.to_parent, self.span, self.leaf = [], [], [], [], []
        order: list[int] = []
        dist: list[float] = []
        rng = np.random.default_rng(5)
        centre = x.mean(axis=0) if len(x) else np.zeros(vectors.shape[1])
        todo = [(self._node(centre, 0.0), np.arange(len(x)))]
        while todo:
            at, rows = todo.pop(0)
            d = np.sqrt(((x[rows] - self.router[at]) ** 2).sum(axis=1))
            self.radius[at] = float(d.max()) if len(d) else 0.0
            if len(rows) <= page:
                self.leaf[at], self.span[at] = True, (len(order), len(order) + len(rows))
                order += rows.tolist()
                dist += d.tolist()
                continue
            f = min(fanout, -(-len(rows) // page))
            seeds = x[rng.choice(rows, f, replace=False)]
            near = ((seeds**2).sum(axis=1)[None, :] - 2 * x[rows] @ seeds.T).argmin(axis=1)
            if len(np.unique(near)) == 1:  # distances do not tell them apart
                near = np.arange(len(rows)) % f
            first = len(self.router)
            for k in np.unique(near):
                below = rows[near == k]
                c = x[below].mean(axis=0)
                child = self._node(c, float(np.sqrt(((c - self.router[at]) ** 2).sum())))
                todo.append((child, below))
            self.span[at] = (first, len(self.router))
        self.router = np.array(self.router).reshape(len(self.router), vectors.shape[1])
        self.radius, self.to_parent = np.array(self.radius), np.array(self.to_parent)
        self.vectors, self.ids, self.distance = vectors[order], [ids[k] for k in order], np.array(dist)
        self.floats = self.vectors.astype(np.float64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "floats"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.floats = self.vectors.astype(np.float64)

    def _node(self, router: np.ndarray, to_parent: float) -> int:
        self.router.append(router)
        self.radius.append(0.0)
        self.to_parent.append(to_parent)
        self.span.append((0, 0))
        self.leaf.append(False)
        return len(self.router) - 1

    def _scores(self, rows: np.ndarray, q: np.ndarray, qf: np.ndarray) -> list[int]:
        if self.exact and (not len(q) or int(np.abs(q).max()) < _SAFE):
            return (self.floats[rows] @ qf).astype(np.int64).tolist()
        own = q.tolist()
        return [min(max(sum(a * b for a, b in zip(v, own, strict=True)), -(2**63)), 2**63 - 1) for v in self.vectors[rows].tolist()]

    def search(self, q: np.ndarray, own: int, k: int = K, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of this tree at or above ``floor``, higher scores and smaller ids first."""
        qf = q.astype(np.float64)
        size = float(np.sqrt((qf**2).sum()))
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        product = float(self.router[0] @ qf)
        todo = [(-(product + size * self.radius[0]), 0, product)]

        def slack(v: float) -> float:
            return v + 1e-9 * abs(v) + 1e-6 * (1 + size)

        while todo:
            bound, at, product = heapq.heappop(todo)
            if floor is not None and slack(-bound) < floor:
                break
            lo, hi = self.span[at]
            if self.leaf[at]:
                rows = np.arange(lo, hi)
                if floor is not None:
                    may = product + size * self.distance[lo:hi]
                    rows = rows[may + 1e-9 * np.abs(may) + 1e-6 * (1 + size) >= floor]
                for row, s in zip(rows.tolist(), self._scores(rows, q, qf), strict=True):
                    if floor is None or s >= floor:
                        for i in self.ids[row]:
                            if i != own:
                                if len(best) < k:
                                    heapq.heappush(best, (s, -i))
                                elif (s, -i) > best[0]:
                                    heapq.heapreplace(best, (s, -i))
                        if len(best) == k:
                            floor = best[0][0] if floor is None else max(floor, best[0][0])
                continue
            kids = np.arange(lo, hi)
            if floor is not None:
                may = product + size * (self.to_parent[lo:hi] + self.radius[lo:hi])
                kids = kids[may + 1e-9 * np.abs(may) + 1e-6 * (1 + size) >= floor]
            got = self.router[kids] @ qf
            for c, p, b in zip(kids.tolist(), got.tolist(), (got + size * self.radius[kids]).tolist(), strict=True):
                if floor is None or slack(b) >= floor:
                    heapq.heappush(todo, (-b, c, p))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _pivots(vectors: DataFrame, parts: int) -> np.ndarray:
    """Pivots for the parts, spread over a bounded sample of vectors."""
    rows = vectors.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    dims = [len(r.v) for r in rows]
    if not rows:
        return np.zeros((1, 0))
    width = max(set(dims), key=dims.count)
    x = np.array([r.v for r in rows if len(r.v) == width], dtype=np.float64)
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(parts, PIVOTS, len(x)):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _group_of(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df with ``g``, the nearest pivot (vectors of another length have groups of their own), and ``away``."""

    def run(batches):
        for b in batches:
            vs = b.column("v").to_pylist()
            g, away = [], []
            same = [i for i, v in enumerate(vs) if len(v) == pivots.shape[1]]
            g = [-1 - len(v) for v in vs]
            away = [float("inf")] * len(vs)
            if same:
                x = np.array([vs[i] for i in same], dtype=np.float64)
                d = ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2) if len(pivots) <= 16 else (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)[None, :]
                near = d.argmin(axis=1)
                for i, k, w in zip(same, near.tolist(), np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)).tolist(), strict=True):
                    g[i], away[i] = k, w
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int64()), pa.array(away, pa.float64())], names=[*b.schema.names, "g", "away"])

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", g long, away double")


def build(vectors: DataFrame, k: int = K) -> tuple[DataFrame, np.ndarray]:
    """(g, part, tree) rows in the shared folder, and the pivots. ``vectors`` as quantise() gives them."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1)  # ranked before the shuffle already
    own = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    pivots = _pivots(own, -(-own.count() // PART))
    dealt = cut(_group_of(own, pivots))
    sizes = dealt.groupBy("g").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row for each pivot at most
    dealt = dealt.join(F.broadcast(sizes), "g").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))

    def plant(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("v").to_pylist(), table.column("ids").to_pylist(), strict=True))
        x = np.array([r[0] for r in rows], dtype=np.int64).reshape(len(rows), -1)
        tree = pickle.dumps(MTree(x, [r[1] for r in rows]))
        return pa.table({"g": table.column("g")[:1], "part": table.column("part")[:1], "away": pa.array([max(table.column("away").to_pylist())], pa.float64()), "tree": pa.array([tree], pa.binary())})

    return cut(dealt.groupBy("g", "part").applyInArrow(plant, "g long, part int, away double, tree binary")), pivots


def _ask(queries: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """query_id, qh, vec_id, score of each query in each part of its group g, in blocks of queries."""
    n = queries.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    left = queries.join(n, "g").withColumn("block", F.pmod(F.xxhash64("query_id", "qh"), F.col("blocks")).cast("int"))
    left = left.join(trees.select("g", "part"), "g")
    right = trees.join(n, "g").select("g", "part", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = right.toDF("tg", "tpart", "tree", "tblock")

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        cols: dict = {"query_id": [], "qh": [], "vec_id": [], "score": []}
        if q.num_rows and t.num_rows:
            tree = pickle.loads(t.column("tree")[0].as_py())
            v, n = q.column("v").combine_chunks(), 0
            flat = v.flatten().to_numpy()
            for i, h, floor, size in zip(*(q.column(c).to_pylist() for c in ("query_id", "qh", "floor")), pc.list_value_length(v).to_pylist(), strict=True):
                for s, x in tree.search(flat[n : n + size].astype(np.int64), i, k, floor):
                    for name, val in zip(cols, (i, h, x, s), strict=True):
                        cols[name].append(val)
                n += size
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()})

    return left.groupBy("g", "part", "block").cogroup(right.groupBy("tg", "tpart", "tblock")).applyInArrow(run, "query_id long, qh long, vec_id long, score long")


def top_k(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    ship(spark)
    arrow_batches(spark)
    vectors = cut(quantise(embeddings))
    trees, pivots = build(vectors, k)
    queries = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qh"), "v")
    queries = cut(_group_of(queries, pivots).drop("away"))
    at_home = cut(_ask(queries.withColumn("floor", F.lit(None).cast("long")), trees, k))
    balls = {r.g: r.away for r in trees.groupBy("g").agg(F.max("away").alias("away")).collect() if r.g >= 0}  # PIVOTS at most

    def elsewhere(first: bool):
        """Queries with the foreign groups that may hold more than their floor: the best one, or all but that one."""

        def run(batches):
            radius = np.array([balls.get(j, -1.0) for j in range(len(pivots))])
            for b in batches:
                out: dict = {n: [] for n in ("query_id", "qh", "v", "g", "floor")}
                for i, h, v, g, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if g < 0:
                        continue
                    q = np.array(v, dtype=np.float64)
                    size = np.sqrt((q**2).sum())
                    may = np.where(radius >= 0, pivots @ q + size * radius, -np.inf)
                    may[g] = -np.inf
                    best = int(may.argmax())
                    ok = (may > -np.inf) & ((may + 1e-9 * np.abs(may) + 1e-6 * (1 + size) >= floor) if floor is not None else True)
                    for j in np.flatnonzero(ok).tolist():
                        if (j == best) == first:
                            for n, x in zip(out, (i, h, v, j, floor), strict=True):
                                out[n].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if n == "v" else pa.int64()) for n, x in out.items()], names=list(out))

        return run

    found = at_home
    for first in (True, False):
        floors = found.groupBy("query_id", "qh").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
        floors = floors.select("query_id", "qh", F.when(F.size("s") >= k, F.element_at("s", k)).alias("floor"))
        abroad = queries.join(floors, ["query_id", "qh"], "left").select("query_id", "qh", "v", "g", "floor").mapInArrow(elsewhere(first), "query_id long, qh long, v array<long>, g long, floor long")
        found = cut(found.union(_ask(abroad, trees, k)).distinct())
    w = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
