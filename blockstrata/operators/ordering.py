"""Order-dependent operators: merges, recency, expiry, interleaving, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata import config as C


def ranges(rows: DataFrame, by: str, buckets: int = 64):
    """A number that ascends with the column ``by`` and has about as many rows for each of its values."""
    edges = rows.select(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 1000).alias("e")).first()[0] or []  # at most one number a bucket
    edges = sorted(set(edges))

    def between(lo: int, hi: int):
        """The number of edges below the value, which lies from ``lo`` to ``hi``, found by halves."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) > edges[mid], between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(edges))


def ranks(rows: DataFrame, key: str, order: list[str], name: str, buckets: int = 64, bucket=None) -> DataFrame:
    """Rows numbered from 0 within each key in the order of ``order``, whose first column is a number.

    A key's rows are ranked in ranges of that column and numbered on from the counts of
    the ranges before, so a key with a third of all rows is spread over ``buckets`` tasks.
    The ranges come from a sketch of the column, or are given as ``bucket``, an expression
    that ascends with the order.
    """
    own = rows.withColumn("_bucket", ranges(rows, order[0], buckets) if bucket is None else bucket)
    sizes = own.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    return own.withColumn("_nth", nth).join(before, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_nth")).drop("_bucket", "_before", "_nth")


def running_count(rows: DataFrame, key: str, seq: str, flag, name: str, buckets: int = 64, bucket=None) -> DataFrame:
    """Rows with the number of flagged rows before each in its key, by the number ``seq``; counted by ranges, as ``ranks``."""
    own = rows.withColumns({"_bucket": ranges(rows, seq, buckets) if bucket is None else bucket, "_flag": F.when(flag, 1).otherwise(0).cast("long")})
    sums = own.groupBy(key, "_bucket").agg(F.sum("_flag").alias("_n"))
    before = sums.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy(key, "_bucket").orderBy(seq)
    return own.withColumn("_own", F.sum("_flag").over(w) - F.col("_flag")).join(before, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_flag", "_own", "_before")


def merge_adjacent(requests: DataFrame, place: str, *same: str, stretch: int = 1 << 16) -> DataFrame:
    """Runs of consecutive places among requests with equal ``same``: first, last and length.

    Runs are found in stretches of the address space. Only those that touch an end of
    their stretch, two in each at most, are then joined with one another, first within
    stretches of stretches, and what touches the ends of those at last.
    """
    own = requests.select(*same, F.col(place).alias("p")).distinct().withColumn("stretch", F.floor(F.col("p") / stretch).cast("long"))
    w = Window.partitionBy(*same, "stretch").orderBy("p")
    runs = own.withColumn("island", F.col("p") - F.row_number().over(w)).groupBy(*same, "stretch", "island").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    at_end = (F.col("first") % stretch == 0) | ((F.col("last") + 1) % stretch == 0)
    wide = stretch * stretch
    near = _joined(runs.filter(at_end).withColumn("wide", F.floor(F.col("first") / wide).cast("long")), [*same, "wide"])
    at_end_of_wide = (F.col("first") % wide == 0) | (F.floor((F.col("last") + 1) / wide) > F.col("wide"))
    far = _joined(near.filter(at_end_of_wide).withColumn("all", F.lit(0)), [*same, "all"])
    out = runs.filter(~at_end).select(*same, "first", "last")
    for more in (near.filter(~at_end_of_wide), far):
        out = out.unionByName(more.select(*same, "first", "last"))
    return out.withColumn("length", F.col("last") - F.col("first") + 1)


def _joined(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each group that follow one another without a gap, put together."""
    w = Window.partitionBy(*keys).orderBy("first")
    starts = F.when(F.col("first") != F.coalesce(F.lag("last").over(w) + 1, F.col("first") - 1), 1).otherwise(0)
    return runs.withColumn("s", starts).withColumn("run", F.sum("s").over(w)).groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def interleave(records: DataFrame, zone: str, arrival: str, zones: int) -> DataFrame:
    """Round-robin place of each record over its zones."""
    return ranks(records, zone, [arrival], "_n").withColumn("place", F.col("_n") * zones + F.col(zone)).drop("_n")


def lru_rank(accesses: DataFrame, key: str, seq: str) -> DataFrame:
    """Keys by last use, the most recent first."""
    return accesses.groupBy(key).agg(F.max(seq).alias("last_used"), F.count("*").alias("uses"))


def least_recent(accesses: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The ``n`` keys that would be evicted first."""
    return lru_rank(accesses, key, seq).orderBy("last_used", key).limit(n)


def expired_pages(dirtied: DataFrame, page: str, seq: str, current: int, age: int) -> DataFrame:
    """Pages whose earliest dirtying is ``age`` periods old or more."""
    return dirtied.groupBy(page).agg(F.min(seq).alias("first_dirty")).filter(F.lit(current) - F.col("first_dirty") >= age)


def byte_histogram(keys: DataFrame, name: str, at: int) -> DataFrame:
    """Count of keys by one byte of their hexadecimal name."""
    return keys.groupBy(F.substring(name, 2 * at + 1, 2).alias("byte")).agg(F.count("*").alias("n"))


def record_page(records: DataFrame, per_page: int) -> DataFrame:
    """Records of each chapter in page order: sorted by hexadecimal name, so many to a page."""
    n = F.col("_n")
    own = ranks(records, "chapter", ["name"], "_n", bucket=F.conv(F.substring("name", 1, 2), 16, 10).cast("int"))
    return own.withColumns({"page": F.call_function("div", n, F.lit(per_page)), "slot": n % per_page}).drop("_n")


def dequeue(queue: DataFrame, group: str, priority: str, seq: str) -> DataFrame:
    """The next element of each queue: highest priority, then first come."""
    return queue.groupBy(group).agg(F.min_by(F.struct(priority, seq), F.struct(-F.col(priority), F.col(seq))).alias("next")).select(group, f"next.{priority}", f"next.{seq}")


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of an order, without sorting the rest."""
    return rows.orderBy(*order).limit(k)


def combine_zones(summaries: DataFrame, zones: int) -> DataFrame:
    """The entry of each slab from the zone that owns it."""
    return summaries.filter(F.col("slab") % zones == F.col("zone"))


def transfer(waiters: DataFrame, more: DataFrame, matching=None) -> tuple[DataFrame, DataFrame]:
    """Queue ``more`` behind ``waiters``; with a predicate, the matching ones and the rest apart."""
    both = waiters.unionByName(more)
    return (both, both.limit(0)) if matching is None else (both.filter(matching), both.filter(~matching))


def flush_generation(requests: DataFrame, group: str, seq: str, is_flush) -> DataFrame:
    """Generation of each request: flushes before it in its group."""
    return running_count(requests, group, seq, is_flush, "generation")


def oldest_active(generations: DataFrame) -> DataFrame:
    """The generation below which flushes are complete: the least active one over zones."""
    return generations.filter("active").agg(F.min("generation").alias("oldest"))


def admission(requests: DataFrame, seq: str, is_discard, limit: int = C.MAX_REQUESTS, discards: int = C.MAX_DISCARDS, batch: int = C.RELEASE_BATCH) -> DataFrame:
    """Release batch that lets each request in, 0 for those let in at once: first come first served, for discards by their own limit too."""
    wave = lambda n, most: F.greatest(F.lit(0).cast("long"), F.ceil((F.col(n) + 1 - most) / batch))
    own = ranks(requests.withColumns({"_all": F.lit(0), "_discard": is_discard}), "_all", [seq], "_n")
    own = ranks(own, "_discard", [seq], "_d")
    late = F.when(F.col("_discard"), F.greatest(wave("_n", limit), wave("_d", discards))).otherwise(wave("_n", limit))
    return own.withColumn("batch", late.cast("long")).drop("_all", "_discard", "_n", "_d")


def late_answers(requests: DataFrame, group: str, ts: str, seconds: int) -> DataFrame:
    """Requests whose predecessor in the group lies more than ``seconds`` back (strictly)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(group).orderBy(ts))
    return requests.withColumn("gap", gap).filter(F.col("gap") > seconds * 1_000_000)


def delta_gaps(keys: DataFrame, group: str, value: str) -> DataFrame:
    """Gap of each value to the one before it in its list; the first counts from 0."""
    own = keys.withColumn("_bucket", ranges(keys, value))
    tops = own.groupBy(group, "_bucket").agg(F.max(value).alias("_top"))
    before = tops.select(group, "_bucket", F.lag("_top").over(Window.partitionBy(group).orderBy("_bucket")).alias("_before"))  # a row a range
    w = Window.partitionBy(group, "_bucket").orderBy(value)
    prior = F.coalesce(F.lag(value).over(w), F.col("_before"), F.lit(0))
    return own.join(before, [group, "_bucket"]).withColumn("gap", F.col(value) - prior).drop("_bucket", "_before")


def by_page(entries: DataFrame, page: str, *order: str) -> DataFrame:
    """Entries with each page's together and in order, page after page, for writers that apply them in one pass."""
    return entries.repartition(page).sortWithinPartitions(page, *order)


def reuse_gap(accesses: DataFrame, key: str, seq: str) -> DataFrame:
    """Accesses since the last one of the same key; null for the first."""
    return accesses.withColumn("reuse", F.col(seq) - F.lag(seq).over(Window.partitionBy(key).orderBy(seq)))


def notify_all(waiters: DataFrame, callback, schema: str) -> DataFrame:
    """Apply a function of Arrow-backed pandas batches to every waiter."""
    return waiters.mapInPandas(callback, schema)
