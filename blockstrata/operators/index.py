"""The time-ordered index: five kinds of request, recency windows and chapters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockstrata.operators.ordering import ranges, running_count

#: Requests that leave a key in the index, and those that take part in what it holds.
WRITES = ("POST", "UPDATE")


def answers(requests: DataFrame, window: int | None = None, buckets: int = 64) -> DataFrame:
    """Each request with ``found`` and ``old_metadata`` as an index without expiry answers it.

    A key is present when its last POST, UPDATE or DELETE before is not a DELETE. Its
    metadata are those of the last UPDATE since the last DELETE, or else of the first
    POST. With ``window`` a key also leaves after that many requests without a POST,
    UPDATE or QUERY of it: a count-based stand-in for chapters, not their exact fold.

    Runs between DELETEs are counted, and what came before is carried on, by ranges of seq,
    so a key with a third of all requests is spread over ``buckets`` tasks.
    """
    own = requests.withColumn("_range", ranges(requests, "seq", buckets))
    op, meta, seq = F.col("op"), F.col("metadata"), F.col("seq")
    runs = running_count(own, "key", "seq", op == "DELETE", "run", bucket=F.col("_range"))
    posted, updated = F.when(op == "POST", meta), F.when(op == "UPDATE", meta)
    wrote, fresh = F.when(op.isin(*WRITES), seq), F.when(op.isin(*WRITES, "QUERY"), seq)
    by = ["key", "run", "_range"]
    so_far = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    here = {"_posted": F.first(posted, ignorenulls=True).over(so_far), "_updated": F.last(updated, ignorenulls=True).over(so_far), "_wrote": F.max(wrote).over(so_far), "_fresh": F.max(fresh).over(so_far)}
    sums = runs.groupBy(*by).agg(F.min_by(posted, F.when(posted.isNotNull(), seq)).alias("p"), F.max_by(updated, F.when(updated.isNotNull(), seq)).alias("u"), F.max(wrote).alias("w"), F.max(fresh).alias("f"))
    prior = Window.partitionBy("key", "run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = sums.select(*by, F.first("p", ignorenulls=True).over(prior).alias("_p"), F.last("u", ignorenulls=True).over(prior).alias("_u"), F.max("w").over(prior).alias("_w"), F.max("f").over(prior).alias("_f"))
    out = runs.withColumns(here).join(carried, by)
    found = F.coalesce("_wrote", "_w").isNotNull()
    if window is not None:
        found = found & (seq - F.coalesce("_fresh", "_f") <= window)
    old = F.coalesce("_updated", "_u", "_p", "_posted")
    return out.select(*requests.columns, found.alias("found"), (old if window is None else F.when(found, old)).alias("old_metadata"))


def stats(answered: DataFrame) -> DataFrame:
    """Requests by kind and outcome."""
    return answered.groupBy("op", "found").agg(F.count("*").alias("requests"))


def chapters(requests: DataFrame, capacity: int, live: int, zones: int = 1, index: str = "index") -> DataFrame:
    """The exact fold over each index: found, old_metadata and chapter of each request.

    A chapter closes in all zones as soon as a new record fills one of them, and the
    oldest of more than ``live`` chapters expires. What is found decides where chapters
    end, so requests of one index are folded in order, on one task; different indexes
    run side by side. State is bounded by ``live * capacity * zones`` records.
    """
    schema = f"{index} long, seq long, key long, op string, found boolean, old_metadata double, chapter long"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        held: dict[int, tuple[int, float]] = {}
        fill, newest, out = [0] * zones, 0, []
        names: list[set] = [set() for _ in range(zones)]
        for seq, key, op, new in zip(rows["seq"], rows["key"], rows["op"], rows["metadata"], strict=True):
            at = held.get(key)
            if at is not None and at[0] <= newest - live:
                held.pop(key)
                at = None
            found, old = at is not None, at[1] if at is not None else None
            out.append((found, old, newest))
            z = key % zones
            if op == "DELETE":
                held.pop(key, None)
                if found and at[0] == newest:
                    names[z].discard(key)
                continue
            if op == "QUERY_NO_UPDATE" or op == "QUERY" and not found:
                continue
            here = found and at[0] == newest
            value = new if op == "UPDATE" or not found else old
            held[key] = (newest, value)
            if not here and key not in names[z]:
                names[z].add(key)
                fill[z] += 1
                if fill[z] == capacity:
                    newest += 1
                    fill = [0] * zones
                    names = [set() for _ in range(zones)]
        return pd.DataFrame({index: rows[index].to_numpy(), "seq": rows["seq"].to_numpy(), "key": rows["key"].to_numpy(), "op": rows["op"].to_numpy(), "found": [o[0] for o in out], "old_metadata": [o[1] for o in out], "chapter": [o[2] for o in out]})

    return requests.groupBy(index).applyInPandas(fold, schema)


def rebuild(records: DataFrame, newest: int, live: int, dense: int, hook) -> DataFrame:
    """The newest chapter of each name over live chapters; of chapters about to be sparse only hooks count."""
    vcn = F.col("chapter")
    own = records.filter((vcn > newest - live) & ((vcn > newest - dense) | hook))
    return own.groupBy("name").agg(F.max("chapter").alias("chapter"))


def volume_index(records: DataFrame) -> DataFrame:
    """Entries of records (name, list, address, chapter): the first name under a key by its key alone, later ones with the full name."""
    first = records.groupBy("list", "address").agg(F.min("name").alias("lead"))
    own = records.join(first, ["list", "address"])
    return own.select("list", "address", "chapter", F.when(F.col("name") != F.col("lead"), F.col("name")).alias("full"))


def probe(index: DataFrame, names: DataFrame) -> DataFrame:
    """Names (name, list, address) with the chapter where the volume index says they may be.

    An entry with the full name is certain; without one the entry of the key alone is a
    hint, which a chapter must confirm.
    """
    exact = index.filter("full is not null").select(F.col("list").alias("_list"), F.col("address").alias("_address"), F.col("full").alias("_full"), F.col("chapter").alias("certain"))
    hint = index.filter("full is null").select("list", "address", F.col("chapter").alias("hint"))
    same_key = F.col("list").between(F.col("_list"), F.col("_list")) & F.col("address").between(F.col("_address"), F.col("_address"))  # no key of the join, so names alone deal the rows
    out = names.join(hint, ["list", "address"], "left").join(exact, (F.col("name") == F.col("_full")) & same_key, "left")
    return out.select(*names.columns, F.coalesce("certain", "hint").alias("chapter"), F.col("certain").isNotNull().alias("is_collision"))


def lookup(names: DataFrame, index: DataFrame, open_records: DataFrame, chapter_records: DataFrame, newest) -> DataFrame:
    """Where each name (name, list, address) is found: open, volume or none, after a probe of the volume index.

    A hint at the newest chapter is looked up among the open records, any other in the
    records of that chapter (chapter, name), whose folders alone a scan would open.
    """
    hit = probe(index, names)
    in_open = open_records.select("name", F.lit(True).alias("in_open")).distinct()
    in_volume = chapter_records.select(F.col("chapter").alias("_chapter"), F.col("name").alias("_name")).repartition("_name").distinct().withColumn("in_volume", F.lit(True))
    there = (F.col("name") == F.col("_name")) & F.col("chapter").between(F.col("_chapter"), F.col("_chapter"))  # dealt by name, as after the probe
    out = hit.join(in_open, "name", "left").join(in_volume, there, "left")
    here = F.col("chapter") == newest
    place = F.when(here & F.col("in_open"), "open").when(~here & F.col("in_volume"), "volume").otherwise("none")
    return out.select(*names.columns, "chapter", "is_collision", place.alias("location"))


def cache_epochs(requests: DataFrame) -> DataFrame:
    """Epoch of each request (seq, chapter): how often the sparse cache had changed for all zones before it.

    A request that names a chapter not cached before (``chapter``, null for none) changes the
    membership; every zone sees the change between it and the next request.
    """
    first = requests.filter("chapter is not null").groupBy("chapter").agg(F.min("seq").alias("seq")).select("seq", F.lit(1).alias("_new"))
    own = requests.join(first, "seq", "left").withColumn("_all", F.lit(0))
    return running_count(own, "_all", "seq", F.col("_new").isNotNull(), "epoch").drop("_new", "_all")


def recent_search(names: DataFrame, cached: DataFrame) -> DataFrame:
    """Each name with the most recently used cached chapter that holds it (name, chapter, rank)."""
    best = cached.groupBy("name").agg(F.min_by("chapter", "rank").alias("chapter"))
    return names.join(best, "name", "left")
