"""Registered queries over the driver's tables, each with SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata import config as C
from blockstrata.functions import checks as K
from blockstrata.functions import content as X
from blockstrata.functions import layout as L
from blockstrata.operators import dedupe as D
from blockstrata.operators import index as I
from blockstrata.operators import journal as J
from blockstrata.operators import mapping as M
from blockstrata.operators import ordering as O
from blockstrata.operators import packing as P
from blockstrata.operators import refs as R
from blockstrata.operators import stats as S
from blockstrata.plans import recovery as V
from blockstrata.runtime import arrow_batches, keep, ship, table_dir
from blockstrata.sources import chapters as H
from blockstrata.sources import streams as T

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The views that the SQL below starts from.
_B = "b AS (SELECT doc_id, n, substr(text, CAST(n * 64 + 1 AS BIGINT), 64) AS blk, md5(substr(text, CAST(n * 64 + 1 AS BIGINT), 64)) AS name FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 64 + 1)) AS n FROM documents))"
_J = "j AS (SELECT l_partkey AS lbn, l_suppkey + 1 AS pbn, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem)"
_M = _J + ", m AS (SELECT lbn, max_by(pbn, seq) AS pbn FROM j GROUP BY lbn)"
_E = "e AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'QUERY' ELSE 'QUERY_NO_UPDATE' END AS op, value AS metadata, ts FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'view', 'click'))"
_A = _E + """, r AS (SELECT *, coalesce(sum(CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
a AS (SELECT seq, key, op, max(CASE WHEN op IN ('POST', 'UPDATE') THEN seq END) OVER w IS NOT NULL AS found, max(CASE WHEN op IN ('POST', 'UPDATE', 'QUERY') THEN seq END) OVER w AS fresh,
 coalesce(last_value(CASE WHEN op = 'UPDATE' THEN metadata END IGNORE NULLS) OVER w, first_value(CASE WHEN op = 'POST' THEN metadata END IGNORE NULLS) OVER w) AS old_metadata
 FROM r WINDOW w AS (PARTITION BY key, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _blocks(spark, d):
    return T.text_blocks(table_dir(spark, d, "documents"))


def _writes(spark, d):
    return T.mapping_journal(table_dir(spark, d, "lineitem"))


def _requests(spark, d):
    return T.index_requests(table_dir(spark, d, "events"))


def _hex(a: int, n: int, c: str = "name") -> str:
    return f"CAST('0x' || substr({c}, {2 * a + 1}, {2 * n}) AS BIGINT)"


@query(f"WITH {_B} SELECT count(*) AS blocks, count(DISTINCT name) AS names, count(*) FILTER (WHERE trim(blk) = '') AS zeros FROM b")
def q01_block_dedup(spark, d):
    return D.totals(_blocks(spark, d), K.is_blank(F.col("blk")))


@query(f"WITH {_B}, f AS (SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(n) OVER w AS first_n FROM b WINDOW w AS (PARTITION BY name ORDER BY doc_id, n)) SELECT doc_id, CAST(n AS INTEGER) AS n, first_doc, CAST(first_n AS INTEGER) AS first_n, (doc_id <> first_doc OR n <> first_n) AS is_duplicate FROM f")
def q02_dedup_map(spark, d):
    out = D.dedup_map(_blocks(spark, d).drop("blk"), ["doc_id", "n"])
    return out.select("doc_id", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.n").alias("first_n"), "is_duplicate")


@query(f"WITH {_B} SELECT CAST(({_hex(0, 1)} * 3) >> 8 AS BIGINT) AS zone, count(*) AS blocks FROM b GROUP BY 1")
def q03_hash_zones(spark, d):
    return _blocks(spark, d).groupBy(L.hash_zone(F.col("name"), 3).cast("long").alias("zone")).agg(F.count("*").alias("blocks"))


@query(f"WITH {_B} SELECT count(DISTINCT name) AS hooks FROM b WHERE {_hex(14, 2)} % 32 = 0")
def q04_hooks(spark, d):
    return _blocks(spark, d).filter(L.is_hook(F.col("name"))).agg(F.countDistinct("name").alias("hooks"))


# Eight bytes: the low 20 bits (five digits) are the address, the 44 above them (eleven digits) give the list.
_KEYS = "k AS (SELECT DISTINCT name, CAST('0x' || substr(name, 1, 11) AS BIGINT) % 256 AS list, CAST('0x' || substr(name, 12, 5) AS BIGINT) AS address FROM b)"


def _keys(spark, d):
    a, b = L.index_key(F.col("name"))
    return _blocks(spark, d).select("name").distinct().select("name", a.alias("list"), b.alias("address"))


@query(f"WITH {_B}, {_KEYS} SELECT list, address, count(*) AS names FROM k GROUP BY 1, 2 HAVING count(*) > 1")
def q05_index_collisions(spark, d):
    return D.shared_keys(_keys(spark, d), "list", "address")


@query(f"WITH {_A} SELECT op, found, count(*) AS requests FROM a GROUP BY 1, 2")
def q06_index_found(spark, d):
    return I.stats(I.answers(_requests(spark, d)))


@query(f"WITH {_A} SELECT seq, key, op, found, old_metadata FROM a")
def q07_index_metadata(spark, d):
    return I.answers(_requests(spark, d)).select("seq", "key", "op", "found", "old_metadata")


@query(f"WITH {_A} SELECT op, found AND seq - fresh <= 4096 AS found, count(*) AS requests FROM (SELECT seq, op, found, coalesce(fresh, -1000000) AS fresh FROM a) GROUP BY 1, 2")
def q08_index_window(spark, d):
    return I.stats(I.answers(_requests(spark, d), 4096))


@query(f"WITH {_M} SELECT lbn, pbn FROM m")
def q09_block_map(spark, d):
    return M.latest(_writes(spark, d), "lbn")


@query(f"WITH {_J}, t AS (SELECT lbn, pbn, lag(pbn) OVER (PARTITION BY lbn ORDER BY seq) AS old_pbn FROM j), x AS (SELECT lbn, pbn, 1 AS delta FROM t UNION ALL SELECT lbn, old_pbn, -1 FROM t WHERE old_pbn IS NOT NULL) SELECT lbn, pbn, delta, count(*) AS entries FROM x GROUP BY ALL")
def q10_journal(spark, d):
    return J.entries(_writes(spark, d)).groupBy("lbn", "pbn", "delta").agg(F.count("*").alias("entries"))


@query(f"WITH {_M} SELECT pbn, count(*) AS refs FROM m GROUP BY 1")
def q11_ref_counts(spark, d):
    return R.counts(M.latest(_writes(spark, d), "lbn"))


@query(f"WITH {_M} SELECT pbn, count(*) AS refs, count(*) AS mapped FROM m GROUP BY 1")
def q12_conservation(spark, d):
    w = _writes(spark, d)
    return R.counts_from_journal(J.entries(w)).filter("refs <> 0").join(R.counts(M.latest(w, "lbn")).withColumnRenamed("refs", "mapped"), "pbn")


@query(f"WITH {_J} SELECT pbn, count(*) AS refs, (count(*) + 253) // 254 AS copies FROM j GROUP BY 1")
def q13_rollover(spark, d):
    return D.copies_needed(_writes(spark, d), "pbn")


@query(f"WITH {_J}, t AS (SELECT lbn, pbn, lag(pbn) OVER (PARTITION BY lbn ORDER BY seq) AS old_pbn, row_number() OVER (PARTITION BY lbn ORDER BY seq DESC) AS back FROM j) SELECT lbn, old_pbn AS target FROM t WHERE back = 1 AND lbn % 7 = 0 AND old_pbn IS NOT NULL")
def q14_missing_decrements(spark, d):
    w = _writes(spark, d)
    e = J.entries(w)
    end = w.groupBy("lbn").agg(F.max("point").alias("end"))
    cut = e.join(end, "lbn").filter(~((F.col("lbn") % 7 == 0) & (F.col("point") == F.col("end")) & (F.col("delta") < 0))).drop("end")
    return J.missing_decrements(cut, w.groupBy("lbn").agg(F.lit(None).cast("long").alias("pbn")))


@query("WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, event_id FROM g WHERE gap > 5000000")
def q15_timeouts(spark, d):
    return O.late_answers(table_dir(spark, d, "events"), "user_id", "ts", 5).select("user_id", "event_id")


@query(f"WITH {_J} SELECT lbn, lbn // 812 AS page, (lbn // 812) % 60 AS root, lbn % 812 AS slot, ((lbn // 812) % 60) % 4 AS zone, (lbn // 812) // 60 AS leaf, ((lbn // 812) // 60) // 812 AS above FROM (SELECT DISTINCT lbn * 1000003 AS lbn FROM j)")
def q16_tree_path(spark, d):
    b = F.col("lbn")
    path = L.tree_path(b)
    rows = _writes(spark, d).select((b * 1000003).alias("lbn")).distinct()
    return rows.select("lbn", L.page_of(b).alias("page"), L.root_of(b).alias("root"), L.map_slot(b).alias("slot"), L.logical_zone(b, 4).alias("zone"), path[0][0].alias("leaf"), path[1][0].alias("above"))


@query(f"WITH {_B}, {_KEYS}, g AS (SELECT list, address - coalesce(lag(address) OVER (PARTITION BY list ORDER BY address), 0) AS gap FROM (SELECT DISTINCT list, address FROM k)) SELECT count(*) AS entries, CAST(sum(gap) AS BIGINT) AS gaps, max(gap) AS widest, CAST(sum(CASE WHEN gap < 1257 THEN 12 ELSE 13 + (gap - 1257) // 2839 END) AS BIGINT) AS bits FROM g")
def q17_delta_bits(spark, d):
    g = O.delta_gaps(_keys(spark, d).select("list", "address").distinct(), "list", "address")
    return g.agg(F.count("*").alias("entries"), F.sum("gap").alias("gaps"), F.max("gap").alias("widest"), F.sum(L.code_bits(F.col("gap"), 4096)).alias("bits"))


@query("WITH o AS (SELECT DISTINCT o_orderstatus, o_orderkey AS p FROM orders), g AS (SELECT o_orderstatus, p, p - row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) AS island FROM o) SELECT o_orderstatus, min(p) AS first, max(p) AS last, max(p) - min(p) + 1 AS length FROM g GROUP BY o_orderstatus, island")
def q18_io_merge(spark, d):
    return O.merge_adjacent(table_dir(spark, d, "orders"), "o_orderkey", "o_orderstatus")


_SLABS = "s AS (SELECT l_partkey AS slab, CAST(floor(sum(CAST(l_quantity AS DECIMAL(18, 2)))) AS BIGINT) AS free_blocks, l_partkey % 50 = 0 AS unopened, l_partkey % 3 = 0 AS is_clean FROM lineitem GROUP BY l_partkey)"


def _slabs(spark, d):
    q = F.floor(F.sum(F.col("l_quantity").cast("decimal(18,2)"))).cast("long")
    return table_dir(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("slab")).agg(q.alias("free_blocks")).withColumns({"unopened": F.col("slab") % 50 == 0, "is_clean": F.col("slab") % 3 == 0})


_PRIORITY = "CAST(CASE WHEN free_blocks = 0 THEN 0 WHEN unopened THEN 8 WHEN length(bin(free_blocks)) < 8 THEN length(bin(free_blocks)) ELSE length(bin(free_blocks)) + 1 END AS INTEGER)"


@query(f"WITH {_SLABS} SELECT slab, {_PRIORITY} AS priority, CASE WHEN free_blocks = 0 THEN 0 ELSE greatest(1, free_blocks >> 6) END AS hint FROM s")
def q19_slab_priority(spark, d):
    free = F.col("free_blocks")
    return _slabs(spark, d).select("slab", L.slab_priority(free, F.col("unopened"), 8).cast("int").alias("priority"), L.fullness_hint(free, 6).alias("hint"))


@query(f"WITH {_SLABS}, x AS (SELECT slab, is_clean, CASE WHEN free_blocks = 0 THEN 0 ELSE greatest(1, free_blocks >> 6) END AS hint FROM s) SELECT slab, is_clean, hint, row_number() OVER (ORDER BY is_clean DESC, hint DESC, slab) - 1 AS place FROM x")
def q20_slab_order(spark, d):
    return R.recovery_order(_slabs(spark, d).withColumn("hint", L.fullness_hint(F.col("free_blocks"), 6))).select("slab", "is_clean", "hint", "place")


@query(f"WITH {_B}, {_M} SELECT (SELECT count(*) FROM b) AS written, (SELECT count(*) FROM b WHERE trim(blk) = '') AS zeros, (SELECT count(DISTINCT name) FROM b WHERE trim(blk) <> '') AS unique_blocks, (SELECT count(*) FROM m) AS logical_used, (SELECT count(DISTINCT pbn) FROM m) AS physical_used, (SELECT count(*) - count(DISTINCT name) FROM b WHERE trim(blk) <> '') AS duplicates")
def q21_stats(spark, d):
    return S.snapshot(_blocks(spark, d), M.latest(_writes(spark, d), "lbn"), K.is_blank(F.col("blk")))


@query(f"WITH {_SLABS} SELECT slab, h AS hint, h << 6 AS approximate FROM (SELECT slab, CASE WHEN free_blocks = 0 THEN 0 ELSE greatest(1, free_blocks >> 6) END AS h FROM s)")
def q22_fullness_hint(spark, d):
    h = _slabs(spark, d).select("slab", L.fullness_hint(F.col("free_blocks"), 6).alias("hint"))
    return h.withColumn("approximate", L.free_from_hint(F.col("hint"), 6))


@query(f"WITH {_J} SELECT pbn, refs, CASE WHEN refs = 0 THEN 'free' WHEN refs = 1 THEN 'single' WHEN refs = 255 THEN 'provisional' ELSE 'shared' END AS status, least(refs, 254) AS stored, greatest(refs - 254, 0) AS refused, CASE WHEN refs = 255 THEN 253 ELSE greatest(254 - refs, 0) END AS available FROM (SELECT pbn, count(*) AS refs FROM j GROUP BY 1)")
def q23_ref_status(spark, d):
    c = R.available(R.saturated(_writes(spark, d).groupBy("pbn").agg(F.count("*").alias("refs"))))
    return c.select("pbn", "refs", L.reference_status(F.col("refs")).alias("status"), "stored", "refused", "available")


@query("SELECT o_orderkey, (o_orderkey << 4) | (o_custkey % 16) AS entry, o_orderkey AS pbn, o_custkey % 16 AS state, ((o_orderkey << 12) | ((o_custkey % 812) << 2)) | (o_custkey % 4) AS journal_entry, (o_orderkey << 16) | (o_custkey % 65536) AS point, CAST(((o_custkey % 2) << 23) | (o_orderkey % 8388608) AS INTEGER) AS slab_entry FROM orders")
def q24_codecs(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    entry = L.pack_entry(o, c % 16)
    rows = table_dir(spark, d, "orders").select("o_orderkey", entry.alias("entry"), L.pack_journal_entry(c % 4, c % 812, o).alias("journal_entry"), L.pack_point(o, c % 65536).alias("point"), L.pack_slab_entry(o % 8388608, c % 2 == 1).alias("slab_entry"))
    pbn, state = L.unpack_entry(F.col("entry"))
    return rows.withColumns({"pbn": pbn, "state": state})


_BITS = lambda x: f"length(bin({x}))"


@query(f"""WITH m AS (SELECT memory_gb, sparse, CAST(1024 * greatest(1, floor(memory_gb)) AS BIGINT) AS base, CAST(64 * least(memory_gb * 4, 4) AS BIGINT) AS record_pages FROM (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75), (1.0), (2.0)) t(memory_gb), (VALUES (false), (true)) u(sparse)),
a AS (SELECT memory_gb, sparse, CASE WHEN sparse THEN 10 * base ELSE base END AS chapters, record_pages, CASE WHEN sparse THEN 19 * base // 2 ELSE 0 END AS sparse_chapters, 1024 * record_pages AS r FROM m),
b AS (SELECT *, {_BITS('(r - 1) | 63')} - 6 AS list_bits, r * ({_BITS('record_pages - 1')} + 16 + 1) + r // 2 AS index_bits FROM a),
c AS (SELECT *, CAST(pow(2, list_bits) AS BIGINT) AS lists FROM b), e AS (SELECT *, (32768 - 20) * 8 - (19 + index_bits // lists) AS room FROM c), f AS (SELECT *, (index_bits + lists * 19 + room - 1) // room AS index_pages FROM e)
SELECT memory_gb, sparse, chapters, record_pages, sparse_chapters, r AS records_per_chapter, lists AS delta_lists, 16 - list_bits + {_BITS('r - 1')} AS address_bits, index_pages, 32768 * ((index_pages + record_pages) * chapters + 1) AS bytes_per_volume FROM f""")
def q25_geometry(spark, d):
    rows = []
    for gb in (0.25, 0.5, 0.75, 1.0, 2.0):
        for sparse in (False, True):
            chapters, pages, cold = C.memory_sizes(gb, sparse)
            g = C.index_geometry(pages, chapters, cold)
            rows.append((gb, sparse, chapters, pages, cold, g["records_per_chapter"], g["delta_lists"], g["address_bits"], g["index_pages"], g["bytes_per_volume"]))
    return spark.createDataFrame(rows, "memory_gb double, sparse boolean, chapters long, record_pages long, sparse_chapters long, records_per_chapter long, delta_lists long, address_bits long, index_pages long, bytes_per_volume long")


def _generations(blocks):
    """Blocks with a place of arrival, and the zone and flush generation that bounds what is packed together."""
    generation = L.div(F.col("doc_id"), 1024) * 64 + F.col("doc_id") % 64  # 16 documents of a zone
    return blocks.withColumns({"generation": generation, "seq": F.shiftleft(F.col("doc_id").cast("long"), 24) + F.col("n")})


@query()
def q26_packing(spark, d):
    ship(spark)
    arrow_batches(spark)
    b = _generations(T.byte_blocks(table_dir(spark, d, "documents"))).select("generation", "seq", X.compressed_size(F.col("data")).alias("size"))
    return P.pack(b.filter(K.compressible(F.col("size"))), "generation")


@query()
def q27_murmur_names(spark, d):
    ship(spark)
    arrow_batches(spark)
    return T.byte_blocks(table_dir(spark, d, "documents")).select("doc_id", "n", F.hex(X.murmur_name(F.col("data"))).alias("name"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def q28_read_back(spark, d):
    b = _blocks(spark, d).withColumnRenamed("name", "pbn")
    physical = b.groupBy("pbn").agg(F.first("blk").alias("data"))  # one copy of each content
    back = M.fetch(b.drop("blk"), physical).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("p"))  # the blocks of one text
    return back.select("doc_id", F.md5(F.concat_ws("", F.transform("p", lambda x: x["data"])).cast("binary")).alias("text_md5"))


@query("WITH r AS (SELECT event_id AS seq, (user_id * 7919) % 1000000 AS lo, 1 + event_id % 9000 AS len FROM events), x AS (SELECT seq, lo, len, unnest(range(lo // 4096, (lo + len - 1) // 4096 + 1)) AS lbn FROM r) SELECT seq, lbn, CAST(least(lo + len - lbn * 4096, 4096) - greatest(lo - lbn * 4096, 0) AS BIGINT) AS bytes, least(lo + len - lbn * 4096, 4096) - greatest(lo - lbn * 4096, 0) < 4096 AS partial FROM x")
def q29_write_source(spark, d):
    e = table_dir(spark, d, "events").select(F.col("event_id").alias("seq"), ((F.col("user_id") * 7919) % 1000000).alias("offset"), (1 + F.col("event_id") % 9000).alias("length"))
    return T.write_stream(e).select("seq", "lbn", "bytes", "partial")


@query(f"WITH {_B} SELECT doc_id, CAST(n AS INTEGER) AS n, md5(concat(substr(blk, 1, 10), 'XXXX', substr(blk, 15))) AS name FROM b")
def q30_partial_write(spark, d):
    return _blocks(spark, d).select("doc_id", "n", F.md5(M.partial_write(F.col("blk"), F.lit("XXXX"), F.lit(10), F.lit(4)).cast("binary")).alias("name"))


@query("WITH e AS (SELECT event_id // 100 AS vcn, (event_id // 100 + CASE WHEN event_id % 700 = 3 THEN 1 ELSE 0 END) % 50 AS chapter FROM events) SELECT chapter, count(*) AS records, min(vcn) AS vcn, min(vcn) = max(vcn) AND min(vcn) % 50 = chapter AS valid FROM e GROUP BY 1")
def q31_chapter_probe(spark, d):
    vcn = L.div(F.col("event_id"), 100)
    e = table_dir(spark, d, "events").select(vcn.alias("vcn"), ((vcn + F.when(F.col("event_id") % 700 == 3, 1).otherwise(0)) % 50).alias("chapter"))
    return H.probe_chapters(e, lambda v: L.physical_chapter(v, 50))


@query("SELECT min(event_id // 100) AS lowest, max(event_id // 100) AS highest FROM events")
def q32_chapter_bounds(spark, d):
    return H.bounds(table_dir(spark, d, "events").select(L.div(F.col("event_id"), 100).alias("chapter")))


@query("WITH e AS (SELECT user_id AS slot, event_id AS save, ts, event_type <> 'error' AS valid FROM events), o AS (SELECT slot, save AS next FROM e QUALIFY row_number() OVER (PARTITION BY slot ORDER BY valid, ts, save) = 1), l AS (SELECT slot, save FROM e WHERE valid QUALIFY row_number() OVER (PARTITION BY slot ORDER BY ts DESC, save DESC) = 1) SELECT o.slot, l.save, o.next FROM o LEFT JOIN l ON l.slot = o.slot")
def q33_saves(spark, d):
    e = table_dir(spark, d, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("save"), F.col("ts").alias("timestamp"), (F.col("event_type") != "error").alias("valid"))
    return H.oldest_save(e, "slot").withColumnRenamed("save", "next").join(H.latest_save(e, "slot").drop("timestamp"), "slot", "left")


@query(f"WITH {_B}, k AS (SELECT DISTINCT name FROM b) SELECT name, {_hex(8, 6)} >> 20 & 1023 AS list, {_hex(8, 6)} & 1048575 AS address, {_hex(8, 6)} % 1009 AS slot, {_hex(14, 2)} AS sample FROM k")
def q34_name_slices(spark, d):
    n = F.col("name")
    a, b = L.chapter_key(n, 10, 20)
    return _blocks(spark, d).select("name").distinct().select("name", a.alias("list"), b.alias("address"), L.open_slot(n, 1009).alias("slot"), L.sampling_bytes(n).alias("sample"))


@query("SELECT o_orderkey, (o_orderkey + 5000) >> 10 AS slab, (o_orderkey + 5000) & 1023 AS sbn, o_orderkey % 500 AS chapter, CASE WHEN o_orderkey = 1000 THEN 7 WHEN o_orderkey > 1007 THEN (o_orderkey - 1000) % 501 WHEN o_orderkey > 1000 THEN o_orderkey - 1001 WHEN 1000 - o_orderkey < 501 THEN 501 - (1000 - o_orderkey) ELSE 0 END AS converted, (o_orderkey + 5000 = 0) OR ((o_orderkey + 5000) & 1023) < 900 AS is_data FROM orders")
def q35_physical_places(spark, d):
    o = F.col("o_orderkey")
    slab, sbn = L.slab_of(o + 6000, 1000, 10)
    return table_dir(spark, d, "orders").select("o_orderkey", slab.alias("slab"), sbn.alias("sbn"), L.physical_chapter(o, 500).alias("chapter"), L.physical_chapter(o, 501, 1000, 7).alias("converted"), K.is_data_block(o + 6000, 1000, 1 << 40, 10, 900).alias("is_data"))


@query("SELECT s.l_linenumber, CAST(count(*) AS BIGINT) AS entries, count(*) FILTER (WHERE CASE WHEN pbn = 0 THEN NOT state > 1 ELSE state <> 0 END) AS valid_places, count(*) FILTER (WHERE slot < 812 AND page >= 0 AND page < 150 AND (pbn = 0 OR (pbn >= 2 AND pbn < 60 AND (pbn - 2) % 16 < 12)) AND (CASE WHEN pbn = 0 THEN NOT state > 1 ELSE state <> 0 END) AND (op <> 'block_map_increment' OR (pbn <> 0 AND state <= 1))) AS valid_entries FROM (SELECT l_linenumber, l_suppkey % 67 AS pbn, l_partkey % 4 AS state, l_orderkey % 900 AS slot, l_partkey - 1 AS page, CASE WHEN l_returnflag = 'R' THEN 'block_map_increment' ELSE 'data_increment' END AS op FROM lineitem) s GROUP BY 1")
def q36_entry_validity(spark, d):
    li = table_dir(spark, d, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 67).alias("pbn"), (F.col("l_partkey") % 4).alias("state"), (F.col("l_orderkey") % 900).alias("slot"), (F.col("l_partkey") - 1).alias("page"), F.when(F.col("l_returnflag") == "R", "block_map_increment").otherwise("data_increment").alias("op"))
    ok = K.valid_journal_entry(F.col("slot"), F.col("page"), F.col("op"), F.col("pbn"), F.col("state"), 150, K.is_data_block(F.col("pbn"), 2, 60, 4, 12))
    return li.groupBy("l_linenumber").agg(F.count("*").alias("entries"), F.count_if(K.valid_location(F.col("pbn"), F.col("state"))).alias("valid_places"), F.count_if(ok).alias("valid_entries"))


_BLOCKS = "jb AS (SELECT event_id AS seq, event_type <> 'error' OR event_id < 600 AS ok, 311 - (event_id % 997 = 996)::INT AS count FROM events)"


@query(f"WITH {_BLOCKS}, g AS (SELECT * FROM jb WHERE seq >= 3 AND ok), x AS (SELECT g.*, EXISTS (SELECT 1 FROM g p WHERE p.seq = g.seq - 1 AND p.count = 311) OR g.seq = 3 AS led FROM g) SELECT seq FROM x WHERE seq < coalesce((SELECT min(seq) FROM x WHERE NOT led), 9223372036854775807) AND (SELECT min(seq) FROM x) = 3")
def q37_contiguous_range(spark, d):
    e = F.col("event_id")
    blocks = table_dir(spark, d, "events").select(e.alias("seq"), ((F.col("event_type") != "error") | (e < 600)).alias("ok"), (311 - (e % 997 == 996).cast("int")).alias("count"))
    return J.contiguous(blocks, 3).select("seq")


@query("SELECT max(event_id) FILTER (WHERE event_type <> 'error') AS tail, max(user_id) FILTER (WHERE event_type <> 'error') AS map_head, max(user_id + 1) FILTER (WHERE event_type <> 'error') AS slab_head, min(event_id) FILTER (WHERE event_type = 'click') AS reap_head FROM events")
def q38_journal_bounds(spark, d):
    e = table_dir(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("map_head"), (F.col("user_id") + 1).alias("slab_head"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "click").cast("int").alias("locks"))
    return J.bounds(e).crossJoin(J.reap_horizon(e).select(F.col("head").alias("reap_head")))


@query("SELECT event_id, event_id // 311 AS block, CAST(1 + (event_id % 311) // 46 AS BIGINT) AS sector, (event_id % 311) % 46 AS position, (event_id // 128) % 3 AS zone FROM events")
def q39_journal_places(spark, d):
    n = J.numbered(table_dir(spark, d, "events").select("event_id"), "event_id")
    return R.rotor(n, 3, "event_id")


@query(f"WITH {_E}, x AS (SELECT key % 4 AS zone, seq FROM e) SELECT zone, seq, (row_number() OVER (PARTITION BY zone ORDER BY seq) - 1) * 4 + zone AS place FROM x")
def q40_interleave(spark, d):
    e = _requests(spark, d).select((F.col("key") % 4).alias("zone"), "seq")
    return O.interleave(e, "zone", "seq", 4)


@query("SELECT user_id, max(event_id) AS last_used, count(*) AS uses FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 20")
def q41_least_recent(spark, d):
    return O.least_recent(table_dir(spark, d, "events"), "user_id", "event_id", 20)


@query(f"WITH {_J} SELECT lbn // 8 AS page, min(pbn) AS first_dirty FROM j GROUP BY 1 HAVING 60 - min(pbn) >= 50")
def q42_dirty_pages(spark, d):
    return O.expired_pages(_writes(spark, d).select(L.div(F.col("lbn"), 8).alias("page"), "pbn"), "page", "pbn", 60, 50)


@query(f"WITH {_B} SELECT substr(name, 1, 2) AS byte, count(*) AS n FROM b GROUP BY 1")
def q43_byte_histogram(spark, d):
    return O.byte_histogram(_blocks(spark, d), "name", 0)


@query(f"WITH {_B}, r AS (SELECT DISTINCT doc_id // 100 AS chapter, name FROM b) SELECT chapter, name, (row_number() OVER (PARTITION BY chapter ORDER BY name) - 1) // 1024 AS page, (row_number() OVER (PARTITION BY chapter ORDER BY name) - 1) % 1024 AS slot FROM r")
def q44_record_pages(spark, d):
    r = _blocks(spark, d).select(L.div(F.col("doc_id"), 100).alias("chapter"), "name").distinct()
    out = O.record_page(r, 1024)
    return out.select("chapter", "name", F.col("page").cast("long").alias("page"), F.col("slot").cast("long").alias("slot"))


@query("SELECT user_id, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def q45_dequeue(spark, d):
    return O.dequeue(table_dir(spark, d, "events"), "user_id", "value", "event_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def q46_heap_top(spark, d):
    return O.top(table_dir(spark, d, "events").select("event_id", "value"), 50, F.desc("value"), "event_id")


@query(f"WITH {_E}, t AS (SELECT key, max_by(op, seq) AS last FROM e GROUP BY 1) SELECT p_partkey AS lbn FROM part WHERE p_partkey NOT IN (SELECT key FROM t WHERE last = 'DELETE')")
def q47_discard(spark, d):
    gone = M.latest(_requests(spark, d), "key", value="op", point="seq").filter("op = 'DELETE'").select(F.col("key").alias("lbn"))
    return M.discard(table_dir(spark, d, "part").select(F.col("p_partkey").alias("lbn")), gone)


@query(f"WITH {_M} SELECT o_orderkey, o_custkey AS lbn, pbn, CASE WHEN pbn IS NULL THEN 'unmapped' WHEN pbn % 7 = 0 THEN 'invalid' ELSE 'mapped' END AS outcome FROM orders LEFT JOIN m ON m.lbn = o_custkey")
def q48_mapped_reads(spark, d):
    m = M.latest(_writes(spark, d), "lbn").withColumn("state", F.when(F.col("pbn") % 7 == 0, 0).otherwise(1))
    return M.get(table_dir(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("lbn")), m).select("o_orderkey", "lbn", "pbn", "outcome")


@query(f"WITH {_J}, x AS (SELECT DISTINCT lbn * 1000003 AS lbn FROM j), p AS (SELECT (lbn // 812) % 60 AS root, (lbn // 812) // 60 AS l0 FROM x) SELECT root, CAST(h AS INTEGER) AS height, CAST(CASE h WHEN 0 THEN l0 WHEN 1 THEN l0 // 812 WHEN 2 THEN l0 // 812 // 812 WHEN 3 THEN l0 // 812 // 812 // 812 ELSE l0 // 812 // 812 // 812 // 812 END AS BIGINT) AS page FROM p, range(5) t(h) GROUP BY ALL")
def q49_tree_pages(spark, d):
    return M.tree_pages(_writes(spark, d).select((F.col("lbn") * 1000003).alias("lbn")).distinct())


@query(f"WITH {_M}, s AS (SELECT lbn, pbn, lbn % 5 AS state FROM m) SELECT (lbn // 812) % 60 AS root, count(*) AS entries, count(*) FILTER (WHERE (CASE WHEN pbn = 0 THEN NOT state > 1 ELSE state <> 0 END) AND state <> 0 AND lbn < 1500) AS kept FROM s GROUP BY 1")
def q50_forest(spark, d):
    m = M.latest(_writes(spark, d), "lbn").withColumn("state", F.col("lbn") % 5)
    return M.forest(m, 1500).groupBy("root").agg(F.count("*").alias("entries"), F.count_if("kept").alias("kept"))


@query(f"WITH {_M} SELECT pbn, count(*) AS refs FROM m WHERE lbn % 5 <> 0 AND lbn < 1500 AND pbn <> 0 GROUP BY 1")
def q51_rebuild_counts(spark, d):
    return R.rebuild(M.latest(_writes(spark, d), "lbn").withColumn("state", F.col("lbn") % 5), 1500)


@query(f"WITH {_SLABS} SELECT slab AS slab, {_PRIORITY} AS priority FROM s ORDER BY priority DESC, slab LIMIT 1")
def q52_best_slab(spark, d):
    return R.best_slab(_slabs(spark, d), 8).select("slab", F.col("priority").cast("int").alias("priority"))


@query("WITH c AS (SELECT o_custkey AS slab, o_orderkey % 512 AS sbn, min(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) AS count FROM orders GROUP BY 1, 2) SELECT slab, coalesce(min(sbn) FILTER (WHERE count = 0 AND sbn >= 256), min(sbn) FILTER (WHERE count = 0)) AS sbn FROM c GROUP BY 1")
def q53_first_free(spark, d):
    c = table_dir(spark, d, "orders").groupBy(F.col("o_custkey").alias("slab"), (F.col("o_orderkey") % 512).alias("sbn")).agg(F.min(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1)).alias("count"))
    return R.first_free(c, 256)


@query("SELECT event_type AS op, count(*) AS came, count(*) FILTER (WHERE value > 50) AS acknowledged, count(*) - count(*) FILTER (WHERE value > 50) AS in_progress FROM events GROUP BY 1")
def q54_bio_stats(spark, d):
    return S.bio_stats(table_dir(spark, d, "events").select(F.col("event_type").alias("op"), (F.col("value") > 50).alias("done")))


@query("SELECT event_id, user_id, CAST(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS generation FROM events")
def q55_flush_generations(spark, d):
    return O.flush_generation(table_dir(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", F.col("generation").cast("long").alias("generation"))


@query("SELECT min(g) AS oldest FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS g FROM events GROUP BY 1)")
def q56_oldest_active(spark, d):
    g = table_dir(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("generation"))
    return O.oldest_active(g.withColumn("active", F.lit(True)))


@query("SELECT user_id % 3 AS zone, user_id AS slab, max(value) AS free FROM events GROUP BY ALL ")
def q57_combine_zones(spark, d):
    e = table_dir(spark, d, "events").groupBy(F.col("user_id").alias("slab")).agg(F.max("value").alias("free"))
    return O.combine_zones(e.withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))), 3)


@query(f"WITH {_B}, i AS (SELECT name, min(doc_id) AS pbn FROM b WHERE doc_id % 2 = 0 GROUP BY 1) SELECT b.doc_id, CAST(b.n AS INTEGER) AS n, i.pbn AS candidate, i.pbn IS NOT NULL AS found FROM b LEFT JOIN i USING (name) WHERE b.doc_id % 2 = 1")
def q58_candidates(spark, d):
    b = _blocks(spark, d)
    index = b.filter("doc_id % 2 = 0").groupBy("name").agg(F.min("doc_id").alias("pbn"))
    return D.candidates(b.filter("doc_id % 2 = 1"), index).select("doc_id", "n", "candidate", "found")


@query(f"WITH {_B}, x AS (SELECT *, substr(name, 1, 3) AS short FROM b), i AS (SELECT short, min_by(blk, (doc_id, n)) AS stored FROM x WHERE doc_id % 2 = 0 GROUP BY 1) SELECT CASE WHEN stored IS NULL THEN 'new' WHEN stored = blk THEN 'dup' ELSE 'stale' END AS outcome, count(*) AS blocks FROM x LEFT JOIN i USING (short) WHERE doc_id % 2 = 1 GROUP BY 1")
def q59_verify(spark, d):
    b = _blocks(spark, d).select("doc_id", "n", F.col("blk").alias("data"), F.substring("name", 1, 3).alias("name"))
    first = b.filter("doc_id % 2 = 0").groupBy("name").agg(F.min_by("data", F.struct("doc_id", "n")).alias("data"), F.min(F.struct("doc_id", "n")).alias("pbn"))
    found = D.candidates(b.filter("doc_id % 2 = 1"), first)
    return D.verify(found, first).groupBy("outcome").agg(F.count("*").alias("blocks"))


@query(f"WITH {_B} SELECT substr(name, 1, 4) AS name, count(DISTINCT blk) AS contents FROM b GROUP BY 1 HAVING count(DISTINCT blk) > 1")
def q60_content_collisions(spark, d):
    return D.collisions(_blocks(spark, d).select(F.substring("name", 1, 4).alias("name"), "blk"), "blk")


@query(f"WITH {_B}, r AS (SELECT name, doc_id // 100 AS chapter FROM b), t AS (SELECT max(chapter) AS top FROM r) SELECT name, max(chapter) AS chapter FROM r, t WHERE chapter > 9 - 8 AND (chapter > 9 - 4 OR {_hex(14, 2)} % 32 = 0) GROUP BY 1")
def q61_index_rebuild(spark, d):
    r = _blocks(spark, d).select("name", L.div(F.col("doc_id"), 100).alias("chapter"))
    return I.rebuild(r, 9, 8, 4, L.is_hook(F.col("name")))


@query(f"WITH {_B}, r AS (SELECT DISTINCT name, doc_id // 100 AS chapter FROM b) SELECT n.name, max(r.chapter) AS chapter FROM (SELECT DISTINCT name FROM b) n LEFT JOIN r ON r.name = n.name AND r.chapter >= 3 GROUP BY 1")
def q62_recent_search(spark, d):
    b = _blocks(spark, d)
    cached = b.select("name", L.div(F.col("doc_id"), 100).alias("chapter")).filter("chapter >= 3").withColumn("rank", -F.col("chapter"))
    return I.recent_search(b.select("name").distinct(), cached)


@query(f"WITH {_J}, x AS (SELECT lbn % 16 AS slab, pbn AS sbn, seq, CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS delta FROM (SELECT lbn, pbn, l AS seq FROM (SELECT l_partkey AS lbn, l_suppkey + 1 AS pbn, l_orderkey AS l FROM lineitem))), c AS (SELECT DISTINCT lbn % 16 AS slab, pbn AS sbn, 10 AS count, pbn * 20 AS commit FROM j WHERE pbn % 2 = 0) SELECT x.slab, x.sbn, CAST(coalesce(any_value(c.count), 0) + coalesce(sum(delta) FILTER (WHERE c.commit IS NULL OR x.seq > c.commit), 0) AS BIGINT) AS count FROM x LEFT JOIN c ON c.slab = x.slab AND c.sbn = x.sbn GROUP BY 1, 2 HAVING any_value(c.count) IS NOT NULL OR count(*) > 0")
def q63_slab_replay(spark, d):
    li = table_dir(spark, d, "lineitem")
    e = li.select((F.col("l_partkey") % 16).alias("slab"), (F.col("l_suppkey") + 1).alias("sbn"), F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1).alias("delta"), F.col("l_orderkey").alias("point"))
    counts = e.filter("sbn % 2 = 0").select("slab", "sbn", F.lit(10).alias("count"), (F.col("sbn") * 20).alias("commit")).distinct()
    return J.replay_slab(counts, e).select("slab", "sbn", F.col("count").cast("long").alias("count"))


@query(f"WITH {_B}, f AS (SELECT name, min(doc_id * 100000 + n) AS place FROM b GROUP BY 1) SELECT name, row_number() OVER (ORDER BY place) AS pbn FROM f")
def q64_allocate(spark, d):
    f = _blocks(spark, d).groupBy("name").agg(F.min(F.col("doc_id") * 100000 + F.col("n")).alias("place"))
    return R.allocate(f).select("name", F.col("pbn").cast("long").alias("pbn"))


@query(f"WITH {_B}, x AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY doc_id, n) AS rn FROM b) SELECT name, CAST((rn - 1) // 3 AS BIGINT) AS copy_no, count(*) AS refs FROM x GROUP BY 1, 2")
def q65_copy_numbers(spark, d):
    c = D.with_copies(_blocks(spark, d), ["doc_id", "n"], 3)
    return c.groupBy("name", F.col("copy_no").cast("long").alias("copy_no")).agg(F.count("*").alias("refs"))


@query(f"WITH {_A}, s AS (SELECT op, found FROM a) SELECT op, count(*) FILTER (WHERE found) AS hits, count(*) FILTER (WHERE NOT found) AS misses FROM s GROUP BY 1")
def q66_index_stats(spark, d):
    a = I.answers(_requests(spark, d))
    return a.groupBy("op").agg(F.count_if("found").alias("hits"), F.count_if(~F.col("found")).alias("misses"))


@query("WITH n AS (SELECT max(event_id) AS newest FROM events) SELECT event_id AS vcn, (event_id + 200 <= newest) AND (newest - 100 + 1 > 200) AS sparse, event_id + 900 <= newest AS expired FROM events, n")
def q67_chapter_age(spark, d):
    v, e = F.col("event_id"), table_dir(spark, d, "events")
    newest = e.agg(F.max("event_id").alias("newest"))  # one row
    return e.crossJoin(F.broadcast(newest)).select(v.alias("vcn"), K.is_sparse(v, F.lit(100), F.col("newest"), 200, 900).alias("sparse"), K.expired(v, F.col("newest"), 900).alias("expired"))


@query("SELECT event_id, (user_id % 3 = 2) AND value <> 0 AND (user_id <> 0) AND user_id >= 10 AND user_id < 400 AS valid_advice, CASE WHEN user_id % 2 <> 1 OR event_id % 5 = 0 THEN 'invalid' WHEN event_id % 7 = 0 THEN 'bad' ELSE 'valid' END AS page FROM events")
def q68_advice_and_pages(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    page = K.page_validity(u % 2, F.when(e % 5 == 0, 0).otherwise(9), F.when(e % 7 == 0, -1).otherwise(e), 9, e)
    return table_dir(spark, d, "events").select("event_id", K.valid_advice(F.when(u % 3 == 2, 2).otherwise(1), F.when(F.col("value") != 0, 1).otherwise(0), u, 10, 400).alias("valid_advice"), page.alias("page"))


@query("SELECT user_id, max(event_id) AS kept FROM events WHERE event_type <> 'error' AND user_id % 3 <> 1 AND (event_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 64 = event_id % 64 GROUP BY 1")
def q69_journal_load(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    blocks = table_dir(spark, d, "events").select(u, e.alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(9).alias("nonce"), F.when(u % 3 == 1, 0).otherwise(2).alias("kind"), ((e + F.when(e % 11 == 0, 1).otherwise(0)) % 64).alias("place"))
    return M.latest(J.load(blocks, 9, 2, 64).select("user_id", F.col("seq").alias("kept"), F.col("seq").alias("point")), "user_id", value="kept")


@query("SELECT k AS counter, CAST(v AS VARCHAR) AS value FROM (SELECT count(*) AS events, count(DISTINCT user_id) AS users, max(event_id) AS last FROM events) UNPIVOT (v FOR k IN (events, users, last))")
def q70_stat_rows(spark, d):
    return S.rows_of(table_dir(spark, d, "events").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last")))


@query("SELECT 'dm0' AS device, 'normal' AS mode, '-' AS recovery, 'online' AS index, 'offline' AS compression, count(DISTINCT l_suppkey) AS used_blocks, CAST(100000 AS BIGINT) AS total_blocks FROM lineitem")
def q71_status(spark, d):
    return S.status("dm0", "normal", "-", "online", False, table_dir(spark, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("used")), 100000)


@query(f"WITH {_SLABS} SELECT CAST(sum(4000 - free_blocks) - 100 AS BIGINT) AS data, CAST(10000000 - sum(4000) + 100 AS BIGINT) AS overhead FROM s")
def q72_space(spark, d):
    s = R.space(_slabs(spark, d).withColumn("data_blocks", F.lit(4000).cast("long")), 100, 10_000_000)
    return s.select(F.col("data").cast("long").alias("data"), F.col("overhead").cast("long").alias("overhead"))


@query(f"WITH {_J}, t AS (SELECT lbn, pbn, lag(pbn) OVER (PARTITION BY lbn ORDER BY seq) AS old_pbn FROM j) SELECT CAST(count(*) - count(old_pbn) AS BIGINT) AS logical_used, count(*) AS increments FROM t")
def q73_usage(spark, d):
    u = J.usage(J.entries(_writes(spark, d)))
    return u.select(F.col("logical_used").cast("long").alias("logical_used"), "increments")


@query()
def q74_exact_chapters(spark, d):
    ship(spark)
    r = _requests(spark, d).withColumn("index", F.col("key") % 16)
    return I.chapters(r.select("index", "seq", "key", "op", "metadata"), capacity=16, live=4, zones=2)


@query()
def q75_fragment_round_trip(spark, d):
    ship(spark)
    arrow_batches(spark)
    b = _generations(T.byte_blocks(table_dir(spark, d, "documents"))).select("generation", "seq", "data")
    f = b.withColumn("frag", X.compress(F.col("data"))).withColumn("size", F.length("frag").cast("long")).filter(K.compressible(F.col("size")))
    placed = P.pack(f, "generation").drop("size").join(f.select("generation", "seq", F.col("frag").alias("data")), ["generation", "seq"])
    built = P.build_blocks(placed, "generation")
    each = placed.filter("block >= 0").select("generation", "block", "slot", "seq").join(built, ["generation", "block"])
    back = each.withColumn("raw", X.decompress(X.fragment(F.col("sizes"), F.col("area"), F.col("slot").cast("int"))))
    return back.join(b.select("generation", "seq", F.col("data").alias("was")), ["generation", "seq"]).groupBy("generation").agg(F.count("*").alias("fragments"), F.count_if(F.col("raw") == F.col("was")).alias("equal"))


@query("SELECT p_partkey, (n + 811) // 812 AS pages, ((greatest((n + 811) // 812, 1) + 59) // 60 + 811) // 812 AS level0, (((greatest((n + 811) // 812, 1) + 59) // 60 + 811) // 812 + 811) // 812 AS level1 FROM (SELECT p_partkey, p_partkey * 1234567 AS n FROM part)")
def q76_map_sizing(spark, d):
    n = F.col("p_partkey") * 1234567
    levels = L.forest_levels(n)
    return table_dir(spark, d, "part").select("p_partkey", L.pages_for(n).alias("pages"), levels[0].alias("level0"), levels[1].alias("level1"))


@query(f"WITH {_M}, z AS (SELECT lbn, CASE WHEN pbn % 5 = 0 THEN 0 ELSE pbn END AS pbn, CASE WHEN pbn % 7 = 0 THEN 0 ELSE 1 END AS state FROM m) SELECT o_orderkey, CASE WHEN z.pbn IS NULL THEN 'unmapped' WHEN z.pbn = 0 THEN 'zero' WHEN state = 0 THEN 'invalid' ELSE 'mapped' END AS outcome, CASE WHEN z.pbn IS NULL OR z.pbn = 0 THEN 'blank' WHEN state <> 0 THEN s_name END AS data FROM orders LEFT JOIN z ON z.lbn = o_custkey LEFT JOIN supplier ON s_suppkey + 1 = z.pbn")
def q77_read_outcomes(spark, d):
    p = F.col("pbn")
    m = M.latest(_writes(spark, d), "lbn").select("lbn", F.when(p % 5 == 0, 0).otherwise(p).alias("pbn"), F.when(p % 7 == 0, 0).otherwise(1).alias("state"))
    physical = table_dir(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("pbn"), F.col("s_name").alias("data"))
    return M.read_back(table_dir(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("lbn")), m, physical, F.lit("blank")).select("o_orderkey", "outcome", "data")


_PAGE, _TO = "((o_orderkey * 1000003) % 68719476736)", "((o_orderkey * 104729 + 4294967296 * (o_custkey % 16)) % 68719476736)"
_LE = lambda x, n: " || ".join(f"printf('%02X', ({x} >> {8 * k}) & 255)" for k in range(n))


@query(f"SELECT o_orderkey, {_LE(f'((o_custkey % 3) | ((o_custkey % 812) << 2) | (({_PAGE} >> 32) << 12))', 2)} || {_LE(_PAGE, 4)} || printf('%02X', (o_custkey % 16) | (({_TO} >> 32) << 4)) || {_LE(_TO, 4)} AS stored, o_custkey % 3 AS op, o_custkey % 812 AS slot, {_PAGE} AS page, {_TO} AS pbn, o_custkey % 16 AS state FROM orders")
def q78_journal_entry_bytes(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    to = (o * 104729 + F.lit(1 << 32) * (c % 16)) % (1 << 36)
    rows = table_dir(spark, d, "orders").select("o_orderkey", L.journal_entry_bytes(c % 3, c % 812, (o * 1000003) % (1 << 36), to, c % 16).alias("stored"))
    return rows.withColumns(dict(zip(("op", "slot", "page", "pbn", "state"), L.read_journal_entry_bytes(F.col("stored")), strict=True)))


@query("SELECT event_id, CASE WHEN event_type <> 'view' AND (CASE WHEN event_id % 16 < 8 THEN user_id % 256 ELSE event_id % 251 END >> (event_id % 8)) & 1 = 1 THEN 'block_map_increment' WHEN event_id % 3 = 0 THEN 'data_increment' ELSE 'data_decrement' END AS op, event_id % 8388608 AS sbn, event_id + CASE WHEN user_id % 5 = 4 THEN 1 ELSE 0 END AS next_seq, CASE WHEN user_id % 5 = 4 THEN 0 ELSE user_id % 5 + 1 END AS next_entry, event_id AS point_seq, user_id % 5 AS point_entry FROM events")
def q79_slab_entries_and_points(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    sbn, up = L.unpack_slab_entry(L.pack_slab_entry(e % 8388608, e % 3 == 0))
    seq, entry = L.unpack_point(L.pack_point(e, u % 5))
    after = L.next_point(seq, entry, 5)
    op = L.slab_entry_op(up, F.col("event_type") != "view", F.array(u % 256, e % 251), e % 16)
    return table_dir(spark, d, "events").select("event_id", op.alias("op"), sbn.cast("long").alias("sbn"), after[0].alias("next_seq"), after[1].cast("long").alias("next_entry"), seq.alias("point_seq"), entry.alias("point_entry"))


@query("SELECT o_orderkey, o_custkey % 14 + 2 AS state, o_custkey % 14 AS slot, true AS compressed, (o_custkey % 3) | ((o_custkey % 812) << 2) | (o_orderkey << 12) AS entry, o_custkey % 3 AS op, o_custkey % 812 AS page_slot, o_orderkey AS page FROM orders")
def q80_mapping_states(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table_dir(spark, d, "orders").select("o_orderkey", L.state_of_slot(c % 14).alias("state"), L.pack_journal_entry(c % 3, c % 812, o).alias("entry"))
    op, slot, page = L.unpack_journal_entry(F.col("entry"))
    return rows.select("*", L.slot_of_state(F.col("state")).alias("slot"), L.is_compressed(F.col("state")).alias("compressed"), op.alias("op"), slot.alias("page_slot"), page.alias("page"))


@query(f"WITH {_B}, {_KEYS}, g AS (SELECT list, address, address - coalesce(lag(address) OVER (PARTITION BY list ORDER BY address), 0) AS gap FROM (SELECT DISTINCT list, address FROM k)) SELECT list, address, gap, CASE WHEN gap < 1257 THEN reverse(lpad(bin(gap), 12, '0')) ELSE reverse(lpad(bin((gap - 1257) % 2839 + 1257), 12, '0')) || repeat('0', CAST((gap - 1257) // 2839 AS INTEGER)) || '1' END AS code, gap AS decoded FROM g")
def q81_delta_codes(spark, d):
    g = O.delta_gaps(_keys(spark, d).select("list", "address").distinct(), "list", "address").withColumn("code", L.delta_code(F.col("gap"), 4096))
    return g.withColumn("decoded", L.read_delta_code(F.col("code"), 4096))


@query(f"SELECT o_orderkey, '02' || printf('%02X', o_custkey % 16) || {_LE(_PAGE, 8)} AS stored, CAST(2 AS BIGINT) AS version, o_custkey % 16 AS state, {_PAGE} AS pbn FROM orders")
def q82_advice_bytes(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table_dir(spark, d, "orders").select("o_orderkey", L.advice_bytes(c % 16, (o * 1000003) % (1 << 36)).alias("stored"))
    return rows.withColumns(dict(zip(("version", "state", "pbn"), L.read_advice(F.col("stored")), strict=True)))


@query("SELECT event_id, event_type <> 'error' AND user_id % 2 = 0 AND event_id % 64 = (event_id + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END) % 64 AS congruent, user_id % 8 = event_id % 8 AND user_id % 4 = 1 AS sector FROM events")
def q83_journal_blocks(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    ok = K.congruent_block(e, F.when(F.col("event_type") == "error", 5).otherwise(9), u % 2, (e + F.when(e % 9 == 0, 1).otherwise(0)) % 64, 9, 0, 64)
    return table_dir(spark, d, "events").select("event_id", ok.alias("congruent"), K.valid_sector(u % 8, u % 4, e % 8, F.lit(1)).alias("sector"))


@query("SELECT event_id, event_id % 2 = 0 AND event_type <> 'error' AND user_id % 5 <> 0 AND user_id % 3 <> 0 AND event_id % 4 <= 1 AS may_compress, event_id % 5000 < 4060 AND user_id % 5 <> 0 AND event_id % 7 <> 0 AS may_pack FROM events")
def q84_compression_gates(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    go = K.may_compress(e % 2 == 0, F.col("event_type") == "error", u % 5 != 0, u % 3 != 0, e % 4)
    return table_dir(spark, d, "events").select("event_id", go.alias("may_compress"), K.may_pack(e % 5000, u % 5 != 0, e % 7 == 0).alias("may_pack"))


@query("SELECT event_id AS newest, CAST(CASE WHEN event_id < 101 THEN 0 ELSE 1 END AS INTEGER) AS plain, CAST(CASE WHEN event_id < 101 THEN 0 WHEN event_id - 101 = 40 THEN 2 WHEN event_id - 101 = 47 THEN 0 ELSE 1 END AS INTEGER) AS converted FROM events")
def q85_chapters_to_expire(spark, d):
    e = F.col("event_id")
    return table_dir(spark, d, "events").select(e.alias("newest"), K.chapters_to_expire(e, 101).cast("int").alias("plain"), K.chapters_to_expire(e, 101, 40, 7).cast("int").alias("converted"))


@query("SELECT event_id, event_type = 'error' OR event_id < 300 OR user_id >= 50 AS all_searched, event_type = 'error' OR event_id < 300 OR CASE WHEN user_id % 2 = 0 THEN event_id <> 10 * user_id ELSE user_id >= 50 END AS hook_searched FROM events")
def q86_skipped_chapters(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    skip = lambda hook: K.skip_sparse(F.col("event_type") == "error", e, F.lit(300), u, hook, 50)
    return table_dir(spark, d, "events").select("event_id", skip(None).alias("all_searched"), skip(F.when(u % 2 == 0, 10 * u)).alias("hook_searched"))


@query(f"WITH {_B}, r AS (SELECT name, max(doc_id // 100) AS chapter FROM b GROUP BY 1), t AS (SELECT max(chapter) AS newest FROM r), q AS (SELECT name, name AS asked FROM r UNION ALL SELECT name, md5(name) FROM r) SELECT asked AS name, CASE WHEN r.chapter IS NULL THEN 'none' WHEN r.chapter = newest THEN 'open' ELSE 'volume' END AS location FROM q LEFT JOIN r ON r.name = asked, t")
def q87_index_lookup(spark, d):
    b, _ = keep(_blocks(spark, d).groupBy("name").agg(F.max(L.div(F.col("doc_id"), 100)).alias("chapter")))  # read six times, so texts are cut and named once
    key = lambda df: df.withColumns(dict(zip(("list", "address"), L.index_key(F.col("name"), 16, 8), strict=True)))
    newest = b.agg(F.max("chapter")).first()[0]
    asked = b.select("name").unionByName(b.select(F.md5(F.col("name").cast("binary")).alias("name")))
    return I.lookup(key(asked), I.volume_index(key(b)), b.filter(F.col("chapter") == newest), b, newest).select("name", "location")


@query("SELECT event_id, CASE WHEN value < 20 THEN CAST(0 AS BIGINT) END AS pbn FROM events")
def q88_zero_elimination(spark, d):
    blk = F.when(F.col("value") < 20, F.lpad(F.lit(""), 8, " ")).otherwise(F.col("event_type"))
    return D.zero_elimination(table_dir(spark, d, "events").select("event_id", blk.alias("blk")), K.is_blank(F.col("blk"))).select("event_id", "pbn")


@query(f"WITH {_J}, x AS (SELECT DISTINCT lbn * 1000003 AS lbn, lbn % 4 = 0 AS old FROM j), p AS (SELECT (lbn // 812) % 60 AS root, (lbn // 812) // 60 AS l0, old FROM x), t AS (SELECT DISTINCT old, root, CAST(h AS INTEGER) AS height, CAST(l0 // CAST(pow(812, h) AS BIGINT) AS BIGINT) AS page FROM p, range(5) t(h)), n AS (SELECT DISTINCT root, height, page FROM t EXCEPT SELECT root, height, page FROM t WHERE old) SELECT root, height, page, 99 + row_number() OVER (ORDER BY height DESC, root, page) AS pbn FROM n")
def q89_allocated_pages(spark, d):
    w = _writes(spark, d).select("lbn").distinct()
    far = lambda df: df.select((F.col("lbn") * 1000003).alias("lbn"))
    return M.allocate_pages(far(w), M.tree_pages(far(w.filter("lbn % 4 = 0"))), 100).withColumn("pbn", F.col("pbn").cast("long"))


@query("WITH x(h, a, b) AS (VALUES (0, (100000 + 811) // 812, (90000000 + 811) // 812)), l AS (SELECT 0 AS height, ((a + 59) // 60 + 811) // 812 AS a, ((b + 59) // 60 + 811) // 812 AS b FROM x), m AS (SELECT * FROM l UNION ALL SELECT 1, (a + 811) // 812, (b + 811) // 812 FROM l UNION ALL SELECT 2, ((a + 811) // 812 + 811) // 812, ((b + 811) // 812 + 811) // 812 FROM l UNION ALL SELECT 3, 1, 1 FROM l UNION ALL SELECT 4, 1, 1 FROM l) SELECT height, CAST((b - a) * 60 AS BIGINT) AS pages FROM m")
def q90_grown_pages(spark, d):
    return M.grow(table_dir(spark, d, "orders"), 100_000, 90_000_000)


_LOG = _J + """, g AS (SELECT lbn, pbn, seq, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS BIGINT) AS block FROM (SELECT l_partkey AS lbn, l_suppkey + 1 AS pbn, l_shipdate, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem)),
days AS (SELECT DISTINCT block FROM g), head AS (SELECT min(block) + 20 AS head FROM days), stop AS (SELECT coalesce(min(block), 9223372036854775807) AS stop FROM days, head WHERE block > head AND block - 1 NOT IN (SELECT block FROM days)),
good AS (SELECT g.* FROM g, head, stop WHERE block >= head AND block < stop AND head IN (SELECT block FROM days)), old AS (SELECT lbn, max_by(pbn, seq) AS pbn FROM g, head WHERE block < head GROUP BY lbn), new AS (SELECT lbn, max_by(pbn, seq) AS pbn FROM good GROUP BY lbn)"""


def _crash(spark, d):
    """A journal whose blocks are days of shipping, the map before its head, and its recovery."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    block = F.datediff("point.l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    w = _writes(spark, d)
    days = table_dir(spark, d, "lineitem").select(day.alias("seq")).distinct().withColumns({"ok": F.lit(True), "count": F.lit(C.JOURNAL_ENTRIES_PER_BLOCK)})
    head = days.agg(F.min("seq")).first()[0] + 20
    entries = J.entries(w).withColumn("block", block).filter(F.col("block") >= head)
    start = M.latest(w.filter(block < head), "lbn")
    counts = R.counts(start).select(F.shiftright("pbn", 16).alias("slab"), (F.col("pbn") % 65536).alias("sbn"), F.col("refs").alias("count"), F.lit(None).cast(dict(w.dtypes)["point"]).alias("commit"))
    return V.crash_recovery(days, entries, start, counts, head)


@query(f"WITH {_LOG} SELECT coalesce(new.lbn, old.lbn) AS lbn, coalesce(new.pbn, old.pbn) AS pbn FROM old FULL JOIN new ON old.lbn = new.lbn")
def q91_crash_recovery(spark, d):
    return _crash(spark, d).block_map


@query(f"WITH {_LOG}, m AS (SELECT coalesce(new.pbn, old.pbn) AS pbn FROM old FULL JOIN new ON old.lbn = new.lbn) SELECT pbn, count(*) AS count FROM m GROUP BY 1")
def q92_recovered_counts(spark, d):
    return _crash(spark, d).counts.select(F.shiftleft("slab", 16).bitwiseOR(F.col("sbn")).alias("pbn"), F.col("count").cast("long").alias("count")).filter("count <> 0")


@query(f"WITH {_J}, v AS (SELECT lbn, max_by(pbn, seq) AS pbn FROM j WHERE pbn % 9 <> 0 GROUP BY lbn) SELECT pbn, count(*) AS refs FROM v WHERE lbn < 1500 GROUP BY 1")
def q93_read_only_rebuild(spark, d):
    e = J.entries(_writes(spark, d))
    empty = e.select("lbn", "pbn").limit(0)
    return V.rebuild(e, F.col("pbn") % 9 != 0, empty, 1500).counts


@query(f"WITH {_SLABS}, x AS (SELECT slab, -(CASE WHEN free_blocks = 0 THEN 0 ELSE greatest(1, free_blocks >> 6) END) AS r FROM s WHERE NOT is_clean), c AS (SELECT l_partkey AS slab, sum(CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS total FROM lineitem GROUP BY 1) SELECT x.slab, row_number() OVER (ORDER BY r, x.slab) - 1 AS place, 'rebuilt' AS state, CAST(total AS BIGINT) AS total FROM x LEFT JOIN c ON c.slab = x.slab")
def q94_slab_scrub(spark, d):
    e = table_dir(spark, d, "lineitem").select(F.col("l_partkey").alias("slab"), F.col("l_suppkey").alias("sbn"), F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1).alias("delta"), F.col("l_orderkey").alias("point"))
    none = e.limit(0).select("slab", "sbn", F.lit(0).alias("count"), F.col("point").alias("commit"))
    order, counts = J.scrub(_slabs(spark, d).withColumn("hint", L.fullness_hint(F.col("free_blocks"), 6)), none, e)
    return order.join(counts.groupBy("slab").agg(F.sum("count").cast("long").alias("total")), "slab", "left")


@query("WITH n AS (SELECT event_id, event_type = 'error' AS gone, row_number() OVER (ORDER BY event_id) AS n, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY event_id) AS k FROM events) SELECT event_id, CAST(greatest(0, ceil((n - 2048) / 128.0), CASE WHEN gone THEN ceil((k - 1536) / 128.0) ELSE 0 END) AS BIGINT) AS batch FROM n")
def q95_admission(spark, d):
    return O.admission(table_dir(spark, d, "events").select("event_id", "event_type"), "event_id", F.col("event_type") == "error").select("event_id", "batch")


@query("WITH c AS (SELECT event_id // 16 AS l, CASE WHEN user_id % 2 = 0 THEN 'logical' ELSE 'physical' END AS t, user_id % 3 AS z, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS held FROM events GROUP BY ALL), s AS (SELECT l AS seq, count(*) FILTER (WHERE held > 0) AS locks FROM c GROUP BY 1) SELECT seq, locks, (SELECT min(seq) FROM s WHERE locks > 0) AS head FROM s")
def q96_lock_counters(spark, d):
    u = F.col("user_id")
    refs = table_dir(spark, d, "events").select(L.div(F.col("event_id"), 16).alias("lock"), F.when(u % 2 == 0, "logical").otherwise("physical").alias("zone_type"), (u % 3).alias("zone"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta"))
    held = J.locks(J.lock_counters(refs))
    return held.crossJoin(F.broadcast(J.reap_horizon(held).select("head")))  # one row


@query("WITH n AS (SELECT row_number() OVER (ORDER BY event_id // 50, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) - 1 AS n, event_id FROM events), k AS (SELECT n // 311 AS block, count(*) AS entries FROM n GROUP BY 1) SELECT event_id, n.n AS number, block, CASE WHEN entries = 311 THEN 'full' ELSE 'idle' END AS reason FROM n JOIN k ON k.block = n.n // 311")
def q97_group_commit(spark, d):
    e = table_dir(spark, d, "events").select("event_id", L.div(F.col("event_id"), 50).alias("queue"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta"))
    n = J.appended(e, "queue", "event_id")
    return J.numbered(n).select("event_id", "number", "block").join(J.commits(n).select("block", "reason"), "block")


@query("WITH r AS (SELECT event_id AS record_no, user_id % 3 AS zone FROM events WHERE event_type <> 'error') SELECT record_no, zone FROM r QUALIFY row_number() OVER (PARTITION BY zone ORDER BY record_no) <= 100")
def q98_reloaded_chapter(spark, d):
    e = table_dir(spark, d, "events").select(F.col("event_id").alias("record_no"), (F.col("event_type") == "error").alias("deleted"), "user_id")
    return H.reload_open(e, 3, 100, F.col("user_id")).select("record_no", "zone")


@query("WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN user_id // 10 END AS chapter FROM events), f AS (SELECT min(event_id) AS at FROM r WHERE chapter IS NOT NULL GROUP BY chapter) SELECT event_id, (SELECT count(*) FROM f WHERE f.at < r.event_id) AS epoch FROM r")
def q99_cache_epochs(spark, d):
    e = table_dir(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", L.div(F.col("user_id"), 10)).alias("chapter"))
    return I.cache_epochs(e).select(F.col("seq").alias("event_id"), F.col("epoch").cast("long").alias("epoch"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have any."""
    return dict(_SQL)
