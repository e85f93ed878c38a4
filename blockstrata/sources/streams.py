"""Streams of blocks, mappings and index requests from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.functions.layout import block_name

#: What each kind of event asks of the index.
REQUESTS = {"signup": "POST", "purchase": "UPDATE", "error": "DELETE", "view": "QUERY", "click": "QUERY_NO_UPDATE"}


def _pieces(text: Column, size: int) -> Column:
    """A text cut in one pass, so long texts cost in proportion and no row carries more than its piece."""
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def text_blocks(docs: DataFrame, size: int = 64) -> DataFrame:
    """doc_id, n, blk, name: fixed-size slices of each text; an empty text is one empty block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.posexplode(_pieces(text, size)).alias("n", "blk"))
    return rows.withColumn("name", block_name(F.col("blk")))


def byte_blocks(docs: DataFrame, size: int = 4096) -> DataFrame:
    """doc_id, n, data: UTF-8 bytes in blocks of ``size``, the last one padded with zeros."""
    letters = F.decode(F.coalesce(F.col("text"), F.lit("")).cast("binary"), "ISO-8859-1")  # a character a byte
    rows = docs.select("doc_id", F.posexplode(_pieces(letters, size)).alias("n", "piece"))
    return rows.select("doc_id", "n", F.rpad(F.encode("piece", "ISO-8859-1"), size, F.unhex(F.lit("00"))).alias("data"))


def write_stream(requests: DataFrame, size: int = 4096) -> DataFrame:
    """Requests (seq, offset, length, op) split by block: lbn, first byte and bytes within it, and whether it is partial."""
    first = F.call_function("div", F.col("offset"), F.lit(size))
    last = F.call_function("div", F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1, F.lit(size))
    rows = requests.withColumn("lbn", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("offset") - F.col("lbn") * size, F.lit(0))
    stop = F.least(F.col("offset") + F.col("length") - F.col("lbn") * size, F.lit(size))
    return rows.withColumns({"at": start, "bytes": stop - start}).withColumn("partial", F.col("bytes") < size)


def mapping_journal(lineitem: DataFrame) -> DataFrame:
    """lbn, pbn and ``point``, a struct that orders all writes; those that share one write the same mapping to the same block."""
    lbn, pbn = F.col("l_partkey").alias("lbn"), (F.col("l_suppkey") + 1).alias("pbn")
    return lineitem.select(lbn, pbn, F.struct("l_shipdate", "l_orderkey", "l_linenumber", lbn, pbn).alias("point"))


def index_requests(events: DataFrame) -> DataFrame:
    """seq, key, op, metadata and ts of each request."""
    ops = F.create_map(*[F.lit(x) for kv in REQUESTS.items() for x in kv])
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), ops[F.col("event_type")].alias("op"), F.col("value").alias("metadata"), "ts").filter("op is not null")
