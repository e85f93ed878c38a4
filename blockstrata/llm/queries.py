"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockstrata.runtime import table_dir


def vocabulary(name: str) -> Callable[[], str]:
    """The path of a public tokenizer file, found on the machine that asks."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def split_pattern() -> str:
    """The pattern that goes with the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import topk as m

    return m.top_k(table_dir(spark, sf_dir, "embeddings"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import licenses as m

    return m.find_licenses(table_dir(spark, sf_dir, "documents"))


def op3_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import passages as m

    return m.document_links(table_dir(spark, sf_dir, "documents"))


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import contamination as m

    return m.contamination(table_dir(spark, sf_dir, "documents"), table_dir(spark, sf_dir, "benchmark")).drop("hit_chars")  # SQL has no offsets of words


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import tokenfile as m

    return m.round_trip(table_dir(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import bpe as m

    return m.digest_documents(table_dir(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import tokencount as m

    return m.count_documents(table_dir(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import pii as m

    return m.summary(table_dir(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import neardup as m

    return m.near_duplicates(table_dir(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockstrata.llm import quality as m

    docs = table_dir(spark, sf_dir, "documents")
    return m.score(docs, m.fit(docs, table_dir(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the subpackage by name."""
    return {f.__name__: f for f in (op1_top_k, op2_licenses, op3_shared_passages, op4_contamination, op5_token_files, op6_bpe, op7_token_counts, op8_pii, op9_near_duplicates, op10_quality)}


OP1_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), patterns AS (
  SELECT DISTINCT item_id, w[k : k + least(8, len(w)) - 1] AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT len(p) AS n FROM patterns
), places AS (
  SELECT doc_id, n, k, w[k : k + n - 1] AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, n, k FROM places JOIN patterns USING (p)
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY 1
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(k - 1, k - 1 + n)) AS place FROM (SELECT DISTINCT doc_id, n, k FROM found)
), runs AS (
  SELECT doc_id, min(place) AS s, max(place) + 1 AS e FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS g FROM hit) GROUP BY doc_id, g
), spans AS (
  SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_hit, string_agg(s || ',' || e, ',' ORDER BY s) AS hit_words FROM runs GROUP BY 1
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated, coalesce(hit_words, '') AS hit_words
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_in JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_in.n >= 80 * (x.n + y.n - both_in.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = d.doc_id AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express over whole tables."""
    return {"op1_top_k": OP1_SQL, "op4_contamination": OP4_SQL, "op9_near_duplicates": OP9_SQL}
