"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
import pytest
from conftest import DATA

from blockstrata.llm import contamination, pii, quality
from blockstrata.runtime import table_dir


def test_stages(spark, tmp_path):
    from test_corpus_operators import plain_near

    docs = table_dir(spark, DATA, "documents")
    names = docs.columns
    df, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, DATA).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in df.collect()})
        assert k == 4 or df.columns == names
    start = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, table_dir(spark, DATA, "labels"))
    good = {i for i, t in start.items() if model.scores([quality.features(t)])[0] >= quality.CUT}
    assert set(kept[0]) == good
    groups = plain_near([(i, start[i]) for i in good], 5, 80)
    assert set(kept[1]) == {i for _, i, _, _, own in groups if own}
    scanner = contamination.Scanner([(r.item_id, r.text) for r in table_dir(spark, DATA, "benchmark").collect()])
    assert set(kept[2]) == {i for i in kept[1] if not scanner.scan(start[i])[2]}
    assert {i: r.text for i, r in kept[3].items()} == {i: pii.mask(start[i]) for i in kept[2]}
    assert {i: bytes(r.decoded).decode() for i, r in kept[4].items()} == {i: r.text for i, r in kept[3].items()}
    assert corpus_pipeline.run(spark, DATA).count() == len(kept[4]) > 0


def test_stages_of_awkward_rows(spark):
    from test_corpus_operators import SCHEMA, awkward

    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS _k", "1 AS rep", "2 AS root", "3 AS id", "text AS ids")
    table = lambda df: sorted(map(repr, df.select("doc_id", "text", "kept", "component_id").collect()))
    stage = dict(corpus_pipeline.STAGES)
    for name, f in list(stage.items())[:4]:
        out = f(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert set(table(out)) <= set(table(docs)), name  # nothing here is personal data
    leaks = stage["decontamination"](spark, docs, DATA)
    assert table(leaks) == table(docs)
    assert table(stage["pii"](spark, docs, DATA)) == table(docs)
    near = stage["near_duplicates"](spark, docs, DATA)
    left = [(r.doc_id, r.text) for r in near.collect()]
    assert {i for i, t in left if not (t or "").split()} == {r[0] for r in rows if not (r[1] or "").split()}  # without words, nothing is near
    assert (None, "null id here") in left and left.count((3, rows[3][1])) == 2  # a repeated row stays with its like
    tokens = stage["bpe"](spark, docs, DATA)
    assert tokens.count() == len(rows) and {r.doc_id: bytes(r.decoded).decode() for r in tokens.collect()} == {r[0]: r[1] or "" for r in rows}


@pytest.mark.parametrize("at", range(5))
def test_stages_of_an_empty_table(spark, at):
    docs = table_dir(spark, DATA, "documents").limit(0)
    name, f = corpus_pipeline.STAGES[at]
    out = f(spark, docs, DATA)
    assert out.count() == 0 and (at == 4 or out.columns == docs.columns), name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table_dir(spark, DATA, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
