import pytest
from pyspark.sql import functions as F

from blockstrata.operators import dedupe as D
from blockstrata.operators import ordering as O
from blockstrata.operators import stats as S
from blockstrata.session import Engine, IndexSession, SessionError

REQ = "seq long, key long, op string, metadata double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_index_session(spark, tmp_path):
    s = IndexSession(spark, str(tmp_path / "i"))
    with pytest.raises(SessionError):
        s.open("no_rebuild")
    s.open("create")
    one = spark.createDataFrame([(1, 7, "POST", 1.0), (2, 8, "UPDATE", 2.0), (3, 7, "QUERY", None)], REQ)
    seen = []
    assert rows(s.ask(one, seen.append), "seq", "found") == [(1, False), (2, False), (3, True)] and len(seen) == 1
    s.suspend()
    with pytest.raises(SessionError):
        s.ask(one)
    s.resume()
    two = spark.createDataFrame([(4, 8, "DELETE", None), (5, 7, "UPDATE", 5.0), (6, 8, "QUERY", None)], REQ)
    assert rows(s.ask(two), "seq", "found", "old_metadata") == [(4, True, 2.0), (5, True, 1.0), (6, False, None)]
    assert sum(r.requests for r in s.stats().collect()) == 3
    s.close()
    again = IndexSession(spark, str(tmp_path / "i")).open("load")
    assert rows(again.held(), "key", "metadata") == [(7, 5.0)]


def test_index_session_over_many_saves(spark, tmp_path, monkeypatch):
    from blockstrata import session

    monkeypatch.setattr(session, "FULL", 3)
    s, want, seq = IndexSession(spark, str(tmp_path / "i")).open("create"), {}, 0
    for k in range(7):
        batch = [(seq, k % 3, "UPDATE", float(k)), (seq + 1, k, "POST", 0.5), (seq + 2, (k + 1) % 4, "DELETE", None)]
        seq += 3
        got = rows(s.ask(spark.createDataFrame(batch, REQ)), "seq", "found", "old_metadata")
        for (n, key, op, value), answer in zip(batch, got, strict=True):
            assert answer == (n, key in want, want.get(key))
            if op == "DELETE":
                want.pop(key, None)
            elif op == "UPDATE" or key not in want:
                want[key] = value
        if k != 4:
            s.flush()
    s.close()
    again = IndexSession(spark, str(tmp_path / "i")).open("load")
    assert rows(again.held(), "key", "metadata") == sorted(want.items())
    names = sorted(p.name for p in (tmp_path / "i").iterdir())
    assert [n for n in names if n.startswith("full")] == ["full-000001", "full-000004", "full-000007"]


def test_messages(spark, tmp_path):
    e = Engine("dm0", IndexSession(spark, str(tmp_path / "i")), lambda: spark.createDataFrame([(3, 4)], "written long, zeros long"), 100)
    e.message("index-create")
    e.message("compression", "on")
    assert e.message("stats").first()[0] == '{"written":3,"zeros":4}'
    assert rows(e.message("dump"), "counter", "value") == [("written", "3"), ("zeros", "4")]
    line = e.status(spark.createDataFrame([(5,)], "n long")).first()
    assert (line["index"], line.compression, line.used_blocks, line.total_blocks) == ("online", "online", 5, 100)
    e.message("index-disable")
    assert e.status(spark.createDataFrame([(5,)], "n long")).first()["index"] == "offline"
    with pytest.raises(SessionError):
        e.message("nonsense")


def test_outcomes(spark):
    b = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "a", "z"), (5, "b", "y"), (6, "c", "q")], "seq long, name string, data string")
    index = spark.createDataFrame([("b", 10), ("c", 11)], "name string, pbn long")
    stored = spark.createDataFrame([(10, "y"), (11, "other")], "pbn long, data string")
    got = dict(rows(D.outcomes(b, index, stored, ["seq"], 2), "seq", "outcome"))
    assert got == {1: "new", 2: "dup", 3: "rollover", 4: "collision", 5: "dup", 6: "stale"}


def test_queues_and_tallies(spark):
    a, b = spark.createDataFrame([(1, 0), (2, 1)], "id long, p int"), spark.createDataFrame([(3, 1)], "id long, p int")
    hit, rest = O.transfer(a, b, F.col("p") == 1)
    assert rows(hit, "id") == [(2,), (3,)] and rows(rest, "id") == [(1,)]
    assert O.transfer(a, b)[0].count() == 3
    z = spark.createDataFrame([(0, "r", 1), (1, "r", 2), (1, "w", 5)], "zone int, counter string, value long")
    assert rows(S.zone_tally(z), "counter", "value") == [("r", 3), ("w", 5)]
    acc = spark.createDataFrame([(1, "k"), (4, "k"), (5, "m")], "seq long, key string")
    assert rows(O.reuse_gap(acc, "key", "seq").filter("reuse is not null"), "seq", "reuse") == [(4, 3)]
    assert O.by_page(acc, "key", "seq").count() == 3
    assert O.notify_all(acc, lambda it: (d.assign(seq=d.seq + 1) for d in it), "seq long, key string").count() == 3


def test_streams(spark, tmp_path):
    from blockstrata.streaming import index_stream as ST

    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, seq long").coalesce(1).write.parquet(str(tmp_path / "b"))
    src = spark.readStream.schema("name string, seq long").parquet(str(tmp_path / "b"))
    q = ST.first_copies(src).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "o")), "seq", "is_duplicate") == [(1, False), (2, True), (3, False)]
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:20:00') t(name, ts)").coalesce(1).write.parquet(str(tmp_path / "t"))
    late = ST.recent_copies(spark.readStream.schema("name string, ts timestamp").parquet(str(tmp_path / "t")), "ts")
    late.writeStream.format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "c3")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(spark.sql("select * from recent"), "name") == [("a",), ("b",)]
    spark.sql("select 1L as chapter, 'n' as name").coalesce(1).write.parquet(str(tmp_path / "r"))
    q = ST.chapter_sink(spark.readStream.schema("chapter long, name string").parquet(str(tmp_path / "r")), str(tmp_path / "ch"), str(tmp_path / "cc")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ch")).count() == 1


def test_timeouts_stream(spark, tmp_path):
    from blockstrata.streaming import index_stream as ST

    q = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00'), (2L, timestamp'2024-01-01 00:00:01'), (3L, timestamp'2024-01-01 01:00:00') t(key, request_ts)")
    a = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:05'), (2L, timestamp'2024-01-01 00:00:07'), (9L, timestamp'2024-01-01 01:00:00') t(key, response_ts)")
    q.coalesce(1).write.parquet(str(tmp_path / "q"))
    a.coalesce(1).write.parquet(str(tmp_path / "a"))
    late = ST.timeouts(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")), spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")))
    w = late.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert rows(spark.sql("select * from late"), "key") == [(2,)]
