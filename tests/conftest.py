import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


DATA = "/root/testdata/sf0.001"


def views(sf_dir=DATA):
    """A DuckDB connection with the driver's tables."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(spark_df, sql, con):
    """Whether a DataFrame and SQL give the same rows, columns by name."""
    rel = con.sql(sql)
    names = sorted(spark_df.columns)
    assert names == sorted(rel.columns)

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) is False and hasattr(v, "__index__") else v

    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in spark_df.collect())
    at = [rel.columns.index(c) for c in names]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    assert got == want
