"""Session helpers shared by the operators: worker code, checkpoints, sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Executors may run elsewhere without this source tree, so a zip of it goes
    through Spark's own file distribution.
    """
    sc = spark.sparkContext
    if getattr(sc, "_blockstrata_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="blockstrata"), "blockstrata_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(path)
    sc._blockstrata_shipped = True


def java_class(spark: SparkSession, source: Path, name: str):
    """An instance of a class of a Java source file, which executors can load; compiled once per application.

    The compiler is the one that Spark brings along for its own code. The classes go
    through Spark's file distribution as a jar.
    """
    sc = spark.sparkContext
    done = sc.__dict__.setdefault("_blockstrata_java", {})
    if source not in done:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jsc.getClass().getClassLoader())
        compiler.cook(source.read_text())
        path = os.path.join(tempfile.mkdtemp(prefix="blockstrata"), f"{source.stem}.jar")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for key, code in compiler.getBytecodes().items():
                z.writestr(key.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path)
        done[source] = compiler.getClassLoader()
    return done[source].loadClass(name).getDeclaredConstructor(sc._gateway.new_array(sc._jvm.Class, 0)).newInstance(sc._gateway.new_array(sc._jvm.Object, 0))


def java_column(spark: SparkSession, source: Path, name: str, kind: str, *columns: Column) -> Column:
    """What a Java UDF of a source file makes of columns; ``kind`` is the type of the result."""
    known = "blockstrata_" + name.replace(".", "_").replace("$", "_").lower()
    if not spark.catalog.functionExists(known):
        udf = java_class(spark, source, name)
        spark._jsparkSession.udf().register(known, udf, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
    return F.call_function(known, *columns)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python operators receive, by rows and bytes; the same for all, since the session holds them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="blockstrata-checkpoint"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` gave and that nothing reads any more."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table_dir(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
