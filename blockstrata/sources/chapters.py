"""Chapter files: a table partitioned by chapter, its bounds and saved states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_chapters(records: DataFrame, path: str) -> None:
    """Write closed chapters, one folder each, records in name order. Replaces chapters written before."""
    own = records.repartition("chapter", F.pmod(F.xxhash64("name"), F.lit(16))).sortWithinPartitions("chapter", "name")
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chapter").parquet(path)


def read_chapters(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records of a range of chapters; other folders are not opened."""
    df = spark.read.parquet(path)
    df = df if first is None else df.filter(F.col("chapter") >= first)
    return df if last is None else df.filter(F.col("chapter") <= last)


def probe_chapters(records: DataFrame, place=None) -> DataFrame:
    """Records of each physical chapter, the virtual one (``vcn``) that its headers name, and whether that belongs there.

    ``place`` gives the physical chapter of a virtual one. A chapter whose headers differ is not valid.
    """
    own = records.groupBy("chapter").agg(F.count("*").alias("records"), F.min("vcn").alias("vcn"), F.max("vcn").alias("last"))
    belongs = place(F.col("vcn")) == F.col("chapter") if place is not None else F.lit(True)
    return own.withColumn("valid", (F.col("vcn") == F.col("last")) & belongs).drop("last")


def bounds(records: DataFrame) -> DataFrame:
    """The lowest and highest chapter."""
    return records.agg(F.min("chapter").alias("lowest"), F.max("chapter").alias("highest"))


def latest_save(saves: DataFrame, *index: str) -> DataFrame:
    """The latest valid saved state (save, timestamp, valid) of each index: the one to load."""
    return saves.filter("valid").groupBy(*index).agg(F.max_by("save", F.struct("timestamp", "save")).alias("save"), F.max("timestamp").alias("timestamp"))


def oldest_save(saves: DataFrame, *index: str) -> DataFrame:
    """The slot of each index to write next: an invalid one first, else the oldest."""
    return saves.groupBy(*index).agg(F.min(F.struct("valid", "timestamp", "save")).alias("s")).select(*index, "s.save")


def reload_open(records: DataFrame, zones: int, capacity: int, zone) -> DataFrame:
    """Live records of a saved open chapter dealt to other zones; what a full zone cannot hold is dropped."""
    own = records.filter(~F.col("deleted")).withColumn("zone", zone % zones)
    n = F.row_number().over(Window.partitionBy("zone").orderBy("record_no"))
    return own.withColumn("n", n).filter(F.col("n") <= capacity).drop("n")  # ranked before the shuffle already
