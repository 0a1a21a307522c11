"""Reports on disk: one text document per run, written from the line table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = ["incident_no", "section", "line_no"]


def write_documents(lines: DataFrame, path: str) -> None:
    """Write the report lines of every run, in order, as one file under `path`/run_id=....

    A task sorts whole runs, on disk where need be, and streams them out, so no document is held
    in memory; the files appear when the job commits.  Blank lines at a document's end go, and it
    ends with one line feed.
    """
    place = F.struct(*_PLACE)
    ends = lines.filter(F.rtrim("text") != "").groupBy("run_id").agg(F.max(place).alias("_last"))
    kept = lines.join(ends, "run_id").filter(place <= F.col("_last")).withColumn(
        "text", F.when(place == F.col("_last"), F.regexp_replace("text", r"\n+$", "")).otherwise(F.col("text")))
    (kept.repartition("run_id").sortWithinPartitions("run_id", *_PLACE).select("run_id", "text")
     .write.partitionBy("run_id").option("lineSep", "\n").text(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, document) of written reports."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("run_id").cast("string").alias("run_id"), F.col("value").alias("document"))
