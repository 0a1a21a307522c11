"""The store of past incidents as append-only JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave import schemas
from planeweave.operators import memory
from planeweave.session import read_if_there


def parse_lines(lines: DataFrame) -> DataFrame:
    """Episodes from text lines (`value`); blank, corrupt or invalid lines drop."""
    parsed = lines.withColumn("e", F.from_json("value", schemas.EPISODES,
                                               {"mode": "PERMISSIVE"}))
    kept = [c for c in lines.columns if c != "value"]
    return memory.valid(parsed.select(*kept, "e.*"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored episodes; a store that does not exist is empty.

    Lines end at a line feed only: other separators are data.
    """
    lines = read_if_there(lambda: spark.read.option("lineSep", "\n").text(path))
    return spark.createDataFrame([], schemas.EPISODES) if lines is None else parse_lines(lines)


def append(episodes: DataFrame, path: str) -> None:
    """Append valid episodes, one JSON record per line."""
    memory.valid(episodes).select(
        "incident_type", "narrative", "cited_evidence",
        F.coalesce("created_at", F.current_timestamp()).alias("created_at"),
    ).write.mode("append").option("ignoreNullFields", "false").json(path)


def remember(batch: DataFrame, path: str, order: str) -> DataFrame:
    """Consolidate a batch into the store and return what was written."""
    from planeweave.session import cut_lineage

    fresh = cut_lineage(memory.consolidate(batch, read_store(batch.sparkSession, path), order))
    append(fresh, path)
    return fresh


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ground truth, one JSON file per scenario, named after it (V7)."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    read = spark.read.schema("incident_type string, scenario string").option(
        "multiLine", True).json(paths)
    return read.select("incident_type", F.coalesce(
        "scenario", F.regexp_replace(name, r"\.label\.json$", "")).alias("scenario"))
