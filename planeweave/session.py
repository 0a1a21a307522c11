"""Session settings every job of this package relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# A lookup join meets one row per key on one side and may meet a hot key on the
# other.  Adaptive execution splits such a hot partition; forcing it keeps the
# split even where a later step has to shuffle again.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (all are per-session SQL settings)."""
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("planeweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster's `spark.checkpoint.dir` is used when it is set; only a local
    session without one (a test) gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="planeweave-checkpoint-"))
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` to the shared folder, so later steps start from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again: later steps start from
    the files, read only the columns they need, and Spark knows the size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What `read` gives, or None when its path does not exist; any other error is one."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
