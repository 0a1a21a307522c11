"""Pieces that the training-data operators share."""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.session import shared_folder, tune

BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings; Arrow batches are kept short because one row can be a long text."""
    tune(spark)
    # Workers import this package from where the driver did, unless it is installed there.
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), home]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Tables that several steps read are written out, so shuffle files can go with their query.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: later steps start from the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of `stored` tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_fold(doc_id, folds: int = 5):
    """True for rows of the held-out fold: crc32 of the id as text, modulo `folds`, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def rows_of(it, *columns):
    """The rows of Arrow batches, column by column as Python lists."""
    for batch in it:
        yield tuple(batch.column(c).to_pylist() for c in columns)


def grouped(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """Rows that `fn` makes of each group, a dict of column lists.

    For many small groups of bounded size: a task goes through its sorted rows and holds one
    group at a time.
    """
    import pyarrow as pa

    names = df.columns

    def run(it):
        held: dict[str, list] | None = None
        for batch in it:
            columns = {c: batch.column(c).to_pylist() for c in names}
            at = list(zip(*(columns[k] for k in keys)))
            cuts = [0, *(k for k in range(1, len(at)) if at[k] != at[k - 1]), len(at)]
            made = []
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = {c: v[start:end] for c, v in columns.items()}
                if held is not None and tuple(held[k][0] for k in keys) == at[start]:
                    for c in names:
                        held[c] += part[c]
                    continue
                if held is not None:
                    made += fn(held)
                held = part
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in made], schema=schema)
        made = fn(held) if held is not None else []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in made], schema=schema)

    ddl = ", ".join(f"{f.name} {'long' if f.type == 'int64' else 'double'}" for f in schema)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


# Hashing of words in numpy.  A word's value is its polynomial hash, so that one running
# sum over the bytes of a text gives the hash of every word.
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("i", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["i"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes, blank_bytes: np.ndarray = BLANK) -> np.ndarray:
    """64-bit hashes of the words of `data` in order; words are runs free of the marked bytes,
    which are ASCII blanks by default."""
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    blank = blank_bytes[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=run[1:])
    value = (run[ends] - run[starts]) * inverse[starts]
    return mixed(value + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width`-word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        factor = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % (1 << 64))
        total = mixed(total * factor + words[k:len(words) - width + 1 + k])
    return np.unique(total)
