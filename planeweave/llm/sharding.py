"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document.  A bucket is split on
one more bit only while it is over the byte limit, so shards have different depths and each
holds at most the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm.common import prepare, stored

SHARD_BYTES = 32 << 20
HASH_BITS = 60
SPARE_BITS = 3           # bits beyond those an even split needs, counted in one pass
MORE_BITS = 8            # bits by which buckets that are still too large are counted again


def key_of():
    """60 bits of a hash of the id; a row without an id goes by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t:"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _prefix(bits, h="h"):
    return F.shiftright(h, HASH_BITS - bits)


def _leaves(cells: DataFrame, start: int, bits: int, limit: int) -> DataFrame:
    """Depth of the bucket that each cell of `bits` bits falls into, null where even the cell
    is too large.  A cell whose rows share one hash cannot be split and is a bucket as it is."""
    paths = (cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(bits))))
             .withColumn("node", F.expr(f"shiftright(cell, {bits} - depth)")))
    sums = paths.groupBy("depth", "node").agg(
        F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = sums.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "node")
    depth = paths.join(fits, ["depth", "node"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(depth, "cell", "left")


def directory(keys: DataFrame, limit: int = SHARD_BYTES) -> list[tuple[int, DataFrame]]:
    """Directory tables (bits, table of cell and depth) for rows of h and bytes.

    The first one counts all rows by so many bits as an even split needs and a few more.  Rows
    of cells that are still too large are counted again by more bits, until none is left: each
    table's null depths lead to the next.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(0, (total // limit).bit_length()) + SPARE_BITS)
    tables, start, rows = [], 0, keys
    while True:
        cells = rows.groupBy(_prefix(bits).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        found = stored(_leaves(stored(cells, "shard-cells"), start, bits, limit), "shard-directory")
        tables.append((bits, found))
        large = found.where("depth IS NULL").select("cell")
        if bits == HASH_BITS or large.limit(1).count() == 0:
            return tables
        rows = rows.withColumn("cell", _prefix(bits)).join(large, "cell", "left_semi").drop("cell")
        start, bits = bits + 1, min(HASH_BITS, bits + MORE_BITS)


def placed(rows: DataFrame, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """`rows` (with h) and the depth of the bucket of each; Spark broadcasts a directory table
    only while its files are small."""
    for k, (bits, table) in enumerate(tables):
        own = table.where("depth IS NOT NULL").select(F.col("cell").alias(f"_cell{k}"), F.col("depth").alias(f"_depth{k}"))
        rows = rows.join(own, _prefix(bits) == F.col(f"_cell{k}"), "left")
    names = [f"_depth{k}" for k in range(len(tables))]
    return rows.withColumn("depth", F.coalesce(*[F.col(n) for n in names], F.lit(HASH_BITS))).drop(
        *names, *[f"_cell{k}" for k in range(len(tables))])


def _shard():
    return F.expr(f"substring(lpad(bin(h), {HASH_BITS}, '0'), 1, depth)")


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, shard, depth, bytes, shard_bytes), one row per row of `docs`.

    `shard` is the bucket's bits, '' while all fits one shard.  A null text has no bytes.  Rows
    of equal id, and a document above the limit by itself, cannot be split: only their bucket
    may exceed the limit.  Rows without an id are placed by their text.
    """
    prepare(docs.sparkSession)
    keys = stored(docs.select("doc_id", key_of().alias("h"),
                              F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "shard-keys")
    rows = placed(keys, directory(keys.select("h", "bytes"), limit)).withColumn("shard", _shard())
    sizes = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return rows.join(sizes, "shard").select(
        "doc_id", "shard", F.col("depth").cast("long").alias("depth"), "bytes", "shard_bytes")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents with the shard that each is written to, in a column
    `shard`; an input column of that name is called `shard_in`."""
    prepare(spark)
    keys = stored(docs.select(key_of().alias("h"),
                              F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "shard-keys")
    row = [F.col(f"`{c}`").alias("shard_in" if c.lower() == "shard" else c) for c in docs.columns]
    rows = docs.select(F.struct(row).alias("_row"), key_of().alias("h"))
    return placed(rows, directory(keys)).select("_row.*", _shard().alias("shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard; a shard's rows are gathered before writing."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE = f"""
WITH k AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), {HASH_BITS}, '0') AS b
  FROM documents),
p AS (SELECT k.*, d.depth, substr(b, 1, d.depth) AS node FROM k, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth) d),
s AS (SELECT depth, node, sum(bytes)::BIGINT AS shard_bytes FROM p GROUP BY depth, node
      HAVING sum(bytes) <= {SHARD_BYTES} OR min(b) = max(b)),
f AS (SELECT p.doc_id, p.b, p.bytes, min(p.depth) AS depth FROM p JOIN s USING (depth, node) GROUP BY ALL)
SELECT f.doc_id, substr(f.b, 1, f.depth) AS shard, f.depth::BIGINT AS depth, f.bytes, s.shard_bytes
FROM f JOIN s ON s.depth = f.depth AND s.node = substr(f.b, 1, f.depth)
"""
