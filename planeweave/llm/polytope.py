"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A hash is the axis, with its sign, that a randomly rotated vector lies closest to; a bucket is
a few such hashes.  Every vector is put into its own bucket and into the next likely ones of
every table.  Vectors that share a bucket are compared by exact cosine, which gives the
components; links are then counted inside each component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.bbit import Forest
from planeweave.llm.common import grouped, mixed, prepare, rows_of, stored
from planeweave.llm.components import components

TABLES, HASHES, PROBES = 12, 3, 6
LEAST_COSINE = 0.9
BLOCK_ROWS = 2_048       # vectors in one block of a crowded bucket or component
_SEED = 20_240_611


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; rows are padded to a power
    of two."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    draw = np.random.RandomState(seed % (1 << 32))
    for _ in range(3):
        y *= draw.randint(0, 2, size) * 2 - 1
        half = 1
        while half < size:
            z = y.reshape(n, size // (2 * half), 2, half)
            y = np.concatenate((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(n, size)
            half *= 2
        y /= np.sqrt(size)
    return y


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket keys of each unit vector: in every table its own one and the `probes` next."""
    n, d = x.shape
    out = []
    rows = np.arange(n)[:, None]
    for table in range(tables):
        codes, losses = [], []
        for h in range(hashes):
            y = rotated(x, _SEED + 1000 * table + h)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :3]
            height = size[rows, top]
            codes.append(top * 2 + (y[rows, top] < 0))
            losses.append((height[:, :1] - height) ** 2)
        # Changes of one hash to its second or third axis, and of two hashes to their second.
        choices = [[0] * hashes]
        for h in range(hashes):
            for rank in range(1, codes[h].shape[1]):
                choices.append([rank if k == h else 0 for k in range(hashes)])
            choices += [[1 if k in (h, g) else 0 for k in range(hashes)] for g in range(h)]
        choices = [c for c in choices if max(c) < codes[0].shape[1]]
        loss = np.stack([sum(losses[h][:, c[h]] for h in range(hashes)) for c in choices], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes + 1]
        keys = np.zeros((n, len(choices)), np.uint64)
        for k, c in enumerate(choices):
            value = np.full(n, (table * 65_536 + d) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for h in range(hashes):
                value = mixed(value + codes[h][:, c[h]].astype(np.uint64))
            keys[:, k] = value
        out.append(keys[rows, order])
    return np.concatenate(out, axis=1).view(np.int64)


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, vec): the bytes of usable vectors, null for all others."""
    def pack(it):
        for ids, values in rows_of(it, "vec_id", "embedding"):
            digest, data = [], []
            for v in values:
                x = np.array(v, float) if v and None not in v else np.zeros(0)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    digest.append(None), data.append(None)
                    continue
                data.append((x + 0.0).tobytes())
                digest.append(hashlib.md5(data[-1]).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array(data, pa.binary())],
                ["vec_id", "digest", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")
                          .alias("embedding")).mapInArrow(pack, "vec_id long, digest binary, vec binary")


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data)).reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Rows of `members` once for each pair of blocks of their group that they are in."""
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    return (members.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
            .drop("other", "blocks"))


def duplicates(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, hashes: int = HASHES,
               probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    Linked are vectors of the same length whose cosine, in double precision, is at least
    `least`; equal vectors are linked.  Null, empty and zero vectors and those with null or
    non-finite components are linked with nothing.  A null vec_id gives a null component and
    is kept and not counted.  Rows that repeat a vec_id count as one node.  Labels and further
    columns are not read; an empty table gives an empty result.
    """
    prepare(vectors.sparkSession)
    packed = stored(_vectors(vectors), "polytope-vectors")
    classes = stored(packed.where("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "polytope-classes")

    def place(it):
        for reps, data in rows_of(it, "rep", "vec"):
            lengths = np.array([len(v) for v in data])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                keys = buckets(_unit([data[k] for k in at]), tables, hashes, probes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(reps)[at], keys.shape[1])), pa.array(keys.ravel())], ["rep", "bucket"])

    met = classes.select("rep", "vec").mapInArrow(place, "rep long, bucket long").distinct()
    met = stored(met, "polytope-buckets")
    crowded = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    # Members of one bucket, or of several with the same members, are compared once.
    inside = met.join(crowded, "bucket")
    alike = inside.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"),
                                         F.min("rep").alias("lowest"), F.max("rep").alias("highest"))
    once = alike.groupBy("n", "s", "lowest", "highest").agg(F.min("bucket").alias("bucket")).select("bucket")
    placed = _blocks(inside.join(once, "bucket"), "bucket").join(classes.select("rep", "vec"), "rep")

    def link(rows: dict) -> list[tuple[int, int]]:
        # A chance collision of keys can bring vectors of different length together.
        made, rep = [], rows["rep"]
        lengths = np.array([len(v) for v in rows["vec"]])
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            x = _unit([rows["vec"][k] for k in at])
            forest = Forest(len(at))
            for k in range(0, len(at), 512):
                i, j = np.nonzero(x[k:k + 512] @ x.T >= least)
                i = i + k
                for p, q in zip(i[i < j].tolist(), j[i < j].tolist()):
                    if forest.union(p, q):
                        made.append((rep[at[p]], rep[at[q]]))
        return made

    links = grouped(placed, ["bucket", "low", "high"], link, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    joined = stored(components(links, "polytope-components").distinct(), "polytope-members")
    members = classes.join(joined, classes["rep"] == joined["node"]).select("rep", "component", "vec", "weight")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        rep, weight = group["rep"].to_numpy(), group["weight"].to_numpy().astype(float)
        own, crossing = group["own"].to_numpy(), group["low"].iat[0] != group["high"].iat[0]
        total = np.zeros(len(rep))
        x = _unit(group["vec"].tolist())
        for k in range(0, len(rep), 512):
            near = x[k:k + 512] @ x.T >= least
            rows = np.arange(len(near))
            near[rows, rows + k] = False
            if crossing:
                near &= own[k:k + 512, None] != own[None, :]
            total[k:k + 512] = near @ weight
        return pd.DataFrame({"rep": rep, "others": total.astype(np.int64)})

    counted = (_blocks(members, "component").groupBy("component", "low", "high")
               .applyInPandas(count, "rep long, others long")
               .groupBy("rep").agg(F.sum("others").alias("others")))
    found = (classes.select("digest", "rep", "weight").join(joined, classes["rep"] == joined["node"], "left")
             .join(counted, "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("found"),
                     (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    named = F.col("vec_id").isNotNull()
    return (packed.select("vec_id", "digest").join(found, "digest", "left")
            .select("vec_id", F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                    F.when(named, F.coalesce("found", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
