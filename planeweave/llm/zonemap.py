"""Centroid clustering over zone maps of Hilbert-ordered vectors.

Vectors become vectors of integers, are laid along a Hilbert curve and cut into blocks, each
with the box of its least and largest components.  A round sends the centroids to the blocks:
no centroid whose least distance to a box exceeds another's largest one can be nearest to any vector in
it, the others are compared with all its vectors at once.  Only sums for each centroid leave the tasks.
All arithmetic is exact; nothing but centroids and their sums passes the driver.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import prepare, rows_of, stored

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
CURVE_BITS = 4           # bits of each component on the curve
BLOCK_ROWS = 250
NARROW = 1 << 27         # components up to here are compared in 64-bit integers
_SHORT = 1 << 15         # and up to here are stored in two bytes
_LIMB = 32               # bits of one part of a sum


def packed(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec) of the vectors with `dimensions` finite components.

    `vec` holds the integers floor(scale * x) in two bytes each where all are short, else the
    components themselves as doubles.
    """
    def pack(it):
        for ids, values in rows_of(it, "vec_id", "embedding"):
            kept, data = [], []
            for key, v in zip(ids, values):
                if v is None or len(v) != dimensions or None in v:
                    continue
                x = np.array(v, float)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    whole = np.floor(x * scale)
                short = (np.abs(whole) < _SHORT).all()
                kept.append(key)
                data.append((whole.astype(np.int16) if short else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        pack, "vec_id long, vec binary")


def integers(data: list[bytes], dimensions: int, scale: int) -> np.ndarray:
    """The integer vectors of packed ones: 64-bit where all components are narrow, else Python's."""
    out = np.empty((len(data), dimensions), np.int64)
    wide: dict[int, list[int]] = {}
    for k, v in enumerate(data):
        if len(v) == 2 * dimensions:
            out[k] = np.frombuffer(v, np.int16)
            continue
        x = np.frombuffer(v)
        if (np.abs(x) < NARROW / scale).all():
            out[k] = np.floor(x * scale)
        else:
            wide[k] = [math.floor(Fraction(c) * scale) for c in x.tolist()]
    if wide:
        out = out.astype(object)
        for k, row in wide.items():
            out[k] = row
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of each cell (a row of unsigned numbers of so many bits) on the Hilbert curve.

    The curve visits the halves of each axis in the order of a Gray code; going from coarse to
    fine bits, the axes are mirrored or swapped so that neighbouring parts of the curve touch.
    """
    axis = cells.T.astype(np.uint32).copy()
    d = len(axis)
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for k in range(d):
            upper = (axis[k] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(upper, np.uint32(0), (axis[0] ^ axis[k]) & below)
            axis[0] ^= np.where(upper, below, swap)
            axis[k] ^= swap
    for k in range(1, d):
        axis[k] ^= axis[k - 1]
    turn = np.zeros(len(cells), np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axis[d - 1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    axis ^= turn
    digits = np.stack([(axis >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(digits.transpose(2, 0, 1).reshape(len(cells), -1).astype(np.uint8), axis=1)]


def _floats(data: list[bytes], dimensions: int, scale: int) -> np.ndarray:
    """Components near enough for a place on the curve."""
    x = integers(data, dimensions, scale)
    return np.array([[min(max(c, -10 ** 300), 10 ** 300) for c in row] for row in x], float) if x.dtype == object else x.astype(float)


def _edges(vectors: DataFrame, dimensions: int, scale: int) -> np.ndarray:
    """Least and largest value of every component."""
    def span(it):
        low, high = np.full(dimensions, np.inf), np.full(dimensions, -np.inf)
        for (data,) in rows_of(it, "vec"):
            if data:
                x = _floats(data, dimensions, scale)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(low), pa.array(high)],
                                         ["place", "low", "high"])

    rows = (vectors.select("vec").mapInArrow(span, "place long, low double, high double")
            .groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect())
    return np.array([[r.low for r in rows], [r.high for r in rows]])


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(ids, vecs, low, high): packed vectors in Hilbert order, about BLOCK_ROWS a block, and the
    box of each block; blocks with components that are not narrow have no box."""
    low, high = _edges(vectors, dimensions, scale)
    step = np.where(high > low, (high / 2 - low / 2) / (1 << CURVE_BITS - 1), 1.0)

    def place(it):
        for ids, data in rows_of(it, "vec_id", "vec"):
            if not ids:
                continue
            cells = np.floor((_floats(data, dimensions, scale) / 2 - low / 2) / step * 2)
            keys = hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(keys, pa.binary())],
                ["vec_id", "vec", "place"])

    def cut(it):
        for ids, data in rows_of(it, "vec_id", "vec"):
            made = []
            for at in range(0, len(ids), BLOCK_ROWS):
                x = integers(data[at:at + BLOCK_ROWS], dimensions, scale)
                narrow = x.dtype != object
                made.append({"ids": ids[at:at + BLOCK_ROWS], "vecs": data[at:at + BLOCK_ROWS],
                             "low": x.min(axis=0).tolist() if narrow else None,
                             "high": x.max(axis=0).tolist() if narrow else None})
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([
                ("ids", pa.list_(pa.int64())), ("vecs", pa.list_(pa.binary())),
                ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]))

    # Equal vectors share a place; their ids tell them apart, so that a crowd of copies is split.
    laid = (vectors.mapInArrow(place, "vec_id long, vec binary, place binary")
            .withColumn("tie", F.xxhash64("vec_id")))
    return stored(laid.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
                  .select("vec_id", "vec").mapInArrow(
                      cut, "ids array<long>, vecs array<binary>, low array<long>, high array<long>"), "zonemap-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to a vector in the box: none is surely farther than another."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    across = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((outside ** 2).sum(axis=1) <= (across ** 2).sum(axis=1).min())


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; of equal ones the first."""
    away = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    which = away.argmin(axis=1)
    return which, away[np.arange(len(x)), which]


def _assigned(batches, centroids: list[list[int]], dimensions: int, scale: int):
    """(ids, vectors, cluster, distance) of each block."""
    wide = any(abs(c) >= NARROW for row in centroids for c in row)
    centre = np.array(centroids, dtype=object if wide else np.int64)
    for ids, data, lows, highs in rows_of(batches, "ids", "vecs", "low", "high"):
        for block_ids, vecs, low, high in zip(ids, data, lows, highs):
            x = integers(vecs, dimensions, scale)
            near = np.arange(len(centre))
            if low is not None and not wide:
                near = candidates(np.array(low), np.array(high), centre)
            which, distance = nearest(x, centre[near])
            yield block_ids, x, near[which], distance


def _limbs(value: int):
    """Parts of an integer of any size whose sums fit 64 bits: the number is the sum of
    part * 2 ** (32 * k)."""
    k = 0
    while not -(1 << _LIMB - 1) <= value < 1 << _LIMB - 1:
        yield k, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        k += 1
    yield k, value


def _sums(laid: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of the vectors nearest to each centroid."""
    def add(it):
        count = [0] * len(centroids)
        total = np.zeros((len(centroids), dimensions), object)
        for _, x, which, _ in _assigned(it, centroids, dimensions, scale):
            for c in np.unique(which).tolist():
                mine = x[which == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0).astype(object)
        rows = [(c, place, k, part) for c in range(len(centroids)) if count[c]
                for place, value in enumerate([count[c], *total[c].tolist()]) for k, part in _limbs(int(value))]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(4)],
                                         ["cluster", "place", "k", "part"])

    rows = (laid.mapInArrow(add, "cluster long, place long, k long, part long")
            .groupBy("cluster", "place", "k").agg(F.sum("part").alias("part")).collect())
    sums = {c: [0] * (dimensions + 1) for c in {r.cluster for r in rows}}
    for r in rows:
        sums[r.cluster][r.place] += r.part << (_LIMB * r.k)
    return {c: (values[0], values[1:]) for c, values in sums.items()}


def _as_long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector
    that has `dimensions` components, all finite; the others are left out.

    Components become floor(scale * x).  The first centroids are the `k` vectors whose
    sha256 of `seed:vec_id` is smallest (of repeated ids the smaller bytes first, null ids last),
    fewer where there are fewer vectors.  Each round assigns every vector to its nearest centroid, of
    equal ones the lower number, and moves centroids to the floor of their vectors' mean; a
    centroid without vectors stays.  Repeated rows count each.  Components of any size are exact; a
    distance or inertia beyond 64 bits is null.  Further columns are not read; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    usable = stored(packed(vectors, dimensions, scale), "zonemap-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.orderBy(order.asc_nulls_last(), "vec").limit(k).collect()
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(c) for c in row] for row in integers([bytes(r.vec) for r in first], dimensions, scale)]
    laid = blocks(usable, dimensions, scale)
    for _ in range(rounds):
        for c, (count, total) in _sums(laid, centroids, dimensions, scale).items():
            centroids[c] = [value // count for value in total]

    def final(it):
        for ids, _, which, distance in _assigned(it, centroids, dimensions, scale):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(which.astype(np.int32)),
                 pa.array([_as_long(int(v)) for v in distance], pa.int64()),
                 pa.array([str(int(v)) for v in distance], pa.string())], ["vec_id", "cluster", "distance", "exact"])

    found = stored(laid.mapInArrow(final, "vec_id long, cluster int, distance long, exact string"), "zonemap-found")
    # One row per centroid; a sum that is null holds a distance beyond 64 bits.
    inertia = {r.cluster: None if r.over else int(r.total) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"),
        F.max(F.col("distance").isNull()).alias("over")).collect()}
    whole = None if None in inertia.values() else _as_long(sum(inertia.values()))
    names = [(c, None if inertia[c] is None else _as_long(inertia[c]), whole,
              hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    named = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.drop("exact").join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
           seed: int = SEED) -> str:
    """DuckDB SQL for `cluster` over `embeddings`."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
        FROM embeddings WHERE len(embedding) = {dimensions}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
             f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q AS m
        FROM (SELECT * FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}))"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT rid, min(struct_pack(d := list_sum(list_transform(list_zip(q, m),
        lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)) AS near FROM v, m{n} GROUP BY rid)""")
        if n < rounds:
            parts.append(f"""m{n + 1} AS MATERIALIZED (SELECT m{n}.c, coalesce(moved, m) AS m FROM m{n} LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS HUGEINT) ORDER BY i) AS moved FROM (
        SELECT near.c AS c, i, sum(q[i]) AS s, CAST(count(*) AS HUGEINT) AS n
        FROM a{n} JOIN v USING (rid), range(1, {dimensions + 1}) r(i) GROUP BY 1, 2) GROUP BY c) f ON f.c = m{n}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT vec_id, CAST(near.c AS INTEGER) AS "cluster", CAST(near.d AS BIGINT) AS distance,
        CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia,
        CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (rid) JOIN m{rounds} ON m{rounds}.c = near.c"""
