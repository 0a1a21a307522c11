import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from planeweave.llm import queries, zonemap

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, place int"


def clustered(rows, k=8, rounds=10, d=64):
    """The contract by plain Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    named = [r for r in kept if r[0] is not None]
    first = sorted(named, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    first += [r for r in kept if r[0] is None][:k - len(first)]
    centre = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centre)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centre)):
            mine = [v for (_, v), (_, n) in zip(kept, at) if n == c]
            if mine:
                centre[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at, long = assign(), lambda x: x if x < 1 << 63 else None
    total = [sum(w for w, n in at if n == c) for c in range(len(centre))]
    fits = [all(w < 1 << 63 for w, n in at if n == c) for c in range(len(centre))]
    return [(i, c, long(w), long(total[c]) if fits[c] else None, long(sum(total)) if all(fits) else None,
             hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for (i, _), (w, c) in zip(kept, at)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def made(rng, n, spread=1.0, d=64):
    centre = [[rng.uniform(-spread, spread) for _ in range(d)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread / 5) for x in rng.choice(centre)], "x", 1, 2) for i in range(n)]


def test_curve_goes_through_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * d)).reshape(d, -1).T
        keys = zonemap.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_no_nearest_centroid_is_ruled_out():
    rng = np.random.RandomState(2)
    for _ in range(200):
        x, m = rng.randint(-20, 20, (12, 3)), rng.randint(-25, 25, (6, 3))
        near = zonemap.candidates(x.min(axis=0), x.max(axis=0), m)
        which, distance = zonemap.nearest(x, m[near])
        want, far = zonemap.nearest(x, m)
        assert (near[which] == want).all() and (distance == far).all()
    few = zonemap.candidates(np.array([0, 0]), np.array([1, 1]), np.array([[0, 0], [50, 50], [1, 2]]))
    assert few.tolist() == [0, 2]


def test_sums_of_any_size():
    for value in (0, 5, -5, 2 ** 31, -2 ** 31, 2 ** 40 + 7, -2 ** 70 - 3, 3 ** 500):
        assert sum(part << 32 * k for k, part in zonemap._limbs(value)) == value


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(zonemap, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    rows = made(rng, 150)
    rows += [(500, rows[0][1], "y", 1, 2), (500, rows[0][1], "y", 1, 2), (501, [0.0] * 64, None, None, None)]
    rows += [(600 + k, rows[3][1], "copy", 1, 1) for k in range(60)]
    rows += [(700, None, "x", 1, 2), (701, [], "x", 1, 2), (702, [1.0] * 63, "x", 1, 2), (703, [None] + [1.0] * 63, "x", 1, 2),
             (704, [math.nan] * 64, "x", 1, 2), (705, [math.inf] + [0.0] * 63, "x", 1, 2), (None, rows[1][1], "x", 1, 2)]
    got = zonemap.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ordered(got) == ordered(clustered(rows))


def test_components_of_any_size(spark):
    rng = random.Random(9)
    rows = made(rng, 30) + [(100 + i, v, "", 0, 0) for i, v, *_ in made(rng, 12, spread=1e6)]
    rows += [(200, [1e300] * 64, "", 0, 0), (201, [-1e300] + [0.5] * 63, "", 0, 0), (202, [1.79e308] * 64, "", 0, 0)]
    got = zonemap.cluster(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ordered(got) == ordered(clustered(rows))


def test_fewer_vectors_than_centroids(spark):
    rows = made(random.Random(1), 3)
    assert ordered(zonemap.cluster(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(clustered(rows))
    nothing = zonemap.cluster(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0 and nothing.columns[:3] == ["vec_id", "cluster", "distance"]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert ordered(queries.centroid_clusters(spark, folder).collect()) == ordered(clustered(rows))
