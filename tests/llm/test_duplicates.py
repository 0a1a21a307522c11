import random
import re
import tracemalloc
from itertools import combinations

import numpy as np

from planeweave.llm import bbit, lines, polytope
from planeweave.llm.components import components


def labels(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def word_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(width, len(words))
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()


def test_components_of_a_long_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_all_pairs(docs, rows):
    got = bbit.near_duplicates(docs).collect()
    sets = {r[0]: word_set(r[1], 3) for r in rows if r[0] is not None}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = labels(sets, pairs)
    assert len(got) == len(rows) and len(pairs) > 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_of_nothing(empty):
    assert bbit.near_duplicates(empty).count() == 0


def test_blocks_of_a_cluster_keep_its_links(docs, monkeypatch):
    whole = sorted(map(tuple, bbit.near_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(bbit, "BLOCK_BYTES", 800)
    assert sorted(map(tuple, bbit.near_duplicates(docs).collect()), key=str) == whole


def packed(sets):
    hashes = [bbit.shingle_hashes(np.array([hash(x) & (1 << 63) - 1 for x in sorted(s)], np.uint64), 1) for s in sets]
    return [bbit.planes(bbit.minima(h)) for h in hashes]


def test_many_similar_texts_need_no_list_of_pairs():
    n = 2000
    sets = [lines.shingle_set(f"the same template of a line that goes on for ninety characters with a number at its end {k:05d}") for k in range(n)]
    sig, counts = packed(sets), np.array([len(s) for s in sets])
    for side, crossing in ((np.zeros(n), False), (np.arange(n) % 2, True)):
        tracemalloc.start()
        found = bbit.confirmed(sig, counts, side, crossing, 80, sets.__getitem__)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == n - 1 and set(labels(range(n), found).values()) == {0}
        # 24 bytes for each of the pairs are 48 MB, or half of it.
        assert peak < 8 << 20


def test_confirmed_links_join_what_all_pairs_join(monkeypatch):
    rng = random.Random(6)
    sets = []
    for _ in range(12):
        base = [rng.randrange(10 ** 9) for _ in range(60)]
        for _ in range(rng.randint(1, 12)):
            sets.append(set(base) - set(rng.sample(base, rng.randint(0, 12))) | {rng.randrange(10 ** 9) for _ in range(5)})
    rng.shuffle(sets)
    n, side = len(sets), np.array([rng.randrange(2) for _ in sets])
    pairs = [(i, j) for i, j in combinations(range(n), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    sig, counts = packed(sets), np.array([len(s) for s in sets])
    for held in (bbit.HELD, 100):
        monkeypatch.setattr(bbit, "HELD", held)
        for crossing in (False, True):
            wanted = [(i, j) for i, j in pairs if not crossing or side[i] != side[j]]
            assert len(wanted) > 10
            for packs in (sig, None):
                found = bbit.confirmed(packs, counts, side, crossing, 80, sets.__getitem__)
                assert {tuple(sorted(p)) for p in found} <= set(wanted)
                assert labels(range(n), found) == labels(range(n), wanted)


def test_blocks_of_rows_keep_the_links(docs, monkeypatch):
    whole = [sorted(map(tuple, f(docs).collect()), key=str) for f in (bbit.near_duplicates, lines.line_duplicates)]
    for module in (bbit, lines):
        monkeypatch.setattr(module, "BLOCK_ROWS", 2)
    assert [sorted(map(tuple, f(docs).collect()), key=str) for f in (bbit.near_duplicates, lines.line_duplicates)] == whole


def test_estimate_is_close_to_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(30):
            x = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
            y = x.copy()
            y[:int(400 * (1 - share))] = rng.integers(0, 2 ** 63, int(400 * (1 - share)), dtype=np.uint64)
            a, b = (np.frombuffer(bbit.planes(bbit.minima(v)), np.uint64).reshape(bbit.BITS, -1) for v in (x, y))
            differ = int(np.bitwise_count(np.bitwise_or.reduce(a ^ b)).sum())
            errors.append(bbit.similarity(np.array([differ]))[0] - len(set(x) & set(y)) / len(set(x) | set(y)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_lines_equal_all_pairs(docs, rows):
    got = {r.doc_id: r for r in lines.line_duplicates(docs).collect()}
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    where = {}
    for i in sorted(texts):
        for p, x in enumerate(lines.lines_of(texts[i])):
            if x:
                where.setdefault(x, []).append((i, p))
    sets = {x: lines.shingle_set(x) for x in where}
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if 100 * len(sets[a] & sets[b]) >= lines.PERCENT * len(sets[a] | sets[b])]
    group = labels(sorted(sets), links)
    keep = {}
    for x, at in where.items():
        keep[group[x]] = min(keep.get(group[x], at[0]), at[0])
    lost = {i: [] for i in texts}
    for x, at in where.items():
        for i, p in at:
            if (i, p) != keep[group[x]]:
                lost[i].append(p)
    assert set(got) == set(texts) and any(lost.values()) and links
    for i, r in got.items():
        assert r.dropped == sorted(lost[i]) and r.n_dropped == len(lost[i])
        assert r.n_lines == (0 if texts[i] is None else texts[i].count("\n") + 1)


def test_compared_lines_join_as_their_sets_do():
    rng = random.Random(1)
    for t in range(1500):
        letters = rng.choice(["ab c", "abé中", "".join(chr(200 + k) for k in range(300))]) + ("\0" if t % 50 == 0 else "")
        base, made = [rng.choice(letters) for _ in range(rng.randint(1, 40))], []
        while len(made) < rng.choice([2, 2, 3, 5]):
            x = list(base)
            for _ in range(rng.randint(0, 2)):
                x.insert(rng.randrange(len(x) + 1), rng.choice(letters))
            made += ["".join(x)] if "".join(x) not in made else []
        own = [rng.randrange(2) for _ in made]
        crossing = len(set(own)) == 2 and rng.random() < .3
        n = len(made)
        got = lines.compared({"id": list(range(n)), "line": made, "own": own, "low": [0] * n, "high": [int(crossing)] * n})
        sets = [lines.shingle_set(x) for x in made]
        links = [(i, j) for i, j in combinations(range(n), 2) if (not crossing or own[i] != own[j])
                 and 100 * len(sets[i] & sets[j]) >= lines.PERCENT * len(sets[i] | sets[j])]
        assert {tuple(sorted(p)) for p in got} <= set(links) and labels(range(n), got) == labels(range(n), links)


def test_dropped_lines_leave_the_text(docs, spark):
    small = spark.createDataFrame([(1, "same line here\nown one", 3), (2, "same line here\nmine", 4), (3, None, 5)],
                                  "doc_id long, text string, dropped int")
    kept = {r.doc_id: r.text for r in lines.without_lines(small, lines.line_duplicates(small)).collect()}
    assert kept == {1: "same line here\nown one", 2: "mine", 3: None}


def test_lines_of_nothing(empty):
    assert lines.line_duplicates(empty).count() == 0


def test_cosine_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    vectors = [c + 0.12 * rng.normal(size=24) for c in centres for _ in range(6)] + list(rng.normal(size=(100, 24)))
    data = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, vectors[0].tolist()), (501, (3 * vectors[1]).tolist())]
    odd = [(600, None), (601, []), (602, [0.0] * 24), (603, [float("nan")] * 24), (604, [None] + [1.0] * 23),
           (605, [1.0, 2.0]), (606, [2.0, 4.0]), (None, vectors[0].tolist())]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in data + odd], "vec_id long, embedding array<double>, n_links int, label int")
    got = {r.vec_id: r for r in polytope.duplicates(table).collect()}
    links = []
    for (i, x), (j, y) in combinations(data, 2):
        x, y = np.array(x), np.array(y)
        if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links.append((i, j))
    links.append((605, 606))
    named = labels([i for i, _ in data + odd if i is not None], links)
    degree = {i: sum(i in p for p in links) for i in named}
    assert len(got) == len(data) + len(odd) and len(links) > 60
    right = sum((got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], c, c == i) for i, c in named.items())
    assert right == len(named)
    assert got[None].component_id is None and got[None].kept and got[None].n_links == 0
    assert polytope.duplicates(table.limit(0)).count() == 0


def test_recall_of_buckets_at_the_limit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = (polytope.buckets(v, polytope.TABLES, polytope.HASHES, polytope.PROBES).tolist() for v in (x, y))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b)]) >= 0.9
