import random

import corpus_pipeline
from fixtures import prose

from planeweave.llm import bbit


def applied(spark, docs, folder):
    """The rows after each stage."""
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        seen[name] = now.collect()
        yield name, now, seen[name]
        now = spark.createDataFrame(seen[name], now.schema)


def test_stages_take_effect(spark, docs, bench, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, now, found in applied(spark, docs, str(tmp_path)):
        if name != "sharding":
            assert now.columns == docs.columns
        seen[name] = found
    first = {r.doc_id for r in seen["language_id"]}
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[i] and any(c.isalpha() for c in texts[i]) for i in first if i is not None)
    kept = [r.doc_id for r in seen["minhash_dedup"] if r.doc_id is not None]
    assert len(kept) == len(set(kept)) < len(first)
    clean = {r.doc_id for r in seen["decontamination"]}
    assert len(set(kept) - clean) == 1
    assert 0 < len(seen["sharding"]) == len(seen["source_mixing"])


EXTRA = ("score int, mixture string, lang_pred string, copies string, `row` int, h string, shard string, "
         "size string, pattern int, component_id string, kept string, raw string, grp string, _id string")


def test_extra_columns_keep_their_values_and_types(spark, docs, bench, rows, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [c.split()[0].strip("`") for c in EXTRA.split(", ")]
    made = [r[:4] + tuple(f"{c}-{k}" if f"{c} string" in EXTRA else 1_000 * k + n for n, c in enumerate(names))
            for k, r in enumerate(rows)]
    wide = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, " + EXTRA)
    inputs = {tuple(r) for r in made}
    for name, now, found in applied(spark, wide, str(tmp_path)):
        assert found, name
        types = [(c if c != "shard" or name != "sharding" else "shard_in", t) for c, t in wide.dtypes]
        assert now.dtypes[:len(types)] == types, name
        assert {tuple(r)[:len(types)] for r in found} <= inputs, name


def test_texts_that_share_an_id(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (prose(rng, 90) for _ in range(3))
    near = c + " more"
    made = [(1, a, "x"), (1, b, "x"), (3, b + " word", "x"), (4, c, "x"), (4, near, "x"), (5, a.upper(), "x"),
            (6, "", "x"), (6, None, "x"), (6, None, "x"), (7, a + " z", "b"), (7, a + " z", "a"), (None, a, "x"), (None, a, "x")]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bbit.near_duplicates(frame).collect()), key=str)
    sizes = {t: n for t, n in ((a, 88), (b, 88), (b + " word", 89), (c, 88), (near, 89), (a.upper(), 88), (a + " z", 89), ("", 0), (None, 0))}
    least = {1: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 1, None: None}
    assert got == sorted(((i, sizes[t], least[i], i is None or least[i] == i) for i, t, _ in made), key=str)
    left = bbit.dedup_stage(spark, frame, str(tmp_path)).collect()
    keep = min((c, near), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())
    assert sorted(map(tuple, left), key=str) == sorted(
        [(1, a, "x"), (1, b, "x"), (4, keep, "x"), (6, "", "x"), (6, None, "x"), (None, a, "x"), (None, a, "x")], key=str)
    # The row of a repeated document does not depend on the order of the rows.
    turned = bbit.dedup_stage(spark, spark.createDataFrame([(9, a, s) for s in "cab"], frame.schema).repartition(3), "").collect()
    assert [tuple(r) for r in turned] == [(9, a, "a")]


def test_pipeline_of_nothing(spark, empty, bench, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
