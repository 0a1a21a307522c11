"""Operators that work on each document, mixing and sharding."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import ITEM, prose
from planeweave.llm import crf, decontam, langid, mixing, pii, quality, sharding, toxicity


def test_items_are_found_where_they_occur(docs, bench, rows):
    found = decontam.contaminated(docs, bench).collect()
    want = {r[0] for r in rows if r[1] and " ".join(decontam.tokens(ITEM)) in " ".join(decontam.tokens(r[1]))}
    assert {r.doc_id for r in found if r.item_id == 1} == want and len(want) == 1
    assert not any(r.item_id == 2 for r in found)
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_lightly_edited_items_are_found():
    rng = random.Random(11)
    vocabulary = [prose(rng, 1) + prose(rng, 1) for _ in range(3000)]
    # A long question and an answer of five to eight words.
    items = [(k, prose(rng, 30, vocabulary) + "? " + prose(rng, 5 + k % 4, vocabulary)) for k in range(40)]
    index = decontam.Index(items)
    for k, text in items:
        words = decontam.tokens(text)
        for edited in ([32], [31, 33], [3, 32], [8, 20]):
            copy = ["edited" if at in edited else w for at, w in enumerate(words)]
            around = [prose(rng, 80, vocabulary), " ".join(copy), prose(rng, 80, vocabulary)]
            found = index.matches(" ".join(around), decontam.THRESHOLD, decontam.OVERLAP)
            assert [m[0] for m in found] == [k]
        # A question without its answer, and an answer to another question, stay clean.
        alone = " ".join([prose(rng, 80, vocabulary), " ".join(words[:30]), prose(rng, 80, vocabulary)])
        assert not index.matches(alone, decontam.THRESHOLD, decontam.OVERLAP)


def test_aligned_words_are_those_of_fewest_edits():
    rng = random.Random(12)
    for _ in range(200):
        part, near = ([rng.choice("abcd") for _ in range(rng.randint(1, 6))] for _ in range(2))
        row = [0] * (len(near) + 1)
        for i, w in enumerate(part):
            now = [i + 1]
            for j, x in enumerate(near):
                now.append(min(row[j] + (x != w), row[j + 1] + 1, now[j] + 1))
            row = now
        assert abs(decontam.aligned(part, near) - (1 - min(row) / len(part))) < 1e-12
    assert decontam.aligned([], ["a"]) == 1 and decontam.aligned(["a"], []) == 0


def test_block_max_retrieval_is_complete():
    rng = random.Random(2)
    index = decontam.Index([(k, prose(rng, rng.randint(3, 70))) for k in range(200)])
    for _ in range(200):
        terms = sorted({index.terms[w] for w in prose(rng, 40).split() if w in index.terms})
        scores = Counter()
        for t in terms:
            for part, value in zip(*index.postings[t]):
                scores[part] += value
        for limit in (0.1, 0.3, 0.6):
            assert {p for p, _ in index.retrieve(terms, limit)} == {p for p, s in scores.items() if s >= limit}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(9)
    words = {"xx": ["kali", "mapo", "tika", "lomu"], "yy": ["schrant", "wirg", "brelm", "plurz"], "zz": ["éoua", "ñiva", "üoe", "àie"]}
    rows = [(k, prose(rng, 40, words[g]), g, "s") for k, g in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "12 ... 34", "zz", "s"), (903, prose(rng, 40, words["xx"]), None, "s"),
             (904, prose(rng, 60, words["xx"]) + " " + prose(rng, 40, words["yy"]), None, "s"), (None, "kali mapo", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_languages_of_held_out_documents(tongues):
    known = {r.doc_id: r.lang for r in tongues.collect()}
    got = {r.doc_id: r for r in langid.language_of(tongues).collect()}
    assert len(got) == len(known) and any(r.held_out for r in got.values())
    for i in range(120):
        assert got[i].lang_pred == known[i] and 0 <= got[i].score <= 1
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "xx" and got[None].lang_pred == "xx" and not got[None].held_out
    assert set(got[904].mixture) == {"xx", "yy"} and abs(got[904].mixture["xx"] - 0.5) < 0.2
    assert langid.language_of(tongues.limit(0)).count() == 0


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    text = "Ab c, déf!  ghi " * 50
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.trigram_counts(text) == whole).all()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and total % 10 == 0
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_patterns_of_random_texts():
    rng = random.Random(1)
    parts = ["a", "1", "25", "300", ".", "@", "-", " ", "+", "(", "b.c", "4111111111111111", "é", "9.9", "\n"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_of_documents(docs, rows, empty):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, text, *_ in rows:
        if i is not None:
            spans = plain_spans(text or "")
            assert [got[i][f"n_{k}"] for k in crf.KINDS] == [sum(s[0] == k for s in spans) for k in crf.KINDS]
            assert set(f"{k}:{s}:{e}" for k, s, e in spans) <= set(got[i].spans.split(","))
    assert pii.personal_data(empty).count() == 0


def test_field_adds_what_the_patterns_miss(spark):
    table = spark.createDataFrame([(1, "call (415) 555-2671 soon"), (2, "in 2001 there were 17 of 350")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(table).collect()}
    assert got[1].spans == "phone:5:19" and got[1].n_phone == 0 and got[2].spans == ""


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    size = 3
    for n in (1, 2, 5):
        emit, change, first = rng.normal(size=(n, size)), rng.normal(size=(size, size)), rng.normal(size=size)
        field = crf.Field({}, np.zeros((0, size)), change, first)
        before, crf.LABELS[:] = list(crf.LABELS), crf.LABELS[:size]
        try:
            path = field.decode([emit])[0].tolist()
        finally:
            crf.LABELS[:] = before
        paths = np.array(np.meshgrid(*[range(size)] * n)).reshape(n, -1).T.tolist()
        score = lambda p: first[p[0]] + sum(emit[k, y] for k, y in enumerate(p)) + sum(change[a, b] for a, b in zip(p, p[1:]))
        assert path == max(paths, key=score)


def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(2400):
        toxic = k % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vilest", "filthor", "grubbash"])
        rows.append((k, " ".join(words), "en"))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    rows += [(7000, None, None), (7001, "", "en"), (None, "vilest", "en"), (1, rows[1][1], "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table, marks).collect()}
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 2400]
    assert len(held) > 200 and np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.95
    assert got[7000].predicted == got[7001].predicted == 0 and got[None].predicted == 1
    assert toxicity.toxicity(table.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(table, marks.limit(0)).collect()} == {0}


def test_risk_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    z, positive = rng.normal(size=12), np.arange(12) < 4

    def risk(z, prior):
        p, u = z[positive], z[~positive]
        return (prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    step = np.eye(12) * 1e-6
    slope = [(risk(z + s, 0.2) - risk(z - s, 0.2)) / 2e-6 for s in step]
    assert np.allclose(toxicity.risk_gradient(z, positive, 0.2), slope, atol=1e-5)


def test_sparse_hosts_are_drawn_to_the_corpus(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        bad = (k % 2 == 0) if k < 300 else k % 50 == 0
        rows.append((k, prose(rng, 30) if not bad else "%% ## " + "$$ ".join(prose(rng, 30).split()), "en", "big" if k < 300 else "good"))
        labels.append((k, int(not bad), 0))
    rows += [(900, prose(rng, 30), "fr", "lone"), (901, None, None, None), (None, "a b", "en", "big")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(table, marks).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].kept == bool(q) for i, q, _ in labels]) > 0.97
    mean = np.mean([r.evidence for r in got.values()])
    assert abs(got[900].path_score - mean) < abs(got[900].evidence - mean)
    assert got[399].host_score > got[0].host_score
    assert {r.score for r in quality.quality(table, marks.limit(0)).collect()} == {0.5}
    assert quality.quality(table.limit(0), marks).count() == 0


def test_mix_meets_the_targets(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size >= r.size
        if r.doc_id is not None:
            target[by_id[r.doc_id]] = r.target
            taken[by_id[r.doc_id]] += r.taken
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_flow_uses_overlapping_patterns():
    supply = {"ab": 10, "a": 10, "b": 4}
    members = {"ab": ["a", "b"], "a": ["a"], "b": ["b"]}
    used = mixing.route(supply, members, {"a": 10, "b": 14}, 2)
    assert used == {"a": 10, "ab": 10, "b": 4}
    used = mixing.route(supply, members, {"a": 0, "b": 20}, 2)
    assert sum(used.values()) == 20 and used["ab"] >= 10 and used["a"] == 0


def test_fill_shares_again_what_is_left():
    assert mixing.fill([100, 10, 100], [3, 1, 2], 150, 2) == [78.0, 20.0, 52.0]
    assert mixing.fill([], [], 0, 2) == []


def test_mix_of_more_sources_than_fit_a_list(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 40_000)
    n = 100_500
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat('word ', int(id % 7 + 1)) AS text", "concat('host', id) AS source")
    got = {f"host{r.doc_id}": r for r in mixing.mix(docs).collect()}
    names = sorted(got)
    sizes = [got[s].size for s in names]
    want = mixing.fill(sizes, [float(mixing.WEIGHTS[k % 3]) for k in range(n)], 1.5 * sum(sizes), 2)
    assert len(names) == n and all(abs(got[s].target - t) < 1e-9 for s, t in zip(names, want))
    assert all(got[s].taken == int(got[s].target) and got[s].source_size == got[s].size for s in names)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_mix_of_overlapping_sources_is_the_flow(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "MOST_SENT", sent)
    rng = random.Random(8)
    groups = [["a"], ["b"], ["a", "b"], ["c"], ["c", "d"], ["d", None], ["e"], [None], ["f"], [], None]
    rows = [(k, prose(rng, rng.randint(1, 30)), groups[k % len(groups)]) for k in range(220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    got = {r.doc_id: r for r in mixing.mix(docs, F.col("held")).collect()}
    supply, members, taken = Counter(), {}, Counter()
    for k, text, held in rows:
        name = json.dumps(held or [], separators=(",", ":"))
        members[name] = held or []
        supply[name] += len(text.split())
        taken[name] += got[k].taken
    sources = ["a", "b", "c", "d", "e", "f", None]
    sizes = [sum(supply[p] for p, m in members.items() if s in m) for s in sources]
    want = mixing.fill(sizes, [float(mixing.WEIGHTS[k % 3]) for k in range(len(sources))], 1.5 * sum(supply.values()), 2)
    used = mixing.route(dict(supply), dict(sorted(members.items())), {s: int(t) for s, t in zip(sources, want)}, 2)
    assert len(got) == len(rows) and dict(taken) == used
    for k, _, held in rows:
        one = held and len(held) == 1
        assert got[k].source_size == (sizes[sources.index(held[0])] if one else None)
        assert got[k].target == (pytest.approx(want[sources.index(held[0])]) if one else None)


def test_shards_fit(docs, rows, empty):
    limit = 3_000
    got = sharding.shards(docs, limit).collect()
    assert len(got) == len(rows) and len({r.shard for r in got}) > 3
    size, ids = Counter(), {}
    for r in got:
        size[r.shard] += r.bytes
        ids.setdefault(r.shard, set()).add(r.doc_id)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for r in got:
        assert r.shard_bytes == size[r.shard] and r.depth == len(r.shard)
        assert r.shard_bytes <= limit or len(ids[r.shard]) == 1
    # A bucket is split only while it is too large: with its sister it is over the limit.
    for s in names:
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit
    assert sharding.shards(empty).count() == 0


def cheapest(supply, members, quotas, repeats):
    """Most words that can be placed and their least cost, by trying all ways."""
    ways = [[]]
    for p, size in supply.items():
        own = [()]
        for s in members[p]:
            own = [w + (n,) for w in own for n in range(min(size * repeats - sum(w), quotas[s]) + 1)]
        ways = [w + [o] for w in ways for o in own]
    best = None
    for way in ways:
        placed = Counter()
        for (p, size), units in zip(supply.items(), way):
            for s, n in zip(members[p], units):
                placed[s] += n
        if any(placed[s] > quotas[s] for s in quotas):
            continue
        cost = sum(-(-unit // size) for (p, size), units in zip(supply.items(), way) for unit in range(1, sum(units) + 1))
        best = min(best or (0, 0), (-sum(placed.values()), cost))
    return -best[0], best[1]


def test_routes_are_cheapest_flows():
    rng = random.Random(21)
    for _ in range(150):
        sources = range(rng.randint(1, 3))
        members = {p: sorted(rng.sample(sources, rng.randint(1, len(sources)))) for p in range(rng.randint(1, 3))}
        supply = {p: rng.randint(1, 3) for p in members}
        quotas = {s: rng.randint(0, 5) for s in sources}
        repeats = rng.randint(1, 2)
        used = mixing.route(supply, members, quotas, repeats)
        cost = sum(-(-unit // supply[p]) for p, n in used.items() for unit in range(1, n + 1))
        assert (sum(used.values()), cost) == cheapest(supply, members, quotas, repeats)
        assert all(n <= supply[p] * repeats for p, n in used.items())


def test_items_score_alike_in_any_number_of_indexes(spark, monkeypatch, tmp_path):
    rng = random.Random(31)
    items = [(k, prose(rng, 20 + k % 30) + "? " + prose(rng, 6 + k % 5)) for k in range(60)]
    rows = [(k, prose(rng, 70) + " " + items[k % 60][1] + " " + prose(rng, 70)) for k in range(60)]
    rows += [(100 + k, " ".join(w if at % 7 else "other" for at, w in enumerate(items[k][1].split()))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (1 << 20, 2_000, 300):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        found.append(sorted((r.doc_id, r.item_id, round(r.score, 9), r.passage_word) for r in decontam.contaminated(docs, bench).collect()))
    assert len(found[0]) >= 60 and found[0] == found[1] == found[2]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in decontam.decontaminate_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {k for k, _ in rows} - {r[0] for r in found[0]}
