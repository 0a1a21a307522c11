import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from planeweave.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, rank long, conv string, words string"
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(rows):
    """Rebuilt conversations by plain Python: conv_id -> tuple of (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def words(text):
    return len([w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w])


def nodes(found):
    """The contract by a table of all prefixes."""
    members = defaultdict(list)
    for c, seq in found.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]] += 1
    for prefix, inside in members.items():
        own = (len(inside) - 1) * (words(prefix[-1][1]) if prefix else 0)
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += not kids[prefix]
            saved[prefix[:d]] += own
    out = []
    for prefix, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if found[c] == prefix)))
        out.append((min(inside), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(inside), kids[prefix],
                    leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def made(rng, n, base=0):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 4, 5, 9])):
            rows.append((base + c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "c\td\n e", "f", ""]), 1, "x", "y"))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", range(60))
def test_forest_of_runs_equals_a_table_of_prefixes(seed):
    rng = random.Random(seed)
    found = {c: tuple(("u", rng.choice(["a", "b c", "d"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 8])))
             for c in rng.sample(range(100), rng.randint(1, 40))}
    if seed % 3 == 0:                          # each shares one more turn with the longest
        longest = tuple(("u", f"w{k % 2}") for k in range(30))
        found |= {200 + k: longest[:k] + (("u", "other"),) for k in range(30)}
    classes = defaultdict(list)
    for c, seq in found.items():
        classes[seq].append(c)
    order, items = sorted(classes), []
    upto = lambda seq, d: sum(words(t) for _, t in seq[:d])
    bits = lambda seq, d: hash(seq[:d]) if d > 0 else 0

    def shared(k):
        if not 0 < k < len(order):
            return -1
        one, two = order[k - 1], order[k]
        return next((d for d, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))

    for k, seq in enumerate(order):
        left = shared(k)
        items.append({"rank": k, "conv": min(classes[seq]), "n": len(classes[seq]), "depth": len(seq), "upto": upto(seq, len(seq)),
                      "p1": bits(seq, len(seq)), "p2": 0, "kids": 0, "leaves": 0, "saved": 0, "ldepth": left,
                      "lupto": upto(seq, max(left, 0)), "lp1": bits(seq, left), "lp2": 0, "rdepth": shared(k + 1)})
    want, run, done, groups = nodes(found), rng.randint(1, 6), [], [items]
    groups = [items[k:k + run] for k in range(0, len(items), run)]
    while len(groups) > 1:
        left = []
        for group in groups:
            finished, open_ = trie.contracted(group, False)
            done += finished
            left.append(open_)
        fan = rng.randint(2, 4)
        groups = [sum(left[k:k + fan], []) for k in range(0, len(left), fan)]
    done += trie.contracted(groups[0], True)[0]
    names = {(n["p1"], n["depth"]): n["conv"] for n in done}
    table = []
    for n in done:
        seq = found[n["conv"]]
        for d in range(n["lo"] + 1, n["depth"] + 1):
            bottom = d == n["depth"]
            ends = ",".join(map(str, sorted(c for c in found if found[c] == seq[:d]))) if bottom else ""
            parent = None if d == 0 else names[n["q1"], n["lo"]] if d == n["lo"] + 1 else n["conv"]
            table.append((n["conv"], d, parent, n["n"], n["kids"] if bottom else 1, n["leaves"],
                          n["below"] + (n["n"] - 1) * (n["upto"] - upto(seq, d - 1) if d else 0),
                          hashlib.sha256(ends.encode()).hexdigest()))
    assert sorted(table, key=lambda r: r[:2]) == want


def test_small_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "STEP", 2)
    monkeypatch.setattr(trie, "PIECE", 50)
    rng = random.Random(11)
    rows = made(rng, 50) + made(rng, 4, base=1_000)
    rows += [(2_000 + k, t, "user", "same same", 1, "x", "y") for k in range(60) for t in range(12)]
    rows += [(2_100 + k, t, "user", f"w{t}" if t < k else "end", 1, "x", "y") for k in range(12) for t in range(k + 1)]
    turns, convs = trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    assert got(trie.prefix_trie(turns, convs, block=2, run=5, fan=3)) == nodes(sequences(rows))


def test_odd_rows(spark):
    rng = random.Random(12)
    rows = made(rng, 25)
    rows += [(30, None, None, None, 1, "x", "y"), (30, 1, None, "t", 1, "x", "y"), (30, 1, "user", "t", 1, "x", "y"),
             (30, 1, "user", "t", 1, "x", "y"), (30, None, "", "", None, None, None), (-45, 0, "a", "b", 1, "x", "y"),
             (-40, 7, "u", "long " * 30_000, 1, "x", "y"), (None, 1, "user", "lost", 1, "x", "y"),
             (5_003, 1, "user", "too short to stay", 1, "x", "y"), (5_004, 1, "user", "z", 1, "x", "y"), (9, 99, "ro", "lex", 1, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = nodes(sequences(rows))
    assert got(trie.conversation_trie(frame)) == want
    assert any(not seq for seq in sequences(rows).values())
    duckdb.register("conversations", frame.toArrow())
    asked = duckdb.sql(trie.ORACLE).fetchall()
    duckdb.unregister("conversations")
    assert sorted(asked, key=lambda r: r[:2]) == want


def test_nothing_and_one_shared_turn(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, t, "user", "first" if t == 0 else f"{c}", 1, "x", "y") for c in (0, 20, 40) for t in range(4)]
    assert got(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == nodes(sequences(rows))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.conversation_trie(spark, folder)) == nodes(sequences(rows))
