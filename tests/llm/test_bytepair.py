import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from planeweave.llm import bytepair, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
OWN = bytepair.BytePairs.read(DATA, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                           mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())})


def merged(ids: dict[bytes, int], piece: bytes) -> list[int]:
    """The plain rule: merge the leftmost pair of the lowest rank until none is left."""
    parts = [piece[k:k + 1] for k in range(len(piece))]
    while True:
        ranked = [(ids[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not ranked:
            return [ids[p] for p in parts]
        k = min(ranked)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    made = [k for part in OWN.encode(text) for k in part]
    assert made == THEIRS.encode_ordinary(text)
    assert OWN.decode(made) == text.encode()


def test_any_bytes_as_the_plain_rule():
    rng, ids = random.Random(3), {v: k for k, v in OWN.bytes_of.items()}
    tokens = list(ids)
    for k in range(3_000):
        piece = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))), rng.randbytes(rng.randint(1, 25)),
                 bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 40))), rng.choice(tokens) * rng.randint(2, 9)][k % 4]
        if piece not in ids:
            assert list(OWN.encode_piece(piece.decode("latin-1"))) == merged(ids, piece)


def test_vocabulary_of_few_merges():
    ids = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6, b"aab": 7}
    own = bytepair.BytePairs(ids, r"\w+")
    rng = random.Random(1)
    for _ in range(500):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        want = [ids[piece.encode()]] if piece.encode() in ids else merged(ids, piece.encode())
        assert list(own.encode_piece(piece)) == want


def test_windows_cut_no_piece(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(bytepair, "WINDOW", 7)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice("ab1 .\n\té'  s") for _ in range(rng.randint(0, 60)))
        parts = list(OWN.windows(text))
        assert "".join(parts) == text
        assert [p for part in parts for p in pattern.findall(part)] == pattern.findall(text)


def test_bounded_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(bytepair, "REMEMBERED_PIECES", 3)
    monkeypatch.setattr(bytepair, "REMEMBERED_PAIRS", 3)
    own = bytepair.BytePairs.read(DATA, public_tokenizers.PATTERN)
    text = "several quite differentish words, unmergeablexyz " * 4
    assert [k for p in own.encode(text) for k in p] == THEIRS.encode_ordinary(text)
    assert len(own.known) <= 3 and len(own.verdicts) <= 3


def test_rows(spark, docs, rows):
    got = bytepair.round_trip(docs.withColumn("n_tokens", docs["doc_id"]), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for row in rows:
        ids, text = THEIRS.encode_ordinary(row[1] or ""), (row[1] or "").encode()
        want.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_lists_come_back(spark, docs, rows):
    tokens = bytepair.encode(docs, PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in tokens.collect()} == {
        (r[0], tuple(THEIRS.encode_ordinary(r[1] or ""))) for r in rows}
    assert {tuple(r) for r in bytepair.decode(tokens, PATH).collect()} == {(r[0], r[1] or "") for r in rows}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [99_999]), (4, [int(OWN.ids["\xc3"])])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in bytepair.decode(odd, PATH).collect()} == {(1, None), (2, ""), (3, None), (4, "�")}


def test_nothing(spark, empty):
    assert bytepair.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    got = {r.doc_id: r.ids_sha256 for r in queries.byte_pairs(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = THEIRS.encode_ordinary(r.text or "")
        assert got[r.doc_id] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
