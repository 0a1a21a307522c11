"""Byte-level BPE encoding and decoding, exact and in linear time.

The bytes of a piece are read as Latin-1 characters, so that a pyahocorasick automaton over the
vocabulary finds every token that starts at each byte in one pass.  Encoding walks the piece
from the left: it takes the longest token that can stand beside the token before it, and where
no token can it steps back over the last one and never ends a token there again.  Two tokens
can stand side by side when the merges, applied to their joined bytes, leave just these two; that is
decided on the merge trees of both and remembered.  The only sequence whose neighbours all
pass is the one that the merges make.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import prepare, rows_of

REMEMBERED_PIECES = 1 << 18   # pieces whose ids a worker remembers
REMEMBERED_PAIRS = 1 << 20    # pairs of neighbours whose verdict it remembers
LONGEST_REMEMBERED = 64       # bytes of a remembered piece
WINDOW = 1 << 20              # characters of a text that are cut into pieces at a time


class BytePairs:
    """The coder of one vocabulary: `ranks` gives each token's bytes its id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: str(rank) for rank in ranks.values()}
        self.pattern = regex.compile(pattern)
        self.blank = regex.compile(r"(?<=\S)\s")
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.length = {rank: len(token) for token, rank in self.ids.items()}
        self.shorter = {rank: self._longest_prefix(token) for token, rank in self.ids.items()}
        # merged[a, b] is the token that the merge of a and b makes; halves is its inverse.
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        for token, rank in sorted(self.ids.items(), key=lambda entry: entry[1]):
            self._learn_merge(token, rank)
        self.verdicts.clear()

    @staticmethod
    def read(data: bytes, pattern: str) -> BytePairs:
        """From the lines `base64-token rank` of a rank file."""
        entries = (line.split() for line in data.splitlines() if line)
        return BytePairs({base64.b64decode(token): int(rank) for token, rank in entries}, pattern)

    def _longest_prefix(self, token: str) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if token[:end] in self.ids:
                return self.ids[token[:end]]
        return None

    def _learn_merge(self, token: str, rank: int) -> None:
        """The last merge of a token joins the two older tokens that can stand side by side."""
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
            if left is not None and right is not None and max(left, right) < rank and self.beside(left, right):
                self.merged[left, right] = rank
                self.halves[rank] = (left, right)
                # A verdict from before this merge was known may no longer hold.
                self.verdicts.pop((left, right), None)
                return

    def beside(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` as they are when they are neighbours."""
        verdict = self.verdicts.get((left, right))
        if verdict is None:
            if len(self.verdicts) >= REMEMBERED_PAIRS:
                self.verdicts.clear()
            verdict = self.verdicts[left, right] = self._beside(left, right)
        return verdict

    def _beside(self, left: int, right: int) -> bool:
        # Undo the merges of both from the newest on: `a` is what ends the left part and `b` what
        # begins the right part before the merge numbered `until`.  Had a and b a merge of their
        # own that is older, it would have come first and joined the two sides.
        a, b, until = left, right, float("inf")
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < until:
                return False
            if a in self.halves and (a > b or b not in self.halves):
                # Of equal merges the left one comes first, so only an older one stops `a`.
                until, a = a, self.halves[a][1]
            elif b in self.halves:
                until, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        longest = [-1] * len(piece)
        for end, (rank, size) in self.automaton.iter(piece):
            longest[end - size + 1] = rank       # later ends are longer tokens
        allowed = bytearray(b"\1") * (len(piece) + 1)
        made: list[int] = []
        at, token = 0, longest[0] if piece else -1
        while at < len(piece):
            while token is not None:
                end = at + self.length[token]
                if allowed[end] and (not made or self.beside(made[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                allowed[at] = 0
                token = made.pop()
                at -= self.length[token]
            else:
                made.append(token)
                at = end
                token = longest[at] if at < len(piece) else None
        return tuple(made)

    def windows(self, text: str) -> Iterator[str]:
        """`text` in parts of about WINDOW characters; no piece reaches from a character that is
        not blank to a blank one, so a text can be cut there."""
        at = 0
        while at < len(text):
            cut = self.blank.search(text, at + WINDOW) if at + WINDOW < len(text) else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, window by window."""
        for window in self.windows(text):
            made: list[int] = []
            for piece in self.pattern.findall(window):
                ids = self.known.get(piece)
                if ids is None:
                    data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
                    ids = self.encode_piece(data)
                    if len(data) <= LONGEST_REMEMBERED:
                        if len(self.known) >= REMEMBERED_PIECES:
                            self.known.clear()
                        self.known[piece] = ids
                made += ids
            yield made

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[k] for k in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of their decimal list and of the decoded bytes."""
        listed, decoded, count = hashlib.sha256(), hashlib.sha256(), 0
        for ids in self.encode(text):
            listed.update(((" " if count and ids else "") + " ".join([self.text_of[k] for k in ids])).encode())
            decoded.update(self.decode(ids))
            count += len(ids)
        return count, listed.hexdigest(), decoded.hexdigest()


_CODERS: dict[tuple[bytes, str], BytePairs] = {}


def coder(data: bytes, pattern: str) -> BytePairs:
    """The coder of a rank file's bytes, built once in each worker."""
    key = hashlib.sha256(data).digest(), pattern
    if key not in _CODERS:
        _CODERS[key] = BytePairs.read(data, pattern)
    return _CODERS[key]


def _ranks(docs: DataFrame, path: str):
    # A rank file is a vocabulary: half a megabyte for 50,000 tokens, whatever the documents are.
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids), the token ids of each whole text, one row per row of `docs`.

    A null text counts as empty and has no ids; repeated rows and null ids stay as they are.
    Other columns are not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    ranks = _ranks(docs, path)

    def run(it):
        own = coder(ranks.value, pattern)
        for keys, texts in rows_of(it, "doc_id", "text"):
            for key, text in zip(keys, texts):
                ids = [k for part in own.encode(text or "") for k in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids).  Null ids give a null text, and so do ids that the
    vocabulary does not hold; bytes that are no UTF-8 become replacement characters."""
    prepare(tokens.sparkSession)
    ranks = _ranks(tokens, path)

    def run(it):
        own = coder(ranks.value, "")
        for keys, lists in rows_of(it, "doc_id", "ids"):
            for key, ids in zip(keys, lists):
                known = ids is not None and all(k in own.bytes_of for k in ids)
                text = own.decode(ids).decode("utf-8", "replace") if known else None
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([text], pa.string())],
                                                 ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and its ids decoded,
    as digests.  No list of ids leaves its task; odd rows are treated as by `encode`."""
    prepare(docs.sparkSession)
    ranks = _ranks(docs, path)

    def run(it):
        own = coder(ranks.value, pattern)
        for keys, texts in rows_of(it, "doc_id", "text"):
            made = [own.digests(text or "") for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
