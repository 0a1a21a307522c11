"""Personal data: fixed patterns, and a conditional random field that adds to them."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm import crf
from planeweave.llm.common import prepare, rows_of

_DIGIT = re.compile("[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A look-behind gives the same matches and keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from the @ sign as far as it can."""
    found, floor = [], 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            floor = m.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind and start."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text)
              if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and crf.luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _joined(spans) -> str:
    rank = {k: n for n, k in enumerate(crf.KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (rank[x[0]], x[1], x[2])))


def personal_data(docs: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of `docs`.

    The counts and the digest are those of the fixed patterns; `spans` holds these and the
    spans that the field adds, which overlap none of them.  Offsets are code points, the end
    exclusive.  A null text is an empty one, and both give counts of 0, the digest of an empty
    string and no spans.  Repeated rows and null ids are carried as they are; an empty table
    gives an empty result, and other columns are not read.  `labelled` are marked-up rows to
    train the field on, by default the small table of this package.
    """
    spark = prepare(docs.sparkSession)
    field = crf.train(labelled)
    sent = spark.sparkContext.broadcast((field.index, field.weights, field.change, field.first))
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

    def find(it):
        local = crf.Field(*sent.value)
        for ids, texts in rows_of(it, "doc_id", "text"):
            base = [base_spans(t) if t else [] for t in texts]
            runs = [(n, run) for n, t in enumerate(texts) if t for run in crf.candidates(t)]
            paths = local.decode([local.scores(crf.features(texts[n], run)) for n, run in runs])
            spans = [list(b) for b in base]
            for (n, run), path in zip(runs, paths):
                if path.any():
                    for kind, s, e in crf.spans_of(texts[n], run, path):
                        if all(e <= x[1] or x[2] <= s for x in spans[n]):
                            spans[n].append((kind, s, e))
            count = {k: [sum(s[0] == k for s in b) for b in base] for k in crf.KINDS}
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array(count[k], pa.int64()) for k in crf.KINDS],
                 pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([_joined(s) for s in spans], pa.string())],
                ["doc_id", *[f"n_{k}" for k in crf.KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)
