"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, toxic ones among
them, is unlabelled.  A linear classifier over hashed words and word beginnings minimises the
class-prior-corrected risk, whose estimate of the negative part is kept from going below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import BLANK, in_fold, prepare, rows_of, stored, word_hashes

FEATURE_BITS = 20
POSITIVE_ROWS = 4_000    # expected confirmed rows that are learned from
UNLABELLED_ROWS = 12_000  # expected unlabelled rows
FEATURES = 4_096         # features that tell the two samples apart best
LEAST_SHARE = 0.004      # share of the positives that a feature must occur in
STEPS, RATE, DECAY = 400, 0.05, 2e-3
PREFIX = 5
PIECE = 1 << 20

_BETWEEN = BLANK.copy()
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True


def hashed_features(text: str | None) -> np.ndarray:
    """Sorted distinct features of the whole text: its words and their beginnings."""
    if not text:
        return np.zeros(0, np.int64)
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            # Pieces end between words; a word longer than a piece is cut.
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else end
        data = text[at:end].lower().encode("utf-8", "surrogatepass")
        words = np.unique(word_hashes(data, _BETWEEN))
        raw = np.frombuffer(data, np.uint8)
        blank = _BETWEEN[raw]
        run = np.arange(len(raw)) - np.maximum.accumulate(np.where(blank, np.arange(len(raw)), -1))
        starts = np.unique(word_hashes(np.where(run > PREFIX, 32, raw).astype(np.uint8).tobytes(), _BETWEEN))
        mask = np.uint64((1 << FEATURE_BITS) - 1)
        parts += [(words & mask).astype(np.int64), ((starts >> np.uint64(24)) & mask).astype(np.int64)]
        at = end
    return np.unique(np.concatenate(parts))


def risk_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Gradient, in the scores, of the non-negative positive-unlabelled risk with log loss.

    prior * mean_p loss(+) + max(0, mean_u loss(-) - prior * mean_p loss(-)); while the second
    part is negative its gradient is turned round, so that it rises again.
    """
    p, u = positive, ~positive
    right = 1.0 / (1.0 + np.exp(-z))
    grad = np.zeros_like(z)
    plus, minus = max(1, p.sum()), max(1, u.sum())
    high = np.logaddexp(0.0, z)
    rest = high[u].sum() / minus - prior * high[p].sum() / plus
    if rest >= 0:
        grad[p] = prior * (right[p] - 1.0) / plus - prior * right[p] / plus
        grad[u] = right[u] / minus
    else:
        grad[p] = prior * right[p] / plus
        grad[u] = -right[u] / minus
    return grad


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(1 << FEATURE_BITS)
        self.table[features] = weights
        self.bias = bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.table[hashed_features(text)].sum())
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -500, 500))))


def train(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with running moments."""
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not positive.any() or positive.all():
        return weights, bias
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(owner, weights[cols], len(rows)) + bias
        g = risk_gradient(z, positive, prior)
        step = np.append(np.bincount(cols, g[owner], size) + DECAY * prior * weights, g.sum())
        first = 0.9 * first + 0.1 * step
        second = 0.99 * second + 0.01 * step * step
        move = RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, positive_rows: int = POSITIVE_ROWS,
        unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Learn from rows outside the held-out fold.

    The class prior is the share of toxic rows among the labelled ones.  Both samples are
    drawn by a hash of the id with an expected size that does not grow with the input; what
    comes to the driver is the chosen features of the sampled rows.
    """
    known = labels.where(~in_fold("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = docs.where(~in_fold("doc_id")).count()
    if not counts.get(1) or not total:
        return Model(np.zeros(0, np.int64), np.zeros(0), -8.0)
    prior = min(0.9, counts[1] / sum(counts.values()))

    def drawn(share, salt):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    rows = docs.where(~in_fold("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    toxic = (known.where((F.col("toxic") == 1) & drawn(positive_rows / counts[1], "p"))
             .select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    # About POSITIVE_ROWS ids at any input size; the unlabelled rows need no join.
    picked = (rows.join(F.broadcast(toxic), "doc_id").select("text", F.lit(1).alias("positive"))
              .union(rows.where(drawn(unlabelled_rows / total, "u")).select("text", F.lit(0).alias("positive"))))

    def extract(it):
        for texts, positive in rows_of(it, "text", "positive"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(positive, pa.int32()), pa.array([hashed_features(t) for t in texts], pa.list_(pa.int64()))],
                ["positive", "features"])

    sample = stored(picked.mapInArrow(extract, "positive int, features array<long>"), "toxic-sample")
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    seen = (sample.select("positive", F.explode("features").alias("feature")).groupBy("feature")
            .agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u")))
    share_p, share_u = (F.col("p") + 0.5) / (n1 + 1.0), (F.col("u") + 0.5) / (n0 + 1.0)
    # How far apart the shares are, in units of their chance variation.
    apart = F.abs(share_p - share_u) / F.sqrt((share_p + share_u) * (1.0 / n1 + 1.0 / n0))
    best = (seen.where(F.col("p") >= max(2.0, LEAST_SHARE * n1))
            .orderBy(apart.desc(), "feature").limit(FEATURES).select("feature").collect())
    features = np.sort(np.array([r["feature"] for r in best], np.int64))

    def choose(it):
        for positive, found in rows_of(it, "positive", "features"):
            own = [np.flatnonzero(np.isin(features, f, assume_unique=True)).tolist() for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(positive, pa.int32()), pa.array(own, pa.list_(pa.int32()))], ["positive", "features"])

    chosen = sample.mapInArrow(choose, "positive int, features array<int>").toArrow()
    positive = chosen["positive"].to_numpy() == 1
    own = [np.array(x, np.int64) for x in chosen["features"].to_pylist()]
    # Rows come in no fixed order: sorted, so that sums and therefore scores agree in reruns.
    order = sorted(range(len(own)), key=lambda k: (not positive[k], own[k].tobytes()))
    weights, bias = train([own[k] for k in order], positive[order], len(features), prior)
    return Model(features, weights, bias)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    `score` is the probability of label 1 and `predicted` 1 from 0.5 on.  A null or empty
    text has the score of a text without known features.  Without labels every score is near
    0.  Rows with a null doc_id are scored and never held out; repeated rows are scored each;
    null labels are not learned from.  Only the named columns are read, and an empty table
    gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit(docs, labels))

    def score(it):
        model = sent.value
        for ids, texts in rows_of(it, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([model.score(t) for t in texts], pa.float64())],
                ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", in_fold("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
