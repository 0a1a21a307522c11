"""Quality by hierarchical empirical Bayes.

A document classifier gives evidence for each document.  Its host and the path below it get a
posterior mean of that evidence: a sparse path is drawn towards its host, a sparse host towards
the whole corpus, by variances that are estimated from the corpus.  The document's score joins
its own evidence with the posterior of its path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import in_fold, prepare, rows_of, stored

LABELLED_ROWS = 20_000   # expected labelled rows that the classifier is fitted on
STEPS, RIDGE = 40, 1.0
CLIP = 4.0               # largest evidence of one document, in log-odds
PIECE = 1 << 20
NAMES = ["length", "blank", "letter", "upper", "digit", "mark", "odd", "mean_word", "long_word", "repeat", "lines"]

_KIND = np.zeros(256, np.uint8)          # 0 letter or beyond ASCII, 1 blank, 2 upper, 3 digit, 4 mark, 5 odd sign
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()-!?"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def measures(text: str | None) -> list[float]:
    """Shape of a whole text as numbers of about unit size."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * len(NAMES)
    kinds, words, size, long_, double, lines, before = np.zeros(6, np.int64), 0, 0, 0, 0, 1, None
    for at in range(0, len(data), PIECE):
        raw = data[at:at + PIECE]
        kinds += np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
        lines += raw.count(b"\n")
        parts = raw.split()
        sizes = np.array([len(p) for p in parts], np.int64)
        words, size, long_ = words + len(parts), size + int(sizes.sum()), long_ + int((sizes > 12).sum())
        double += sum(a == b for a, b in zip(parts, parts[1:])) + (bool(parts) and parts[0] == before)
        before = parts[-1] if parts else before
    n, words = len(data), max(1, words)
    return [np.log1p(n) / 10, *(kinds[[1, 0, 2, 3, 4, 5]] / n * [5, 1, 5, 10, 10, 10]).tolist(),
            size / words / 10, long_ / words * 3, double / words * 5, np.log1p(lines) / 5]


def design(rows: np.ndarray) -> np.ndarray:
    """Measures, their squares and a constant."""
    return np.concatenate([rows, rows ** 2, np.ones((len(rows), 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> np.ndarray:
    """Weights learned from labelled rows outside the held-out fold, a hash sample of about
    `rows` of them; what comes to the driver is their measures."""
    known = labels.where(~in_fold("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    total = known.count()
    share = int(min(1.0, rows / max(1, total)) * (1 << 30))
    drawn = (known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < share)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")))

    def measure(it):
        for ids, texts, quality in rows_of(it, "doc_id", "text", "quality"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(quality, pa.int32()),
                 pa.array([measures(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "quality", "m"])

    # About LABELLED_ROWS ids at any input size.
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
             .mapInArrow(measure, "doc_id long, quality int, m array<double>").toArrow())
    if not found.num_rows:
        return np.zeros(2 * len(NAMES) + 1)
    order = np.lexsort((found["quality"].to_numpy(), found["doc_id"].to_numpy()))
    x = np.array(found["m"].to_pylist())[order]
    return logistic(design(x), found["quality"].to_numpy()[order].astype(float))


def shrunk(groups: DataFrame, prior: str, within: float, keys: list[str]) -> DataFrame:
    """`groups` (n, mean, and a prior mean) with `posterior`: normal-normal shrinkage, the
    variance between groups estimated by moments."""
    gap = F.col("mean") - F.col(prior)
    n, squares, spread, count = groups.agg(
        F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * gap * gap), F.count("*")).first()
    between = max(0.0, (spread - count * within) / n) if n else 0.0
    weight = F.lit(between) / (F.lit(between) + F.lit(max(within, 1e-9)) / F.col("n"))
    return groups.withColumn("posterior", weight * F.col("mean") + (1 - weight) * F.col(prior))


def quality(docs: DataFrame, labels: DataFrame, host=None, path=None) -> DataFrame:
    """(doc_id, held_out, evidence, host_score, path_score, score, kept), one row per row of `docs`.

    `host` and `path` are string columns, by default the source and the language below it; null
    is a host or a path of its own.  Evidence is in log-odds; the host's and the path's posterior
    too.  score is a probability, kept where it is 0.5 or more.  A null or blank text has the
    evidence of an empty one; without labels every evidence is 0 and every score 0.5.  Null ids
    and repeated rows are scored each; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(fit(docs, labels))

    def weigh(it):
        for ids, texts, hosts, paths in rows_of(it, "doc_id", "text", "host", "path"):
            z = design(np.array([measures(t) for t in texts]).reshape(-1, len(NAMES))) @ sent.value
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(np.clip(z, -CLIP, CLIP))], ["doc_id", "host", "path", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       (F.col("source") if host is None else host).alias("host"),
                       (F.col("lang") if path is None else path).alias("path"))
    scored = stored(rows.mapInArrow(weigh, "doc_id long, host string, path string, evidence double"), "quality-evidence")
    # Sums are folded before the shuffle, so a host with a third of all rows sends one row per task.
    paths = stored(scored.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q")), "quality-paths")
    total, s, q, inner = paths.agg(F.sum("n"), F.sum("s"), F.sum("q"), F.sum(F.col("q") - F.col("s") ** 2 / F.col("n"))).first()
    centre = s / total if total else 0.0
    within = max(1e-6, inner / total) if total else 1.0
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    hosts = shrunk(hosts.withColumn("centre", F.lit(centre)), "centre", within, ["host"]).select(
        F.col("host").alias("_host"), F.col("posterior").alias("host_score"))
    below = paths.select("host", "path", "n", (F.col("s") / F.col("n")).alias("mean")).join(
        hosts, F.col("host").eqNullSafe(F.col("_host")))
    below = stored(shrunk(below, "host_score", within, ["host", "path"]).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "host_score", F.col("posterior").alias("path_score")),
        "quality-posteriors")
    found = scored.join(below, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.col("path_score") - F.lit(centre))))
    return found.withColumn("score", score).select(
        "doc_id", in_fold("doc_id").alias("held_out"), "evidence", "host_score", "path_score", "score",
        (F.col("score") >= 0.5).alias("kept"))
