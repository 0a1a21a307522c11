"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Every language is a distribution over hashed character trigrams of lower-cased letters and
word edges.  A document is a mixture of languages; expectation-maximisation estimates its
proportions, and the set of languages is the one with the best likelihood after a penalty
for each further language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm.common import in_fold, prepare, rows_of

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS = 4_000      # expected labelled rows per language that the model is fitted on
SMOOTHING = 0.5
STEPS = 15
PENALTY = 3.0            # nats per further language, times the logarithm of the length
PIECE = 1 << 20          # characters of a text that are turned into arrays at a time
LEAST_SHARE = 0.4        # of a document's main language, in the pipeline
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTERS[0]


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed trigrams of the whole text; None when it holds no letter."""
    if not text:
        return None
    counts, carry = None, np.zeros(1, np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        codes = np.concatenate((carry, codes))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        last = at + PIECE >= len(text)
        if last and codes[-1]:
            codes = np.concatenate((codes, np.zeros(1, np.uint32)))
        carry = codes[-2:]
        if len(codes) < 3:
            continue
        value = (codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA77)
        value = (value ^ (value >> np.uint32(15))) + codes[2:]
        value = (value * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BUCKET_BITS)
        found = np.bincount(value, minlength=BUCKETS)
        counts = found if counts is None else counts + found
    return counts


class Model:
    """Languages in code-point order and their log-probabilities, one column per language."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    def mixture(self, counts: np.ndarray | None) -> np.ndarray | None:
        """Language proportions of one document."""
        if counts is None or not self.languages:
            return None
        used = np.flatnonzero(counts)
        c, log_p = counts[used].astype(float), self.log_p[used]
        n = c.sum()
        single = c @ log_p
        best = int(single.argmax())
        share = np.zeros(len(self.languages))
        share[best] = 1.0
        if len(self.languages) == 1:
            return share
        high = log_p.max(axis=1)
        p = np.exp(log_p - high[:, None])
        base = float(c @ high)
        cost = PENALTY * np.log(n + 1.0)
        full, top = self._fit(p, c, n, base)
        # Overlapping trigrams count every letter three times.
        if (top - single[best]) / 3.0 <= cost:
            return share
        order, value = np.argsort(-full, kind="stable"), single[best] / 3.0
        for k in range(2, len(self.languages) + 1):
            chosen = np.sort(order[:k])
            part, like = self._fit(p[:, chosen], c, n, base)
            if like / 3.0 - (k - 1) * cost <= value:
                break
            value = like / 3.0 - (k - 1) * cost
            share = np.zeros(len(self.languages))
            share[chosen] = part
        return share

    @staticmethod
    def _fit(p, c, n, base):
        share = np.full(p.shape[1], 1.0 / p.shape[1])
        for _ in range(STEPS):
            share = share * ((c / (p @ share + 1e-300)) @ p) / n
        share /= share.sum()
        return share, base + float(c @ np.log(p @ share + 1e-300))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the languages named in `lang` on a sample chosen by a hash of the row.

    The sample is about `sample_rows` rows per language at any input size, so what comes to
    the driver is one count per language and trigram bucket.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(min(1.0, sample_rows / sizes[g])))])
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = {g: k for k, g in enumerate(languages)}

    def count(it):
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for texts, langs in rows_of(it, "text", "lang"):
            for text, lang in zip(texts, langs):
                found = trigram_counts(text)
                if found is not None:
                    totals[at[lang]] += found
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(totals[lang, bucket])],
            ["lang", "bucket", "n"])

    counted = (rows.where(draw < share[F.col("lang")]).select("text", "lang")
               .mapInArrow(count, "lang int, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    totals = np.full((BUCKETS, len(languages)), SMOOTHING)
    totals[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] += counted["n"].to_numpy()
    return Model(languages, np.log(totals / totals.sum(axis=0)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` and lang_pred, score (share of that language), mixture.

    `und` with score 0 and an empty mixture: null texts, texts without a letter, and every
    text when no language was learned.  Equal shares go to the language first in code-point
    order.  Input columns with the names of the results are replaced; every row, repeated
    ones too, is scored by itself, and an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "mixture")]
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema]
                       + ["lang_pred string", "score double", "mixture map<string,double>"])

    def score(it):
        local = Model(*sent.value)
        for batch in it:
            langs, scores, mixtures = [], [], []
            for text in batch.column("text").to_pylist():
                share = local.mixture(trigram_counts(text))
                if share is None:
                    langs.append(UNKNOWN), scores.append(0.0), mixtures.append([])
                    continue
                best = int(share.argmax())
                langs.append(local.languages[best])
                scores.append(float(share[best]))
                mixtures.append([(local.languages[k], float(share[k])) for k in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                   pa.array(mixtures, pa.map_(pa.string(), pa.float64()))],
                [*names, "lang_pred", "score", "mixture"])

    return docs.select([F.col(f"`{c}`") for c in names]).mapInArrow(score, schema)


def language_of(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold and predict every row.

    Returns doc_id, held_out, lang_pred, score, mixture.  Rows with a null doc_id are never
    held out.
    """
    prepare(docs.sparkSession)
    model = fit(docs.where(~in_fold("doc_id")))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold("doc_id").alias("held_out"), "lang_pred", "score", "mixture")


def identify_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language go.

    A document is rejected when no language is recognised or when none makes up 0.4 of it.  The rows
    of the others stay as they are, whatever their columns are called.
    """
    prepare(spark)
    model = fit(docs.where(~in_fold("doc_id")))
    sent = spark.sparkContext.broadcast((model.languages, model.log_p))

    def known(it):
        local = Model(*sent.value)
        for batch in it:
            shares = [local.mixture(trigram_counts(text)) for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([s is not None and float(s.max()) >= LEAST_SHARE for s in shares], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
