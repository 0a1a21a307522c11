"""b-bit MinHash near-duplicates of documents.

A document is its set of word shingles.  Exact copies are folded to one representative
first.  Representatives meet in bands of full minima; of all minima only the low bits are
kept, packed as bit planes, and pairs are compared by counting differing positions,
corrected for chance collisions.  Pairs that may be similar enough are confirmed on whole
shingle sets.  Links are joined to components by distributed union-find.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planeweave.llm.common import mixed, prepare, rows_of, shingle_hashes, stored, word_hashes
from planeweave.llm.components import components

HASHES = 128
BITS = 4                 # low bits kept of every minimum, one plane of HASHES bits each
BANDS, BAND_ROWS = 25, 5
MARGIN = 4.0             # standard deviations below the limit that still get confirmed
BLOCK_BYTES = 16 << 20   # texts of a candidate cluster that one block of a task holds
BLOCK_ROWS = 1 << 14     # and texts of it
HELD = 1 << 21           # shingles of sets that a task keeps

_FACTORS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WEIGHTS = mixed(np.arange(1000, 1000 + BAND_ROWS, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII blanks only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima of a non-empty shingle set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at:at + 512]
        np.minimum(low, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=low)
    return low


def planes(low: np.ndarray) -> bytes:
    """The low bits of the mixed minima: BITS planes of HASHES bits."""
    value = mixed(low)
    return b"".join(np.packbits(((value >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).tobytes()
                    for b in range(BITS))


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band, the band's number mixed in."""
    part = low[:BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    value = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(BAND_ROWS):
        value = mixed(value + part[:, k] * _WEIGHTS[k])
    return value.view(np.int64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Similarity by differing positions: equal low bits also occur by chance."""
    chance = 2.0 ** -BITS
    return (1.0 - differing / HASHES - chance) / (1.0 - chance)


def least_estimate(percent: int) -> float:
    """The lowest estimate that a pair at the limit is allowed to get."""
    chance = 2.0 ** -BITS
    equal = chance + (1 - chance) * percent / 100.0
    return percent / 100.0 - MARGIN * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, raw, n_shingles, digest, bytes, sig, bands); the last four are null for empty sets.
    `raw` is the digest of the text as it is, `digest` that of its words."""
    def sign(it):
        for ids, raw, texts in rows_of(it, "doc_id", "raw", "text"):
            count, digest, size, sig, bands = [], [], [], [], []
            for text in texts:
                data = b"" if text is None else text.encode("utf-8", "surrogatepass").lower()
                shingles = shingle_hashes(word_hashes(data), width)
                count.append(len(shingles))
                size.append(len(data))
                if not len(shingles):
                    digest.append(None), sig.append(None), bands.append(None)
                    continue
                low = minima(shingles)
                digest.append(_digest(data))
                sig.append(planes(low)), bands.append(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(raw, pa.string()), pa.array(count, pa.int64()),
                 pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "raw", "n_shingles", "digest", "bytes", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_digest().alias("raw"), "text").mapInArrow(
        sign, "doc_id long, raw string, n_shingles long, digest binary, bytes long, sig binary, bands array<long>")


def raw_digest():
    """Digest of a text as it is; a null text has one of its own."""
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))


def _digest(data: bytes) -> bytes:
    return hashlib.md5(b" ".join(data.split())).digest()


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _shingle_set(text: str, width: int) -> set:
    words = words_of(text)
    width = min(width, len(words))
    return set(zip(*(words[k:len(words) - width + 1 + k] for k in range(width))))


def confirmed(sig, counts, side, crossing: bool, percent: int, set_of):
    """Links (i, j) of one task that join what was apart, each confirmed on the whole sets
    that `set_of` gives.  Without signatures all pairs of like size are likely.

    Row by row, pairs estimated above the limit in a first pass: partners that are joined
    already are left out, of the others the most likely of each joined group goes first.  No
    more than the pairs of one row are held.
    """
    n = len(counts)
    if sig is None:
        return _confirmed_few(n, counts, side, crossing, percent, set_of)
    order = np.argsort(side, kind="stable") if crossing else np.arange(n)
    size = np.asarray(counts, np.int64)[order]
    cut = int(np.count_nonzero(np.asarray(side) == np.asarray(side)[order[0]])) if crossing and n else 0
    bits = np.frombuffer(b"".join(sig), np.uint64).reshape(n, -1)[order]
    per_plane = bits.shape[1] // BITS
    label, found = np.arange(n), []
    members: dict[int, list[int]] = {}
    sets: dict[int, set] = {}
    held = 0

    def held_set(k, beside):
        nonlocal held
        if k not in sets:
            if held > HELD:
                mine = sets.get(beside)
                sets.clear()
                if mine is not None:
                    sets[beside] = mine
                held = len(mine or ())
            sets[k] = set_of(int(order[k]))
            held += len(sets[k])
        return sets[k]

    limit, rows = percent / 100.0, cut if crossing else n - 1
    passes = ((limit, np.inf), (least_estimate(percent), limit))
    for i, (least, most) in ((i, between) for between in passes for i in range(rows)):
        at = cut if crossing else i + 1
        low, high = np.minimum(size[i], size[at:]), np.maximum(size[i], size[at:])
        near = np.flatnonzero((100 * low >= percent * high) & (label[at:] != label[i])) + at
        if not len(near):
            continue
        apart = bits[i] ^ bits[near]
        differ = apart[:, :per_plane]
        for b in range(1, BITS):
            differ = differ | apart[:, b * per_plane:(b + 1) * per_plane]
        estimate = similarity(np.bitwise_count(differ).sum(axis=1))
        likely = np.flatnonzero((estimate >= least) & (estimate < most))
        if not len(likely):
            continue
        near = near[likely[np.argsort(-estimate[likely], kind="stable")]]
        first = np.zeros(len(near), bool)
        first[np.unique(label[near], return_index=True)[1]] = True
        for j in np.concatenate((near[first], near[~first])).tolist():
            if label[i] == label[j]:
                continue
            one, two = held_set(i, j), held_set(j, i)
            both = len(one & two)
            if 100 * both >= percent * (len(one) + len(two) - both):
                found.append((int(order[i]), int(order[j])))
                # The smaller group takes the label of the larger.
                a, b = (int(x) for x in (label[i], label[j]))
                mine, other = members.pop(a, [a]), members.pop(b, [b])
                if len(mine) < len(other):
                    a, mine, other = b, other, mine
                label[other] = a
                mine += other
                members[a] = mine
    return found


def _confirmed_few(n, counts, side, crossing, percent, set_of):
    forest, found = Forest(n), []
    for i in range(n - 1):
        for j in range(i + 1, n):
            if (crossing and side[i] == side[j] or 100 * min(counts[i], counts[j]) < percent * max(counts[i], counts[j])
                    or forest.root(i) == forest.root(j)):
                continue
            one, two = set_of(i), set_of(j)
            both = len(one & two)
            if 100 * both >= percent * (len(one) + len(two) - both):
                forest.union(i, j)
                found.append((i, j))
    return found


def _meetings(reps: DataFrame) -> DataFrame:
    """Edges (a, b) from the first text of each crowded band to its others."""
    keys = reps.select("id", F.explode("bands").alias("band"))
    crowded = keys.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top")
    # Sized from the files, the exploded keys would look small enough to be sent through the driver.
    return (keys.hint("merge").join(crowded.select("band", "hub").hint("merge"), "band").where("id != hub")
            .select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())


def grouped_documents(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, raw, n_shingles, grp, component_id), one row per row of `docs`: `grp` tells the groups
    of linked documents apart, component_id is the smallest doc_id in the group.

    A text of a doc_id is a document, so an id that comes with different texts can be in several
    groups.  Both are null for a null doc_id; a text without words has a null group.
    """
    prepare(docs.sparkSession)
    signed = stored(signatures(docs, width), "bbit-signatures")
    # Exact copies: one aggregate row per task and text, however many copies there are.  Ids are
    # given once and read from the files from then on.
    reps = stored(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"),
             F.first("n_shingles").alias("n_shingles"), F.first("bytes").alias("bytes"))
        .withColumn("id", F.monotonically_increasing_id()), "bbit-representatives")
    clusters = components(_meetings(reps), "bbit-clusters")
    links = _links(docs, reps, stored(clusters, "bbit-members"), width, percent)
    joined = stored(components(links, "bbit-components"), "bbit-linked").join(
        reps.select(F.col("id").alias("node"), "rep"), "node")
    least = joined.groupBy("component").agg(F.min("rep").alias("least"))
    linked = joined.select("node", "component").join(least, "component")
    named = reps.join(linked, reps["id"] == linked["node"], "left").select(
        "digest", F.coalesce("component", "id").alias("grp"), F.coalesce("least", "rep").alias("found"))
    has_id = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "raw", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "raw", "n_shingles", F.when(has_id, F.col("grp")).alias("grp"),
        F.when(has_id, F.coalesce("found", "doc_id")).alias("component_id"))


def duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`.

    Linked are documents whose sets of `width`-word shingles share at least `percent` percent
    of their union; component_id is the smallest doc_id that can be reached.  A text of fewer
    words is one shingle.  A null or blank text has no shingle and is linked with nothing; a
    null doc_id gets its own null component and is kept.  Repeated rows are one document; rows
    that repeat a doc_id with another text are documents of their own.  Other columns of
    `docs` are not read.
    """
    return grouped_documents(docs, width, percent).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join each cluster as far as its texts are similar.

    A cluster is cut into blocks by a hash of the text, of about BLOCK_BYTES or BLOCK_ROWS;
    every pair of blocks is one group and hands on at most one link per text.
    """
    members = reps.join(clusters, reps["id"] == clusters["node"]).select(
        "id", "digest", "rep", "sig", "n_shingles", "bytes", "component")
    sizes = members.groupBy("component").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_ROWS))
        .cast("int").alias("blocks"))
    placed = (members.join(sizes, "component")
              .withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("id", "digest", "rep", "sig", "n_shingles", "component", "own",
                      F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))
    # Only the texts of the representative are sent, once for each group that it is in.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("text IS NOT NULL")
    chosen = placed.join(texts, "rep")

    def compare(group):
        # An id may have further texts, and a text further rows.
        if group["id"].duplicated().any():
            own = [_digest(t.encode("utf-8", "surrogatepass").lower()) == bytes(d) for t, d in zip(group["text"], group["digest"])]
            group = group[own].drop_duplicates("id")
        texts = group["text"].tolist()
        found = confirmed(group["sig"].tolist(), group["n_shingles"].to_numpy(), group["own"].to_numpy(),
                          group["low"].iat[0] != group["high"].iat[0], percent, lambda k: _shingle_set(texts[k], width))
        ids = group["id"].to_numpy()
        return _frame([ids[i] for i, _ in found], [ids[j] for _, j in found])

    return chosen.groupBy("component", "low", "high").applyInPandas(compare, "a long, b long")


def _frame(a, b):
    import pandas as pd

    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Three-word shingles, 85 percent: the form of the registered query."""
    return duplicates(docs, 3, 85)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays (five words, 0.8).

    Of a group the smallest doc_id stays, and of its texts in the group the one with the
    smallest digest.  Rows that repeat a doc_id and its text are one document and leave the row
    that comes first in the order of its other values.  Rows with a null doc_id stay as they are.
    """
    found = stored(grouped_documents(docs, 5, 80).select(
        F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "grp").where("_id IS NOT NULL"), "bbit-found")
    first = found.where("grp IS NOT NULL").groupBy("grp").agg(F.min(F.struct("_id", "_raw")).alias("first"))
    gone = found.join(first, "grp").where(F.struct("_id", "_raw") != F.col("first")).select("_id", "_raw").distinct()
    again = found.groupBy("_id", "_raw").count().where("count > 1").select("_id", "_raw")
    rows = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").cast("long").alias("_id"), raw_digest().alias("_raw"))
    left = rows.join(gone, ["_id", "_raw"], "left_anti")
    order = Window.partitionBy("_id", "_raw").orderBy(F.to_json("_row", {"ignoreNullFields": "false"}))
    once = left.join(again, ["_id", "_raw"], "left_semi").withColumn("_no", F.row_number().over(order)).where("_no = 1")
    return left.join(again, ["_id", "_raw"], "left_anti").select("_row").union(once.select("_row")).select("_row.*")
