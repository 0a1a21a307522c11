"""Benchmark decontamination: passages of documents query an index of the test items.

The index is a BM25 inverted index over the items, cut into parts of a few dozen words.
Every overlapping passage of every document is a query; block-max WAND retrieves all parts
above a threshold.  A retrieved item counts only when its question and its answer both occur
in the document around the passage: by shared shingles, or aligned word by word, so that an
edited word costs one word and not all shingles across it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm.common import prepare, rows_of, stored, word_hashes

PART_WORDS = 32          # longest indexed part of an item
PASSAGE_WORDS = 64       # passages start every half passage, so a part lies whole in one
BLOCK = 32               # postings with one block maximum
RANGES, RANGE_PARTS = 64, 8   # ranges of parts with a maximum per term, and their least length
THRESHOLD = 0.7          # share of a part's score with itself
OVERLAP = 0.6            # share of the shingles of question and of answer that must be found
ALIGNED = 0.75           # or share of the words of either that must be found in place
WHOLE = 0.85             # or of the whole item, when SIDE of either is in place
SIDE = 0.5
SHINGLE = 5
K1, B = 1.2, 0.75
SHARD_BYTES = 8 << 20    # text of the items that one index holds

# A word is a run of ASCII letters, digits, underscores and characters beyond ASCII.
_WORD = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")
_BETWEEN = np.array([b < 128 and not (chr(b).isalnum() or chr(b) == "_") for b in range(256)])
_SIEVE_BITS = 20
_BREAK = re.compile(r"[.!?\n]\s*(?=\S)")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence is the answer when both
    sides hold five words, else all is question."""
    cut = 0
    for m in _BREAK.finditer(text):
        if len(tokens(text[:m.end()])) >= SHINGLE and len(tokens(text[m.end():])) >= SHINGLE:
            cut = m.end()
    return (tokens(text[:cut]), tokens(text[cut:])) if cut else (tokens(text), [])


def shingles(words: list[str]) -> set:
    width = min(SHINGLE, len(words))
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)} if words else set()


def aligned(part: list[str], near: list[str]) -> float:
    """Share of a part's words that stay in the stretch of `near` most like it: 1 less the
    fewest edits of single words for each word of the part."""
    if not part:
        return 1.0
    known = {w: k for k, w in enumerate(dict.fromkeys(part))}
    text = np.array([known.get(w, -1) for w in near], np.int64)
    steps = np.arange(len(near) + 1)
    edits = np.zeros(len(near) + 1, np.int64)      # a stretch may start anywhere
    for w in part:
        now = edits + 1
        np.minimum(now[1:], edits[:-1] + (text != known[w]), out=now[1:])
        edits = np.minimum.accumulate(now - steps) + steps
    return 1.0 - int(edits.min()) / len(part)


def parts_of(question: list[str], answer: list[str]) -> list[list[str]]:
    """The indexed parts of an item: its words in pieces of about equal length."""
    words = question + answer
    count = -(-len(words) // PART_WORDS)
    return [words[k * len(words) // count:(k + 1) * len(words) // count] for k in range(count)]


class Statistics:
    """What BM25 needs of all parts: their number, their mean length, and how many hold a term."""

    def __init__(self, parts: int, words: int, holding: dict[str, int]):
        self.parts, self.mean, self.holding = parts, words / parts if parts else 1.0, holding

    @staticmethod
    def of(parts: list[list[str]]) -> "Statistics":
        holding: dict[str, int] = {}
        for words in parts:
            for w in set(words):
                holding[w] = holding.get(w, 0) + 1
        return Statistics(len(parts), sum(map(len, parts)), holding)


class Index:
    """Inverted index of item parts with impacts scaled so that a part scores 1 with itself.

    `statistics` are those of the whole benchmark where the index holds some of its items only.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        self.items = [(i, *question_answer(t)) for i, t in items if tokens(t)]
        self.part_item: list[int] = []
        parts = []
        for at, (_, question, answer) in enumerate(self.items):
            own_parts = parts_of(question, answer)
            parts += own_parts
            self.part_item += [at] * len(own_parts)
        statistics = statistics or Statistics.of(parts)
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for p, words in enumerate(parts):
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            for w, n in counts.items():
                t = self.terms.setdefault(w, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((p, n))
        lengths = np.array([len(w) for w in parts], float)
        own, raw = np.zeros(len(parts)), []
        for w, posting in zip(self.terms, postings):
            at = np.array([p for p, _ in posting])
            n = np.array([c for _, c in posting], float)
            holding = statistics.holding[w]
            idf = np.log(1 + (statistics.parts - holding + 0.5) / (holding + 0.5))
            value = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[at] / statistics.mean))
            own[at] += value
            raw.append((at, value))
        self.postings = [(at.tolist(), (value / own[at]).tolist()) for at, value in raw]
        self.ends = [[at[min(k + BLOCK, len(at)) - 1] for k in range(0, len(at), BLOCK)] for at, _ in self.postings]
        self.tops = [[max(v[k:k + BLOCK]) for k in range(0, len(v), BLOCK)] for _, v in self.postings]
        self.best = np.array([max(v) for _, v in self.postings] + [0.0])
        # Terms by hash: a sieve over the low bits, then a search.
        hashes = np.array([word_hashes(w.encode("utf-8", "surrogatepass"))[0] for w in self.terms], np.uint64)
        self.term_of = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.term_of]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[(hashes & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)] = True
        # Maxima over longer ranges of parts: bounds of many passages in one sum of rows.
        self.length = max(RANGE_PARTS, -(-len(parts) // RANGES))
        self.high = np.zeros((len(self.best), max(1, -(-len(parts) // self.length))), np.float32)
        for t, (at, value) in enumerate(self.postings):
            np.maximum.at(self.high[t], np.array(at) // self.length, value)

    def retrieve(self, terms: list[int], threshold: float, low: int = 0, end: int = 1 << 62) -> list[tuple[int, float]]:
        """All parts from `low` to below `end` whose score with the distinct `terms` reaches
        `threshold`, by block-max WAND."""
        # A cursor: part it stands at, posting position, block position, term.
        cursors = []
        for t in terms:
            at = self.postings[t][0]
            p = bisect_left(at, low)
            if p < len(at) and at[p] < end:
                cursors.append([at[p], p, p // BLOCK, t])
        found, best = [], self.best
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += best[c[3]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            bound, stop = 0.0, None
            for c in cursors[:pivot + 1]:
                ends = self.ends[c[3]]
                while c[2] < len(ends) and ends[c[2]] < part:
                    c[2] += 1
                if c[2] < len(ends):
                    bound += self.tops[c[3]][c[2]]
                    stop = ends[c[2]] if stop is None else min(stop, ends[c[2]])
            if bound >= threshold:
                if cursors[0][0] == part:
                    score = 0.0
                    for c in cursors[:pivot + 1]:
                        score += self.postings[c[3]][1][c[1]]
                    if score >= threshold:
                        found.append((part, score))
                    target = part + 1
                else:
                    target = part
            else:
                # No part before the nearest block end or the next cursor can reach it.
                target = (stop if stop is not None else part) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, part + 1)
            left = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < target:
                    at = self.postings[c[3]][0]
                    ends, b = self.ends[c[3]], c[2]
                    while b < len(ends) and ends[b] < target:
                        b += 1
                    if b == len(ends):
                        continue
                    p = max(c[1], b * BLOCK)
                    while at[p] < target:
                        p += 1
                    if at[p] >= end:
                        continue
                    c[0], c[1], c[2] = at[p], p, b
                left.append(c)
            cursors = left
        return found

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question overlap, answer overlap, first word of the passage), one
        row per item of the index that the text holds: its best passage."""
        if not text or not len(self.hashes):
            return []
        ids, unknown = self.ids(text), len(self.postings)
        half, words = PASSAGE_WORDS // 2, None
        out: dict[int, tuple] = {}
        for s in self.open_passages(ids, half, threshold):
            e = min(s + PASSAGE_WORDS, len(ids))
            terms = np.sort(ids[s:e])
            terms = terms[np.append(terms[1:] != terms[:-1], True) & (terms < unknown)]
            # The range bound again, each distinct term once.
            ranges = np.flatnonzero(self.high[terms].sum(axis=0) >= threshold - 1e-4).tolist()
            for part, score in [x for r in ranges for x in self.retrieve(
                    terms.tolist(), threshold, r * self.length, (r + 1) * self.length)]:
                words = words or tokens(text)
                item = self.part_item[part]
                # Equal but for the order in which terms were added: the first passage stays.
                if item in out and out[item][1] >= score - 1e-9:
                    continue
                row = self.verified(item, words, s, e, overlap)
                if row:
                    out[item] = (self.items[item][0], score, *row, s)
        return list(out.values())

    def ids(self, text: str) -> np.ndarray:
        """The index's term number of every word of a text; words it lacks get the last one."""
        value = word_hashes(text.lower().encode("utf-8", "surrogatepass"), _BETWEEN)
        out = np.full(len(value), len(self.postings), np.int64)
        hit = np.flatnonzero(self.sieve[(value & np.uint64((1 << _SIEVE_BITS) - 1)).view(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, value[hit]), len(self.hashes) - 1)
        same = self.hashes[at] == value[hit]
        out[hit[same]] = self.term_of[at[same]]
        return out

    def open_passages(self, ids: np.ndarray, half: int, threshold: float) -> list[int]:
        """Starts of the passages whose terms can reach the threshold in some range of parts."""
        found, unknown = [], len(self.postings)
        for at in range(0, len(ids), half * 512):
            part = ids[at:at + half * 513]
            count = -(-len(part) // half)
            # Each known term once for each half passage.
            key = (np.arange(len(part)) // half) * (unknown + 1) + part
            key = np.sort(key[part < unknown])
            key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
            cuts = np.searchsorted(key, np.arange(count) * (unknown + 1))
            sums = np.zeros((count + 1, self.high.shape[1]), np.float32)
            full = np.flatnonzero(np.diff(np.append(cuts, len(key))))
            if len(full):
                sums[full] = np.add.reduceat(self.high[key % (unknown + 1)], cuts[full], axis=0)
            if at + len(part) < len(ids):
                sums = sums[:-1]
            both = (sums[:-1] + sums[1:]).max(axis=1)
            found += (at + half * np.flatnonzero(both >= threshold - 1e-4)).tolist()
        return found

    def verified(self, item: int, words: list[str], start: int, stop: int, overlap: float):
        """Shares of the question and of the answer that occur around a passage, by shingles
        or aligned words, whichever finds more."""
        _, question, answer = self.items[item]
        reach = len(question) + len(answer)
        near = words[max(0, start - reach):stop + reach]

        def share(part):
            wanted = shingles(part)
            width = len(next(iter(wanted))) if wanted else 1
            there = {tuple(near[k:k + width]) for k in range(len(near) - width + 1)}
            return len(wanted & there) / len(wanted) if wanted else 1.0

        q, a = share(question), share(answer)
        if q >= overlap and a >= overlap:
            return q, a
        # Words that occur at all bound what can be aligned.
        there = set(near)
        if any(sum(w in there for w in part) < SIDE * len(part) for part in (question, answer)):
            return None
        in_place = aligned(question, near), aligned(answer, near)
        both = max(q, in_place[0]), max(a, in_place[1])
        if all(x >= overlap or y >= ALIGNED for x, y in zip((q, a), in_place)):
            return both
        return both if min(both) >= SIDE and aligned(question + answer, near) >= WHOLE else None


def indexes(benchmark: DataFrame):
    """(index, whether it is the last): indexes over all items, each of about SHARD_BYTES of text,
    one after the other.

    Items are dealt to the indexes by a hash.  The statistics are counted once over all items, so
    a passage is judged alike however many indexes there are.
    """
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))

    def tally(it):
        for shards, texts in rows_of(it, "shard", "text"):
            found: dict[tuple, list] = {}
            for shard, text in zip(shards, texts):
                for words in parts_of(*question_answer(text)):
                    for term in (None, *set(words)):
                        row = found.setdefault((shard, term), [0, 0])
                        row[0] += 1
                        row[1] += len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.string()),
                 pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                ["shard", "term", "parts", "words"])

    counts = stored(dealt.select("shard", "text").mapInArrow(tally, "shard long, term string, parts long, words long")
                    .groupBy("shard", "term").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words")), "bench-terms")
    total = counts.where("term IS NULL").agg(F.sum("parts"), F.sum("words")).first()
    everywhere = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("parts").alias("parts"))
    for k in range(count):
        # What comes to the driver is one index's items and its terms.
        rows = dealt.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        terms = everywhere.join(counts.where((F.col("shard") == k) & F.col("term").isNotNull()).select("term"), "term")
        statistics = Statistics(total[0] or 0, total[1] or 0, {r["term"]: r["parts"] for r in terms.collect()})
        yield Index([(r["item_id"], r["text"]) for r in rows], statistics), k == count - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_word) per document and item.

    Null or wordless texts and items match nothing; an item of fewer than five words is one
    shingle; an overlap is the larger of the shares of shingles and of aligned words; repeated
    rows each give their matches; a null doc_id is carried as null; the
    best passage is reported, the first one among equals.  Empty tables give an empty result
    and columns other than doc_id, item_id and text are not read.
    """
    spark = prepare(docs.sparkSession)
    schema = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
              "passage_word long")
    found = spark.createDataFrame([], schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index, last in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def search(it, sent=sent):
            index = sent.value
            for ids, texts in rows_of(it, "doc_id", "text"):
                rows = [(i, *m) for i, t in zip(ids, texts) for m in index.matches(t, threshold, overlap)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(NAMES, r)) for r in rows], schema=RESULT)

        matches = source.mapInArrow(search, schema)
        if not last:
            # Executors hold one index at a time: what it finds is written before the next is sent.
            matches = stored(matches, "bench-matches")
            sent.unpersist()
        found = found.union(matches)
    return found


NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_word"]
RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                    ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage_word", pa.int64())])


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go, clean ones and null texts stay."""
    prepare(spark)
    names, left = docs.columns, docs
    schema = docs.schema
    for index, last in indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        sent = spark.sparkContext.broadcast(index)

        def clean(it, sent=sent):
            index = sent.value
            for batch in it:
                keep = [not index.matches(t, THRESHOLD, OVERLAP) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        left = left.mapInArrow(clean, schema)
        if not last:
            left = stored(left, "bench-clean")
            sent.unpersist()
    return left.select(names)
