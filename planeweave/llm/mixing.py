"""Mixing sources to target weights: a min-cost flow from membership patterns to sources.

Documents are aggregated by the set of sources they belong to.  A pattern supplies its words
once at cost 1, a second time at cost 2 and so on; every source asks for its target.  The
cheapest flow gives the words that each pattern contributes, and documents are chosen within
a pattern in the order of a seeded hash.  Patterns and sources of any number stay in tables;
only sources that share patterns need the flow, each connected component in a task of its own.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planeweave.llm.common import grouped, prepare, stored
from planeweave.llm.components import components

WEIGHTS = (3, 1, 2)
SHARE = 1.5              # words of the mix for each word there is
REPEATS = 2              # most times that a document is taken
SEED = "mix-1"
HASH_BITS = 60
LEVELS = (12, 24, HASH_BITS)   # bits of the hash by which the last document is narrowed down
MOST_SENT = 100_000      # rows of the plan that are sent everywhere; a longer one is joined
RANGE_SOURCES = 100_000  # sources that one task numbers


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(doc_id, seed: str):
    """60 bits of a hash of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def pattern_of(membership):
    return F.coalesce(F.to_json(F.array_sort(F.array_distinct(membership))), F.lit("[]"))


def fill(sizes: list[int], weights: list[float], total: float, repeats: int) -> list[float]:
    """The plain form of `targets_of`: targets in proportion to the weights, none above `repeats` times its size: what a
    source cannot take is shared again among the others by weight."""
    targets, left = [0.0] * len(sizes), total
    open_ = sorted(range(len(sizes)), key=lambda k: (repeats * sizes[k] / weights[k], k))
    weight = float(sum(weights))
    while open_:
        level = left / weight
        k = open_[0]
        if repeats * sizes[k] / weights[k] > level:
            for k in open_:
                targets[k] = level * weights[k]
            break
        targets[k] = float(repeats * sizes[k])
        left -= targets[k]
        weight -= weights[k]
        open_.pop(0)
    return targets


def route(supply: dict[str, int], members: dict[str, list], quotas: dict, repeats: int) -> dict[str, int]:
    """Words that each pattern contributes in the cheapest flow that fills the quotas.

    Costs lie on the supplies alone and rise with each repetition, so cheapest paths come in
    the order of the repetitions: one more copy of every supply is released at a time, and
    the flow is augmented along shortest residual paths before the next.
    """
    flow: dict[tuple, int] = {}
    used = dict.fromkeys(supply, 0)
    left = dict(quotas)
    holds: dict = {s: [] for s in quotas}
    for p, sources in members.items():
        for s in sources:
            holds[s].append(p)
    for copies in range(1, repeats + 1):
        for start in sorted(supply):
            while (room := supply[start] * copies - used[start]) > 0:
                came: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    if kind == "p":
                        for s in members[x]:
                            if ("s", s) not in came:
                                came[("s", s)] = node
                                queue.append(("s", s))
                                if left[s] > 0:
                                    end = ("s", s)
                                    break
                    else:
                        for p in holds[x]:
                            if ("p", p) not in came and flow.get((p, x), 0) > 0:
                                came[("p", p)] = node
                                queue.append(("p", p))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                step = min([room, left[end[1]]] + [flow[(b[1], a[1])] for a, b in zip(path, path[1:]) if a[0] == "s"])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[(a[1], b[1])] = flow.get((a[1], b[1]), 0) + step
                    else:
                        flow[(b[1], a[1])] -= step
                used[start] += step
                left[end[1]] -= step
    return used


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` (source, size) with k, the place of each in code-point order, null last."""
    parts = max(1, -(-sources.count() // RANGE_SOURCES))
    order = [F.col("source").isNull(), F.col("source")]
    # The id holds the range above 33 bits and the place in it below.
    placed = stored(
        sources.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("id", 33)), "mix-sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))
    return placed.join(starts, "part").select(
        "source", "size", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("k"))


def targets_of(sources: DataFrame, weights, total: float, repeats: int) -> DataFrame:
    """`sources` with the target of each, as `fill` gives them.

    What each unit of weight gets rises as long as some source cannot take it: sums over the
    sources that can and that cannot are taken again until none is added to the latter.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    rows = stored(numbered(sources).withColumn("weight", weight).withColumn(
        "ratio", (F.lit(repeats) * F.col("size")).cast("double") / F.col("weight")), "mix-ratios")
    level, full = 0.0, -1
    while True:
        at = F.col("ratio") <= F.lit(level)
        if full < 0:
            at = F.lit(False)
        now = rows.agg(F.count(F.when(at, 1)).alias("full"), F.sum(F.when(at, F.lit(repeats) * F.col("size"))).alias("capped"),
                       F.sum(F.when(~at, F.col("weight"))).alias("weight")).first()
        if now["full"] == full:
            break
        full = now["full"]
        if now["weight"] is None:
            level = float("inf")
            break
        level = (total - float(now["capped"] or 0)) / now["weight"]
    target = F.when(F.col("ratio") > F.lit(level), F.lit(level) * F.col("weight")).otherwise(
        (F.lit(repeats) * F.col("size")).cast("double"))
    return rows.select("source", "k", F.col("size").alias("source_size"), target.alias("target"))


def contributions(sums: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """(pattern, size, source_size, target, taken): the words that each pattern contributes.

    Sources that share patterns are one network; every network is solved by `route`, one that
    is a single source with its single pattern like any other.
    """
    of = stored(sums.withColumn("members", F.from_json("pattern", "array<string>"))
                .withColumn("id", F.monotonically_increasing_id()), "mix-members")
    each = of.select("id", "pattern", "size", F.explode("members").alias("source"))
    total, most = of.agg(F.sum("size"), F.max(F.size("members"))).first()
    sources = stored(targets_of(each.groupBy("source").agg(F.sum("size").alias("size")), weights,
                                share * (total or 0), repeats), "mix-targets")
    asked = stored(each.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "pattern", "size", "k", "source_size", "target", F.floor("target").cast("long").alias("quota")), "mix-asked")
    network = F.col("k")
    nets = asked
    if (most or 0) > 1:
        first = Window.partitionBy("id")
        meets = asked.select(F.min("k").over(first).alias("a"), F.col("k").alias("b")).where("a <> b")
        joined = components(meets, "mix-overlaps")
        nets = asked.join(joined, asked["k"] == joined["node"], "left")
        network = F.coalesce("component", "k")

    def flow(rows: dict) -> list[tuple[int, int]]:
        # By pattern, so that reruns choose alike among flows of one cost.
        ids, members = dict(zip(rows["pattern"], rows["id"])), {}
        for pattern, source in sorted(zip(rows["pattern"], rows["k"])):
            members.setdefault(pattern, []).append(source)
        used = route(dict(zip(rows["pattern"], rows["size"])), members, dict(zip(rows["k"], rows["quota"])), repeats)
        return [(ids[pattern], taken) for pattern, taken in used.items()]

    routed = grouped(nets.select(network.alias("net"), "id", "pattern", "k", "size", "quota"), ["net"], flow,
                     pa.schema([("id", pa.int64()), ("taken", pa.int64())]))
    single = asked.groupBy("id").agg(F.count("*").alias("many"), F.first("source_size").alias("source_size"),
                                     F.first("target").alias("target"))
    alone = F.col("many") == 1
    return (of.join(single, "id", "left").join(routed, "id", "left").select(
        "pattern", "size", F.when(alone, F.col("source_size")).alias("source_size"),
        F.when(alone, F.col("target")).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per membership pattern: source_size, target, whole (copies of every document),
    edge and rest (the seeded hash up to which one more copy is taken, and the words taken at
    that hash), edge_size.

    `sized` has pattern, size, h.  Sources come in code-point order, null last.
    """
    sums = stored(sized.groupBy("pattern").agg(F.sum("size").alias("size")), "mix-patterns")
    taken = stored(contributions(sums, weights, share, repeats), "mix-taken")
    edges = taken.where("size > 0 AND taken % size > 0").select(
        "pattern", F.lit(0).cast("long").alias("edge"), F.expr("taken % size").alias("left"))
    done = 0
    for bits in LEVELS:
        inside = (sized.where("size > 0").join(edges.select("pattern", "edge", "left"), "pattern")
                  .where(F.shiftright("h", HASH_BITS - done) == F.col("edge"))
                  .groupBy("pattern", "left", F.shiftright("h", HASH_BITS - bits).alias("p"))
                  .agg(F.sum("size").alias("size")))
        run = F.sum("size").over(Window.partitionBy("pattern").orderBy("p"))
        edges = stored(
            inside.withColumn("upto", run).where("upto > left AND upto - size <= left")
            .select("pattern", F.col("p").alias("edge"), (F.col("left") - F.col("upto") + F.col("size")).alias("left"),
                    F.col("size").alias("edge_size")), "mix-edges")
        done = bits
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    return stored(taken.join(edges, "pattern", "left").select(
        "pattern", "source_size", "target", whole.cast("long").alias("whole"),
        F.coalesce("edge", F.lit(-1)).cast("long").alias("edge"), F.coalesce("left", F.lit(0)).cast("long").alias("rest"),
        F.coalesce("edge_size", F.lit(1)).cast("long").alias("edge_size")), "mix-plan")


def _sent(planned: DataFrame) -> DataFrame:
    return F.broadcast(planned) if planned.count() <= MOST_SENT else planned


def _taken():
    part = F.when(F.col("h") < F.col("edge"), F.col("size")).when(
        F.col("h") == F.col("edge"), F.floor(F.col("size") * F.col("rest") / F.col("edge_size"))).otherwise(0)
    return (F.col("size") * F.col("whole") + part).cast("long")


def sized_rows(docs: DataFrame, membership, seed: str) -> DataFrame:
    return docs.select("doc_id", pattern_of(membership).alias("pattern"),
                       word_count(F.col("text")).alias("size"), seeded("doc_id", seed).alias("h"))


def mix(docs: DataFrame, membership=None, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of `docs`.

    `membership` is an array of source names, by default the one in `source`; a null source
    is a source of its own.  A document of several sources has null source_size and target.
    Null and blank texts have size 0 and are never taken.  Every source gets its target to
    the word, rounded down, unless rows that repeat a doc_id meet at the edge: they share what
    is left.  No row is taken above REPEATS times its size.  Empty tables give an empty
    result, and other columns are not read.
    """
    prepare(docs.sparkSession)
    member = F.array("source") if membership is None else membership
    sized = stored(sized_rows(docs, member, seed), "mix-sizes")
    return sized.join(_sent(plan(sized)), "pattern").select(
        "doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it; part of a document, at the
    edge of a source, counts when it is half or more.  Texts are not shuffled, unless there
    are more than MOST_SENT patterns."""
    prepare(spark)
    names = docs.columns
    member = F.array("source")
    planned = plan(stored(sized_rows(docs, member, SEED), "mix-sizes"))
    own = docs.select(F.struct([F.col(f"`{c}`") for c in names]).alias("row"), pattern_of(member).alias("pattern"),
                      word_count(F.col("text")).alias("size"), seeded("doc_id", SEED).alias("h"))
    copies = F.when(F.col("size") > 0, F.round(_taken() / F.col("size"))).otherwise(0).cast("int")
    return (own.join(_sent(planned), "pattern").withColumn("copies", copies).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM sized GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
r AS (SELECT *, {REPEATS} * source_size / weight AS ratio FROM w),
o AS (SELECT *, {SHARE}::DOUBLE * sum(source_size) OVER () AS total,
             coalesce(sum({REPEATS} * source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
             sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
      FROM r),
level AS (SELECT (total - capped) / weights AS x FROM o WHERE ratio > (total - capped) / weights
          ORDER BY ratio, k LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN ratio > (SELECT x FROM level) THEN (SELECT x FROM level) * weight
                  ELSE ({REPEATS} * source_size)::DOUBLE END AS target FROM o),
g AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE
         size * (quota // source_size)
         + least(size, greatest(0, quota % source_size - (upto - size))) END)::BIGINT AS taken
FROM g
"""
