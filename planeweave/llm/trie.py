"""Prefix trie of conversations by union-find over the LCP edges of sorted neighbours.

Equal conversations are folded to one class.  Classes are sorted so that those with a common
prefix are neighbours; the edge between two neighbours is as deep as the longest prefix they share.
Taking edges from the deepest up, every merge of neighbouring components makes one branching node.
A task does this for a run of neighbours and hands on what may still grow across
its ends: the contracted forest, which is merged in runs of runs until one is left.  Nodes between two
branching ones are then written out turn by turn.

No conversation is gathered into a row: prefixes are told apart by 128 bits that are summed along
the turns, and the sort goes over blocks of turns whose ranks are paired until one is left.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import CHUNK_ROWS, dealt, position, scan, total_to, xor_to
from planeweave.llm.common import grouped, prepare, rows_of, stored

BLOCK_TURNS = 256        # turns of a conversation that are compared as one value
RUN = 2_048              # classes that are merged in one group
FAN = 64                 # groups that are merged in one group of the next level
STEP = 4_096             # nodes of one conversation that are written out at a time
PIECE = 1 << 20          # characters of a list of ids that are hashed as one piece
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_HASH = ["p1", "p2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, digest, words): the turns of every conversation numbered from 1.

    They are ordered by turn, null first, and where turns repeat by a digest of role and text; a
    null role or text is empty.  Rows without a conv_id belong to no conversation.
    """
    prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    laid = dealt(turns, ["conv_id", "turn", "digest"])
    return scan(laid, ["conv_id"], "turn", ties=("digest",), bucket=F.col("_part"),
                no=position()).select("conv_id", "no", "digest", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, words) and conversations (conv_id, len) after rebuilding.

    Conversation c takes the first crc32(c) % 4 turns of conversation c - c % 20, as many as that has,
    and its own turns after as many of its own; one that is left without turns stays.
    """
    own = stored(numbered_turns(conversations), "trie-turns")
    sizes = stored(own.groupBy("conv_id").agg(F.max("no").alias("size")), "trie-sizes")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = sizes.select("conv_id", "size", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base")).join(
        sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).cast("long").alias("taken"),
        F.greatest(F.col("size") - F.col("h"), F.lit(0)).cast("long").alias("left"))
    convs = stored(convs, "trie-conversations")
    rest = own.where(F.col("no") > shared).join(convs.select("conv_id", "h", "taken"), "conv_id").select(
        "conv_id", (F.col("no") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    heads = own.where("no <= 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "base").join(
        convs.select("conv_id", "base", "taken"), "base").where("no <= taken").select(
        "conv_id", F.col("no").alias("pos"), "digest", "words")
    return rest.union(heads), convs.select("conv_id", (F.col("taken") + F.col("left")).alias("len"))


def paths(turns: DataFrame) -> DataFrame:
    """`turns` with the 128 bits (p1, p2) of the prefix up to each turn and the words `upto` it."""
    turns = stored(turns, "trie-sequences")
    bits = [F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2)]
    return scan(turns, ["conv_id"], "pos", split=CHUNK_ROWS, upto=total_to(F.col("words")),
                p1=xor_to(bits[0]), p2=xor_to(bits[1]))


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Add `value`: the place, from 1, of the row's `by` among the different ones."""
    different = dealt(df.select(*by).distinct(), by)
    first = by[0]
    placed = scan(different, [], first, ties=by[1:], bucket=F.col("_part"), value=position()).drop("_part")
    return df.join(stored(placed, "trie-values"), by)


def _sorted(classes: DataFrame, steps: DataFrame, longest: int, block: int) -> DataFrame:
    """`classes` with `rank`, from 0, such that classes with a common prefix are neighbours."""
    blocks = -(-longest // block)
    keys = steps.groupBy("rep", F.floor((F.col("pos") - 1) / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("turns")).select(
        "rep", "block", F.transform("turns", lambda t: t["digest"]).alias("value"))
    if blocks > 1:
        keys = stored(keys.withColumnRenamed("value", "turns"), "trie-blocks")
        keys = _ranked(keys, ["turns"]).drop("turns")
    while blocks > 1:
        # A conversation that has no second block stands before those that have one.
        side = F.col("block") % 2
        pairs = keys.groupBy("rep", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(side == 0, F.col("value"))).alias("one"),
            F.coalesce(F.max(F.when(side == 1, F.col("value"))), F.lit(0)).alias("two"))
        keys = stored(_ranked(stored(pairs, "trie-pairs"), ["one", "two"]).drop("one", "two"), "trie-blocks")
        blocks = -(-blocks // 2)
    # The class without turns has no value and comes first.
    laid = dealt(classes.join(keys.select("rep", "value"), "rep", "left"), ["value"])
    return scan(laid, [], "value", bucket=F.col("_part"), rank=position()).withColumn(
        "rank", F.col("rank") - 1).drop("value", "_part")


def _edges(classes: DataFrame, steps: DataFrame) -> DataFrame:
    """`classes` with the edge to the neighbour before: its depth `ldepth`, the words `lupto` there, the
    bits of the shared prefix, and the depth `rdepth` of the edge to the next; -1 beyond the ends."""
    named = steps.join(classes.select("rep", "rank"), "rep")
    before = named.select((F.col("rank") + 1).alias("rank"), "pos", *_HASH)
    shared = named.select("rank", "pos", "upto", *_HASH).join(before, ["rank", "pos", *_HASH]).groupBy("rank").agg(
        F.max(F.struct("pos", "upto", *_HASH)).alias("l"))
    first = F.col("rank") == 0

    def edge(field: str):
        return F.coalesce(F.col(f"l.{field}"), F.when(first & (field == "pos"), -1).otherwise(0)).cast("long")

    left = stored(classes.join(shared, "rank", "left").select(
        *classes.columns, edge("pos").alias("ldepth"), edge("upto").alias("lupto"), edge("p1").alias("lp1"),
        edge("p2").alias("lp2")), "trie-edges")
    after = left.where("rank > 0").select((F.col("rank") - 1).alias("rank"), F.col("ldepth").alias("rdepth"))
    return left.join(after, "rank", "left").withColumn("rdepth", F.coalesce("rdepth", F.lit(-1)).cast("long"))


# What is known of a component: its place, smallest member, members, depth, words and bits of its
# prefix, children, childless nodes and saved tokens below it, the edge before it and the depth of the one after.
_ITEM = ["rank", "conv", "n", "depth", "upto", "p1", "p2", "kids", "leaves", "saved", "ldepth", "lupto", "lp1", "lp2", "rdepth"]
# A finished node: `lo` is the depth of its parent, q1 and q2 the parent's bits.
_NODE = ["conv", "n", "lo", "depth", "kids", "leaves", "below", "upto", "p1", "p2", "q1", "q2"]


def _finished(item: dict, lo: int, lupto: int, q1: int, q2: int) -> tuple[dict, int, int]:
    """The node that `item` is, its childless nodes, and the tokens saved from it up to depth `lo`."""
    leaves = item["leaves"] if item["kids"] else 1
    node = {"conv": item["conv"], "n": item["n"], "lo": lo, "depth": item["depth"], "kids": item["kids"], "leaves": leaves,
            "below": item["saved"], "upto": item["upto"], "p1": item["p1"], "p2": item["p2"], "q1": q1, "q2": q2}
    return node, leaves, item["saved"] + (item["n"] - 1) * (item["upto"] - lupto)


def contracted(items: list[dict], whole: bool) -> tuple[list[dict], list[dict]]:
    """Finished nodes of neighbouring `items`, and the components that may grow beyond them.

    The deepest edges are merged first.  A component goes into the node of an edge when its other edge is
    no deeper; else its parent lies on that other edge, beyond the end, and it waits.  With `whole` there
    is nothing beyond the ends, and all nodes are finished.
    """
    made: list[dict] = []
    up = list(range(len(items)))               # union-find; a root holds its component's first and last item
    held: dict[int, tuple[int, int, dict]] = {k: (k, k, item) for k, item in enumerate(items)}

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    by_depth: dict[int, list[int]] = {}
    for k in range(1, len(items)):
        by_depth.setdefault(items[k]["ldepth"], []).append(k)
    for depth in sorted(by_depth, reverse=True):
        edges = by_depth[depth]
        at = 0
        while at < len(edges):
            # Components that follow each other over edges of this depth.
            edge = items[edges[at]]
            run = [root(edges[at] - 1), root(edges[at])]
            at += 1
            while at < len(edges) and held[run[-1]][1] == edges[at] - 1:
                run.append(root(edges[at]))
                at += 1
            if held[run[0]][2]["ldepth"] > depth:
                run = run[1:]
            if run and held[run[-1]][2]["rdepth"] > depth:
                run = run[:-1]
            if not run:
                continue
            first, last = held[run[0]][2], held[run[-1]][2]
            node = {"rank": first["rank"], "conv": first["conv"], "n": 0, "depth": depth, "upto": edge["lupto"],
                    "p1": edge["lp1"], "p2": edge["lp2"], "kids": 0, "leaves": 0, "saved": 0, "ldepth": first["ldepth"],
                    "lupto": first["lupto"], "lp1": first["lp1"], "lp2": first["lp2"], "rdepth": last["rdepth"]}
            bounds = held[run[0]][0], held[run[-1]][1]
            for k in run:
                item = held.pop(k)[2]
                up[k] = run[0]
                node["conv"] = min(node["conv"], item["conv"])
                node["n"] += item["n"]
                if item["depth"] == depth:     # a part of this node, or a conversation that ends here
                    more = item["kids"], item["leaves"], item["saved"]
                else:
                    done, leaves, saved = _finished(item, depth, edge["lupto"], edge["lp1"], edge["lp2"])
                    made.append(done)
                    more = 1, leaves, saved
                for name, value in zip(("kids", "leaves", "saved"), more):
                    node[name] += value
            held[run[0]] = (*bounds, node)
    left = [item for _, _, item in sorted(held.values(), key=lambda h: h[0])]
    if not whole:
        return made, left
    (top,) = left
    if top["depth"] > 0:
        done, leaves, saved = _finished(top, 0, 0, 0, 0)
        made.append(done)
        top = {**top, "depth": 0, "upto": 0, "p1": 0, "p2": 0, "kids": 1, "leaves": leaves, "saved": saved}
    made.append(_finished(top, -1, 0, 0, 0)[0])
    return made, []


def _forest(items: DataFrame, count: int, run: int, fan: int) -> DataFrame:
    """The finished nodes of all `items`, merged level by level."""
    schema = pa.schema([(name, pa.int64()) for name in ["grp", "final", *dict.fromkeys(_ITEM + _NODE)]])
    now, groups, found = items.withColumn("grp", F.floor(F.col("rank") / run).cast("long")), -(-count // run), None
    while True:
        whole = groups == 1

        def merge(rows: dict, whole=whole) -> list[tuple]:
            own = sorted((dict(zip(_ITEM, values)) for values in zip(*(rows[c] for c in _ITEM))), key=lambda r: r["rank"])
            nodes, left = contracted(own, whole)
            group = rows["grp"][0]
            return [tuple({"grp": group, "final": final, **row}.get(c) for c in schema.names)
                    for final, part in ((1, nodes), (0, left)) for row in part]

        level = stored(grouped(now.select("grp", *_ITEM), ["grp"], merge, schema), "trie-level")
        nodes = level.where("final = 1").select(*_NODE)
        found = nodes if found is None else found.union(nodes)
        if whole:
            return found
        now = level.where("final = 0").select(F.floor(F.col("grp") / fan).cast("long").alias("grp"), *_ITEM)
        groups = -(-groups // fan)


def _ends(members: DataFrame) -> DataFrame:
    """(p1, p2, len, ends_sha256): the ids of equal conversations, ascending, as one hash.

    Ids are joined to pieces where they lie, so that the one task that must read all of a crowd in
    order reads few long rows, one at a time.
    """
    key = ["p1", "p2", "len"]

    def pieces(it):
        held, ids, size = None, [], 0
        for values in rows_of(it, *key, "conv_id"):
            made = []
            for *now, conv in zip(*values):
                if held is not None and (now != held or size > PIECE):
                    made.append((*held, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                held = now
                ids.append(conv)
                size += 20
            yield batch(made)
        yield batch([(*held, ids[0], ",".join(map(str, ids)))] if held is not None else [])

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 4 + [pa.string()])],
            [*key, "first", "ids"])

    def hashed(it):
        held, state = None, None
        for values in rows_of(it, *key, "ids"):
            made = []
            for *now, ids in zip(*values):
                if now == held:
                    state.update(b",")
                else:
                    if held is not None:
                        made.append((*held, state.hexdigest()))
                    held, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield named(made)
        yield named([(*held, state.hexdigest())] if held is not None else [])

    def named(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.string()])],
            [*key, "ends_sha256"])

    joined = (members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
              .mapInArrow(pieces, "p1 long, p2 long, len long, first long, ids string"))
    return (joined.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(hashed, "p1 long, p2 long, len long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK_TURNS, run: int = RUN, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row
    per distinct prefix of the conversations, the empty one included.

    `turns` holds (conv_id, pos, digest, words), pos from 1 without gaps, `convs` (conv_id, len), one row per
    conversation; one without turns is a member of the root alone.  A node is named by its smallest
    member and its depth.  No conversations give no node, not even the root.
    """
    spark = prepare(convs.sparkSession)
    steps = stored(paths(turns), "trie-paths")
    last = steps.select("conv_id", F.col("pos").alias("len"), "upto", *_HASH)
    members = stored(convs.join(last, ["conv_id", "len"], "left").select(
        "conv_id", "len", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("upto", *_HASH)]), "trie-members")
    classes = stored(members.groupBy("len", *_HASH).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"),
                                                        F.first("upto").alias("upto")), "trie-classes")
    count, longest = classes.agg(F.count("*"), F.max("len")).first()
    if not count:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
                                         "n_leaves long, saved_tokens long, ends_sha256 string")
    own = stored(steps.withColumnRenamed("conv_id", "rep").join(classes.select("rep"), "rep", "left_semi"), "trie-steps")
    ranked = stored(_sorted(classes, own, longest, block), "trie-sorted")
    items = _edges(ranked, own).select(
        F.col("rep").alias("conv"), F.col("len").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")],
        *[c for c in _ITEM if c not in ("conv", "depth", "kids", "leaves", "saved")])
    nodes = stored(_forest(items, count, run, fan), "trie-nodes")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("depth").alias("lo"),
                           F.col("conv").alias("parent"))
    ends = _ends(members).withColumnRenamed("len", "depth")
    whole = nodes.join(parents, ["q1", "q2", "lo"], "left").join(ends, ["p1", "p2", "depth"], "left")
    # Every node between two branching ones has the members of the lower one.
    first = F.explode(F.sequence(F.col("lo") + 1, "depth", F.lit(STEP))).alias("start")
    spread = whole.select("*", first).select(
        "*", F.explode(F.sequence("start", F.least(F.col("start") + (STEP - 1), "depth"))).alias("at"))
    before = own.select(F.col("rep").alias("conv"), F.col("pos").alias("at"), (F.col("upto") - F.col("words")).alias("before"))
    bottom, top = F.col("at") == F.col("depth"), F.col("at") == F.col("lo") + 1
    return spread.join(before, ["conv", "at"], "left").select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"),
        F.when(F.col("at") > 0, F.when(top, F.col("parent")).otherwise(F.col("conv"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("upto") - F.coalesce("before", F.lit(0)))).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, as `prefix_trie` gives it.

    Rows without a conv_id are left out; repeated rows are repeated turns; other columns are not read.
    """
    return prefix_trie(*rebuilt(conversations))


ORACLE = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce("text", ''))) AS no,
    {'r': coalesce(role, ''), 't': coalesce("text", '')} AS msg,
    len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
seq AS MATERIALIZED (
  SELECT c.conv_id, list(msg ORDER BY part, no) FILTER (msg IS NOT NULL) AS msgs,
    list(words ORDER BY part, no) FILTER (msg IS NOT NULL) AS words
  FROM c LEFT JOIN (
    SELECT c.conv_id, 0 AS part, no, msg, words FROM c JOIN t ON t.conv_id = c.base AND no <= h
    UNION ALL SELECT c.conv_id, 1, no, msg, words FROM c JOIN t ON t.conv_id = c.conv_id AND no > h) USING (conv_id)
  GROUP BY 1),
pre AS MATERIALIZED (
  SELECT conv_id, d AS depth, coalesce(len(msgs), 0) AS len, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w,
    md5(CAST(CASE WHEN d > 0 THEN msgs[:d] END AS VARCHAR)) AS k,
    md5(CAST(CASE WHEN d > 1 THEN msgs[:d - 1] END AS VARCHAR)) AS up
  FROM seq, range(0, coalesce(len(msgs), 0) + 1) r(d)),
node AS MATERIALIZED (
  SELECT depth, coalesce(k, '') AS k, CASE WHEN depth > 0 THEN coalesce(any_value(up), '') END AS up, min(conv_id) AS conv_id,
    count(*) AS n, any_value(w) AS w, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len = depth) AS ends
  FROM pre GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS kids FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS MATERIALIZED (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (depth, k)),
above AS (
  SELECT p.depth, coalesce(p.k, '') AS k, CAST(sum((x.kids = 0)::INT) AS BIGINT) AS leaves,
    CAST(sum((x.n - 1) * x.w) AS BIGINT) AS saved
  FROM full_node x JOIN pre p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY 1, 2)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, a.leaves AS n_leaves,
  a.saved AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_node x JOIN above a USING (depth, k)
LEFT JOIN full_node p ON p.depth = x.depth - 1 AND p.k = x.up"""
