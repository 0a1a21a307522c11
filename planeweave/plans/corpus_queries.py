"""Corpus operators: the lines of a document are the units of a spec."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.text import name_key, normalize_space
from planeweave.operators import corpus
from planeweave.plans import bridges as b
from planeweave.plans.oracle import block
from planeweave.plans.registry import query

# Units: every fifth line is a heading whose number follows from its position; every fifth
# document nests its headings up to twelve levels.
_N = "CAST(floor(unit_no / 5) AS BIGINT)"
_TOKEN = f"""CASE WHEN doc_id % 5 = 1 THEN '1' || repeat('.1', CAST({_N} % 12 AS INT))
      || chr(9) || line
    WHEN {_N} % 11 = 10 THEN 'Annex B (informative)'
    WHEN {_N} % 7 = 5 THEN 'Notes'
    WHEN {_N} % 13 = 12 THEN '9.9' || chr(9) || line
    WHEN {_N} % 17 = 16 THEN '3' || chr(9) || 'Contents'
    ELSE CAST(1 + CAST(floor({_N} / 6) AS BIGINT) AS STRING)
      || CASE WHEN {_N} % 6 >= 2 THEN '.' || CAST(CAST(floor(({_N} % 6) / 2) AS BIGINT) AS STRING)
         ELSE '' END
      || CASE WHEN {_N} % 2 = 1 THEN '.1' ELSE '' END
      || chr(9) || line END"""
_UNITS = ["CAST(doc_id AS STRING) AS spec", "unit_no",
          "CASE WHEN unit_no % 5 = 0 THEN 'h' WHEN unit_no % 5 = 3 THEN 'r' ELSE 'p' END AS kind",
          f"CASE WHEN unit_no % 5 = 0 THEN {_TOKEN} ELSE line END AS text"]
block("doclines", """SELECT doc_id, CAST(i - 1 AS BIGINT) AS unit_no, l[i] AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
block("units", f"SELECT {', '.join(_UNITS)} FROM doclines")


def units(spark, d):
    lines = b.table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("unit_no"), "line").selectExpr(
        *_UNITS)


_SPACE = "regexp_replace({x}, '[ \\f\\v\\x{{a0}}\\x1f]+', ' ', 'g')"
block("heads", """SELECT spec, unit_no, CASE WHEN regexp_matches(text, '^(?i)annex\\s+[A-Z]\\b')
      THEN regexp_extract(text, '^(?i)annex\\s+([A-Z])\\b', 1)
    ELSE trim(split_part(text, chr(9), 1)) END AS token,
    CASE WHEN contains(text, chr(9)) THEN trim(regexp_replace(split_part(text, chr(9), 2),
      '[ \\x{a0}]+', ' ', 'g')) ELSE text END AS title FROM units WHERE kind = 'h'""")
block("numbered", """SELECT * FROM heads WHERE regexp_matches(token, '^\\d+(\\.\\d+)*[A-Z]?$')
    OR length(token) = 1""")
block("skips", "SELECT * FROM numbered WHERE title = 'Contents'")
block("absorbed", """SELECT h.spec, h.unit_no FROM numbered h JOIN skips s ON s.spec = h.spec
    AND s.unit_no < h.unit_no AND starts_with(h.token, s.token || '.')
    WHERE NOT EXISTS (SELECT 1 FROM numbered x WHERE x.spec = h.spec AND x.title <> 'Contents'
      AND x.unit_no > s.unit_no AND x.unit_no < h.unit_no
      AND NOT starts_with(x.token, s.token || '.'))""")
block("kept", """SELECT * FROM numbered WHERE title <> 'Contents'
    AND (spec, unit_no) NOT IN (SELECT (spec, unit_no) FROM absorbed)""")
block("ancestor", """SELECT h.spec, h.unit_no, a.unit_no AS a_no, a.token || chr(9) || a.title AS crumb
    FROM kept h JOIN kept a ON a.spec = h.spec AND a.unit_no < h.unit_no
      AND starts_with(h.token, a.token || '.')
    WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.spec = h.spec AND x.unit_no > a.unit_no
      AND x.unit_no < h.unit_no AND NOT starts_with(x.token, a.token || '.'))""")
block("crumbs", """SELECT k.spec, k.unit_no, k.token, k.title,
    coalesce(string_agg(crumb, ' > ' ORDER BY a_no), '') AS breadcrumb
    FROM kept k LEFT JOIN ancestor a USING (spec, unit_no) GROUP BY ALL""")
block("placed", """SELECT u.spec, u.unit_no, u.text, (SELECT max(n.unit_no) FROM numbered n
    WHERE n.spec = u.spec AND n.unit_no <= u.unit_no) AS node_no FROM units u
    WHERE (u.spec, u.unit_no) NOT IN (SELECT (spec, unit_no) FROM numbered)""")
block("bodyunit", """SELECT p.* FROM placed p JOIN kept k ON k.spec = p.spec
    AND k.unit_no = p.node_no""")


@query("x1_whitespace_normalize", """SELECT doc_id, trim(regexp_replace(regexp_replace(text,
    '[\\n\\r]', ' ', 'g'), '[ \\x{a0}]+', ' ', 'g')) AS text FROM (
      SELECT doc_id, regexp_replace(line, '[ \\x{a0}]+', ' ', 'g') AS text FROM doclines)""")
def _(spark, d):
    lines = b.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n"))
                                                  .alias("line"))
    return lines.select("doc_id", normalize_space(F.col("line")).alias("text"))


@query("x2_clause_token", """SELECT spec, unit_no, CASE WHEN regexp_matches(token,
    '^\\d+(\\.\\d+)*[A-Z]?$') OR length(token) = 1 THEN token END AS token, title FROM heads""")
def _(spark, d):
    heads = units(spark, d).filter("kind = 'h'")
    return heads.select("spec", "unit_no", corpus.clause_token(F.col("text")).alias("token"),
                        corpus.heading_title(F.col("text")).alias("title"))


@query("x3_breadcrumbs", "SELECT spec, unit_no, token, title, breadcrumb FROM crumbs")
def _(spark, d):
    return corpus.headings(units(spark, d)).filter("kept").select(
        "spec", "unit_no", "token", "title", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


@query("x3_body_units", "SELECT spec, unit_no, node_no FROM bodyunit")
def _(spark, d):
    lines = units(spark, d)
    return corpus.bodies(lines, corpus.headings(lines)).select("spec", "unit_no", "node_no")


# The greedy folds, as reductions over lists: oversized units into slices, the
# pieces of a clause into bodies.
block("sliced", """SELECT spec, node_no, unit_no, CASE WHEN length(text) <= 6000 THEN [text] ELSE
    list_filter(list_append(r.done, r.buf), lambda s: s <> '') END AS pieces FROM (
      SELECT *, list_reduce(list_transform(CASE WHEN length(text) <= 6000 THEN ['']
        ELSE string_split(text, ' ') END, lambda w: {'done': CAST([] AS VARCHAR[]), 'buf': w}),
      lambda a, x: CASE WHEN a.buf <> '' AND length(a.buf) + length(x.buf) + 1 > 6000
        THEN {'done': list_append(a.done, a.buf), 'buf': x.buf}
        WHEN a.buf = '' THEN {'done': a.done, 'buf': x.buf}
        ELSE {'done': a.done, 'buf': a.buf || ' ' || x.buf} END) AS r FROM bodyunit)""")
block("packed", """SELECT spec, node_no, unnest(range(len(done))) AS body_no, unnest(done) AS body
    FROM (SELECT spec, node_no, list_append(r.done, r.cur) AS done FROM (
      SELECT spec, node_no, list_reduce(list_transform(pieces, lambda p:
          {'done': CAST([] AS VARCHAR[]), 'cur': p, 'size': CAST(length(p) AS BIGINT)}),
        lambda a, x: CASE WHEN a.size + x.size > 6000
          THEN {'done': list_append(a.done, a.cur), 'cur': x.cur, 'size': x.size}
          ELSE {'done': a.done, 'cur': a.cur || chr(10) || chr(10) || x.cur,
                'size': a.size + x.size} END) AS r
      FROM (SELECT spec, node_no, flatten(list(pieces ORDER BY unit_no)) AS pieces FROM sliced
        GROUP BY 1, 2)))""")


@query("x4_body_packing", """SELECT spec, node_no, body_no, md5(body) AS body,
    CAST(length(body) AS BIGINT) AS chars FROM packed""")
def _(spark, d):
    return corpus.packed_bodies(units(spark, d)).select(
        "spec", "node_no", "body_no", F.md5(F.encode("body", "UTF-8")).alias("body"),
        F.length("body").cast("long").alias("chars"))


_SPECS = ["CAST(doc_id AS STRING) AS spec", "'TS ' || CAST(doc_id AS STRING) AS title",
          """CASE WHEN doc_id % 5 = 4 THEN 'z' ELSE chr(CAST(103 + doc_id % 5 AS INT)) END
             || CAST(doc_id % 100 AS STRING) AS token"""]


@query("x6_version_resolve", """SELECT spec, coalesce(named, CASE WHEN letter <= 'j' THEN
    CAST(16 + ascii(letter) - 103 AS VARCHAR) || '.' || digits // 10 || '.' || digits % 10 END)
    AS version FROM (SELECT CAST(doc_id AS VARCHAR) AS spec,
      CASE WHEN doc_id % 5 = 4 THEN 'z' ELSE chr(CAST(103 + doc_id % 5 AS INT)) END AS letter,
      doc_id % 100 AS digits, CASE WHEN doc_id % 3 = 0 THEN '17.' || doc_id % 9 || '.1' END AS named
    FROM documents)""")
def _(spark, d):
    """Every third document names its version in a title line."""
    docs = b.table(spark, d, "documents")
    titles = docs.filter("doc_id % 3 = 0").selectExpr(
        "CAST(doc_id AS STRING) AS spec", "CAST(-1 AS BIGINT) AS unit_no", "'p' AS kind",
        "'Release V17.' || CAST(doc_id % 9 AS STRING) || '.1 (2024-01) V1.1.1' AS text")
    return corpus.versions(units(spark, d).unionByName(titles), docs.selectExpr(*_SPECS)).select(
        "spec", "version")


@query("x5_chunk_emit", """SELECT k.spec, p.node_no, p.body_no, k.token AS clause,
    md5('TS ' || k.spec || ' V' || v.version || ' | ' || k.token || chr(9) || k.title || chr(10)
      || CASE WHEN k.breadcrumb = '' THEN '' ELSE '[under: ' || replace(k.breadcrumb, ' > ',
      '] [under: ') || '] ' || chr(10) END || p.body) AS text, length(p.body) AS chars
    FROM packed p JOIN crumbs k ON k.spec = p.spec AND k.unit_no = p.node_no
    JOIN (SELECT CAST(doc_id AS VARCHAR) AS spec, CAST(16 + doc_id % 4 AS VARCHAR) || '.'
      || (doc_id % 100) // 10 || '.' || doc_id % 10 AS version FROM documents) v
      ON v.spec = k.spec
    WHERE (SELECT sum(length(q.body)) FROM packed q WHERE q.spec = p.spec
      AND q.node_no = p.node_no) + length(k.token) + 1 + length(k.title) >= 80""")
def _(spark, d):
    specs = b.table(spark, d, "documents").selectExpr(
        *_SPECS[:2], "chr(CAST(103 + doc_id % 4 AS INT)) || CAST(doc_id % 100 AS STRING) AS token")
    return corpus.build(units(spark, d), specs).select(
        "spec", "node_no", "body_no", "clause",
        F.md5(F.encode("text", "UTF-8")).alias("text"), F.col("chars").cast("long").alias("chars"))


@query("x11_name_normalize", """SELECT p_partkey, regexp_replace(upper(p_name || ' (' || p_brand
    || ')'), '[^A-Z0-9]+', '', 'g') AS key FROM part""")
def _(spark, d):
    named = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return b.table(spark, d, "part").select("p_partkey", name_key(named).alias("key"))
