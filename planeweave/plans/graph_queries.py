"""Spec graph and retrieval over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.operators import graph, report, retrieval
from planeweave.plans import bridges as b
from planeweave.plans.oracle import block
from planeweave.plans.registry import query
from planeweave.session import cut_lineage, written

# One chunk per document; its clause follows from the id, a table row or a name is
# added below its text.
_M = "CAST(floor(doc_id / 4) AS BIGINT)"
_S = lambda x: f"CAST({x} AS STRING)"
_CHUNK = [
    "doc_id AS chunk_id",
    """CASE doc_id % 4 WHEN 0 THEN '24501' WHEN 1 THEN '38413' WHEN 2 THEN '29244'
       ELSE CASE WHEN doc_id % 8 = 3 THEN '29531' ELSE '29500' END END AS spec""",
    f"""CASE doc_id % 4
      WHEN 0 THEN CASE {_M} % 6 WHEN 0 THEN '9.11.3.2' WHEN 1 THEN '9.11.4.2' WHEN 2 THEN '9.7'
        WHEN 3 THEN '8.2.' || {_S(f'{_M} % 23')} WHEN 4 THEN '5.5.' || {_S(f'{_M} % 7')}
        ELSE '5.5.' || {_S(f'{_M} % 7')} || '.1' END
      WHEN 1 THEN CASE {_M} % 5 WHEN 0 THEN '9.3.1.2' WHEN 1 THEN '9.4.3'
        WHEN 2 THEN '8.1.' || {_S(f'{_M} % 9')} WHEN 3 THEN '9.3.2.' || {_S(f'{_M} % 8')}
        ELSE '8.1.' || {_S(f'{_M} % 9')} || '.2' END
      WHEN 2 THEN CASE {_M} % 4 WHEN 0 THEN '8.2.1' WHEN 1 THEN '7.4.4.' || {_S(f'{_M} % 13')}
        WHEN 2 THEN '6.2.' || {_S(f'{_M} % 5')} ELSE '6.2.' || {_S(f'{_M} % 5')} || '.1' END
      ELSE '5.2.' || {_S(f'{_M} % 31')} END AS clause""",
    f"""CASE WHEN doc_id % 4 = 3 AND {_M} % 3 = 0 THEN 'Nnssf_Sel' || {_S(f'{_M} % 5')}
          || ' Service API'
        WHEN doc_id % 4 = 3 AND {_M} % 97 = 1 THEN 'ProblemDetails'
        WHEN doc_id % 4 = 0 AND {_M} % 6 = 3 THEN w1 || ' ' || w2 || ' (UE side)'
        WHEN doc_id % 4 IN (0, 2) AND {_M} % 2 = 0 THEN w1 || ' procedure'
        ELSE w1 || ' ' || w2 END AS heading""",
    f"""CASE doc_id % 4
      WHEN 0 THEN CASE WHEN {_M} % 6 < 3 THEN
          {" || ' | ' || ".join(_S(f'CAST(floor({_M} / {2 ** i}) AS BIGINT) % 2')
                                for i in range(7, -1, -1))}
          || ' |  | ' || w1 || ' ' || w2 || ' (note)' ELSE 'THE ' || upper(w1) || ' ' || upper(w2)
          || ' MESSAGE' END
      WHEN 1 THEN CASE {_M} % 5 WHEN 0 THEN '>Radio Cause | M | ENUMERATED (' || w1 || ', '
          || w2 || ' ' || w1 || ', …)' ELSE 'INITIATING MESSAGE' || chr(9) || 'Name'
          || {_S(f'{_M} % 30')} END
      WHEN 2 THEN 'all | ' || CASE WHEN {_M} % 8 = 4 THEN '4-63' ELSE {_S(f'{_M} % 80')} END
          || ' | ' || w1 || ' ' || w2 || ' | text'
      ELSE 'see Nnssf_Sel' || {_S(f'{_M} % 9')} || '_Get and Npcf_Other' END AS extra""",
    "text AS prose",
]
_WORDS = ["doc_id", "text", "split_part(replace(text, chr(10), ' '), ' ', 1) AS w1",
          "split_part(replace(text, chr(10), ' '), ' ', 2) AS w2"]
# The same, without a look at the rest of the text.
_FIRST = ["doc_id", "text", r"regexp_extract(text, '^[^ \\n]*', 0) AS w1",
          r"regexp_extract(text, '^[^ \\n]*[ \\n]([^ \\n]*)', 1) AS w2"]
_PARENT = "regexp_replace(clause, '\\\\.[^.]*$', '')"
_TEXT = """'TS | ' || clause || chr(9) || heading || chr(10) || prose || chr(10) || extra AS text"""
block("chunkb", f"""SELECT *, regexp_replace(clause, '\\.[^.]*$', '') AS parent, {_TEXT}
    FROM (SELECT {', '.join(_CHUNK)} FROM (SELECT {', '.join(_WORDS)} FROM documents))""")


def chunks(spark, d):
    flat = b.table(spark, d, "documents").selectExpr(*_FIRST).selectExpr(*_CHUNK).selectExpr(
        "*", _TEXT)
    parent = F.regexp_replace("clause", r"\.[^.]*$", "")
    return flat.withColumn("breadcrumb", F.array(
        F.concat(parent, F.lit("\tPart "), parent))).drop("prose", "extra")


def _kept(spark, d):
    """Chunks that several steps read: put together once, and read by columns from then on."""
    return written(chunks(spark, d))


block("nodeown", """SELECT spec, clause, arg_max(heading, chunk_id) AS heading,
    min(chunk_id * 2 + 1) AS seen FROM chunkb GROUP BY 1, 2""")
block("nodeall", """SELECT coalesce(o.spec, p.spec) AS spec, coalesce(o.clause, p.clause) AS clause,
    coalesce(o.heading, 'Part ' || p.clause) AS heading, o.clause IS NOT NULL AS has_chunk,
    least(o.seen, p.seen) AS seen FROM nodeown o FULL JOIN (SELECT spec, parent AS clause,
      min(chunk_id * 2) AS seen FROM chunkb GROUP BY 1, 2) p
    ON o.spec = p.spec AND o.clause = p.clause""")
block("entie", """SELECT 'ie' AS type, spec, heading AS name, clause, 'ie:' || spec || ':' || clause
    AS id FROM nodeall WHERE has_chunk AND ((spec = '24501' AND regexp_matches(clause, '^9\\.\\d')
      AND lower(heading) <> 'general')
      OR (spec = '38413' AND regexp_matches(clause, '^9\\.3\\.\\d+\\.\\d+$'))
      OR (spec = '29244' AND regexp_matches(clause, '^8\\.2\\.\\d+$')))""")
block("entproc", """SELECT 'procedure' AS type, spec, heading AS name, clause, 'procedure:' || spec
    || ':' || clause AS id FROM nodeall WHERE (spec = '24501' AND regexp_matches(clause,
      '^[56]\\.\\d+\\.\\d+$') AND contains(lower(heading), 'procedure') AND NOT
      regexp_matches(lower(heading), 'general|types of|principles of|overview|coordination|list of'))
    OR (spec = '38413' AND regexp_matches(clause, '^8\\.\\d+\\.\\d+$') AND lower(heading) NOT IN
      ('general', 'successful operation', 'unsuccessful operation', 'abnormal conditions'))
    OR (spec = '29244' AND regexp_matches(clause, '^6\\.\\d+\\.\\d+$')
      AND contains(lower(heading), 'procedure'))""")
block("celled", """SELECT chunk_id, spec, clause, extra, list_transform(string_split(extra, '|'),
    lambda c: trim(c)) AS cells FROM chunkb""")
block("bitrow", """SELECT *, regexp_replace(cells[10], '\\s*\\(.*', '') AS label,
    CAST(list_reduce(list_transform(cells[1:8], lambda c: CAST(c AS BIGINT)),
      lambda a, x: a * 2 + x) AS BIGINT) AS v FROM celled
    WHERE spec = '24501' AND clause IN ('9.11.3.2', '9.11.4.2', '9.7') AND len(cells) = 10
      AND cells[9] = '' AND cells[10] <> ''""")
block("entcause", """SELECT DISTINCT * FROM (SELECT spec, proto || ' cause #' || v AS name, clause,
      'cause:24501:' || clause || ':' || v AS id, proto AS protocol, label AS display, v AS value
      FROM (SELECT *, CASE clause WHEN '9.11.3.2' THEN '5GMM' ELSE '5GSM' END AS proto FROM bitrow
        WHERE clause <> '9.7') UNION ALL
    SELECT spec, 'PFCP cause #' || CAST(cells[2] AS BIGINT), clause, 'cause:29244:8.2.1:'
      || CAST(cells[2] AS BIGINT), 'PFCP', cells[3], CAST(cells[2] AS BIGINT) FROM celled
      WHERE spec = '29244' AND clause = '8.2.1' AND len(cells) = 4 AND regexp_matches(cells[2], '^\\d+$') UNION ALL
    SELECT spec, 'NGAP cause "' || label || '"', clause, 'cause:38413:9.3.1.2:Radio:' || label,
      'NGAP', label, NULL FROM (SELECT spec, clause, trim(unnest(string_split(
        regexp_extract(extra, 'ENUMERATED \\((.*?)\\)', 1), ','))) AS label FROM celled
      WHERE spec = '38413' AND clause = '9.3.1.2') WHERE label NOT IN ('', '…'))""")
_KEY = "regexp_replace(upper({x}), '[^A-Z0-9]+', '', 'g')"
block("nasrun", f"""SELECT key, arg_max(run, pos) AS run FROM (SELECT run,
    {_KEY.format(x='run')} AS key, chunk_id * 1000000 + i AS pos FROM (
      SELECT chunk_id, unnest(r) AS run, unnest(range(len(r))) AS i FROM (SELECT chunk_id,
        regexp_extract_all(prose || chr(10) || extra,
          '\\b(?:5GMM|5GSM) [A-Z0-9]{{2,}}(?: [A-Z0-9]{{2,}})+\\b|\\b[A-Z]{{3,}}(?: [A-Z0-9]{{3,}})+\\b')
        AS r FROM chunkb WHERE spec = '24501'))) GROUP BY 1""")
block("nasvocab", f"""SELECT key, CASE WHEN bool_or(is_row) THEN arg_max(display, pos)
      FILTER (is_row) ELSE arg_min(display, pos) END AS display,
    CASE WHEN bool_or(is_row) THEN '9.7' ELSE arg_min(clause, pos) END AS clause,
    CASE WHEN bool_or(is_row) THEN arg_max(protocol, pos) FILTER (is_row)
      ELSE arg_min(protocol, pos) END AS protocol FROM (
    SELECT {_KEY.format(x='label')} AS key, label AS display, clause, TRUE AS is_row,
      CASE WHEN cells[1] = '0' THEN '5GMM' ELSE '5GSM' END AS protocol, chunk_id AS pos
      FROM bitrow WHERE clause = '9.7' UNION ALL
    SELECT {_KEY.format(x="regexp_replace(heading, '\\s*\\(.*', '')")},
      regexp_replace(heading, '\\s*\\(.*', ''), clause, FALSE, CASE WHEN clause LIKE '8.2.%'
      THEN '5GMM' ELSE '5GSM' END, seen FROM nodeall WHERE spec = '24501'
      AND regexp_matches(clause, '^8\\.[23]\\.\\d+$')) GROUP BY 1""")
_SBI = "\\b(N[a-z]{2,}_[A-Z][A-Za-z0-9]*(?:_[A-Z][A-Za-z0-9]*)*)\\b"
block("sbihead", f"""SELECT DISTINCT spec, clause, unnest(regexp_extract_all(heading, '{_SBI}'))
    AS label FROM nodeall WHERE spec IN ('29500', '29503', '29531')""")
block("sbibody", f"""SELECT DISTINCT spec, clause, unnest(regexp_extract_all(
    prose || chr(10) || extra, '{_SBI}')) AS label FROM chunkb
    WHERE spec IN ('29500', '29503', '29531')""")
block("entmsg", """SELECT '24501' AS spec, coalesce(run, display) AS name, clause, 'message:24501:'
      || clause || ':' || coalesce(run, display) AS id, protocol, TRUE AS pattern_derived
      FROM nasvocab LEFT JOIN nasrun USING (key) UNION ALL
    SELECT DISTINCT spec, regexp_extract(extra, 'MESSAGE\\s+(\\w+)', 1), clause, 'message:38413:9.4.3:'
      || regexp_extract(extra, 'MESSAGE\\s+(\\w+)', 1), 'NGAP', TRUE FROM chunkb
      WHERE spec = '38413' AND clause = '9.4.3' UNION ALL
    SELECT spec, heading, clause, 'message:29244:' || clause || ':' || heading, 'PFCP', FALSE
      FROM nodeall WHERE spec = '29244' AND regexp_matches(clause, '^7\\.4\\.\\d+\\.\\d+$') UNION ALL
    SELECT spec, label, clause, 'message:' || spec || ':' || clause || ':' || label, 'SBI', FALSE
      FROM sbihead UNION ALL
    SELECT spec, label, clause, 'message:' || spec || ':' || clause || ':' || label, 'SBI', TRUE
      FROM sbibody WHERE (spec, clause, label) NOT IN (SELECT (spec, clause, label) FROM sbihead)
      AND (label IN (SELECT label FROM sbihead) OR split_part(label, '_', 1) IN
        (SELECT split_part(label, '_', 1) FROM sbihead)) UNION ALL
    SELECT '29500', 'ProblemDetails', arg_min(clause, seen), 'message:29500:'
      || arg_min(clause, seen) || ':ProblemDetails', 'SBI', FALSE FROM nodeall
      WHERE spec = '29500' AND heading = 'ProblemDetails' HAVING count(*) > 0""")
block("mention", """SELECT DISTINCT c.chunk_id, 'cause' AS type, e.id FROM chunkb c JOIN entcause e
      ON e.protocol <> 'NGAP' AND trim(e.display) LIKE '% %'
      AND contains(lower(c.prose || chr(10) || c.extra), lower(e.display)) UNION ALL
    SELECT DISTINCT c.chunk_id, 'message', e.id FROM chunkb c JOIN entmsg e
      ON e.protocol <> 'SBI' AND contains(lower(c.prose || chr(10) || c.extra), lower(e.name))
    UNION ALL SELECT DISTINCT c.chunk_id, 'procedure', p.id FROM chunkb c JOIN entproc p
      ON starts_with(c.clause, p.clause || '.')""")
block("coedge", """SELECT DISTINCT least(a.id, z.id) AS src, greatest(a.id, z.id) AS dst
    FROM mention a JOIN mention z ON z.chunk_id = a.chunk_id AND a.type < z.type""")
block("entname", """SELECT id, type, name FROM (SELECT id, 'cause' AS type, name FROM entcause
    UNION ALL SELECT id, 'message', name FROM entmsg UNION ALL SELECT id, type, name FROM entproc)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY name) = 1""")
block("entkey", f"""SELECT key, arg_min(id, (rank, id)) AS id FROM (
    SELECT {_KEY.format(x='name')} AS key, 0 AS rank, id FROM entmsg UNION ALL
    SELECT {_KEY.format(x='name')}, 1, id FROM entproc UNION ALL
    SELECT {_KEY.format(x='name')}, 2, id FROM entie) WHERE key <> '' GROUP BY 1""")


@query("x7_clause_nodes", "SELECT spec, clause, heading, has_chunk FROM nodeall")
def _(spark, d):
    return graph.clause_nodes(chunks(spark, d)).select("spec", "clause", "heading", "has_chunk")


@query("x7_contains_edges", """SELECT DISTINCT 'clause:' || spec || ':' || parent AS src,
    'clause:' || spec || ':' || clause AS dst FROM chunkb""")
def _(spark, d):
    return graph.contains_edges(chunks(spark, d))


@query("x8_ie_and_procedure_typing", """SELECT type, spec, name, clause, id FROM entie UNION ALL
    SELECT type, spec, name, clause, id FROM entproc""")
def _(spark, d):
    nodes = graph.clause_nodes(chunks(spark, d))
    return graph.ies(nodes).unionByName(graph.procedures(nodes)).select(
        "type", "spec", "name", "clause", "id")


@query("x9_cause_rows", "SELECT spec, name, clause, id, protocol, display, value FROM entcause")
def _(spark, d):
    return graph.causes(chunks(spark, d)).select(
        "spec", "name", "clause", "id", "protocol", "display", "value")


@query("x10_message_vocabulary", """SELECT spec, name, clause, id, protocol, pattern_derived
    FROM entmsg""")
def _(spark, d):
    rows = _kept(spark, d)
    return graph.messages(rows, graph.clause_nodes(rows)).select(
        "spec", "name", "clause", "id", "protocol", "pattern_derived")


@query("x12_defined_in_edges", """SELECT DISTINCT c.id AS src, i.id AS dst FROM entcause c JOIN entie i
    ON i.spec = c.spec AND i.clause = c.clause""")
def _(spark, d):
    return graph.defined_in(graph.entities(_kept(spark, d)))


def _edges(rows, table):
    return graph.co_mentioned(graph.mention_rows(rows, table), table)


@query("x13_co_mentioned_edges", "SELECT src, dst FROM coedge")
def _(spark, d):
    rows = _kept(spark, d)
    return _edges(rows, cut_lineage(graph.entities(rows)))


@query("x14_neighbour_view", """WITH b AS (SELECT src AS id, dst AS other FROM coedge UNION
      SELECT dst, src FROM coedge),
    n AS (SELECT b.id, e.type, e.name, row_number() OVER (PARTITION BY b.id, e.type
      ORDER BY e.name, e.id) AS rk, count(*) OVER (PARTITION BY b.id, e.type) AS total
      FROM b JOIN entname e ON e.id = b.other)
    SELECT id, type, total, string_agg(name, ', ' ORDER BY rk) FILTER (rk <= 8) || CASE
      WHEN total > 8 THEN ' … and ' || total - 8 || ' more' ELSE '' END AS names
    FROM n GROUP BY id, type, total""")
def _(spark, d):
    rows = _kept(spark, d)
    table = cut_lineage(graph.entities(rows))
    return graph.neighbours(_edges(rows, table), table)


_ASK = ["event_id AS query_id",
        """CASE event_type WHEN 'signup' THEN 'what does 5GMM cause #' || CAST(k AS STRING) || ' mean'
             WHEN 'view' THEN 'cause value=' || CAST(k AS STRING)
             WHEN 'click' THEN 'PFCP Cause ' || CAST(k AS STRING) || '?'
             WHEN 'purchase' THEN 'why Name' || CAST(k AS STRING) || ' after Nnssf_Sel'
               || CAST(k % 7 AS STRING) || '_Get'
             ELSE 'user ' || CAST(user_id AS STRING) END AS query"""]
block("asks", f"SELECT {', '.join(_ASK)} FROM ev")


@query("x15_entity_resolve", f"""WITH q AS (SELECT *, CASE WHEN regexp_matches(query,
        '(?i)cause') THEN CAST(regexp_extract(query, '(\\d+)\\D*$', 1) AS BIGINT) END AS v,
      CASE WHEN query LIKE '%5GMM%' THEN '5GMM' WHEN query LIKE 'PFCP%' THEN 'PFCP' END AS p
      FROM asks)
    SELECT query_id, arg_min(id, (clause <> '9.11.3.2', spec, clause, id)) AS entity_id
      FROM q JOIN entcause c ON c.value = q.v AND (p IS NULL OR p = c.protocol) GROUP BY 1
    UNION ALL SELECT query_id, arg_min(id, (-length(key), key)) FROM q JOIN entkey e
      ON contains({_KEY.format(x='query')}, e.key) WHERE v IS NULL GROUP BY 1""")
def _(spark, d):
    asks = b.ev(spark, d).selectExpr(*_ASK)
    return graph.resolve(asks, cut_lineage(graph.entities(_kept(spark, d))))


# --- retrieval --------------------------------------------------------------

block("vec", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
block("texts", """SELECT doc_id AS chunk_id, lower(text) AS lowered FROM documents""")
block("qwords", """SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '\\s+'),
    lambda w: w <> '') AS w FROM benchmark""")
block("runs", """SELECT * FROM (SELECT query_id, n, s - 1 AS start,
    array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (
      SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
      FROM qwords, (VALUES (8), (7), (6), (5), (4)) t(n))) WHERE length(phrase) >= 16""")
block("bestrun", """SELECT query_id, phrase FROM runs r WHERE EXISTS (SELECT 1 FROM texts t
    WHERE contains(t.lowered, r.phrase))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, start) = 1""")


def _vectors(spark, d, ident):
    return b.table(spark, d, "embeddings").select(F.col("vec_id").alias(ident), "embedding")


@query("r1_cosine_similarity", """SELECT a.vec_id AS query_id, z.vec_id AS chunk_id,
    round(list_cosine_similarity(a.v, z.v), 6) AS score, row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_cosine_similarity(a.v, z.v) DESC, z.vec_id) AS rank FROM vec a, vec z
    WHERE list_cosine_similarity(a.v, z.v) > 0 QUALIFY rank <= 10""")
def _(spark, d):
    found = retrieval.nearest(_vectors(spark, d, "query_id"), _vectors(spark, d, "chunk_id"), 10)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r2_phrase_bonus", """SELECT query_id, chunk_id FROM bestrun JOIN texts
    ON contains(lowered, phrase)""")
def _(spark, d):
    queries = b.table(spark, d, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    docs = b.table(spark, d, "documents").selectExpr("doc_id AS chunk_id", "text")
    return retrieval.phrase_hits(queries, docs)


def _hybrid(spark, d):
    """Benchmark items ask, documents answer; both take the vector of their id modulo the
    number of vectors."""
    vectors = _vectors(spark, d, "slot")
    slot = f"pmod({{}}, {vectors.count()}) AS slot"
    queries = b.table(spark, d, "benchmark").selectExpr(
        "item_id AS query_id", "text AS query", slot.format("item_id")).join(vectors, "slot")
    docs = b.table(spark, d, "documents").selectExpr(
        "doc_id AS chunk_id", "text", slot.format("doc_id")).join(vectors, "slot")
    return queries.drop("slot"), docs.drop("slot")


block("vtexts", """SELECT t.*, v FROM texts t
    JOIN vec ON vec_id = chunk_id % (SELECT count(*) FROM vec)""")
block("vitems", """SELECT b.*, v FROM benchmark b
    JOIN vec ON vec_id = item_id % (SELECT count(*) FROM vec)""")
block("vbest", """SELECT query_id, phrase FROM runs r WHERE EXISTS (SELECT 1 FROM vtexts t WHERE contains(t.lowered, r.phrase))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, start) = 1""")


@query("r3_hybrid_top_k", """SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.item_id AS query_id, t.chunk_id, list_cosine_similarity(q.v, t.v)
        + CASE WHEN p.phrase IS NOT NULL AND contains(t.lowered, p.phrase) THEN 0.15 ELSE 0 END
        AS score FROM vitems q CROSS JOIN vtexts t
      LEFT JOIN vbest p ON p.query_id = q.item_id) WHERE score > 0) WHERE rank <= 5""")
def _(spark, d):
    return retrieval.search(*_hybrid(spark, d)).select(
        "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("r5_hybrid_answer", f"""SELECT q.item_id AS query_id, n.hits, e.entity_id FROM benchmark q
    JOIN (SELECT a.item_id, least(count(*) FILTER (list_cosine_similarity(a.v, t.v)
        + CASE WHEN p.phrase IS NOT NULL AND contains(t.lowered, p.phrase) THEN 0.15 ELSE 0 END > 0),
        5) AS hits FROM vitems a CROSS JOIN vtexts t LEFT JOIN vbest p ON p.query_id = a.item_id
      GROUP BY 1) n ON n.item_id = q.item_id
    LEFT JOIN (SELECT item_id, arg_min(id, (-length(key), key)) AS entity_id FROM benchmark b
      JOIN entkey k ON contains({_KEY.format(x='b.text')}, k.key)
      WHERE NOT regexp_matches(b.text, '(?i)cause') GROUP BY 1) e ON e.item_id = q.item_id""")
def _(spark, d):
    queries, docs = _hybrid(spark, d)
    rows = _kept(spark, d)
    table = cut_lineage(graph.entities(rows))
    blocks = graph.entity_blocks(table, graph.neighbours(_edges(rows, table), table))
    return retrieval.answers(queries, retrieval.search(queries, docs),
                             graph.resolve(queries, table), blocks, table, docs).select(
        "query_id", "hits", "entity_id")


# Cited items of incidents: one incident per order, its line items the citations.
_ITEM = ["CAST('run0' AS STRING) AS run_id", "l_orderkey AS incident_no",
         "l_linenumber AS item_no",
         """CASE l_suppkey % 5 WHEN 0 THEN '5GMMStatus' WHEN 1 THEN '5GSMPDUSessionEstabReject'
              WHEN 2 THEN 'PFCP Session Establishment Request' WHEN 3 THEN 'Name'
              || CAST(l_partkey % 40 AS STRING) ELSE 'Paging' END AS message""",
         "CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 128 END AS cause"]


@query("w5_spec_context", f"""WITH items AS (SELECT DISTINCT {', '.join(_ITEM)} FROM lineitem),
    q AS (SELECT run_id, incident_no, item_no * 2 AS ask_no, CASE WHEN message LIKE '5GMM%'
        THEN '5GMM' WHEN message LIKE '5GSM%' THEN '5GSM' WHEN message LIKE 'PFCP%' THEN 'PFCP' END
        AS p, cause AS v, NULL AS message FROM items WHERE cause IS NOT NULL
        AND message SIMILAR TO '(5GMM|5GSM|PFCP).*' UNION ALL
      SELECT run_id, incident_no, item_no * 2 + 1, NULL, NULL, message FROM items),
    m AS (SELECT message, arg_min(id, (-length(key), key)) AS id FROM (SELECT DISTINCT message
        FROM items) x JOIN entkey e ON contains({_KEY.format(x='x.message')}, e.key) GROUP BY 1),
    a AS (SELECT incident_no, ask_no, arg_min(c.id, c.id) AS id FROM q JOIN entcause c
        ON c.value = q.v AND c.protocol = q.p GROUP BY 1, 2, q.p, q.v UNION ALL
      SELECT incident_no, ask_no, m.id FROM q JOIN m USING (message)),
    f AS (SELECT incident_no, id, min(ask_no) AS ask_no FROM a GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY incident_no ORDER BY ask_no, id) AS rk,
      count(*) OVER (PARTITION BY incident_no) AS n FROM f)
    SELECT incident_no, rk AS line_no, id AS text FROM r WHERE rk <= 6 UNION ALL
    SELECT incident_no, 7, '… and ' || n - 6 || ' more' FROM r WHERE rk = 7""")
def _(spark, d):
    """Blocks are shown by entity id here.  Equal items ask the same, so they need no folding first."""
    table = cut_lineage(graph.entities(_kept(spark, d)))
    items = b.table(spark, d, "lineitem").selectExpr(*_ITEM)
    asked = report.spec_queries(items)
    found = written(graph.resolve(asked.select(F.col("query").alias("query_id"), "query").distinct(), table))
    named = asked.join(found.withColumnRenamed("query_id", "query"), "query", "left")
    # Only the entities found: where they are few, no citation is sorted beside others of its entity.
    blocks = written(table.select(F.col("id").alias("entity_id"), F.col("id").alias("block")).join(
        found, "entity_id", "left_semi").distinct())
    return report.spec_context(named, blocks).select(
        "incident_no", "line_no", F.rtrim(F.regexp_replace("text", "\n", "")).alias("text"))
