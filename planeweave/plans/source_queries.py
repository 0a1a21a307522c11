"""Readers, writers and quality checks over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planeweave import schemas
from planeweave.operators import correlate, corpus, evaluate, flows, kpi, memory
from planeweave.operators import retrieval
from planeweave.plans import bridges as b
from planeweave.plans.graph_queries import chunks
from planeweave.plans.n2_queries import RUN_KPIS
from planeweave.plans.plane_queries import K3_GAPS, planes, sbi_messages
from planeweave.plans.registry import query
from planeweave.plans.incident_queries import episodes
from planeweave.session import shared_folder, written
from planeweave.sources import episodes as store
from planeweave.sources import exports

# One small capture document per event: a flow, an embedded N4 section (an object,
# no object, or none) and for some an explicit N4 document.
_EMBEDDED = """CASE WHEN k % 4 = 0 THEN '{"messages": [{"ts": ' || CAST(k AS STRING)
      || '.5, "name": "embedded", "cause_code": ' || CAST(k AS STRING) || '}]}'
    WHEN k % 4 = 1 THEN '["no object"]' END"""
_GIVEN = "CASE WHEN k % 3 = 0 THEN 'explicit' END"


@query("s1_export_reader", """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'explicit'
    WHEN k % 4 = 0 THEN 'embedded' END AS name, CASE WHEN k % 3 <> 0 AND k % 4 = 0 THEN k END
    AS cause_code, 1 AS flow_messages, event_type AS ngap FROM ev
    WHERE k % 3 = 0 OR k % 4 = 0""")
def _(spark, d):
    source = b.ev(spark, d).selectExpr("CAST(event_id AS STRING) AS run_id", "event_type", "k",
                                       f"{_EMBEDDED} AS n4", f"{_GIVEN} AS given")
    document = F.to_json(F.struct(F.array(F.struct(
        F.lit(1).alias("flow_id"),
        F.array(F.struct(F.col("event_type").alias("ngap"))).alias("messages"))).alias("flows")))
    n2 = source.select("run_id", F.from_json(document, schemas.N2_EXPORT).alias("d"), "n4").select(
        "run_id", "d.kpis", "d.flows", "d.unassociated", "n4",
        F.lit(None).cast("string").alias("sbi"))
    given = source.filter(F.col("given").isNotNull()).select("run_id", F.from_json(F.concat(
        F.lit('{"messages": [{"name": "'), F.col("given"), F.lit('"}]}')), schemas.N4_SECTION)
        .alias("d")).select("run_id", "d.*")
    captures = exports.with_planes(n2, n4=given)
    shown = exports.plane_messages(captures, "n4")
    return shown.join(exports.flow_messages(captures).select("run_id", "i", "ngap"), "run_id").select(
        F.col("run_id").cast("long").alias("event_id"), "name",
        F.col("cause_code").cast("long").alias("cause_code"),
        F.col("i").cast("int").alias("flow_messages"), "ngap")


_DOC = """SELECT run_id, flow_id, (i - 1) // 100000 AS part,
    string_agg(coalesce(v_inner, v_name, ngap, '?'), ',' ORDER BY i) AS messages
    FROM n2num GROUP BY 1, 2, 3"""
_DOC_PROCS = """SELECT run_id, flow_id, string_agg(kind || ':' || outcome, ',' ORDER BY proc_no)
    AS procedures FROM n2proc GROUP BY 1, 2"""


def _documents(n2):
    visible, table, procs = flows.analyze(n2)
    return visible, exports.n2_documents(visible, table, flows.with_duration(procs), False)


def _shown(documents, *more):
    names = F.transform("messages", lambda m: F.coalesce(m.nas_inner, m.nas, m.ngap, F.lit("?")))
    closed = F.transform("procedures", lambda p: F.concat(p.kind, F.lit(":"), p.outcome))
    return documents.select("run_id", "flow_id", "part", "partial",
                            F.array_join(names, ",").alias("messages"),
                            F.array_join(closed, ",").alias("procedures"), *more)


@query("s2_n2_export", f"""SELECT d.run_id, d.flow_id, d.part, a.partial, d.messages,
    CASE WHEN d.part = 0 THEN coalesce(p.procedures, '') ELSE '' END AS procedures
    FROM ({_DOC}) d JOIN n2attr a USING (run_id, flow_id)
    LEFT JOIN ({_DOC_PROCS}) p USING (run_id, flow_id)""")
def _(spark, d):
    return _shown(_documents(b.n2(spark, d))[1])


@query("s3_n4_export", """SELECT m.run_id, m.msg_no, m.name, m.cause, m.cause_code, l.flow_id
    FROM n4b m LEFT JOIN n4link l USING (run_id, msg_no)""")
def _(spark, d):
    events = b.decoded(spark, d)
    visible = written(flows.visible_messages(b.n2(spark, d, events)))
    return exports.n4_records(correlate.n4_with_flow(b.n4(spark, d, events), visible)).select(
        "run_id", "msg_no", "name", "cause", "cause_code", "flow_id")


@query("s4_sbi_export", """SELECT m.run_id, m.msg_no, m.name AS service, m.name, m.path, m.status,
    l.flow_id FROM sbimsg m LEFT JOIN sbilink l USING (run_id, msg_no)""")
def _(spark, d):
    n2, _, http = planes(spark, d)
    linked = correlate.sbi_with_flow(http, written(flows.visible_messages(n2)))
    return exports.sbi_records(linked.withColumn("body_len", F.lit(0).cast("long"))).select(
        "run_id", "msg_no", "service", "name", "path", "status", "flow_id")


@query("s5_merged_export", f"""SELECT d.run_id, d.flow_id, d.part, d.messages,
    coalesce(s.refs, '') AS sbi_refs, coalesce(n.refs, '') AS n4_refs FROM ({_DOC}) d
    LEFT JOIN (SELECT run_id, flow_id, part, string_agg(msg_no, ',' ORDER BY msg_no) AS refs
      FROM (SELECT *, (row_number() OVER (PARTITION BY run_id, flow_id ORDER BY msg_no) - 1)
        // 100000 AS part FROM sbilink) GROUP BY 1, 2, 3) s USING (run_id, flow_id, part)
    LEFT JOIN (SELECT run_id, flow_id, part, string_agg(msg_no, ',' ORDER BY msg_no) AS refs
      FROM (SELECT *, (row_number() OVER (PARTITION BY run_id, flow_id ORDER BY msg_no) - 1)
        // 100000 AS part FROM n4link) GROUP BY 1, 2, 3) n USING (run_id, flow_id, part)""")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    visible, documents = _documents(n2)
    linked = [written(links) for links in (correlate.links(correlate.sbi_with_flow(http, visible)),
                                           correlate.link_n4(n4, visible))]
    merged = exports.merged_documents(documents, *[correlate.flow_refs(links) for links in linked])
    refs = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
            for c in ("sbi_refs", "n4_refs")]
    return _shown(merged, *refs).drop("partial", "procedures")


@query("s5_merged_kpis", f"""SELECT run_id, procedure_successes, round(avg(sbi_to_n4_ms), 3)
    AS sbi_to_n4_ms FROM ({RUN_KPIS}) LEFT JOIN ({K3_GAPS}) USING (run_id) GROUP BY 1, 2""")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    visible, table, procs = flows.analyze(n2)
    cross = kpi.cross_plane_kpis(visible, correlate.sbi_with_flow(http, visible),
                                 correlate.n4_with_flow(n4, visible))
    return exports.merged_kpis(kpi.run_kpis(procs, table), cross).select(
        "run_id", "procedure_successes", F.round("sbi_to_n4_ms", 3).alias("sbi_to_n4_ms"))


@query("s6_plane_detect", """SELECT run_id, CASE WHEN bool_or(n2) THEN 'n2' WHEN bool_or(n4)
    THEN 'n4' WHEN bool_or(sbi) THEN 'sbi' END AS plane FROM (SELECT 'r' || (user_id * 7 + k % 7)
    AS run_id, event_type = 'signup' AND k < 30 AS n2, event_type = 'click' AND k < 50 AS n4,
    event_type = 'view' AS sbi FROM ev) GROUP BY 1""")
def _(spark, d):
    runs = b.ev(spark, d).withColumn("run_id", F.expr(
        "'r' || CAST(user_id * 7 + k % 7 AS STRING)"))
    return exports.detect_plane(
        runs, runs.filter("event_type = 'signup' AND k < 30"),
        runs.filter("event_type = 'click' AND k < 50"), runs.filter("event_type = 'view'"))


_LINE = """CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '{"incident_type": "auth_fail'
      WHEN 2 THEN '{"incident_type": "other", "narrative": "x", "cited_evidence":
 [{"message": "m"}]}'
      WHEN 3 THEN '{"incident_type": "auth_failure", "narrative": "", "cited_evidence":
 [{"message": "m"}]}'
    ELSE '{"incident_type": "auth_failure", "narrative": "at ' || CAST(o_custkey AS STRING)
      || '", "cited_evidence": [' || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE
      '{"message": "5GMMStatus", "cause": ' || CAST(o_custkey % 100 AS STRING) || ', "ts": 1.5}' END
      || '], "created_at": "2024-01-02T03:04:05Z"}' END AS value"""


@query("s7_episode_store_read", """SELECT o_orderkey, 'at ' || o_custkey AS narrative,
    o_custkey % 100 AS cause FROM orders WHERE o_orderkey % 6 >= 4 AND o_custkey % 3 <> 0""")
def _(spark, d):
    lines = b.table(spark, d, "orders").selectExpr("o_orderkey", _LINE)
    return store.parse_lines(lines).select("o_orderkey", "narrative", F.col(
        "cited_evidence")[0]["cause"].cast("long").alias("cause"))


@query("s8_episode_append", """SELECT incident_type, count(*) AS episodes FROM (
    SELECT o_orderkey FROM epvalid WHERE o_orderkey % 3 = 0 UNION ALL
    SELECT min(o_orderkey) FROM epkey WHERE o_orderkey % 3 <> 0 GROUP BY ident
      HAVING ident NOT IN (SELECT ident FROM epkey WHERE o_orderkey % 3 = 0))
    JOIN epvalid USING (o_orderkey) GROUP BY 1""")
def _(spark, d):
    path = f"{shared_folder(spark)}/episodes-{uuid.uuid4().hex}"
    every = episodes(spark, d)
    stored = F.col("o_orderkey") % 3 == 0
    store.append(every.filter(stored), path)
    store.remember(every.filter(~stored), path, "o_orderkey")
    return store.read_store(spark, path).groupBy("incident_type").agg(
        F.count(F.lit(1)).alias("episodes"))


@query("s10_message_contract", """SELECT run_id, msg_no, direction FROM sbimsg
    WHERE (name IS NULL) = (unparsed IS NULL)""")
def _(spark, d):
    return exports.contract_violations(sbi_messages(spark, d)).select(
        "run_id", "msg_no", "direction")


@query("s11_refusal_bar", """SELECT run_id, plane, count(unparsed) AS refused,
    count(CASE WHEN unparsed NOT LIKE 'stream reset%' AND unparsed NOT LIKE 'PFCP decode%'
      THEN 1 END) AS unexpected FROM (SELECT run_id, 'n2' AS plane, unparsed FROM n2b UNION ALL
      SELECT run_id, 'n4', unparsed FROM n4b UNION ALL SELECT run_id, 'sbi', unparsed FROM sbimsg)
    GROUP BY 1, 2""")
def _(spark, d):
    def of(df, plane):
        return df.select("run_id", F.lit(plane).alias("plane"), "unparsed")

    rows = of(b.n2(spark, d), "n2").unionByName(of(b.n4(spark, d), "n4")).unionByName(
        of(sbi_messages(spark, d), "sbi"))
    return exports.unexpected_refusals(rows, ["stream reset", "PFCP decode"])


def _sized(spark, d):
    return chunks(spark, d).withColumn("chars", F.length("text"))


@query("s12_corpus_manifest", """SELECT spec, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT)
    AS chars FROM chunkb GROUP BY 1""")
def _(spark, d):
    return corpus.manifest(_sized(spark, d))


@query("s12_manifest_check", """SELECT coalesce(spec, z) AS spec, have_chunks, chunks FROM (
    SELECT spec, count(*) AS have_chunks FROM chunkb GROUP BY 1) FULL JOIN (
    SELECT CASE spec WHEN '29500' THEN '23501' ELSE spec END AS z,
      count(*) + CASE spec WHEN '24501' THEN 1 ELSE 0 END AS chunks FROM chunkb GROUP BY spec)
    ON spec = z WHERE have_chunks IS DISTINCT FROM chunks""")
def _(spark, d):
    """A manifest that counts one chunk too many and misses a spec."""
    rows = _sized(spark, d)
    listed = corpus.manifest(rows).withColumns({
        "chunks": F.col("chunks") + F.when(F.col("spec") == "24501", 1).otherwise(0),
        "spec": F.when(F.col("spec") == "29500", "23501").otherwise(F.col("spec"))})
    return corpus.manifest_violations(rows, listed).select("spec", "have_chunks", "chunks")


@query("r4_cached_index", """SELECT vec_id, round(sqrt(list_sum(list_transform(
    CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings""")
def _(spark, d):
    """Vector norms, built once per content of the corpus and the vectors, then read back."""
    vectors = b.table(spark, d, "embeddings")
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    norms = vectors.select("vec_id", F.round(F.sqrt(F.aggregate(
        squares, F.lit(0.0), lambda acc, x: acc + x)), 6).alias("norm"))
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    root = shared_folder(spark)
    inputs = [docs, vectors.select("vec_id", "embedding")]
    retrieval.cached(norms, "norms", inputs, root)
    return retrieval.cached(norms, "norms", inputs, root)


@query("v6_hypothesis_brief", """SELECT o_orderkey, 'Procedure: Registration (explicit reject), '
      || CASE WHEN o_orderkey % 2 = 0 THEN 'flow ' || o_orderkey ELSE 'SBI — Registration (flow '
      || o_orderkey || ')' END || chr(10) || 'incident_type: ' || incident_type || chr(10)
      || 'narrative: ' || narrative || chr(10) || 'cited evidence: ' || cited AS brief
    FROM epvalid JOIN (SELECT o_orderkey, string_agg(message || coalesce(' cause #' || cause, '')
      || coalesce(' @' || printf('%.3f', ts) || 's', ''), '; '
      ORDER BY message, cause NULLS FIRST, ts NULLS FIRST) AS cited FROM epcite GROUP BY 1)
    USING (o_orderkey)""")
def _(spark, d):
    rows = memory.valid(episodes(spark, d)).select(
        "*", F.lit("Registration").alias("procedure"), F.lit("explicit reject").alias("shape"),
        F.when(F.col("o_orderkey") % 2 == 0, "n2").otherwise("sbi").alias("plane"),
        F.col("o_orderkey").alias("flow_id"))
    return evaluate.hypothesis_brief(rows).select("o_orderkey", "brief")


