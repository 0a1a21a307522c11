"""N4, SBI and cross-plane operators over the events and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import http
from planeweave.operators import correlate, flows, kpi, pfcp, sbi
from planeweave.plans import bridges as b
from planeweave.plans import oracle
from planeweave.plans.registry import query
from planeweave.session import written


@query("p1_kind_lookup", """SELECT run_id, msg_no, coalesce(req_kind, rsp_kind) AS kind,
    CASE WHEN req_kind IS NOT NULL THEN 'request' WHEN rsp_kind IS NOT NULL THEN 'response' END
    AS role FROM n4kind""")
def _(spark, d):
    return pfcp.with_kind(b.n4(spark, d)).select("run_id", "msg_no", "kind", "role")


_N4_PROC = ["run_id", "kind", "start_ts", "end_ts", "start_msg", "end_msg", "outcome", "cause",
            "cause_name", "req_no", "rsp_no", "seq", "sends"]


@query("p2_request_response_pairing", f"""SELECT {', '.join(_N4_PROC)} FROM n4proc
    WHERE rsp_no IS NOT NULL""")
def _(spark, d):
    return pfcp.pair_procedures(b.n4(spark, d)).filter(F.col("rsp_no").isNotNull()).select(
        *_N4_PROC)


@query("p3_outcome", """SELECT run_id, kind, outcome, count(*) AS procedures FROM n4proc
    GROUP BY 1, 2, 3""")
def _(spark, d):
    return pfcp.pair_procedures(b.n4(spark, d)).groupBy("run_id", "kind", "outcome").agg(
        F.count(F.lit(1)).alias("procedures"))


@query("p4_timeouts", """SELECT p.run_id, kind, start_ts, end_ts, req_no, sends,
    unpaired_requests FROM n4proc p JOIN (SELECT run_id, count(*) AS unpaired_requests FROM n4proc
    WHERE outcome = 'timeout' GROUP BY 1) USING (run_id) WHERE outcome = 'timeout'""")
def _(spark, d):
    procs = pfcp.pair_procedures(b.n4(spark, d))
    return procs.filter(F.col("outcome") == "timeout").join(
        pfcp.unpaired_requests(procs), "run_id").select(
        "run_id", "kind", "start_ts", "end_ts", "req_no", "sends", "unpaired_requests")


@query("p5_procedure_order", """SELECT run_id, req_no, row_number() OVER (PARTITION BY run_id
    ORDER BY start_ts, rsp_no IS NULL, coalesce(rsp_no, req_no)) AS proc_no FROM n4proc""")
def _(spark, d):
    return pfcp.in_order(pfcp.pair_procedures(b.n4(spark, d))).select(
        "run_id", "req_no", "proc_no")


@query("p8_retransmit_flag", """SELECT run_id, msg_no, row_number() OVER (
    PARTITION BY run_id, src_ip, dst_ip, seq ORDER BY msg_no) > 1 AS retransmit FROM n4b""")
def _(spark, d):
    return pfcp.flag_retransmits(b.n4(spark, d)).select("run_id", "msg_no", "retransmit")


@query("p9_retransmit_bursts", """SELECT run_id, seq, requests, coalesce(timeouts, 0) AS timeouts,
    coalesce(max_burst, 0) AS max_burst FROM (SELECT run_id, seq, count(*) AS requests FROM n4pair
      WHERE req_kind IS NOT NULL GROUP BY 1, 2) LEFT JOIN (SELECT run_id, seq, count(*) AS timeouts,
      max(sends) AS max_burst FROM n4proc WHERE outcome = 'timeout' GROUP BY 1, 2)
    USING (run_id, seq)""")
def _(spark, d):
    msgs = b.n4(spark, d)
    return pfcp.retransmit_bursts(msgs, pfcp.pair_procedures(msgs))


_PAGE_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '') AS path"


@query("b1_service_naming", f"SELECT page_id, {oracle.SERVICE} AS service FROM "
       f"(SELECT page_id, {_PAGE_PATH} FROM pages)")
def _(spark, d):
    pages = b.table(spark, d, "pages").selectExpr("page_id", _PAGE_PATH)
    return pages.select("page_id", http.service_name(F.col("path")).alias("service"))


@query("b2_supi_from_path", """SELECT run_id, msg_no, path_supi AS supi FROM sbireq
    WHERE direction = 'request'""")
def _(spark, d):
    return b.sbi_raw(spark, d).filter("direction = 'request'").select(
        "run_id", "msg_no", http.supi_from_path(F.col("path")).alias("supi"))


_BODY = """CASE WHEN event_type = 'click' THEN
      '--gate' || chr(13) || chr(10) || 'Content-Type: application/json' || chr(13) || chr(10)
      || chr(13) || chr(10) || '{"supi": "imsi-' || CAST(90000000000000 + user_id * k AS STRING)
      || '"}' || chr(13) || chr(10) || '--gate' || chr(13) || chr(10) || '{"supi": "x"}'
    WHEN event_type = 'view' THEN '{"supi": "' || CAST(9000000000000 * k AS STRING) || '"}'
    WHEN event_type = 'error' THEN '{"supi": ' || CAST(90000000000000 + k AS STRING) || '}'
    WHEN event_type = 'signup' THEN '--gate' || chr(13) || chr(10) || props
    ELSE props END AS body"""


@query("b3_supi_from_body", f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view')
    AND regexp_matches(x, '^\\d{{14,15}}$') THEN x END AS supi FROM (SELECT event_id, event_type,
    CASE WHEN event_type = 'click' THEN regexp_extract(body, '"imsi-(\\d+)"', 1)
      ELSE regexp_extract(body, '"supi": "(\\d+)"', 1) END AS x
    FROM (SELECT event_id, event_type, {_BODY} FROM ev))""")
def _(spark, d):
    return b.ev(spark, d).selectExpr("event_id", _BODY).select(
        "event_id", http.supi_from_body(F.col("body")).alias("supi"))


@query("b4_identity_agreement", """SELECT run_id, msg_no, supi FROM sbimsg
    WHERE direction = 'request'""")
def _(spark, d):
    return sbi.name_messages(b.sbi_raw(spark, d)).filter("direction = 'request'").select(
        "run_id", "msg_no", "supi")


@query("b5_problem_details", """SELECT run_id, msg_no, problem_title, problem_cause FROM sbimsg
    WHERE direction = 'response'""")
def _(spark, d):
    return sbi.name_messages(b.sbi_raw(spark, d)).filter("direction = 'response'").select(
        "run_id", "msg_no", "problem_title", "problem_cause")


@query("b6_refusal_propagation", """SELECT run_id, msg_no, direction, name, unparsed
    FROM sbimsg""")
def _(spark, d):
    return sbi.name_messages(b.sbi_raw(spark, d)).select(
        "run_id", "msg_no", "direction", "name", "unparsed")


@query("b7_body_length", """SELECT run_id, conn, stream_id, direction,
    CAST(sum(msg_no % 97) AS BIGINT) AS body_len FROM sbireq GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    frames = b.sbi_raw(spark, d).select(
        "run_id", sbi.connection().alias("conn"), "stream_id", "direction",
        (F.col("msg_no") % 97).alias("length"))
    return sbi.body_lengths(frames)


_FRAMES = ["run_id", "conn", "src_port", "floor(ts / 600) * 600.0 AS ts",
           "CASE WHEN direction = 'request' THEN 0 ELSE 1 END AS dir_rank", "msg_no AS seq_no"]


@query("b8_message_order", f"""SELECT run_id, seq_no, row_number() OVER (PARTITION BY run_id
    ORDER BY ts, conn_first_no, dir_rank, seq_no) - 1 AS msg_no FROM (SELECT *, min(seq_no) OVER
    (PARTITION BY run_id, conn) AS conn_first_no FROM (SELECT {', '.join(_FRAMES)} FROM sbireq))""")
def _(spark, d):
    frames = b.sbi_raw(spark, d).withColumn("conn", sbi.connection()).selectExpr(*_FRAMES)
    firsts = frames.groupBy("run_id", "conn").agg(F.min("seq_no").alias("conn_first_no"))
    return sbi.in_capture_order(frames.join(firsts, ["run_id", "conn"])).select(
        "run_id", "seq_no", "msg_no")


_SBI_PROC = ["run_id", "conn", "stream_id", "kind", "start_ts", "end_ts", "start_msg", "end_msg",
             "req_no", "rsp_no"]


def sbi_messages(spark, d, events=None):
    return sbi.name_messages(b.sbi_raw(spark, d, events))


def planes(spark, d):
    """The N2, N4 and SBI messages of a query that reads several planes: events are decoded once, and
    SBI names and identities, which come from texts, are worked out once."""
    events = b.decoded(spark, d)
    return b.n2(spark, d, events), b.n4(spark, d, events), written(sbi_messages(spark, d, events))


@query("b9_request_response_pairing", f"SELECT {', '.join(_SBI_PROC)} FROM sbiproc")
def _(spark, d):
    return sbi.pair_procedures(sbi_messages(spark, d)).select(*_SBI_PROC)


@query("b10_outcome", """SELECT run_id, outcome, status, count(*) AS procedures FROM sbiproc
    GROUP BY 1, 2, 3""")
def _(spark, d):
    return sbi.pair_procedures(sbi_messages(spark, d)).groupBy(
        "run_id", "outcome", "status").agg(F.count(F.lit(1)).alias("procedures"))


# Conversations as one more request/response source: a stream per user turn.
_TALK = """SELECT 'run0' AS run_id, conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0
    END) OVER (PARTITION BY conv_id ORDER BY turn) AS stream_id, length(text) AS size
    FROM conversations"""


@query("b9_conversation_pairing", f"""WITH t AS ({_TALK}) SELECT q.conv_id,
    CAST(q.stream_id AS BIGINT) AS stream_id, CASE WHEN r.turn IS NULL THEN 'timeout'
      ELSE 'accept' END AS outcome, q.turn AS req_no, r.turn AS rsp_no
    FROM (SELECT conv_id, stream_id, max(turn) AS turn FROM t WHERE role = 'user' GROUP BY 1, 2) q
    LEFT JOIN (SELECT conv_id, stream_id, max(turn) AS turn FROM t WHERE role = 'assistant'
      GROUP BY 1, 2) r ON q.conv_id = r.conv_id AND q.stream_id = r.stream_id""")
def _(spark, d):
    from planeweave.functions.scan import count_before, scan

    turns = scan(b.table(spark, d, "conversations"), ["conv_id"], "turn",
                 earlier=count_before(F.col("role") == "user"))
    messages = turns.filter(F.col("role") != "system").select(
        F.lit("run0").alias("run_id"), F.col("conv_id").cast("string").alias("conn"),
        (F.col("earlier") + F.when(F.col("role") == "user", 1).otherwise(0)).alias("stream_id"),
        F.when(F.col("role") == "user", "request").otherwise("response").alias("direction"),
        F.col("turn").alias("msg_no"), F.col("turn").cast("double").alias("ts"),
        F.lit("turn").alias("name"), F.lit(None).cast("string").alias("method"),
        F.lit("/talk").alias("path"), F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("unparsed"))
    return sbi.pair_procedures(messages).select(
        F.col("conn").cast("long").alias("conv_id"), "stream_id", "outcome", "req_no", "rsp_no")


def _visible(spark, d):
    """The flow messages, written once for the steps that read them."""
    return written(flows.visible_messages(b.n2(spark, d)))


@query("c1_claims", """SELECT run_id, supi AS key, flow_id FROM supiclaim UNION ALL
    SELECT run_id, teid || '@' || ip, flow_id FROM tunclaim""")
def _(spark, d):
    visible = _visible(spark, d)
    return correlate.supi_claims(visible).withColumnRenamed("supi", "key").unionByName(
        correlate.tunnel_claims(visible).select(
            "run_id", F.concat(F.col("teid").cast("string"), F.lit("@"), "ip").alias("key"),
            "flow_id"))


@query("c2_unambiguous_keys", """SELECT run_id, supi AS key, flow_id FROM supiowner UNION ALL
    SELECT run_id, teid || '@' || ip, flow_id FROM tunowner""")
def _(spark, d):
    visible = _visible(spark, d)
    by_supi = correlate.unambiguous(correlate.supi_claims(visible), correlate.SUPI_KEY)
    by_tunnel = correlate.unambiguous(correlate.tunnel_claims(visible), correlate.TUNNEL_KEY)
    return by_supi.withColumnRenamed("supi", "key").unionByName(by_tunnel.select(
        "run_id", F.concat(F.col("teid").cast("string"), F.lit("@"), "ip").alias("key"),
        "flow_id"))


@query("c3_sbi_request_link", "SELECT run_id, msg_no, flow_id FROM sbireqlink")
def _(spark, d):
    known = correlate.sbi_with_flow(sbi_messages(spark, d), _visible(spark, d))
    return correlate.links(known.filter("direction = 'request'"))


@query("c4_sbi_response_inheritance", "SELECT run_id, msg_no, flow_id FROM sbilink")
def _(spark, d):
    return correlate.links(correlate.sbi_with_flow(sbi_messages(spark, d), _visible(spark, d)))


@query("c5_n4_link", "SELECT run_id, msg_no, flow_id FROM n4link")
def _(spark, d):
    return correlate.link_n4(b.n4(spark, d), _visible(spark, d)).select(
        "run_id", "msg_no", "flow_id")


@query("c6_flow_refs", """SELECT run_id, flow_id, string_agg(msg_no, ',' ORDER BY msg_no) AS refs
    FROM n4link GROUP BY run_id, flow_id, msg_no // 100000""")
def _(spark, d):
    refs = correlate.flow_refs(correlate.link_n4(b.n4(spark, d), _visible(spark, d)))
    return refs.select("run_id", "flow_id", F.array_join(
        F.col("refs").cast("array<string>"), ",").alias("refs"))


@query("c7_procedure_flow_id", """SELECT 'sbi' AS plane, p.run_id, p.req_no, l.flow_id
    FROM sbiproc p JOIN sbilast q USING (run_id, conn, stream_id)
    LEFT JOIN sbilink l ON l.run_id = p.run_id AND l.msg_no = q.msg_no UNION ALL
    SELECT 'n4', p.run_id, p.req_no, coalesce(q.flow_id, r.flow_id) FROM n4proc p
    LEFT JOIN n4link q ON q.run_id = p.run_id AND q.msg_no = p.req_no
    LEFT JOIN n4link r ON r.run_id = p.run_id AND r.msg_no = p.rsp_no""")
def _(spark, d):
    visible = _visible(spark, d)
    http_procs = sbi.pair_procedures(correlate.sbi_with_flow(sbi_messages(spark, d), visible))
    n4_procs = pfcp.pair_procedures(correlate.n4_with_flow(b.n4(spark, d), visible))
    cols = ["run_id", "req_no", "flow_id"]
    return http_procs.select(F.lit("sbi").alias("plane"), *cols).unionByName(
        n4_procs.select(F.lit("n4").alias("plane"), *cols))


@query("c8_ue_bijection", """SELECT run_id, 'identity' AS side, supi AS value FROM supiclaim
    GROUP BY 1, 3 HAVING count(DISTINCT flow_id) > 1 UNION ALL
    SELECT run_id, 'flow', CAST(flow_id AS VARCHAR) FROM supiclaim GROUP BY 1, 3
    HAVING count(DISTINCT supi) > 1""")
def _(spark, d):
    return correlate.bijection_violations(correlate.supi_claims(_visible(spark, d)))


K3_GAPS = """SELECT f.run_id, f.flow_id, (e.t - c.t) * 1000.0 AS sbi_to_n4_ms,
    (s.t - e.t) * 1000.0 AS n4_to_n2_ms, (s.t - c.t) * 1000.0 AS sbi_to_n2_ms
  FROM (SELECT DISTINCT run_id, flow_id FROM n2vis) f
  LEFT JOIN (SELECT run_id, flow_id, min(ts) AS t FROM n2vis
    WHERE ngap = 'PDUSessionResourceSetupResponse' GROUP BY 1, 2 HAVING count(*) = 1) s
    USING (run_id, flow_id)
  LEFT JOIN k3est e USING (run_id, flow_id)
  LEFT JOIN (SELECT l.run_id, l.flow_id, min(m.ts) AS t FROM sbilink l JOIN sbimsg m
      USING (run_id, msg_no) LEFT JOIN k3est x ON x.run_id = l.run_id AND x.flow_id = l.flow_id
    WHERE m.direction = 'request' AND m.method = 'POST'
      AND m.path = '/nsmf-pdusession/v1/sm-contexts'
      AND (x.smf_ip IS NULL OR m.dst_ip = x.smf_ip) GROUP BY 1, 2 HAVING count(*) = 1) c
    USING (run_id, flow_id)"""
oracle.block("k3est", """SELECT l.run_id, l.flow_id, min(m.ts) AS t, min(m.dst_ip) AS smf_ip
    FROM n4link l JOIN n4b m USING (run_id, msg_no)
    WHERE m.name = 'PFCP Session Establishment Response' GROUP BY 1, 2 HAVING count(*) = 1""")


@query("k3_cross_plane_latency", f"""SELECT run_id, round(avg(sbi_to_n4_ms), 3) AS sbi_to_n4_ms,
    round(avg(n4_to_n2_ms), 3) AS n4_to_n2_ms, round(avg(sbi_to_n2_ms), 3) AS sbi_to_n2_ms
    FROM ({K3_GAPS}) GROUP BY 1""")
def _(spark, d):
    visible, http_msgs, n4 = _visible(spark, d), sbi_messages(spark, d), b.n4(spark, d)
    means = kpi.cross_plane_kpis(visible, correlate.sbi_with_flow(http_msgs, visible),
                                 correlate.n4_with_flow(n4, visible))
    return means.select("run_id", *[F.round(c, 3).alias(c) for c in (
        "sbi_to_n4_ms", "n4_to_n2_ms", "sbi_to_n2_ms")])
