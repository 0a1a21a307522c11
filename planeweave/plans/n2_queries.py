"""N2 and KPI operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.operators import flows, kpi
from planeweave.plans import bridges as b
from planeweave.plans.registry import query


@query("n1_unassociated_split", """SELECT run_id, msg_no, ngap, unparsed FROM n2b
    WHERE ran_ue_id IS NULL AND amf_ue_id IS NULL""")
def _(spark, d):
    return flows.unassociated(b.n2(spark, d)).select("run_id", "msg_no", "ngap", "unparsed")


@query("n2_flow_assignment", """SELECT run_id, msg_no, flow_id, first_msg_no, assoc_lo, assoc_hi,
    ran_ue_id FROM n2flow""")
def _(spark, d):
    return flows.assign_flows(b.n2(spark, d)).select(
        "run_id", "msg_no", "flow_id", "first_msg_no", "assoc_lo", "assoc_hi", "ran_ue_id")


@query("n3_flow_attributes", """SELECT run_id, flow_id, ran_ue_id, amf_ue_id, partial, assoc_lo,
    assoc_hi FROM n2attr""")
def _(spark, d):
    return flows.flow_attributes(flows.assign_flows(b.n2(spark, d))).select(
        "run_id", "flow_id", "ran_ue_id", "amf_ue_id", "partial", "assoc_lo", "assoc_hi")


@query("n4_cipher_state_carry", "SELECT run_id, flow_id, msg_no, flow_algo FROM n2algo")
def _(spark, d):
    return flows.carry_cipher(flows.assign_flows(b.n2(spark, d))).select(
        "run_id", "flow_id", "msg_no", "flow_algo")


@query("n5_payload_visibility", """SELECT run_id, flow_id, msg_no, v_name AS nas_name,
    v_protected AS nas_protected, v_inner AS nas_inner, v_cause AS nas_cause, v_supi AS nas_supi,
    note AS nas_unparsed FROM n2vis""")
def _(spark, d):
    nas = F.col("nas")
    return flows.visible_messages(b.n2(spark, d)).select(
        "run_id", "flow_id", "msg_no", nas["name"].alias("nas_name"),
        nas.protected.alias("nas_protected"), nas.inner.alias("nas_inner"),
        nas.cause.alias("nas_cause"), nas.supi.alias("nas_supi"),
        nas.unparsed.alias("nas_unparsed"))


_PROC = ["run_id", "flow_id", "kind", "start_ts", "start_msg", "start_no", "end_ts", "end_msg",
         "end_no", "outcome"]


@query("n6_nas_procedures", f"SELECT {', '.join(_PROC)} FROM n2nasproc")
def _(spark, d):
    procs = flows.analyze_procedures(b.n2(spark, d))
    return procs.filter(F.col("source") == 0).select(*_PROC)


@query("n7_carrier_fallback", f"SELECT {', '.join(_PROC)} FROM n2fallback")
def _(spark, d):
    procs = flows.analyze_procedures(b.n2(spark, d))
    return procs.filter(F.col("source") == 1).select(*_PROC)


@query("n8_procedure_union", f"SELECT {', '.join(_PROC)}, proc_no FROM n2proc")
def _(spark, d):
    procs = flows.analyze_procedures(b.n2(spark, d))
    return procs.select(*_PROC, "proc_no")


RUN_KPIS = """SELECT r.run_id,
    avg(CASE WHEN NOT a.partial AND p.kind = 'registration'
        THEN (p.end_ts - p.start_ts) * 1000.0 END) AS attach_time_ms,
    count(CASE WHEN NOT a.partial AND p.kind = 'registration' THEN 1 END) AS attach_n,
    avg(CASE WHEN NOT a.partial AND p.kind = 'pdu_session_est'
        THEN (p.end_ts - p.start_ts) * 1000.0 END) AS pdu_session_time_ms,
    count(CASE WHEN NOT a.partial AND p.kind = 'pdu_session_est' THEN 1 END) AS pdu_session_n,
    count(CASE WHEN p.outcome = 'accept' THEN 1 END) AS procedure_successes,
    count(CASE WHEN p.outcome = 'reject' THEN 1 END) AS procedure_failures,
    CAST(count(CASE WHEN p.outcome = 'accept' THEN 1 END) AS DOUBLE)
      / nullif(count(CASE WHEN p.outcome IN ('accept', 'reject') THEN 1 END), 0)
      AS procedure_success_rate
  FROM (SELECT DISTINCT run_id FROM n2attr) r
  LEFT JOIN n2proc p ON p.run_id = r.run_id
  LEFT JOIN n2attr a ON a.run_id = p.run_id AND a.flow_id = p.flow_id
  GROUP BY r.run_id"""


def run_kpis(spark, d):
    _, table, procs = flows.analyze(b.n2(spark, d))
    return kpi.run_kpis(procs, table)


@query("k1_latency", f"""SELECT run_id, round(attach_time_ms, 3) AS attach_time_ms, attach_n,
    round(pdu_session_time_ms, 3) AS pdu_session_time_ms, pdu_session_n FROM ({RUN_KPIS})""")
def _(spark, d):
    return run_kpis(spark, d).select(
        "run_id", F.round("attach_time_ms", 3).alias("attach_time_ms"), "attach_n",
        F.round("pdu_session_time_ms", 3).alias("pdu_session_time_ms"), "pdu_session_n")


@query("k2_success_rate", f"""SELECT run_id, procedure_successes, procedure_failures,
    round(procedure_success_rate, 6) AS procedure_success_rate FROM ({RUN_KPIS})""")
def _(spark, d):
    return run_kpis(spark, d).select(
        "run_id", "procedure_successes", "procedure_failures",
        F.round("procedure_success_rate", 6).alias("procedure_success_rate"))


@query("k4_procedure_duration", """SELECT run_id, flow_id, proc_no, kind, outcome,
    CASE WHEN end_ts IS NOT NULL AND end_ts <> 0
      THEN round((end_ts - start_ts) * 1000.0, 3) END AS duration_ms FROM n2proc""")
def _(spark, d):
    procs = flows.analyze_procedures(b.n2(spark, d))
    return flows.with_duration(procs).select(
        "run_id", "flow_id", "proc_no", "kind", "outcome",
        F.round("duration_ms", 3).alias("duration_ms"))


@query("k5_next_terminal_gap", """SELECT run_id, msg_no,
    round(reject_ts - ts, 6) AS gap_s, coalesce(reject_ts - ts > 5, FALSE) AS is_long
    FROM (SELECT run_id, msg_no, ts, ngap, nas_cause, min(CASE WHEN ngap = 'UplinkNASTransport'
        AND nas_name = '5GMMRegistrationReject' THEN ts END) OVER (
        PARTITION BY run_id ORDER BY msg_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
        AS reject_ts FROM n2b) WHERE ngap = 'InitialUEMessage'""")
def _(spark, d):
    nas = F.col("nas")
    gaps = kpi.next_terminal_gap(
        b.n2(spark, d), ["run_id"],
        F.coalesce(F.col("ngap") == "InitialUEMessage", F.lit(False)),
        F.coalesce(nas["name"] == "5GMMRegistrationReject", F.lit(False)))
    return gaps.select("run_id", "msg_no", F.round("gap_s", 6).alias("gap_s"),
                       F.coalesce(F.col("gap_s") > 5, F.lit(False)).alias("is_long"))


@query("k6_flow_span", """SELECT run_id, flow_id, round(first_ts, 6) AS first_ts,
    round(last_ts, 6) AS last_ts, messages FROM n2attr""")
def _(spark, d):
    return flows.flow_attributes(flows.assign_flows(b.n2(spark, d))).select(
        "run_id", "flow_id", F.round("first_ts", 6).alias("first_ts"),
        F.round("last_ts", 6).alias("last_ts"), "messages")
