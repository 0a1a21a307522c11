"""Evaluation and report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.scan import dealt, position, scan
from planeweave.operators import correlate, evaluate, evidence, flows, incidents, kpi, kpi_state, pfcp, report
from planeweave.operators.incidents import INCIDENT_TYPES
from planeweave.plans import bridges as b
from planeweave.plans.n2_queries import RUN_KPIS, run_kpis
from planeweave.plans.oracle import block
from planeweave.plans.plane_queries import K3_GAPS, planes, sbi_messages
from planeweave.plans.registry import query
from planeweave.plans.incident_queries import citations, located_names, plane_procedures, union_of_planes
from planeweave.session import written

# Entries: one per order; hypotheses: one per line item, with raw scores.
_TYPES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(INCIDENT_TYPES))
_ENTRY = ["o_orderkey AS entry_id", "'fixture' || CAST(o_custkey % 9 AS STRING) AS fixture",
          "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 3 + 1 END AS run",
          f"CASE o_orderkey % 9 {_TYPES} END AS label"]
_HYP = ["l_orderkey AS entry_id", f"CASE l_partkey % 9 {_TYPES} END AS incident_type",
        "CAST(l_discount * 20 - 0.5 AS STRING) AS accuracy",
        "CASE WHEN l_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(l_tax * 12 AS STRING) END AS specificity",
        "CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_quantity / 50 AS STRING) END"
        " AS evidence",
        "CASE WHEN l_linenumber = 7 THEN 'NaN' ELSE CAST(l_linenumber / 5.0 AS STRING) END"
        " AS causality"]
_DIMS = ("accuracy", "specificity", "evidence", "causality")
_CLEAN = ", ".join(
    f"least(1.0, greatest(0.0, CASE WHEN isnan(coalesce(try_cast({d} AS DOUBLE), 0)) THEN 0.0"
    f" ELSE coalesce(try_cast({d} AS DOUBLE), 0.0) END)) AS {d}" for d in _DIMS)
block("entries", f"SELECT {', '.join(_ENTRY)} FROM orders")
block("hyps", f"SELECT entry_id, incident_type, {_CLEAN} FROM (SELECT {', '.join(_HYP)} FROM lineitem)")
block("scores", """SELECT e.*, coalesce(s.hit, 0.0) AS type_accuracy, coalesce(s.q, 0.0)
    AS diagnosis_quality, coalesce(s.n, 0) AS judged FROM entries e LEFT JOIN (SELECT h.entry_id,
      max(CASE WHEN h.incident_type = x.label THEN 1.0 ELSE 0.0 END) AS hit,
      avg((accuracy + specificity + evidence + causality) / 4) AS q, count(*) AS n
      FROM hyps h JOIN entries x USING (entry_id) GROUP BY 1) s USING (entry_id)""")


def entries(spark, d):
    return b.table(spark, d, "orders").selectExpr(*_ENTRY)


def hypotheses(spark, d):
    raw = b.table(spark, d, "lineitem").selectExpr(*_HYP)
    return raw.select("entry_id", "incident_type",
                      *[evaluate.clean_score(F.col(c)).alias(c) for c in _DIMS])


def _scores(spark, d):
    return evaluate.run_scores(entries(spark, d), hypotheses(spark, d))


@query("v1_type_accuracy", """SELECT fixture, round(avg(type_accuracy), 9) AS type_accuracy
    FROM scores GROUP BY 1 UNION ALL SELECT 'all', round(avg(m), 9) FROM (
      SELECT avg(type_accuracy) AS m FROM scores GROUP BY fixture)""")
def _(spark, d):
    scores = _scores(spark, d)
    cols = ["fixture", F.round("type_accuracy", 9).alias("type_accuracy")]
    return evaluate.fixture_scores(scores).select(*cols).unionByName(
        evaluate.macro_scores(scores).withColumn("fixture", F.lit("all")).select(*cols))


@query("v2_diagnosis_quality", """SELECT fixture, round(avg(diagnosis_quality), 9)
    AS diagnosis_quality FROM scores GROUP BY 1 UNION ALL SELECT 'all', round(avg(m), 9) FROM (
      SELECT avg(diagnosis_quality) AS m FROM scores GROUP BY fixture)""")
def _(spark, d):
    scores = _scores(spark, d)
    cols = ["fixture", F.round("diagnosis_quality", 9).alias("diagnosis_quality")]
    return evaluate.fixture_scores(scores).select(*cols).unionByName(
        evaluate.macro_scores(scores).withColumn("fixture", F.lit("all")).select(*cols))


@query("v3_dimension_means", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(avg({d}), 9) AS mean FROM hyps" for d in _DIMS) + """
    UNION ALL SELECT 'runs', CAST(count(*) AS DOUBLE) FROM entries
    UNION ALL SELECT 'judged_hypotheses', CAST(sum(judged) AS DOUBLE) FROM scores
    UNION ALL SELECT 'completed_runs', CAST(count(*) AS DOUBLE) FROM scores WHERE judged > 0
    UNION ALL SELECT 'target', round((count(DISTINCT fixture) - 1) / count(DISTINCT fixture), 9)
      FROM entries)""")
def _(spark, d):
    totals = evaluate.macro_scores(_scores(spark, d)).select(
        *[F.col(c).cast("double").alias(c) for c in (
            "runs", "judged_hypotheses", "completed_runs", "target")])
    return evaluate.dimension_means(hypotheses(spark, d)).unionByName(totals.unpivot(
        [], totals.columns, "dimension", "mean")).select("dimension", F.round("mean", 9)
                                                         .alias("mean"))


@query("v4_score_sanitation", """SELECT entry_id, incident_type, round(accuracy, 9) AS accuracy,
    round(specificity, 9) AS specificity, round(evidence, 9) AS evidence,
    round(causality, 9) AS causality FROM hyps""")
def _(spark, d):
    return hypotheses(spark, d).select(
        "entry_id", "incident_type", *[F.round(c, 9).alias(c) for c in _DIMS])


_PLANE = "CASE n_nationkey % 4 WHEN 0 THEN 'n2' WHEN 1 THEN 'n4' WHEN 2 THEN 'sbi' END AS plane"


@query("v5_plane_filter", f"""SELECT i.run_id, i.plane, i.source_no, f.fixture FROM allinc i
    JOIN (SELECT 'run' || CAST(n_nationkey AS VARCHAR) AS fixture, {_PLANE} FROM nation) f
    ON f.fixture = i.run_id AND (f.plane IS NULL OR f.plane = i.plane)""")
def _(spark, d):
    fixtures = b.table(spark, d, "nation").selectExpr(
        "'run' || CAST(n_nationkey AS STRING) AS fixture", _PLANE)
    found = union_of_planes(spark, d).withColumn("fixture", F.col("run_id"))
    return evaluate.own_plane(found, fixtures).select("run_id", "plane", "source_no", "fixture")


@query("v7_ground_truth_join", f"""SELECT entry_id, fixture, CASE n_nationkey % 9 {_TYPES} END
    AS label FROM (SELECT entry_id, fixture FROM entries) JOIN nation
    ON fixture = 'fixture' || CAST(n_nationkey AS VARCHAR)""")
def _(spark, d):
    labels = b.table(spark, d, "nation").selectExpr(
        "'fixture' || CAST(n_nationkey AS STRING) AS scenario",
        f"CASE n_nationkey % 9 {_TYPES} END AS incident_type")
    return evaluate.with_label(entries(spark, d).select("entry_id", "fixture"), labels)


@query("s9_resume", """SELECT DISTINCT fixture, run FROM (SELECT 'fixture' || CAST(c_custkey % 12
    AS VARCHAR) AS fixture, c_custkey % 5 AS run FROM customer) w WHERE NOT EXISTS (
    SELECT 1 FROM entries e WHERE e.run IS NOT NULL AND e.fixture = w.fixture AND e.run = w.run)""")
def _(spark, d):
    wanted = b.table(spark, d, "customer").selectExpr(
        "'fixture' || CAST(c_custkey % 12 AS STRING) AS fixture", "c_custkey % 5 AS run")
    return evaluate.still_to_run(wanted.distinct(), entries(spark, d))


_TS = "printf('%.3f', ts)"


@query("v6_flow_briefs", f"""SELECT run_id, 'flow:' || flow_id AS handle, 0 AS section,
      CAST(0 AS BIGINT) AS line_no, 'flow span: ' || printf('%.3f', first_ts) || 's -> '
      || printf('%.3f', last_ts) || 's (' || messages || ' message(s))' AS text FROM n2attr
    UNION ALL SELECT run_id, 'flow:' || flow_id, 0, 1,
      'no procedure records: no terminal message ever arrived' FROM n2attr a WHERE NOT EXISTS
      (SELECT 1 FROM n2proc p WHERE p.run_id = a.run_id AND p.flow_id = a.flow_id)
    UNION ALL SELECT run_id, 'flow:' || flow_id, 1, msg_no, {_TS} || ' '
      || coalesce(v_inner, v_name, ngap, '?') || coalesce(' cause #' || v_cause || ' (cause '
      || v_cause || ')', '') FROM n2vis
    UNION ALL SELECT run_id, 'flow:' || flow_id, 2, proc_no, 'procedure ' || kind || ': ' || outcome
      FROM n2proc""")
def _(spark, d):
    return evaluate.flow_brief(*flows.analyze(b.n2(spark, d)))


@query("v6_plane_briefs", f"""SELECT run_id, 'sbi' AS handle, 0 AS section, CAST(0 AS BIGINT)
      AS line_no, 'SBI messages (' || count(*) || '):' AS text FROM sbimsg GROUP BY 1
    UNION ALL SELECT run_id, 'sbi', 1, msg_no, {_TS} || ' ' || CASE WHEN direction = 'request'
      THEN coalesce(method, '?') || ' ' || path ELSE '-> ' || coalesce(CAST(status AS VARCHAR),
      'None') END || coalesce(chr(10) || '  problem: ' || problem_title
      || coalesce(' (' || problem_cause || ')', ''), '') FROM sbimsg
    UNION ALL SELECT run_id, 'sbi', 2, req_no, 'procedure ' || kind || ': ' || outcome FROM sbiproc
    UNION ALL SELECT run_id, 'n4', 0, 0, 'N4 messages (' || count(*) || '):' FROM n4b GROUP BY 1
    UNION ALL SELECT run_id, 'n4', 1, msg_no, {_TS} || ' ' || coalesce(name, '?')
      || coalesce(' cause ' || cause || ' (' || cause_code || ')', '') FROM n4b
    UNION ALL SELECT run_id, 'n4', 2, req_no, 'procedure ' || kind || ': ' || outcome
      || coalesce(' cause ' || cause || ' (' || cause_name || ')', '') FROM n4proc""")
def _(spark, d):
    from planeweave.operators import sbi

    http, n4 = sbi_messages(spark, d), b.n4(spark, d)
    return evaluate.sbi_brief(http, sbi.pair_procedures(http)).unionByName(
        evaluate.n4_brief(n4, pfcp.pair_procedures(n4)))


# --- report -----------------------------------------------------------------

def _over(plane: str, src: str, dst: str) -> str:
    return (f"coalesce(' over {plane} from ' || coalesce({src} || ' (' || src_ip || ')', src_ip) || "
            f"' to ' || coalesce({dst} || ' (' || dst_ip || ')', dst_ip), '')")


def _pair(name: str, first: list[str], second: list[str], a: str, z: str) -> tuple[str, str]:
    def inside(names):
        return f"{name} IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    return (f"(CASE WHEN {inside(first)} THEN '{a}' WHEN {inside(second)} THEN '{z}' END)",
            f"(CASE WHEN {inside(first)} THEN '{z}' WHEN {inside(second)} THEN '{a}' END)")


_PRODUCER = ("(SELECT p.nf FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in report.SBI_PRODUCERS.items())
    + ") p(prefix, nf) WHERE starts_with(lower({name}), p.prefix)"
      " ORDER BY length(p.prefix) DESC LIMIT 1)")


def _n2_over(name: str) -> str:
    return _over("N2", *_pair(name, report.GNB_TO_AMF, report.AMF_TO_GNB, "gNB", "AMF"))


def _n4_over(name: str) -> str:
    return _over("N4", *_pair(name, report.SMF_TO_UPF, report.UPF_TO_SMF, "SMF", "UPF"))


def _sbi_over(name: str) -> str:
    nf = _PRODUCER.format(name=name)
    return (f"CASE WHEN direction = 'response' THEN {_over('SBI', nf, 'CAST(NULL AS VARCHAR)')} "
            f"ELSE {_over('SBI', 'CAST(NULL AS VARCHAR)', nf)} END")


@query("w1_endpoint_attribution", f"""SELECT run_id, 'n2' AS plane, msg_no, {_n2_over('ngap')} AS said
    FROM n2vis UNION ALL SELECT run_id, 'n4', msg_no, {_n4_over('name')} FROM n4b
    UNION ALL SELECT run_id, 'sbi', msg_no, {_sbi_over('name')} FROM sbimsg""")
def _(spark, d):
    def rows(df, plane, said):
        return df.select("run_id", F.lit(plane).alias("plane"), "msg_no", said.alias("said"))

    return (rows(flows.associated(b.n2(spark, d)), "n2", report.n2_attribution(F.col("ngap")))
            .unionByName(rows(b.n4(spark, d), "n4", report.n4_attribution(F.col("name"))))
            .unionByName(rows(sbi_messages(spark, d), "sbi", report.sbi_attribution(
                F.col("name"), F.col("direction")))))


@query("w2_flow_timeline", f"""SELECT run_id, flow_id, i AS line_no, '[' || i || '] ' || {_TS}
      || 's  ' || coalesce(v_inner, v_name, ngap, '?') || {_n2_over('ngap')}
      || coalesce('  cause #' || v_cause || ' (cause ' || v_cause || ')', '') AS text FROM n2num
      WHERE i <= 50 UNION ALL
    SELECT run_id, flow_id, 51, '... (' || messages - 50 || ' more not shown)' FROM n2attr
      WHERE messages > 50""")
def _(spark, d):
    visible = flows.visible_messages(b.n2(spark, d))
    return report.flow_timeline(evidence.numbered(visible, ["run_id", "flow_id"]),
                                flows.flow_attributes(visible))


_PLANE_LINES = f"""SELECT m.run_id, 'sbi' AS plane, m.i AS line_no, '[' || m.i || '] '
      || {_TS} || 's  ' || CASE WHEN direction = 'request' THEN coalesce(method, '?') || ' ' || path
      || {_sbi_over('name')} || ' -> ' || coalesce((SELECT CAST(arg_max_null(r.status, r.msg_no)
        AS VARCHAR) FROM sbinum r WHERE r.run_id = m.run_id AND r.direction = 'response'
        AND r.src_ip = m.dst_ip AND r.src_port = m.dst_port AND r.dst_ip = m.src_ip
        AND r.dst_port = m.src_port AND r.stream_id = m.stream_id), 'no response')
      ELSE '-> ' || coalesce(CAST(status AS VARCHAR), '?') || {_sbi_over('name')} END
      || '  (' || coalesce(name, '?') || ')' AS text FROM sbinum m UNION ALL
    SELECT m.run_id, 'n4', m.i, '[' || m.i || '] ' || {_TS} || 's  '
      || CASE WHEN name LIKE '% Request%' THEN name || {_n4_over('name')} || ' -> '
      || coalesce((SELECT coalesce(arg_max_null(r.cause, r.msg_no), CASE WHEN count(*) > 0
        THEN 'answered' END) FROM n4num r WHERE r.run_id = m.run_id AND r.name LIKE '% Response%'
        AND r.src_ip = m.dst_ip AND r.src_port = m.dst_port AND r.dst_ip = m.src_ip
        AND r.dst_port = m.src_port AND r.seq = m.seq), 'no response')
      ELSE '-> ' || coalesce(cause, '?') || ' (' || coalesce(name, '?') || {_n4_over('name')} || ')'
      END FROM n4num m"""


def plane_timelines(n4, http):
    n4_lines = report.n4_timeline(evidence.numbered(n4)).withColumn("plane", F.lit("n4"))
    return report.sbi_timeline(evidence.numbered(http)).withColumn("plane", F.lit("sbi")).unionByName(n4_lines)


@query("w3_plane_timelines", _PLANE_LINES)
def _(spark, d):
    _, n4, http = planes(spark, d)
    return plane_timelines(n4, http)


@query("w4_evidence_lines", f"""SELECT cite_id, '- [' || CASE WHEN grounded THEN 'verified'
      ELSE 'unverified' END || '] ' || message || CASE WHEN plane = 'n2' THEN {_n2_over('carrier')}
      WHEN plane = 'n4' THEN {_n4_over('message')} WHEN plane = 'sbi' THEN {_sbi_over('message')}
      ELSE '' END || coalesce(' @ ' || {_TS} || 's', '') || coalesce(' — cause #' || cause, '')
      AS text FROM (SELECT g.cite_id, g.grounded, g.message, g.ts, g.cause, n.plane, n.src_ip,
        n.dst_ip, m.ngap AS carrier, s.direction FROM citeground g
      LEFT JOIN (SELECT c.cite_id, c.run_id, n.plane, n.msg_no, n.src_ip, n.dst_ip FROM cites c
        JOIN evname n ON n.run_id = c.run_id AND n.name = c.message AND abs(n.ts - c.ts) < 5e-4
        QUALIFY row_number() OVER (PARTITION BY c.cite_id
          ORDER BY n.prank, n.forder, n.msg_no, n.pos) = 1) n ON n.cite_id = g.cite_id
      LEFT JOIN n2b m ON n.plane = 'n2' AND m.run_id = n.run_id AND m.msg_no = n.msg_no
      LEFT JOIN sbimsg s ON n.plane = 'sbi' AND s.run_id = n.run_id AND s.msg_no = n.msg_no)""")
def _(spark, d):
    names = written(evidence.about(located_names(spark, d), citations(spark, d)))
    grounded = evidence.ground(citations(spark, d), evidence.inventory(names))
    return evidence.locate(grounded, names).select(
        "cite_id", report.evidence_line(F.col("grounded")).alias("text"))


_PATH = ["event_id", "CASE WHEN k = 0 THEN NULL ELSE 'inspect flow:' || CAST(user_id AS STRING) END"
         " AS act", "repeat(event_type || ' ', CAST(k AS INT)) || chr(10) || props AS seen",
         "k % 2 = 0 AS wrote", "event_type <> 'view' AS good"]


@query("w6_rows", f"""SELECT event_id, CASE WHEN act IS NULL
      THEN '(no trajectory — the search exhausted its rollouts)'
      ELSE '[1] ' || act || CASE WHEN line = '' THEN '' ELSE ' -> ' || line END
        || chr(10) || '[2] topology' END AS path,
    CASE WHEN NOT good THEN 'no Episode written (no hypothesis)'
      WHEN wrote THEN 'new Episode written (kind)'
      ELSE 'Episode already recorded (kind) — not rewritten' END AS memory
    FROM (SELECT *, CASE WHEN length(head) <= 78 THEN head ELSE left(head, 77) || '…' END AS line
      FROM (SELECT *, split_part(seen, chr(10), 1) AS head FROM (
        SELECT {', '.join(_PATH)} FROM ev)))""")
def _(spark, d):
    rows = b.ev(spark, d).selectExpr(*_PATH)
    pairs = F.when(F.col("act").isNull(), F.array().cast("array<array<string>>")).otherwise(
        F.array(F.array("act", "seen"), F.array(F.lit("topology"))))
    return rows.select(
        "event_id", F.array_join(report.search_path(pairs), "\n").alias("path"),
        report.memory_line(F.lit("kind"), F.col("good"), F.col("wrote")).alias("memory"))


# Reports show the indicators with as many digits as the indicator queries.
_SHOWN = {"attach_time_ms": 3, "pdu_session_time_ms": 3, "procedure_success_rate": 6}


def shown_kpis(kpis):
    return kpis.select("run_id", *[F.round(c, _SHOWN[c]).alias(c) if c in _SHOWN else F.col(c)
                                   for c in report.KPI_ORDER])


block("kpiline", f"""SELECT run_id, {" || ' | ' || ".join(
    f"'{c}: ' || coalesce(CAST(" + (f"round({c}, {_SHOWN[c]})" if c in _SHOWN else c)
    + " AS VARCHAR), 'None')" for c in report.KPI_ORDER)} AS text FROM ({RUN_KPIS})""")


@query("w6_kpi_line", "SELECT run_id, text FROM kpiline")
def _(spark, d):
    return report.kpi_line(shown_kpis(run_kpis(spark, d)))


@query("e1_kpi_lines", f"""SELECT run_id, 'kpis' AS handle, CAST(unnest([{", ".join(
    str(i + 1) for i in range(len(report.KPI_ORDER)))}]) AS BIGINT) AS line_no,
    unnest([{", ".join(f"'  {c}=' || coalesce(" + (
        f"printf('%.3f', round({c}, {_SHOWN[c]}))" if c in _SHOWN else f"CAST({c} AS VARCHAR)")
        + ", 'None')" for c in report.KPI_ORDER)}]) AS text FROM ({RUN_KPIS})""")
def _(spark, d):
    return evidence.kpi_lines(shown_kpis(run_kpis(spark, d)), report.KPI_ORDER)


@query("k3_maintained_indicators", f"""SELECT k.run_id, round(attach_time_ms, 3) AS attach_time_ms, attach_n,
    round(pdu_session_time_ms, 3) AS pdu_session_time_ms, pdu_session_n, procedure_successes, procedure_failures,
    round(procedure_success_rate, 6) AS procedure_success_rate, round(sbi_to_n4_ms, 3) AS sbi_to_n4_ms,
    round(n4_to_n2_ms, 3) AS n4_to_n2_ms, round(sbi_to_n2_ms, 3) AS sbi_to_n2_ms
    FROM ({RUN_KPIS}) k JOIN (SELECT run_id, avg(sbi_to_n4_ms) AS sbi_to_n4_ms, avg(n4_to_n2_ms) AS n4_to_n2_ms,
      avg(sbi_to_n2_ms) AS sbi_to_n2_ms FROM ({K3_GAPS}) GROUP BY 1) g USING (run_id)""")
def _(spark, d):
    """Half of the flows are counted twice, first as if their last procedure was not known yet."""
    n2, n4, http = planes(spark, d)
    visible, table, procs = flows.analyze(n2)
    gaps = kpi.cross_plane_kpis(visible, correlate.sbi_with_flow(http, visible),
                                correlate.n4_with_flow(n4, visible), by_flow=True)
    half = F.col("flow_id") % 2 == 0
    early = kpi_state.flow_states(table, procs.filter(~half | (F.col("proc_no") == 1)), None, version=1)
    late = kpi_state.flow_states(table, procs, gaps, version=2)
    kept = kpi_state.merge(kpi_state.merge(late.filter("ran_key % 2 = 0"), early), late.filter("ran_key % 2 <> 0"))
    return kpi_state.indicators(kept).select(
        "run_id", "attach_n", "pdu_session_n", "procedure_successes", "procedure_failures",
        F.round("procedure_success_rate", 6).alias("procedure_success_rate"),
        *[F.round(c, 3).alias(c) for c in kpi_state.MEANS.values()])


def report_results(n4, http, visible, table, procs):
    """Every incident of every plane as a result; its first message is the cited evidence."""
    n4_procs, http_procs = plane_procedures(visible, n4, http)
    cases = incidents.classify_flows(incidents.flow_cases(visible, table, procs)).withColumn("plane", F.lit("n2"))
    others = incidents.classify_planes(incidents.n4_incidents(n4_procs).unionByName(incidents.sbi_incidents(http_procs)))
    cols = ["run_id", "plane", "flow_id", "procedure", "shape", "detail", "source_no", "incident_type"]
    rank = F.when(F.col("plane") == "n2", 0).when(F.col("plane") == "n4", 1).otherwise(2)
    every = written(cases.select(*cols).unionByName(others.select(*cols)).withColumn("plane_rank", rank))
    laid = dealt(every, ["run_id", "plane_rank", "source_no"])
    numbered = scan(laid, ["run_id"], "plane_rank", ties=("source_no",), bucket=F.col("_part"), incident_no=position())

    def first(messages, plane, name):
        return messages.select("run_id", F.lit(plane).alias("plane"), F.col("msg_no").alias("source_no"),
                               F.col(name).alias("message"), "ts")

    firsts = first(visible, "n2", "ngap").unionByName(first(n4, "n4", "name")).unionByName(first(http, "sbi", "name"))
    cited = F.array(F.struct(F.coalesce("message", F.lit("?")).alias("message"),
                             F.lit(None).cast("int").alias("cause"), "ts"))
    known = F.col("incident_type").isNotNull()
    return numbered.join(firsts, ["run_id", "plane", "source_no"]).select(
        "run_id", "incident_no", "plane", "flow_id", "procedure", "shape", "detail", "incident_type",
        F.when(known, F.concat(F.lit("Flow failed: "), F.col("procedure"))).alias("narrative"),
        F.when(known, cited).alias("cited_evidence"),
        F.lit(1.0).alias("reward"), F.lit(1).alias("rollouts"),
        F.lit(None).cast("array<array<string>>").alias("trajectory"),
        F.lit(True).alias("memory_wrote"))


block("resultrow", f"""SELECT run_id, plane, flow_id, procedure, shape, detail, type, coalesce(message, '?') AS message, ts,
    row_number() OVER (PARTITION BY run_id ORDER BY plane_rank, source_no) AS incident_no,
    count(*) OVER (PARTITION BY run_id) AS incidents, CASE WHEN plane = 'n2' THEN 'flow ' || flow_id
      ELSE upper(plane) || ' — ' || procedure || coalesce(' (flow ' || flow_id || ')', '') END AS label
    FROM (SELECT run_id, 'n2' AS plane, 0 AS plane_rank, flow_id, procedure, shape, detail, source_no, CASE
      WHEN auth_failure THEN 'auth_failure' WHEN registration_reject THEN 'registration_reject'
      WHEN slice_status THEN 'pdu_session_reject_slice'
      WHEN session_reject THEN 'pdu_session_reject_other'
      WHEN echoes > 1 AND echo_span >= 2 THEN 'pdu_session_timeout'
      WHEN registration_request AND NOT registration_end AND shape LIKE '%timeout%'
        THEN 'registration_timeout' END AS type FROM n2case UNION ALL
      SELECT run_id, plane, CASE plane WHEN 'n4' THEN 1 ELSE 2 END, flow_id, procedure, shape, detail, source_no, CASE
      WHEN plane = 'sbi' AND shape = 'explicit reject' AND procedure LIKE 'Nnssf_NSSelection%' THEN 'sbi_nssf_reject'
      WHEN plane = 'sbi' AND shape <> 'explicit reject' AND regexp_matches(procedure, '^(Nudm|Nausf)_')
        THEN 'sbi_udm_timeout'
      WHEN plane = 'n4' AND shape <> 'explicit reject' THEN 'n4_upf_timeout' END
      FROM (SELECT * FROM n4inc UNION ALL SELECT * FROM sbiinc)) c JOIN (
      SELECT run_id, 'n2' AS plane, msg_no AS source_no, ngap AS message, ts FROM n2vis UNION ALL
      SELECT run_id, 'n4', msg_no, name, ts FROM n4b UNION ALL
      SELECT run_id, 'sbi', msg_no, name, ts FROM sbimsg) m USING (run_id, plane, source_no)""")
block("resultcite", f"""SELECT g.run_id, g.incident_no, CASE WHEN g.type IS NULL THEN '(none cited)' ELSE '- ['
      || CASE WHEN plane IS NULL THEN 'unverified' ELSE 'verified' END || '] ' || g.message
      || CASE WHEN plane = 'n2' THEN {_n2_over('carrier')} WHEN plane = 'n4' THEN {_n4_over('message')}
         WHEN plane = 'sbi' THEN {_sbi_over('message')} ELSE '' END || ' @ ' || {_TS} || 's' END AS text
    FROM (SELECT r.run_id, r.incident_no, r.type, r.message, r.ts, n.plane, n.src_ip, n.dst_ip, m.ngap AS carrier,
        s.direction FROM resultrow r LEFT JOIN (
        SELECT c.incident_no, c.run_id, n.plane, n.msg_no, n.src_ip, n.dst_ip FROM resultrow c
        JOIN evname n ON n.run_id = c.run_id AND n.name = c.message AND abs(n.ts - c.ts) < 5e-4
        QUALIFY row_number() OVER (PARTITION BY c.run_id, c.incident_no
          ORDER BY n.prank, n.forder, n.msg_no, n.pos) = 1) n ON n.run_id = r.run_id AND n.incident_no = r.incident_no
      LEFT JOIN n2b m ON n.plane = 'n2' AND m.run_id = n.run_id AND m.msg_no = n.msg_no
      LEFT JOIN sbimsg s ON n.plane = 'sbi' AND s.run_id = n.run_id AND s.msg_no = n.msg_no) g""")
block("chapter", """SELECT run_id, plane, max(incidents) + CASE plane WHEN 'n4' THEN 1 ELSE 2 END AS no
    FROM resultrow WHERE plane <> 'n2' GROUP BY 1, 2""")
_LAST = "CAST(1000000000 AS BIGINT)"


def _lines(section: int, *texts: str) -> str:
    """One SELECT per fixed line of every incident."""
    return " UNION ALL ".join(
        f"SELECT run_id, incident_no, {section} AS section, CAST({i} AS BIGINT) AS line_no, "
        f"{t} AS text FROM resultrow" for i, t in enumerate(texts))


@query("w7_report_assembly", f"""SELECT run_id, CAST(0 AS BIGINT) AS incident_no, 0 AS section,
      CAST(unnest([0, 1, 2, 3, n + 4]) AS BIGINT) AS line_no,
      unnest(['# Post-incident report — ' || n || ' incidents', '',
        '| # | flow | hypothesis | reward | rollouts |',
        '|---|------|------------|--------|----------|', '']) AS text
      FROM (SELECT run_id, max(incidents) AS n FROM resultrow GROUP BY 1)
    UNION ALL SELECT run_id, 0, 0, incident_no + 3, '| ' || incident_no || ' | ' || CASE WHEN plane = 'n2'
      THEN CAST(flow_id AS VARCHAR) ELSE label END || ' | ' || coalesce(type, '—') || ' | 1.0 | 1 |' FROM resultrow
    UNION ALL {_lines(0, "'## Incident ' || incident_no || ' — ' || coalesce(type, 'no hypothesis')"
                      " || ' — ' || label", "''")}
    UNION ALL SELECT run_id, incident_no, 0, unnest([2, 3]), unnest(['**Incident detail:** '
      || detail, '']) FROM resultrow WHERE detail <> ''
    UNION ALL {_lines(1, "'### Root cause'", "CASE WHEN type IS NULL THEN 'No hypothesis: the LATS "
                      "search completed no finalize.' ELSE 'Flow failed: ' || procedure END", "''")}
    UNION ALL {_lines(2, "'### Evidence'")}
    UNION ALL SELECT run_id, incident_no, 2, CASE WHEN text = '(none cited)' THEN 1 ELSE 100 END, text FROM resultcite
    UNION ALL SELECT run_id, incident_no, 2, {_LAST}, '' FROM resultrow
    UNION ALL {_lines(4, "'### Timeline (' || CASE WHEN plane = 'n2' THEN 'flow ' || flow_id ELSE upper(plane) END || ')'")}
    UNION ALL SELECT run_id, incident_no, 4, 1, '(see Timeline (' || upper(plane) || ') after the last incident)'
      FROM resultrow WHERE plane <> 'n2'
    UNION ALL SELECT r.run_id, r.incident_no, 4, t.line_no + 100, t.text FROM resultrow r JOIN (
      SELECT run_id, flow_id, i AS line_no, '[' || i || '] ' || {_TS} || 's  '
        || coalesce(v_inner, v_name, ngap, '?') || {_n2_over('ngap')}
        || coalesce('  cause #' || v_cause || ' (cause ' || v_cause || ')', '') AS text FROM n2num
        WHERE i <= 50 UNION ALL SELECT run_id, flow_id, 51, '... (' || messages - 50
        || ' more not shown)' FROM n2attr WHERE messages > 50) t
      ON t.run_id = r.run_id AND t.flow_id = r.flow_id AND r.plane = 'n2'
    UNION ALL SELECT run_id, no, 4, CAST(unnest([0, 1, 1000000000]) AS BIGINT),
      unnest(['## Timeline (' || upper(plane) || ')', '', '']) FROM chapter
    UNION ALL SELECT c.run_id, no, 4, t.line_no + 100, t.text FROM chapter c JOIN ({_PLANE_LINES}) t
      ON t.run_id = c.run_id AND t.plane = c.plane
    UNION ALL {_lines(5, "''", "'### Capture KPIs'", "(SELECT k.text FROM kpiline k WHERE k.run_id = resultrow.run_id)")}
    UNION ALL {_lines(6, "''", "'### Search path'",
                      "'(trajectory not recorded in this results file)'")}
    UNION ALL {_lines(7, "''", "'### Memory'", "CASE WHEN type IS NULL THEN 'no Episode written "
                      "(no hypothesis)' ELSE 'new Episode written (' || type || ')' END", "''")}""")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    visible, table, procs = flows.analyze(n2)
    table, procs = written(table), written(procs)
    results = written(report_results(n4, http, visible, table, procs))
    cites = results.filter(F.col("cited_evidence").isNotNull()).select(
        "run_id", "incident_no", F.posexplode("cited_evidence").alias("line_no", "e")).select(
        F.concat_ws("/", "run_id", "incident_no", "line_no").alias("cite_id"), "run_id",
        "incident_no", F.col("line_no").cast("long").alias("line_no"), "e.*")
    names = written(evidence.about(
        evidence.located_names(visible, flows.unassociated(n2), n4, http), cites))
    shown = evidence.locate(evidence.ground(cites, evidence.inventory(names)), names).select(
        "run_id", "incident_no", "line_no", report.evidence_line(F.col("grounded")).alias("text"))
    timeline = report.flow_timeline(evidence.numbered(visible, ["run_id", "flow_id"]), table)
    lines = report.assemble(results, shown, timeline, shown_kpis(kpi.run_kpis(procs, table)),
                            plane_lines=plane_timelines(n4, http), repeat_planes=False)
    return lines.unionByName(report.no_incident_lines(table, results))
