"""Incidents, topology, evidence and memory over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.operators import correlate, evidence, flows, incidents, memory, pfcp, sbi, topology
from planeweave.plans import bridges as b
from planeweave.plans.oracle import block
from planeweave.plans.plane_queries import planes, sbi_messages
from planeweave.plans.registry import query
from planeweave.session import cut_lineage, written

block("n2named", """SELECT *, coalesce(v_inner, v_name, ngap, '') AS shown,
    coalesce(v_inner, v_name, '') AS nas_shown FROM n2vis""")
block("n2feat", """SELECT run_id, flow_id,
    bool_or(shown LIKE '%PDUSession%' OR shown LIKE '%5GSMPDU%') AS names_session,
    bool_or(shown LIKE '%Registration%') AS names_registration,
    bool_or(v_cause IS NOT NULL) AS has_cause,
    bool_or(v_cause IS NOT NULL AND regexp_matches(lower(nas_shown), 'reject|status|failure'))
      AS cause_on_reject,
    bool_or(shown LIKE '%AuthenticationFailure%') AS auth_failure,
    bool_or(shown LIKE '%RegistrationReject%') AS registration_reject,
    bool_or(shown LIKE '%RegistrationRequest%') AS registration_request,
    bool_or(shown LIKE '%RegistrationAccept%' OR shown LIKE '%RegistrationReject%')
      AS registration_end,
    bool_or(coalesce(v_cause = 91, FALSE) AND regexp_matches(lower(nas_shown), '5gmm.*status'))
      AS slice_status,
    bool_or(lower(shown) LIKE '%pdusessionestabreject%' OR (v_cause IS NOT NULL
      AND regexp_matches(lower(nas_shown), '5gsm.*(reject|status|failure)'))) AS session_reject,
    count(CASE WHEN v_cause = 90 AND shown LIKE '%PDUSession%' THEN 1 END) AS echoes,
    max(CASE WHEN v_cause = 90 AND shown LIKE '%PDUSession%' THEN ts END)
      - min(CASE WHEN v_cause = 90 AND shown LIKE '%PDUSession%' THEN ts END) AS echo_span,
    min(msg_no) AS source_no FROM n2named GROUP BY 1, 2""")
block("n2codes", """SELECT run_id, flow_id, string_agg('#' || v_cause, ', ' ORDER BY v_cause) AS codes
    FROM (SELECT DISTINCT run_id, flow_id, v_cause FROM n2vis WHERE v_cause <> 0) GROUP BY 1, 2""")
block("n2outcome", """SELECT run_id, flow_id, count(*) AS procedures,
    bool_or(outcome = 'reject') AS any_reject,
    arg_min(kind, proc_no) FILTER (outcome = 'reject') AS failed_kind FROM n2proc GROUP BY 1, 2""")
block("n2case", """SELECT f.*, CASE WHEN o.failed_kind = 'registration' THEN 'Registration'
      WHEN o.failed_kind IS NOT NULL THEN 'PDU Session' WHEN names_session THEN 'PDU Session'
      WHEN names_registration THEN 'Registration' ELSE 'unknown' END AS procedure,
    CASE WHEN coalesce(any_reject, FALSE) OR cause_on_reject THEN 'explicit reject'
      ELSE 'no terminal message (timeout)' END AS shape,
    CASE WHEN has_cause THEN 'cause code(s) observed: ' || coalesce(codes, '') END AS detail
    FROM n2feat f JOIN n2attr a USING (run_id, flow_id)
    LEFT JOIN n2outcome o USING (run_id, flow_id) LEFT JOIN n2codes c USING (run_id, flow_id)
    WHERE coalesce(any_reject, FALSE) OR has_cause OR coalesce(procedures, 0) = 0 OR partial""")
block("sbiflow", """SELECT p.*, l.flow_id FROM sbiproc p JOIN sbilast q
    USING (run_id, conn, stream_id) LEFT JOIN sbilink l
    ON l.run_id = p.run_id AND l.msg_no = q.msg_no""")
block("n4flow", """SELECT p.*, coalesce(q.flow_id, r.flow_id) AS flow_id FROM n4proc p
    LEFT JOIN n4link q ON q.run_id = p.run_id AND q.msg_no = p.req_no
    LEFT JOIN n4link r ON r.run_id = p.run_id AND r.msg_no = p.rsp_no""")
block("sbiinc", """SELECT run_id, 'sbi' AS plane, flow_id, kind AS procedure,
    CASE WHEN outcome = 'reject' THEN 'explicit reject' ELSE 'no terminal message (timeout)' END
      AS shape, CASE WHEN outcome = 'reject' THEN 'SBI status code(s) observed: '
      || coalesce(CAST(status AS VARCHAR), 'None') END AS detail, req_no AS source_no
    FROM sbiflow WHERE outcome IN ('reject', 'timeout')""")
block("n4inc", """SELECT run_id, 'n4' AS plane, flow_id, kind AS procedure,
    CASE WHEN outcome = 'reject' THEN 'explicit reject' ELSE 'no terminal message (timeout)' END
      AS shape, CASE WHEN outcome = 'reject' THEN 'PFCP cause code(s) observed: ' || cause END
      AS detail, req_no AS source_no FROM n4flow WHERE outcome IN ('reject', 'timeout') AND kind IN
    ('session_establishment', 'session_modification', 'session_deletion', 'session_report')""")
block("allinc", """SELECT run_id, 'n2' AS plane, 0 AS plane_rank, flow_id, procedure, shape, detail,
    source_no FROM n2case UNION ALL
    SELECT run_id, plane, 1, flow_id, procedure, shape, detail, source_no FROM n4inc UNION ALL
    SELECT run_id, plane, 2, flow_id, procedure, shape, detail, source_no FROM sbiinc""")

_INC = ["run_id", "plane", "flow_id", "procedure", "shape", "detail", "source_no"]


def _analysis(spark, d):
    """Flow analysis for cases: events decoded once, without the columns that no case is made of."""
    return flows.analyze(b.n2(spark, d, b.decoded(spark, d)).drop(
        "src_ip", "dst_ip", "stream_id", "kind", "f_teids", "unparsed"))


def _cases(spark, d):
    return incidents.flow_cases(*_analysis(spark, d))


def plane_procedures(visible, n4, http):
    return (pfcp.pair_procedures(correlate.n4_with_flow(n4, visible)),
            sbi.pair_procedures(correlate.sbi_with_flow(http, visible)))


@query("i1_n2_incident_filter", "SELECT run_id, flow_id, source_no FROM n2case")
def _(spark, d):
    return _cases(spark, d).select("run_id", "flow_id", "source_no")


@query("i2_procedure_label", "SELECT run_id, flow_id, procedure FROM n2case")
def _(spark, d):
    return _cases(spark, d).select("run_id", "flow_id", "procedure")


@query("i3_shape", "SELECT run_id, flow_id, shape FROM n2case")
def _(spark, d):
    return _cases(spark, d).select("run_id", "flow_id", "shape")


@query("i4_cause_detail", "SELECT run_id, flow_id, detail FROM n2case")
def _(spark, d):
    return _cases(spark, d).select("run_id", "flow_id", "detail")


@query("i5_sbi_incidents", f"SELECT {', '.join(_INC)} FROM sbiinc")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    _, http_procs = plane_procedures(written(flows.visible_messages(n2)), n4, http)
    return incidents.sbi_incidents(http_procs).select(*_INC)


@query("i6_n4_incidents", f"SELECT {', '.join(_INC)} FROM n4inc")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    n4_procs, _ = plane_procedures(written(flows.visible_messages(n2)), n4, http)
    return incidents.n4_incidents(n4_procs).select(*_INC)


def union_of_planes(spark, d, flow_id=None):
    n2, n4, http = planes(spark, d)
    analysis = flows.analyze(n2)
    n4_procs, http_procs = plane_procedures(analysis[0], n4, http)
    return incidents.all_incidents(
        incidents.n2_incidents(*analysis),
        incidents.n4_incidents(n4_procs), incidents.sbi_incidents(http_procs), flow_id)


@query("i7_incident_union", f"SELECT plane_rank, {', '.join(_INC)} FROM allinc")
def _(spark, d):
    return union_of_planes(spark, d).select("plane_rank", *_INC)


@query("i7_flow_filter", f"SELECT plane_rank, {', '.join(_INC)} FROM allinc WHERE flow_id = 3")
def _(spark, d):
    return union_of_planes(spark, d, flow_id=3).select("plane_rank", *_INC)


@query("i8_incident_types", """SELECT run_id, 'n2' AS plane, source_no, CASE
    WHEN auth_failure THEN 'auth_failure' WHEN registration_reject THEN 'registration_reject'
    WHEN slice_status THEN 'pdu_session_reject_slice'
    WHEN session_reject THEN 'pdu_session_reject_other'
    WHEN echoes > 1 AND echo_span >= 2 THEN 'pdu_session_timeout'
    WHEN registration_request AND NOT registration_end AND shape LIKE '%timeout%'
      THEN 'registration_timeout' END AS incident_type FROM n2case UNION ALL
    SELECT run_id, plane, source_no, CASE
    WHEN plane = 'sbi' AND shape = 'explicit reject' AND procedure LIKE 'Nnssf_NSSelection%'
      THEN 'sbi_nssf_reject'
    WHEN plane = 'sbi' AND shape <> 'explicit reject'
      AND regexp_matches(procedure, '^(Nudm|Nausf)_') THEN 'sbi_udm_timeout'
    WHEN plane = 'n4' AND shape <> 'explicit reject' THEN 'n4_upf_timeout' END
    FROM (SELECT * FROM n4inc UNION ALL SELECT * FROM sbiinc)""")
def _(spark, d):
    n2, n4, http = planes(spark, d)
    analysis = flows.analyze(n2)
    n4_procs, http_procs = plane_procedures(analysis[0], n4, http)
    others = incidents.n4_incidents(n4_procs).unionByName(incidents.sbi_incidents(http_procs))
    cols = ["run_id", "plane", "source_no", "incident_type"]
    typed = incidents.classify_flows(incidents.flow_cases(*analysis)).withColumn("plane", F.lit("n2"))
    return typed.select(*cols).unionByName(incidents.classify_planes(others).select(*cols))


@query("o1_gnb_amf_roles", """SELECT run_id, unnest(['gNB', 'AMF']) AS role,
    unnest([src, dst]) AS ip, evidence FROM (SELECT run_id,
      coalesce(m.src_ip, 'unknown') AS src, coalesce(m.dst_ip, 'unknown') AS dst,
      coalesce('InitialUEMessage src/dst @ +' || printf('%.3f', m.ts - t0) || 's (N2, flow '
        || m.flow_id || ')', 'no IP-carrying N2 message') AS evidence
    FROM (SELECT run_id, min(ts) AS t0, arg_min(CASE WHEN ngap = 'InitialUEMessage' THEN
      {'src_ip': src_ip, 'dst_ip': dst_ip, 'ts': ts, 'flow_id': flow_id} END, flow_id * 1000000000
      + msg_no) FILTER (ngap = 'InitialUEMessage') AS m FROM n2vis GROUP BY 1))""")
def _(spark, d):
    return topology.n2_roles(flows.assign_flows(b.n2(spark, d)))


@query("o2_smf_upf_roles", """SELECT run_id, unnest(['SMF', 'UPF']) AS role,
    unnest([src, dst]) AS ip, evidence FROM (SELECT run_id,
      coalesce(m.src_ip, 'unknown') AS src, coalesce(m.dst_ip, 'unknown') AS dst,
      coalesce(m.name || ' src/dst @ +' || printf('%.3f', m.ts - t0) || 's (N4)',
        'no PFCP CP->UP message (only heartbeats)') AS evidence
    FROM (SELECT run_id, min(ts) AS t0, arg_min({'src_ip': src_ip, 'dst_ip': dst_ip, 'ts': ts,
      'name': name}, CASE WHEN name LIKE '%Association Setup Request' THEN 0 ELSE 1000000000 END
      + msg_no) FILTER (name LIKE '%Association Setup Request'
        OR name LIKE '%Session Establishment Request') AS m FROM n4b GROUP BY 1))""")
def _(spark, d):
    n4 = b.n4(spark, d)
    return topology.n4_roles(n4, n4)


@query("o3_ue_summary", """SELECT run_id, flow_id, ran_ue_id, amf_ue_id, partial, messages,
    coalesce(causes, '') AS causes, coalesce(procedures, 0) AS procedures,
    coalesce(accepted, 0) AS accepted FROM n2attr
    LEFT JOIN (SELECT run_id, flow_id, string_agg('#' || v_cause || ' cause ' || v_cause, '; '
      ORDER BY first_no) AS causes FROM (SELECT run_id, flow_id, v_cause, min(msg_no) AS first_no
      FROM n2vis WHERE v_cause IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (run_id, flow_id)
    LEFT JOIN (SELECT run_id, flow_id, count(*) AS procedures,
      count(CASE WHEN outcome = 'accept' THEN 1 END) AS accepted FROM n2proc GROUP BY 1, 2)
    USING (run_id, flow_id)""")
def _(spark, d):
    return topology.ue_summary(*flows.analyze(b.n2(spark, d)))


# --- evidence ---------------------------------------------------------------

_TS = "printf('%.3f', ts)"
block("n2num", """SELECT *, row_number() OVER (PARTITION BY run_id, flow_id ORDER BY msg_no) AS i
    FROM n2vis""")
block("n4num", """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY msg_no) AS i,
    row_number() OVER (PARTITION BY run_id, src_ip, dst_ip, seq ORDER BY msg_no) > 1 AS again
    FROM n4b""")
block("sbinum", """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY msg_no) AS i
    FROM sbimsg""")
block("loosenum", """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY msg_no) AS i
    FROM n2b WHERE ran_ue_id IS NULL AND amf_ue_id IS NULL""")


def _flow_numbered(spark, d):
    return evidence.numbered(flows.visible_messages(b.n2(spark, d)), ["run_id", "flow_id"])


def _n4_numbered(spark, d):
    return evidence.numbered(pfcp.flag_retransmits(b.n4(spark, d)))


@query("e1_flow_listing", """SELECT run_id, 'flows' AS handle, flow_id AS line_no,
    CAST(0 AS BIGINT) AS part, '  flow ' || flow_id || ': ' || CASE WHEN partial THEN 'partial' ELSE 'complete' END || ', ' || messages
    || ' message(s)' || coalesce(', ' || procs, '') AS text FROM n2attr LEFT JOIN
    (SELECT run_id, flow_id, string_agg(kind || ': ' || outcome || ', '
      || printf('%.1f', (end_ts - start_ts) * 1000.0) || ' ms (' || start_msg || ' -> ' || end_msg
      || ')', ', ' ORDER BY proc_no) AS procs FROM n2proc GROUP BY 1, 2) USING (run_id, flow_id)""")
def _(spark, d):
    _, table, procs = flows.analyze(b.n2(spark, d))
    return evidence.flow_listing(table, procs)


@query("e1_flow_detail", f"""SELECT run_id, 'flow:' || flow_id AS handle, CAST(0 AS BIGINT)
      AS line_no, 'Flow ' || flow_id || ' (RAN-UE-NGAP-ID ' || coalesce(CAST(ran_ue_id AS VARCHAR),
      'None') || ', AMF-UE-NGAP-ID ' || coalesce(CAST(amf_ue_id AS VARCHAR), 'None') || ', '
      || CASE WHEN partial THEN 'partial' ELSE 'complete' END || '):' AS text FROM n2attr
    UNION ALL SELECT run_id, 'flow:' || flow_id, i, '  [' || i || '] ' || {_TS} || '  '
      || concat_ws('  ', src_ip || '->' || dst_ip, coalesce(ngap, '?'),
        coalesce(v_inner, v_name) || CASE WHEN v_protected THEN ' (protected)' ELSE '' END,
        'cause=cause ' || v_cause || ' (#' || v_cause || ')',
        '[unparsed: ' || coalesce(unparsed, note) || ']') FROM n2num
    UNION ALL SELECT m.run_id, 'flow:' || l.flow_id, i, '    [n4:' || i || '] ' || {_TS} || '  '
      || src_ip || '->' || dst_ip || '  ' || coalesce(name, '?') FROM n4num m JOIN n4link l
      USING (run_id, msg_no)
    UNION ALL SELECT m.run_id, 'flow:' || l.flow_id, i, '    [sbi:' || i || '] ' || {_TS} || '  '
      || CASE WHEN direction = 'request' THEN coalesce(method, '?') || ' ' || path
         ELSE '-> ' || coalesce(CAST(status AS VARCHAR), '?') END FROM sbinum m JOIN sbilink l
      USING (run_id, msg_no)""")
def _(spark, d):
    visible = cut_lineage(flows.visible_messages(b.n2(spark, d)))
    n4 = evidence.numbered(correlate.n4_with_flow(b.n4(spark, d), visible))
    http = evidence.numbered(correlate.sbi_with_flow(sbi_messages(spark, d), visible))
    return (evidence.flow_headers(flows.flow_attributes(visible))
            .unionByName(evidence.n2_message_lines(
                evidence.numbered(visible, ["run_id", "flow_id"])))
            .unionByName(evidence.linked_lines(n4, "n4"))
            .unionByName(evidence.linked_lines(http, "sbi")))


@query("e2_plane_listings", f"""SELECT run_id, 'unassociated' AS handle, i AS line_no, '  [' || i
      || '] ' || {_TS} || '  ' || coalesce(ngap, '?') AS text FROM loosenum
    UNION ALL SELECT run_id, 'n4', i, '  [' || i || '] ' || {_TS} || '  ' || src_ip || '->'
      || dst_ip || '  ' || coalesce(name, '?') || CASE WHEN again THEN '  (retransmit)' ELSE '' END
      || coalesce('  cause="' || cause || '"', '')
      || coalesce('  [unparsed: ' || unparsed || ']', '') FROM n4num
    UNION ALL SELECT run_id, 'sbi', i, '  [' || i || '] ' || {_TS} || '  '
      || CASE WHEN direction = 'request' THEN coalesce(method, '?') || ' ' || path
         ELSE '-> ' || coalesce(CAST(status AS VARCHAR), '?') END || '  (' || coalesce(name, '?')
      || ')' || coalesce('  problem="' || problem_title || '"', '')
      || coalesce('  cause="' || problem_cause || '"', '')
      || coalesce('  [unparsed: ' || unparsed || ']', '') FROM sbinum""")
def _(spark, d):
    loose = evidence.numbered(flows.unassociated(b.n2(spark, d)))
    return (evidence.unassociated_lines(loose)
            .unionByName(evidence.n4_lines(_n4_numbered(spark, d)))
            .unionByName(evidence.sbi_lines(evidence.numbered(sbi_messages(spark, d)))))


_HANDLES = [RUN := f"{b.RUN} AS run_id",
            """CASE event_type WHEN 'signup' THEN 'flow:' || CAST(k AS STRING) || ':'
                 || CAST(event_id % 200 AS STRING)
               WHEN 'view' THEN 'n4:' || CAST(event_id AS STRING)
               WHEN 'click' THEN 'sbi:' || CAST(event_id % 1500 AS STRING)
               WHEN 'purchase' THEN 'unassociated:' || CAST(k AS STRING)
               ELSE CASE WHEN k % 3 = 0 THEN 'n4:x' WHEN k % 3 = 1 THEN 'ue:'
                 || CAST(k AS STRING) ELSE 'flow:1:2:3' END END AS handle"""]
_UNKNOWN = """'inspect_decoded_evidence: unrecognized handle "' || handle || '"; expected kpis, flows, unassociated, n4, sbi, flow:<id>, flow:<id>:<i>, unassociated:<i>, n4:<i>, or sbi:<i>'"""


@query("e3_handle_lookup", f"""WITH h AS (SELECT DISTINCT {', '.join(_HANDLES)} FROM ev),
    p AS (SELECT *, split_part(handle, ':', 1) AS plane,
      try_cast(split_part(handle, ':', 2) AS BIGINT) AS x,
      try_cast(split_part(handle, ':', 3) AS BIGINT) AS y FROM h),
    u AS (SELECT run_id, 'unassociated' AS plane, count(*) AS n FROM loosenum GROUP BY 1 UNION ALL
      SELECT run_id, 'n4', count(*) FROM n4num GROUP BY 1 UNION ALL
      SELECT run_id, 'sbi', count(*) FROM sbinum GROUP BY 1)
    SELECT p.run_id, p.handle, CASE
      WHEN plane = 'ue' OR handle IN ('n4:x', 'flow:1:2:3') THEN {_UNKNOWN}
      WHEN plane = 'flow' AND a.messages IS NULL THEN 'inspect_decoded_evidence: no flow ' || x
        || ' in the capture (' || (SELECT count(*) FROM n2attr z WHERE z.run_id = p.run_id)
        || ' flow(s))'
      WHEN plane = 'flow' AND f.i IS NULL THEN 'inspect_decoded_evidence: flow ' || x || ' has '
        || a.messages || ' message(s); no message ' || y
      WHEN plane = 'flow' THEN concat_ws(chr(10), 'Evidence flow:' || x || ':' || y || ':',
        '  ts=' || printf('%.3f', f.ts), '  ' || f.src_ip || ' -> ' || f.dst_ip,
        '  ngap=' || coalesce(f.ngap, '?') || coalesce(' (' || f.kind || ')', ''),
        '  nas=' || f.v_name || CASE WHEN f.v_protected THEN ' (protected)' ELSE '' END,
        '  nas_inner=' || f.v_inner, '  nas_cause: cause ' || f.v_cause || ' (#' || f.v_cause
        || ')', '  unparsed: ' || coalesce(f.unparsed, f.note))
      WHEN n.i IS NULL AND s.i IS NULL AND l.i IS NULL THEN 'inspect_decoded_evidence: ' || plane
        || ' has ' || (SELECT u.n FROM u WHERE u.run_id = p.run_id AND u.plane = p.plane)
        || ' message(s); no message ' || x
      WHEN plane = 'n4' THEN concat_ws(chr(10), 'Evidence n4:' || x || ':',
        '  ts=' || printf('%.3f', n.ts), '  ' || n.src_ip || ':' || n.src_port || ' -> '
        || n.dst_ip || ':' || n.dst_port, '  name=' || coalesce(n.name, '?'),
        CASE WHEN n.again THEN '  retransmit: true' END, '  seq=' || n.seq,
        '  cause="' || n.cause || '"', '  unparsed: ' || n.unparsed)
      WHEN plane = 'sbi' THEN concat_ws(chr(10), 'Evidence sbi:' || x || ':',
        '  ts=' || printf('%.3f', s.ts), '  ' || s.src_ip || ':' || s.src_port || ' -> '
        || s.dst_ip || ':' || s.dst_port, '  direction=' || s.direction,
        CASE WHEN s.direction = 'request' THEN '  method=' || coalesce(s.method, '?') END,
        CASE WHEN s.direction = 'request' THEN '  path=' || s.path END,
        CASE WHEN s.direction = 'response' THEN '  status='
          || coalesce(CAST(s.status AS VARCHAR), '?') END,
        '  name=' || coalesce(s.name, '?'), '  stream_id=' || s.stream_id,
        '  problem_title="' || s.problem_title || '"', '  problem_cause="' || s.problem_cause
        || '"', '  unparsed: ' || s.unparsed)
      ELSE concat_ws(chr(10), 'Evidence unassociated:' || x || ':',
        '  ts=' || printf('%.3f', l.ts), '  ngap=' || coalesce(l.ngap, '?'),
        '  unparsed: ' || l.unparsed) END AS text
    FROM p LEFT JOIN n2attr a ON plane = 'flow' AND a.run_id = p.run_id AND a.flow_id = x
    LEFT JOIN n2num f ON plane = 'flow' AND f.run_id = p.run_id AND f.flow_id = x AND f.i = y
    LEFT JOIN n4num n ON plane = 'n4' AND n.run_id = p.run_id AND n.i = x
    LEFT JOIN sbinum s ON plane = 'sbi' AND s.run_id = p.run_id AND s.i = x
    LEFT JOIN loosenum l ON plane = 'unassociated' AND l.run_id = p.run_id AND l.i = x""")
def _(spark, d):
    handles = b.ev(spark, d).selectExpr(*_HANDLES).distinct()
    visible = cut_lineage(flows.visible_messages(b.n2(spark, d)))
    loose = evidence.numbered(flows.unassociated(b.n2(spark, d)))
    n4, http = _n4_numbered(spark, d), evidence.numbered(sbi_messages(spark, d))
    views = (evidence.n2_views(evidence.numbered(visible, ["run_id", "flow_id"]))
             .unionByName(evidence.unassociated_views(loose))
             .unionByName(evidence.n4_views(n4)).unionByName(evidence.sbi_views(http)))

    def size(df, plane):
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "plane", F.lit(plane))

    sizes = size(loose, "unassociated").unionByName(size(n4, "n4")).unionByName(size(http, "sbi"))
    return evidence.lookup(handles, views, flows.flow_attributes(visible), sizes)


block("evname", """SELECT run_id, n AS name, ts, v_cause AS cause, 'n2' AS plane, msg_no, src_ip,
      dst_ip, 0 AS prank, flow_id AS forder, pos FROM (SELECT *, unnest([ngap, v_name, v_inner]) AS n,
      unnest([0, 1, 2]) AS pos FROM n2vis) WHERE n IS NOT NULL UNION ALL
    SELECT run_id, ngap, ts, NULL, 'n2', msg_no, src_ip, dst_ip, 1, 0, 0 FROM loosenum
      WHERE ngap IS NOT NULL UNION ALL
    SELECT run_id, name, ts, cause_code, 'n4', msg_no, src_ip, dst_ip, 2, 0, 0 FROM n4b
      WHERE name IS NOT NULL UNION ALL
    SELECT run_id, name, ts, NULL, 'sbi', msg_no, src_ip, dst_ip, 3, 0, 0 FROM sbimsg
      WHERE name IS NOT NULL""")


def located_names(spark, d):
    n2, n4, http = planes(spark, d)
    return evidence.located_names(flows.visible_messages(n2), flows.unassociated(n2), n4, http)


@query("e4_message_inventory", """SELECT run_id, name, ts, cause FROM evname
    QUALIFY row_number() OVER (PARTITION BY run_id, name, ts
      ORDER BY prank DESC, forder DESC, msg_no DESC, pos DESC) = 1""")
def _(spark, d):
    return evidence.inventory(located_names(spark, d))


# Citations: one per event, its time off by up to a millisecond.
_CITES = ["event_id AS cite_id", "CAST(floor(event_id / 3) AS BIGINT) AS hypothesis_id", RUN,
          """CASE event_type WHEN 'signup' THEN 'InitialUEMessage'
               WHEN 'view' THEN 'PFCP Session Modification Request'
               WHEN 'click' THEN 'Nsmf_PDUSession'
               WHEN 'purchase' THEN '5GSMPDUSessionEstabAccept'
               ELSE '5GMMRegistrationReject' END AS message""",
          "CAST(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 3 + k % 7 END AS INT) AS cause",
          "CASE WHEN k = 50 THEN NULL ELSE t + (k % 11 - 5) / 10000.0 END AS ts",
          "1 + CAST(event_id % 9 AS BIGINT) AS narrative_size"]
block("cites", f"SELECT {', '.join(_CITES)} FROM ev")
block("citeground", """SELECT c.*, EXISTS (SELECT 1 FROM evstock s WHERE s.run_id = c.run_id
    AND s.name = c.message AND abs(s.ts - c.ts) < 5e-4
    AND (c.cause IS NULL OR c.cause = s.cause)) AS grounded FROM cites c""")
block("evstock", """SELECT run_id, name, ts, cause FROM evname
    QUALIFY row_number() OVER (PARTITION BY run_id, name, ts
      ORDER BY prank DESC, forder DESC, msg_no DESC, pos DESC) = 1""")


def citations(spark, d):
    return b.ev(spark, d).selectExpr(*_CITES)


@query("e5_grounding", "SELECT cite_id, grounded FROM citeground")
def _(spark, d):
    stock = evidence.inventory(located_names(spark, d))
    return evidence.ground(citations(spark, d), stock).select("cite_id", "grounded")


@query("e6_acceptance_bar", """SELECT hypothesis_id, count(*) FILTER (grounded) AS grounded_items
    FROM citeground GROUP BY 1 HAVING count(*) FILTER (grounded) > 0 AND min(narrative_size) > 1""")
def _(spark, d):
    stock = evidence.inventory(located_names(spark, d))
    cited = citations(spark, d)
    hypotheses = cited.groupBy("hypothesis_id").agg(F.min("narrative_size").alias("size"))
    return evidence.accepted(hypotheses, evidence.ground(cited, stock),
                             F.col("size") > 1).select("hypothesis_id", "grounded_items")


@query("e7_locate_message", """SELECT c.cite_id, n.plane, n.msg_no, n.src_ip, n.dst_ip FROM cites c
    LEFT JOIN evname n ON n.run_id = c.run_id AND n.name = c.message AND abs(n.ts - c.ts) < 5e-4
    QUALIFY row_number() OVER (PARTITION BY c.cite_id
      ORDER BY n.prank, n.forder, n.msg_no, n.pos) = 1""")
def _(spark, d):
    return evidence.locate(citations(spark, d), located_names(spark, d)).select(
        "cite_id", "plane", "msg_no", "src_ip", "dst_ip")


# --- memory -----------------------------------------------------------------
# Episodes: one per order, its line items the cited evidence.
_TYPE = "CASE o_orderkey % 10 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(incidents.INCIDENT_TYPES)) + \
    " ELSE 'other' END AS incident_type"
_NAMES = ["InitialUEMessage", "5GMMRegistrationReject", "5GMMRegistrationRequest",
          "UplinkNASTransport", "5GSMPDUSessionEstabReject", "5GMMStatus", "Nudm_SDM",
          "PFCP Session Establishment Request", "5GSMPDUSessionEstabRequest", "Paging"]
# Up to three cited items per order, each from the order's own columns.
_ORDER = ["o_orderkey", _TYPE,
          "CASE WHEN o_custkey % 50 = 0 THEN '' ELSE o_orderpriority END AS narrative"]


def _cited(j: int) -> dict[str, str]:
    return {
        "present": ["o_orderkey % 11 <> 0", "o_custkey % 3 > 0", "o_custkey % 4 = 0"][j],
        "message": f"CASE (o_custkey + o_orderkey * {j + 1}) % 10 " + " ".join(
            f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END",
        "cause": f"""CAST(CASE (o_orderkey + {j} * o_custkey) % 6 WHEN 0 THEN 91 WHEN 1 THEN 67
            WHEN 2 THEN 90 WHEN 3 THEN 3 + o_custkey % 7 END AS INT)""",
        "ts": f"""CAST(CASE WHEN (o_custkey + {j}) % 17 = 0 THEN NULL
            ELSE (o_orderkey * {j + 3}) % 4 + 0.5 END AS DOUBLE)"""}


block("epcite", " UNION ALL ".join(
    f"SELECT o_orderkey, {c['message']} AS message, {c['cause']} AS cause, {c['ts']} AS ts "
    f"FROM orders WHERE {c['present']}" for c in map(_cited, range(3))))
block("epall", f"""SELECT {', '.join(_ORDER)}, epoch_us(o_orderdate) AS created_us, o_orderdate
    AS created_at FROM orders""")
block("epvalid", """SELECT * FROM epall WHERE incident_type <> 'other' AND narrative <> ''
    AND o_orderkey IN (SELECT o_orderkey FROM epcite)""")


def episodes(spark, d):
    items = ", ".join(
        f"CASE WHEN {c['present']} THEN named_struct('message', {c['message']}, "
        f"'cause', {c['cause']}, 'ts', {c['ts']}) END" for c in map(_cited, range(3)))
    return b.table(spark, d, "orders").selectExpr(
        *_ORDER, "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        f"sort_array(array_compact(array({items}))) AS cited_evidence")


@query("m1_validation", "SELECT o_orderkey, incident_type FROM epvalid")
def _(spark, d):
    return memory.valid(episodes(spark, d)).select("o_orderkey", "incident_type")


block("epkey", """SELECT o_orderkey, incident_type || '|' || (SELECT string_agg(x, ';' ORDER BY x)
    FROM (SELECT DISTINCT c.message || '@' || coalesce(CAST(c.ts AS VARCHAR), '-') AS x
      FROM epcite c WHERE c.o_orderkey = e.o_orderkey)) AS ident FROM epvalid e""")


@query("m2_consolidate", """SELECT min(o_orderkey) AS o_orderkey FROM epkey
    WHERE o_orderkey % 3 <> 0 GROUP BY ident
    HAVING ident NOT IN (SELECT ident FROM epkey WHERE o_orderkey % 3 = 0)""")
def _(spark, d):
    every = episodes(spark, d)
    stored = F.col("o_orderkey") % 3 == 0
    return memory.consolidate(every.filter(~stored), every.filter(stored), "o_orderkey").select(
        "o_orderkey")


@query("m3_filtered_lookup", """SELECT o_orderkey, matches, greatest(matches - 5, 0) AS not_shown
    FROM (SELECT *, count(*) OVER () AS matches FROM epvalid e
      WHERE incident_type = 'pdu_session_reject_other' AND EXISTS (SELECT 1 FROM epcite c
        WHERE c.o_orderkey = e.o_orderkey AND c.message = '5GMMStatus' AND c.cause = 67))
    ORDER BY created_us DESC, o_orderkey LIMIT 5""")
def _(spark, d):
    return memory.lookup(episodes(spark, d), "pdu_session_reject_other", "5GMMStatus", 67,
                         ties=("o_orderkey",)).select("o_orderkey", "matches", "not_shown")


@query("m4_similar_episodes", """WITH tok AS (SELECT DISTINCT run_id, flow_id, t, w FROM (
      SELECT run_id, flow_id, unnest([v_inner, v_name, ngap]) AS t, 1 AS w FROM n2vis UNION ALL
      SELECT run_id, flow_id, 'cause' || v_cause, 3 FROM n2vis WHERE v_cause <> 0)
      WHERE t IS NOT NULL),
    etok AS (SELECT DISTINCT o_orderkey, t FROM (SELECT o_orderkey, message AS t FROM epcite
      UNION ALL SELECT o_orderkey, 'cause' || cause FROM epcite WHERE cause IS NOT NULL)),
    pts AS (SELECT run_id, flow_id, o_orderkey, sum(w) AS points FROM tok JOIN etok USING (t)
      GROUP BY 1, 2, 3),
    proc AS (SELECT *, CASE WHEN incident_type LIKE 'auth%' OR incident_type LIKE 'registration%'
        OR incident_type = 'sbi_udm_timeout' THEN 'Registration' ELSE 'PDU Session' END AS about
      FROM epvalid)
    SELECT i.run_id, i.flow_id, e.o_orderkey, CAST(coalesce(p.points, 0)
      + CASE WHEN e.about = i.procedure THEN 2 ELSE 0 END AS BIGINT) AS score,
      row_number() OVER (PARTITION BY i.run_id, i.flow_id ORDER BY coalesce(p.points, 0)
        + CASE WHEN e.about = i.procedure THEN 2 ELSE 0 END DESC, e.created_us DESC, e.o_orderkey)
      AS rank
    FROM n2case i CROSS JOIN proc e LEFT JOIN pts p ON p.run_id = i.run_id
      AND p.flow_id = i.flow_id AND p.o_orderkey = e.o_orderkey
    WHERE coalesce(p.points, 0) + CASE WHEN e.about = i.procedure THEN 2 ELSE 0 END >= 2
    QUALIFY rank <= 3""")
def _(spark, d):
    visible, table, procs = _analysis(spark, d)
    found = incidents.n2_incidents(visible, table, procs)
    profiles = memory.incident_profiles(found, visible).withColumn(
        "incident", F.struct("run_id", "flow_id"))
    best = memory.similar(profiles, episodes(spark, d), "incident", "o_orderkey")
    return best.select("incident.run_id", "incident.flow_id", "o_orderkey", "score", "rank")


@query("m5_type_to_procedure", """SELECT o_orderkey, CASE
    WHEN incident_type LIKE 'auth%' OR incident_type LIKE 'registration%' THEN 'Registration'
    WHEN incident_type LIKE 'pdu_session%' THEN 'PDU Session'
    WHEN incident_type = 'sbi_udm_timeout' THEN 'Registration'
    WHEN incident_type IN ('sbi_nssf_reject', 'n4_upf_timeout') THEN 'PDU Session' END AS procedure
    FROM epall""")
def _(spark, d):
    return b.table(spark, d, "orders").selectExpr(*_ORDER).select(
        "o_orderkey", memory.procedure_of(F.col("incident_type")).alias("procedure"))
