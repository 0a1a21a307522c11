"""Check SQL: named building blocks and the statement assembled from them."""

from __future__ import annotations

import re

from planeweave.plans import bridges as b

BLOCKS: dict[str, str] = {}


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def statement(select: str) -> str:
    """`select` preceded by the blocks it mentions, directly or through others."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in BLOCKS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(BLOCKS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    if not ordered:
        return select
    blocks = "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in ordered)
    if select.lstrip().startswith("WITH "):
        return blocks + ",\n" + select.lstrip()[len("WITH "):]
    return blocks + "\n" + select


block("ev", b.EV_SQL)
block("n2b", f"SELECT {', '.join(b.N2_COLUMNS)} FROM ev")
block("n4b", f"""SELECT *, {b.N4_CAUSE} FROM
  (SELECT *, {b.N4_NAME} FROM (SELECT {', '.join(b.N4_COLUMNS)} FROM ev))""")
block("sbib", f"SELECT {', '.join(b.SBI_COLUMNS)} FROM ev")

block("n2keyed", """SELECT *, least(sport, dport) AS assoc_lo, greatest(sport, dport) AS assoc_hi,
  coalesce(ran_ue_id, -1) AS ran_key FROM n2b
  WHERE ran_ue_id IS NOT NULL OR amf_ue_id IS NOT NULL""")
block("n2flowid", """SELECT run_id, assoc_lo, assoc_hi, ran_key, min(msg_no) AS first_msg_no,
  row_number() OVER (PARTITION BY run_id ORDER BY min(msg_no)) AS flow_id
  FROM n2keyed GROUP BY 1, 2, 3, 4""")
block("n2flow", """SELECT k.*, f.flow_id, f.first_msg_no FROM n2keyed k
  JOIN n2flowid f USING (run_id, assoc_lo, assoc_hi, ran_key)""")
block("n2algo", """SELECT *, first_value(CASE WHEN nas_name IS NOT NULL AND (NOT nas_protected OR
    (nas_shdr IN (1, 3) AND nas_inner IS NOT NULL)) THEN nas_ciph END IGNORE NULLS) OVER (
    PARTITION BY run_id, flow_id ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS flow_algo FROM n2flow""")
block("n2note", """SELECT *, CASE
    WHEN nas_name IS NULL OR NOT nas_protected THEN NULL
    WHEN nas_shdr IS NULL THEN 'security-protected (payload unreadable)'
    WHEN nas_shdr NOT IN (1, 3) AND flow_algo IS NULL
      THEN 'security-protected (ciphering unknown: no SMC in capture)'
    WHEN nas_shdr NOT IN (1, 3) AND flow_algo <> 0
      THEN 'security-protected (ciphering 5G-EA' || flow_algo || ' not supported)'
    WHEN nas_inner IS NULL THEN 'inner NAS parse failed' END AS note FROM n2algo""")
block("n2vis", """SELECT run_id, flow_id, first_msg_no, msg_no, ts, src_ip, dst_ip, sport, dport,
    assoc_lo, assoc_hi, ngap, kind, ran_ue_id, amf_ue_id, teid, tip, unparsed, note,
    nas_name IS NOT NULL AS has_nas,
    CASE WHEN nas_name IS NOT NULL THEN nas_protected END AS v_protected,
    CASE WHEN note IS NULL THEN nas_name END AS v_name,
    CASE WHEN note IS NULL AND nas_name IS NOT NULL THEN nas_inner END AS v_inner,
    CASE WHEN note IS NULL AND nas_name IS NOT NULL THEN nas_cause END AS v_cause,
    CASE WHEN note IS NULL AND nas_name IS NOT NULL THEN nas_supi END AS v_supi,
    CASE WHEN note IS NULL AND nas_name IS NOT NULL THEN coalesce(nas_inner, nas_name) END AS known
    FROM n2note""")
block("n2step", """SELECT run_id, flow_id, msg_no, ts, known AS name,
    CASE WHEN known LIKE '5GMMRegistration%' THEN 'registration' ELSE 'pdu_session_est' END AS kind,
    CASE WHEN known LIKE '%Request' THEN 'start' WHEN known LIKE '%Accept' THEN 'accept'
      ELSE 'reject' END AS step
    FROM n2vis WHERE known IN ('5GMMRegistrationRequest', '5GMMRegistrationAccept',
      '5GMMRegistrationReject', '5GSMPDUSessionEstabRequest', '5GSMPDUSessionEstabAccept',
      '5GSMPDUSessionEstabReject')""")
block("n2nasproc", """SELECT run_id, flow_id, kind, 0 AS source, p_ts AS start_ts, p_name AS start_msg,
    p_no AS start_no, ts AS end_ts, name AS end_msg, msg_no AS end_no, step AS outcome
    FROM (SELECT *, lag(step) OVER w AS p_step, lag(ts) OVER w AS p_ts, lag(name) OVER w AS p_name,
      lag(msg_no) OVER w AS p_no FROM n2step
      WINDOW w AS (PARTITION BY run_id, flow_id, kind ORDER BY msg_no))
    WHERE step <> 'start' AND p_step = 'start'""")
block("n2cycle", """SELECT run_id, flow_id, msg_no, ts, ngap, count(CASE WHEN ngap IN
    ('UEContextReleaseRequest', 'UEContextReleaseCommand', 'UEContextReleaseComplete')
    THEN 1 END) OVER (PARTITION BY run_id, flow_id ORDER BY msg_no) AS cycle FROM n2vis""")
block("n2carrier", """SELECT e.run_id, e.flow_id, k.kind, e.msg_no AS end_no, e.ts AS end_ts,
    e.ngap AS end_msg, CASE WHEN e.ngap = k.good THEN 'accept' ELSE 'reject' END AS outcome,
    min(s.msg_no) AS start_no, arg_min(s.ts, s.msg_no) AS start_ts, k.opener AS start_msg
    FROM n2cycle e JOIN (VALUES
      ('registration', 'InitialUEMessage', 'InitialContextSetupRequest',
       'InitialContextSetupFailure'),
      ('pdu_session_est', 'PDUSessionResourceSetupRequest', 'PDUSessionResourceSetupResponse',
       'PDUSessionResourceSetupFailure')) k(kind, opener, good, bad)
      ON e.ngap IN (k.good, k.bad)
    JOIN n2cycle s ON s.run_id = e.run_id AND s.flow_id = e.flow_id AND s.cycle = e.cycle
      AND s.ngap = k.opener AND s.msg_no < e.msg_no
    GROUP BY ALL""")
block("n2fallback", """SELECT c.run_id, c.flow_id, c.kind, 1 AS source, c.start_ts, c.start_msg,
    c.start_no, c.end_ts, c.end_msg, c.end_no, c.outcome FROM n2carrier c
    WHERE c.end_no = (SELECT min(x.end_no) FROM n2carrier x WHERE x.run_id = c.run_id
        AND x.flow_id = c.flow_id AND x.kind = c.kind)
      AND NOT EXISTS (SELECT 1 FROM n2nasproc p WHERE p.run_id = c.run_id
        AND p.flow_id = c.flow_id AND p.kind = c.kind AND p.end_no <= c.end_no)""")
block("n2proc", """SELECT *, row_number() OVER (PARTITION BY run_id, flow_id
    ORDER BY end_no, source, kind) AS proc_no
    FROM (SELECT * FROM n2nasproc UNION ALL SELECT * FROM n2fallback)""")
block("n2attr", """SELECT run_id, flow_id, any_value(assoc_lo) AS assoc_lo,
    any_value(assoc_hi) AS assoc_hi, max(ran_ue_id) AS ran_ue_id,
    arg_min(amf_ue_id, msg_no) FILTER (amf_ue_id IS NOT NULL) AS amf_ue_id,
    coalesce(arg_min(coalesce(ngap, ''), msg_no), '') <> 'InitialUEMessage' AS partial,
    min(msg_no) AS first_msg_no, arg_min(ts, msg_no) AS first_ts, arg_max(ts, msg_no) AS last_ts,
    count(*) AS messages FROM n2vis GROUP BY 1, 2""")

_KIND = "CASE {t} " + " ".join(
    f"WHEN {n} THEN '{k}'" for n, k in {
        1: "heartbeat", 3: "pfd_management", 5: "association_setup", 7: "association_update",
        9: "association_release", 12: "node_report", 14: "session_set_deletion",
        50: "session_establishment", 52: "session_modification", 54: "session_deletion",
        56: "session_report"}.items()) + " END"
block("n4kind", f"""SELECT *, {_KIND.format(t='msg_type')} AS req_kind,
    {_KIND.format(t='msg_type - 1')} AS rsp_kind FROM n4b""")
block("n4pair", """SELECT *, CASE WHEN req_kind IS NOT NULL THEN src_ip ELSE dst_ip END AS client,
    CASE WHEN req_kind IS NOT NULL THEN src_port ELSE dst_port END AS cport
    FROM n4kind WHERE unparsed IS NULL AND (req_kind IS NOT NULL OR rsp_kind IS NOT NULL)""")
block("n4round", """SELECT *, coalesce(sum(CASE WHEN rsp_kind IS NOT NULL THEN 1 ELSE 0 END) OVER (
    PARTITION BY run_id, client, cport, seq ORDER BY msg_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rnd FROM n4pair""")
block("n4proc", """SELECT run_id, coalesce(r.kind, q.kind) AS kind, q.ts AS start_ts,
    coalesce(r.ts, q.ts) AS end_ts, q.name AS start_msg, r.name AS end_msg,
    CASE WHEN r.msg_no IS NULL THEN 'timeout' WHEN r.cause_code IS NULL THEN 'unknown'
      WHEN r.cause_code IN (1, 2, 3) THEN 'accept' ELSE 'reject' END AS outcome,
    r.cause_code AS cause, r.cause AS cause_name, q.msg_no AS req_no, r.msg_no AS rsp_no, seq,
    sends, (coalesce(r.ts, q.ts) - q.ts) * 1000.0 AS duration_ms
    FROM (SELECT run_id, client, cport, seq, rnd, arg_min(ts, msg_no) AS ts,
        arg_min(name, msg_no) AS name, arg_min(req_kind, msg_no) AS kind, min(msg_no) AS msg_no,
        count(*) AS sends FROM n4round WHERE req_kind IS NOT NULL GROUP BY 1, 2, 3, 4, 5) q
    LEFT JOIN (SELECT run_id, client, cport, seq, rnd, ts, name, rsp_kind AS kind, msg_no,
        cause_code, cause FROM n4round WHERE rsp_kind IS NOT NULL) r
    USING (run_id, client, cport, seq, rnd)""")

_SVC = """CASE WHEN {p} LIKE '/nudm-ueau/%' THEN 'Nudm_UEAuthentication'
    WHEN {p} LIKE '/nudm-uecm/%' THEN 'Nudm_UECM' WHEN {p} LIKE '/nudm-sdm/%' THEN 'Nudm_SDM'
    WHEN {p} LIKE '/nnssf-nsselection/%' THEN 'Nnssf_NSSelection'
    WHEN {p} LIKE '/nsmf-pdusession/%' THEN 'Nsmf_PDUSession'
    WHEN {p} LIKE '/nnrf-nfm/%' THEN 'Nnrf_NFM'
    WHEN {p} LIKE '/nnrf-disc/%' THEN 'Nnrf_NFDiscovery'
    WHEN {p} LIKE '/nausf-auth/%' THEN 'Nausf_UEAuthentication'
    WHEN split_part(ltrim({p}, '/'), '/', 1) = '' THEN 'unknown'
    ELSE array_to_string(list_transform(
      string_split_regex(split_part(ltrim({p}, '/'), '/', 1), '[-_]'),
      lambda x: upper(x[1:1]) || lower(x[2:])), '') END"""
SERVICE = _SVC.format(p="path")
PATH_SUPI = """CASE WHEN regexp_matches(path, 'imsi-\\d{14,15}')
      THEN regexp_extract(path, 'imsi-(\\d{14,15})', 1)
    WHEN regexp_matches(path, 'suci-0-\\d{3}-\\d{2,3}-\\d+-0-\\d+-[0-9a-fA-F]+')
      THEN regexp_replace(regexp_extract(path,
        'suci-0-(\\d{3}-\\d{2,3})-\\d+-0-\\d+-[0-9a-fA-F]+', 1), '-', '')
        || regexp_extract(path, 'suci-0-\\d{3}-\\d{2,3}-\\d+-0-\\d+-([0-9a-fA-F]+)', 1) END"""
block("sbireq", f"""SELECT *, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' ||
    greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS conn,
    CASE WHEN direction = 'request' AND note IS NULL THEN {SERVICE} END AS own_name,
    {PATH_SUPI} AS path_supi,
    nullif(regexp_extract(body, '"supi": "imsi-(\\d{{14,15}})"', 1), '') AS body_supi FROM sbib""")
block("sbilast", """SELECT run_id, conn, stream_id, max(msg_no) AS msg_no
    FROM sbireq WHERE direction = 'request' GROUP BY 1, 2, 3""")
block("sbimsg", """SELECT m.run_id, m.msg_no, m.ts, m.src_ip, m.dst_ip, m.src_port, m.dst_port,
    m.stream_id, m.direction, m.method, m.path, m.status, m.conn,
    CASE WHEN m.direction = 'request' THEN m.own_name WHEN m.note IS NULL THEN q.own_name END
      AS name,
    CASE WHEN m.direction = 'response' AND q.note IS NOT NULL
      THEN 'response to refused request: ' || q.note ELSE m.note END AS unparsed,
    CASE WHEN m.direction = 'request' AND m.note IS NULL AND (m.path_supi IS NULL OR
      m.body_supi IS NULL OR m.path_supi = m.body_supi)
      THEN coalesce(m.path_supi, m.body_supi) END AS supi,
    CASE WHEN m.direction = 'response' THEN json_extract_string(m.body, '$.title') END
      AS problem_title,
    CASE WHEN m.direction = 'response' THEN nullif(json_extract_string(m.body, '$.cause'), '') END
      AS problem_cause
    FROM sbireq m LEFT JOIN (SELECT s.* FROM sbireq s JOIN sbilast USING
      (run_id, conn, stream_id, msg_no)) q
    ON q.run_id = m.run_id AND q.conn = m.conn AND q.stream_id = m.stream_id""")
block("sbiproc", """SELECT q.run_id, q.conn, q.stream_id, coalesce(q.name, 'unknown') AS kind,
    q.ts AS start_ts, coalesce(r.ts, q.ts) AS end_ts,
    CASE WHEN q.method IS NOT NULL THEN q.method || ' ' || q.path ELSE q.path END AS start_msg,
    CASE WHEN r.msg_no IS NOT NULL THEN coalesce(CAST(r.status AS VARCHAR), 'None') END AS end_msg,
    CASE WHEN r.msg_no IS NULL THEN 'timeout' WHEN r.status >= 200 AND r.status < 300 THEN 'accept'
      ELSE 'reject' END AS outcome, r.status, q.msg_no AS req_no, r.msg_no AS rsp_no
    FROM (SELECT * FROM sbimsg WHERE direction = 'request' AND unparsed IS NULL
      QUALIFY row_number() OVER (PARTITION BY run_id, conn, stream_id ORDER BY msg_no DESC) = 1) q
    LEFT JOIN (SELECT * FROM sbimsg WHERE direction = 'response' AND unparsed IS NULL
      QUALIFY row_number() OVER (PARTITION BY run_id, conn, stream_id ORDER BY msg_no DESC) = 1) r
    ON q.run_id = r.run_id AND q.conn = r.conn AND q.stream_id = r.stream_id""")

block("supiclaim", "SELECT DISTINCT run_id, v_supi AS supi, flow_id FROM n2vis WHERE v_supi <> ''")
block("tunclaim", """SELECT DISTINCT run_id, teid, tip AS ip, flow_id FROM n2vis
    WHERE teid IS NOT NULL""")
block("supiowner", """SELECT run_id, supi, any_value(flow_id) AS flow_id FROM supiclaim
    GROUP BY 1, 2 HAVING count(DISTINCT flow_id) = 1""")
block("tunowner", """SELECT run_id, teid, ip, any_value(flow_id) AS flow_id FROM tunclaim
    GROUP BY 1, 2, 3 HAVING count(DISTINCT flow_id) = 1""")
block("sbireqlink", """SELECT m.run_id, m.msg_no, m.conn, m.stream_id, o.flow_id FROM sbimsg m
    JOIN supiowner o USING (run_id, supi) WHERE m.direction = 'request' AND m.unparsed IS NULL""")
block("sbilink", """SELECT run_id, msg_no, flow_id FROM sbireqlink UNION ALL
    SELECT m.run_id, m.msg_no, l.flow_id FROM sbimsg m JOIN (SELECT * FROM sbireqlink QUALIFY
      row_number() OVER (PARTITION BY run_id, conn, stream_id ORDER BY msg_no DESC) = 1) l
    USING (run_id, conn, stream_id) WHERE m.direction = 'response'""")
block("n4key", """SELECT run_id, msg_no, teid1 AS teid, tip1 AS ip FROM n4b
    WHERE teid1 IS NOT NULL AND unparsed IS NULL UNION ALL
    SELECT run_id, msg_no, teid2, tip2 FROM n4b WHERE teid2 IS NOT NULL AND unparsed IS NULL""")
block("n4link", """SELECT run_id, msg_no, any_value(flow_id) AS flow_id FROM n4key
    JOIN tunowner USING (run_id, teid, ip) GROUP BY 1, 2 HAVING count(DISTINCT flow_id) = 1""")
