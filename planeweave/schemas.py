"""Table schemas.  Every table carries `run_id`; `msg_no` is the capture position."""

SCTP_CHUNKS = """run_id string, pkt_no bigint, chunk_no int, ts double, src_ip string,
  dst_ip string, sport int, dport int, ppid int, tsn bigint, stream_id int, ending boolean,
  data binary"""

UDP_DATAGRAMS = """run_id string, pkt_no bigint, ts double, src_ip string, dst_ip string,
  sport int, dport int, payload binary"""

TCP_SEGMENTS = """run_id string, pkt_no bigint, ts double, src_ip string, dst_ip string,
  sport int, dport int, seq bigint, ip_len int, ihl int, dataofs int, payload binary"""

F_TEIDS = "array<struct<teid: bigint, ip: string>>"

NAS = """struct<name: string, protected: boolean, shdr: int, inner: string, cause: int,
  cause_name: string, ciph_algo: int, integ_algo: int, supi: string, guti: string,
  unparsed: string>"""

N2_MESSAGES = f"""run_id string, msg_no bigint, ts double, src_ip string, dst_ip string,
  sport int, dport int, stream_id int, ngap string, kind string, proc_code int,
  ran_ue_id bigint, amf_ue_id bigint, nas {NAS}, f_teids {F_TEIDS}, unparsed string"""

N4_MESSAGES = f"""run_id string, msg_no bigint, ts double, src_ip string, dst_ip string,
  src_port int, dst_port int, msg_type int, name string, seq bigint, seid decimal(20,0),
  cause string, cause_code int, f_teids {F_TEIDS}, ue_ip string, user_id string,
  unparsed string"""

SBI_MESSAGES = """run_id string, msg_no bigint, ts double, src_ip string, dst_ip string,
  src_port int, dst_port int, stream_id bigint, direction string, method string, path string,
  status int, body string, body_len bigint, name string, supi string, problem_title string,
  problem_cause string, unparsed string"""

_N2_EXPORT_MESSAGE = """struct<ts: double, src_ip: string, dst_ip: string, ngap: string,
  kind: string, nas: string, nas_protected: boolean, nas_inner: string,
  nas_cause: struct<code: int, name: string>, unparsed: string>"""

_N2_EXPORT_PROCEDURE = """struct<kind: string, start_ts: double, end_ts: double,
  start_msg: string, end_msg: string, outcome: string, duration_ms: double>"""

_N4_EXPORT = """struct<messages: array<struct<ts: double, src_ip: string, dst_ip: string,
  src_port: int, dst_port: int, name: string, seq: bigint, seid: decimal(20,0), cause: string,
  cause_code: int, user_id: string, ue_ip: string, unparsed: string, flow_id: bigint>>,
  procedures: array<struct<kind: string, start_ts: double, end_ts: double, start_msg: string,
  end_msg: string, outcome: string, cause: int, cause_name: string, duration_ms: double,
  flow_id: bigint>>, unpaired_requests: bigint>"""

_SBI_EXPORT = """struct<messages: array<struct<ts: double, src_ip: string, dst_ip: string,
  src_port: int, dst_port: int, stream_id: bigint, direction: string, method: string,
  path: string, status: int, body_len: bigint, service: string, name: string,
  problem_title: string, problem_cause: string, unparsed: string, flow_id: bigint>>,
  procedures: array<struct<kind: string, start_ts: double, end_ts: double, start_msg: string,
  end_msg: string, outcome: string, status: int, flow_id: bigint>>,
  unpaired_requests: bigint>"""

_KPIS = """struct<attach_time_ms: double, pdu_session_time_ms: double,
  procedure_success_rate: double, procedure_successes: bigint, procedure_failures: bigint,
  sbi_to_n4_ms: double, n4_to_n2_ms: double, sbi_to_n2_ms: double>"""

# The embedded plane sections stay text: a section that is no object is ignored.
N2_EXPORT = f"""kpis {_KPIS}, flows array<struct<flow_id: bigint, ran_ue_ngap_id: bigint,
  amf_ue_ngap_id: bigint, partial: boolean, messages: array<{_N2_EXPORT_MESSAGE}>,
  procedures: array<{_N2_EXPORT_PROCEDURE}>, sbi_refs: array<bigint>, n4_refs: array<bigint>>>,
  unassociated array<struct<ts: double, ngap: string, unparsed: string>>,
  n4 string, sbi string"""
N4_SECTION = _N4_EXPORT
SBI_SECTION = _SBI_EXPORT

CITED = "array<struct<message: string, cause: int, ts: double>>"

EPISODES = f"""incident_type string, narrative string, cited_evidence {CITED},
  created_at timestamp"""

SPEC_UNITS = "spec string, unit_no bigint, kind string, text string"

SPEC_CHUNKS = """chunk_id bigint, spec string, title string, token string, version string,
  clause string, heading string, breadcrumb array<string>, text string, chars int"""
