import ipaddress
import random

import pytest
from build import n2, n4, nas, rows, sbi
from pyspark.sql import functions as F

from planeweave.functions import codes, http
from planeweave.operators import correlate, flows, kpi, pfcp
from planeweave.operators import sbi as plane
from planeweave.sources import exports

RSP = {"src_ip": "u", "dst_ip": "s", "msg_type": 51}


def test_retransmit_burst_is_one_timeout_from_the_first_send(spark):
    df = n4(spark, [{"ts": 0.0}, {"ts": 2.5}, {"ts": 5.0}, {"ts": 7.5}])
    for split in (None, 2):
        p = pfcp.pair_procedures(df, split).collect()
        assert [(x.outcome, x.start_ts, x.end_ts, x.end_msg, x.sends) for x in p] == [
            ("timeout", 0.0, 0.0, None, 4)]
    flagged = pfcp.flag_retransmits(df)
    assert rows(flagged, "msg_no", "retransmit") == [(0, False), (1, True), (2, True), (3, True)]


def test_kind_comes_from_the_response_and_orphans_give_nothing(spark):
    df = n4(spark, [{**RSP, "seq": 9}, {"msg_type": 1}, {**RSP, "cause_code": 64},
                    {"seq": 2}, {**RSP, "seq": 2, "cause_code": 2}, {"seq": 2},
                    {"seq": 3, "unparsed": "x"}, {**RSP, "seq": 3}])
    assert rows(pfcp.pair_procedures(df), "kind", "start_msg", "outcome") == [
        ("session_establishment", "PFCP Heartbeat Request", "reject"),
        ("session_establishment", "PFCP Session Establishment Request", "accept"),
        ("session_establishment", "PFCP Session Establishment Request", "timeout")]


def test_retransmit_flag_ignores_ports_and_type(spark):
    df = n4(spark, [{"src_port": 1}, {"src_port": 2, "msg_type": 2}, {"seq": None}, {"seq": None}])
    assert [r.retransmit for r in pfcp.flag_retransmits(df).orderBy("msg_no").collect()] == [
        False, True, False, True]


@pytest.mark.parametrize("split", [None, 5])
def test_pfcp_pairs_keep_the_rules(spark, split):
    rng = random.Random(11)
    made = []
    for _ in range(400):
        src, dst = ("u", "s") if rng.random() < .4 else ("s", "u")
        made.append({"src_ip": src, "dst_ip": dst, "seq": rng.choice([1, 1, 1, 2, 3]),
                     "msg_type": 50 if rng.random() < .6 else 51})

    def talk(no):
        m = made[no]
        ends = (m["src_ip"], m["dst_ip"])
        return (*(ends if m["msg_type"] == 50 else ends[::-1]), m["seq"])

    found = pfcp.pair_procedures(n4(spark, made), split)
    pairs = rows(found, "req_no", "rsp_no")
    for key in {talk(no) for no in range(len(made))}:
        asked = [no for no in range(len(made)) if talk(no) == key and made[no]["msg_type"] == 50]
        answers = [no for no in range(len(made)) if talk(no) == key and made[no]["msg_type"] == 51]
        own = sorted(((q, a) for q, a in pairs if talk(q) == key), key=lambda p: p[0])
        # Between two answers the first request counts, and the next answer is its own.
        cuts = [-1, *answers, len(made)]
        first = [min((q for q in asked if low < q < high), default=None) for low, high in zip(cuts, cuts[1:])]
        assert own == [(q, high if high < len(made) else None)
                       for q, high in zip(first, cuts[1:]) if q is not None]


def _many_ranges(spark, make):
    """Few rows would be joined to one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return make()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_procedures_of_one_time_are_numbered_in_answer_order(spark):
    rng = random.Random(5)
    made = [("r", 7.5 if k % 3 else float(k), k, None if rng.random() < .3 else 1_000 + rng.randrange(999)) for k in range(300)]
    procs = spark.createDataFrame(made, "run_id string, start_ts double, req_no bigint, rsp_no bigint").repartition(3)
    want = sorted(made, key=lambda r: (r[1], r[3] is None, r[2] if r[3] is None else r[3]))
    got = _many_ranges(spark, lambda: pfcp.in_order(procs).orderBy("proc_no").collect())
    assert [r.proc_no for r in got] == list(range(1, 301))
    place = lambda ts, ask, answer: (ts, answer is None, ask if answer is None else answer)
    assert [place(r.start_ts, r.req_no, r.rsp_no) for r in got] == [place(*r[1:]) for r in want]


def test_messages_of_one_time_keep_connection_and_place(spark):
    made = [("r", 5.0, c, side, seq) for c in (3, 1, 2) for side in (1, 0) for seq in range(40)] + [("r", 1.0, 9, 0, 0)]
    frames = spark.createDataFrame(made, "run_id string, ts double, conn_first_no bigint, dir_rank int, seq_no bigint")
    got = _many_ranges(spark, lambda: plane.in_capture_order(frames.repartition(3)).orderBy("msg_no").collect())
    assert [tuple(r)[:5] for r in got] == sorted(made) and [r.msg_no for r in got] == list(range(len(made)))


def test_refs_of_a_flow_in_parts(spark):
    made = [("r", k % 2 + 1, k) for k in range(90)]
    links = spark.createDataFrame(made, "run_id string, flow_id bigint, msg_no bigint")
    for split in (None, 7):
        got = correlate.flow_refs(links, 20, split).collect()
        for flow in (1, 2):
            parts = [r.refs for r in sorted(got, key=lambda r: r.part) if r.flow_id == flow]
            assert [len(p) for p in parts] == [20, 20, 5]
            assert sum(parts, []) == [no for _, f, no in made if f == flow]


def test_service_names(spark):
    paths = ["/nudm-ueau/v1/x", "/npcf-am_policy-CONTROL/v1", "", "/", "nnrf-nfm/x", "/nnrf-nfm/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(http.service_name(F.col("p"))).collect()] == [
        "Nudm_UEAuthentication", "NpcfAmPolicyControl", "unknown", "unknown", "NnrfNfm",
        "Nnrf_NFM"]


def test_identities(spark):
    crlf = "\r\n"
    part = f"--b{crlf}Content-Type: application/json{crlf}{crlf}" '{"supi": "imsi-999700000000002"}'
    cases = [("/x/imsi-9997000000000021234/y", None), ("/suci-0-999-70-0-0-0-0000000002", None),
             ("/suci-0-999-70-0-1-0-00", None), (None, part + f"{crlf}--b--"), (None, part),
             (None, '{"supi": 999700000000002}'), (None, '{"supi": "imsi-12"}'), (None, "[1]"),
             ("/imsi-999700000000003", '{"supi": "imsi-999700000000002"}')]
    df = spark.createDataFrame(cases, "path string, body string")
    got = [r[0] for r in df.select(http.agreed_identity(
        http.supi_from_path(F.coalesce("path", F.lit(""))),
        http.supi_from_body(F.col("body")))).collect()]
    assert got == ["999700000000002", "999700000000002", None, "999700000000002", None, None,
                   None, None, None]


def test_problem_details(spark):
    bodies = ['{"title": "T", "cause": ""}', '{"title": 0, "cause": 404}', "x", '["title"]',
              '{"title": null, "cause": true}']
    df = spark.createDataFrame([(x,) for x in bodies], "b string")
    got = [tuple(r) for r in df.select(http.problem_field(F.col("b"), "title"),
                                       http.problem_field(F.col("b"), "cause")).collect()]
    assert got == [("T", None), (None, "404"), (None, None), (None, None), (None, "True")]


def test_sbi_pairing_last_wins_and_any_status_but_2xx_is_a_reject(spark):
    back = {"direction": "response", "src_ip": "b", "dst_ip": "a", "src_port": 7777, "dst_port": 1}
    raw = sbi(spark, [
        {"method": "GET", "path": "/nudm-sdm/1"}, {"method": "GET", "path": "/nudm-sdm/2"},
        {**back, "status": 200}, {**back, "status": 302},
        {"src_port": 2, "path": "/x"}, {"stream_id": 3, "path": "/y", "note": "stream reset"},
        {**back, "stream_id": 3, "status": 200}, {**back, "stream_id": 5, "status": 200}])
    named = plane.name_messages(raw)
    assert rows(plane.pair_procedures(named), "kind", "start_msg", "end_msg", "outcome") == [
        ("Nudm_SDM", "GET /nudm-sdm/2", "302", "reject"), ("X", "/x", None, "timeout")]
    note = {r.msg_no: (r.name, r.unparsed) for r in named.collect()}
    assert note[6] == (None, "response to refused request: stream reset") and note[7] == (None, None)


def _linked(spark, supis, teids=()):
    made = [{"ran_ue_id": ue, "ngap": "InitialUEMessage",
             "nas": nas("5GMMRegistrationRequest", supi=s)} for ue, s in supis]
    made += [{"ran_ue_id": ue, "ngap": "PDUSessionResourceSetupResponse", "f_teids": [t],
              "ts": ts} for ue, t, ts in teids]
    return flows.visible_messages(n2(spark, made))


def test_ambiguous_identity_links_nothing(spark):
    back = {"direction": "response", "src_ip": "b", "dst_ip": "a", "src_port": 7777, "dst_port": 1,
            "status": 200}
    raw = sbi(spark, [{"path": "/imsi-999700000000001"}, back,
                      {"path": "/imsi-999700000000002", "stream_id": 3}, {**back, "stream_id": 3},
                      {**back, "stream_id": 3, "note": "stream reset"}])
    visible = _linked(spark, [(1, "999700000000001"), (2, "999700000000001"),
                              (3, "999700000000002")])
    linked = correlate.sbi_with_flow(plane.name_messages(raw), visible)
    assert rows(correlate.links(linked), "msg_no", "flow_id") == [(2, 3), (3, 3), (4, 3)]


def test_message_whose_keys_span_flows_links_none(spark):
    visible = _linked(spark, [], [(1, (1, "x"), 0.0), (2, (2, "x"), 0.0), (2, (9, "x"), 0.0),
                                  (1, (9, "x"), 0.0)])
    df = n4(spark, [{"f_teids": [(1, "x")]}, {"f_teids": [(1, "x"), (2, "x")]},
                    {"f_teids": [(9, "x"), (2, "x")]}, {"f_teids": [(1, "x")], "unparsed": "n"}])
    assert rows(correlate.link_n4(df, visible), "msg_no", "flow_id") == [(0, 1), (2, 2)]


@pytest.mark.parametrize("creates,want", [(1, (40.0, 20.0, 60.0)), (2, (None, 20.0, None))])
def test_cross_plane_latency(spark, creates, want):
    visible = _linked(spark, [(1, "999700000000001")], [(1, (1, "x"), 0.1)])
    post = {"method": "POST", "path": kpi.SBI_LEG_PATH, "dst_ip": "smf", "ts": 0.02,
            "body": '{"supi": "imsi-999700000000001"}'}
    raw = sbi(spark, [{**post, "stream_id": 2 * i + 1} for i in range(creates)]
              + [{**post, "stream_id": 9, "dst_ip": "other"}])
    est = n4(spark, [{"msg_type": 51, "src_ip": "u", "dst_ip": "smf", "ts": 0.06,
                      "f_teids": [(1, "x")]}])
    # The three legs at 20, 60 and 80 ms.
    visible = visible.withColumn("ts", F.when(F.col("ts") == 0.1, 0.08).otherwise(F.col("ts")))
    k = kpi.cross_plane_kpis(
        visible, correlate.sbi_with_flow(plane.name_messages(raw), visible),
        correlate.n4_with_flow(est, visible)).first()
    got = (k.sbi_to_n4_ms, k.n4_to_n2_ms, k.sbi_to_n2_ms)
    assert tuple(None if v is None else round(v, 6) for v in got) == want


def test_ip_text_equals_the_standard_form(spark):
    rng = random.Random(5)
    raws = [bytes(4), b"\x0a\x35\x00\x14", bytes(16), bytes(15) + b"\x01", b"", b"\x01" * 5,
            bytes(12) + b"\x01\x02\x03\x04", bytes(10) + b"\xff\xff\x01\x02\x03\x04"]
    for _ in range(300):
        raws.append(b"".join(rng.choice([b"\0\0", b"\0\0", rng.randbytes(2), b"\0\x05"])
                             for _ in range(8)))
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, raw binary")
    got = {r.i: r.ip for r in df.select("i", codes.ip_text(F.col("raw")).alias("ip")).collect()}
    import socket
    for i, raw in enumerate(raws):
        want = (str(ipaddress.IPv4Address(raw)) if len(raw) == 4 else
                socket.inet_ntop(socket.AF_INET6, raw) if len(raw) == 16 else None)
        assert got[i] == want, raw.hex()


def test_bcd_digits(spark):
    df = spark.createDataFrame([(bytearray(b"\x99\xf9\x07"),), (bytearray(b"\x00\x20"),),
                                (bytearray(b"\x1b"),)], "raw binary")
    assert [r[0] for r in df.select(codes.bcd_digits(F.col("raw"))).collect()] == [
        "99970", "0002", None]


def test_references_go_by_the_flows_own_list(spark):
    links = spark.createDataFrame([("r", 1, 5), ("r", 1, 250001), ("r", 1, 990000)],
                                  "run_id string, flow_id bigint, msg_no bigint")
    refs = correlate.flow_refs(links)
    assert rows(refs, "part", "refs") == [(0, [5, 250001, 990000])]
    documents = spark.createDataFrame([("r", 1, 0, 7, [1])], "run_id string, flow_id bigint, "
                                      "part bigint, ran_ue_ngap_id bigint, messages array<bigint>")
    merged = exports.merged_documents(documents, correlate.flow_refs(links, 2))
    assert rows(merged, "part", "ran_ue_ngap_id", "sbi_refs") == [(0, 7, [5, 250001]), (1, 7, [990000])]
