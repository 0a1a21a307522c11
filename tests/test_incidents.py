import random
from datetime import datetime, timedelta

import pytest
from build import n2, n4, nas, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from planeweave.functions.text import plain_number
from planeweave.operators import evaluate, evidence, flows, incidents, memory, report, topology
from planeweave.session import read_if_there
from planeweave.sources import documents
from planeweave.sources import episodes as store

EPISODE = """id bigint, incident_type string, narrative string,
  cited_evidence array<struct<message: string, cause: int, ts: double>>, created_at timestamp"""
T0 = datetime(2024, 1, 1)


def cases(spark, *messages):
    return incidents.flow_cases(*flows.analyze(n2(spark, list(messages))))


def test_golden_flow_is_no_incident(spark):
    assert cases(spark, {"ngap": "InitialUEMessage", "nas": nas("5GMMRegistrationRequest")},
                 {"nas": nas("5GMMRegistrationAccept")}).count() == 0


def test_cause_on_an_accepted_flow_is_an_explicit_reject(spark):
    case = cases(
        spark, {"ngap": "InitialUEMessage", "nas": nas("5GMMRegistrationRequest")},
        {"nas": nas("5GMMRegistrationAccept")}, {"nas": nas("5GSMPDUSessionEstabRequest")},
        {"nas": nas("5GMMStatus", cause=91)}, {"nas": nas("5GMMStatus", cause=7)}).first()
    assert (case.procedure, case.shape, case.detail) == (
        "PDU Session", "explicit reject", "cause code(s) observed: #7, #91")


def test_echoed_request_is_a_timeout_and_codes_may_be_empty(spark):
    made = [{"ngap": "InitialUEMessage"}] + [
        {"nas": nas("T", inner="5GSMPDUSessionEstabRequest", cause=90), "ts": 10.0 * i}
        for i in (1, 2)]
    found = incidents.classify_flows(cases(spark, *made)).first()
    assert (found.shape, found.incident_type) == (incidents.TIMEOUT_SHAPE, "pdu_session_timeout")
    zero = cases(spark, {"ngap": "InitialUEMessage", "nas": nas("X", cause=0)}).first()
    assert zero.detail == "cause code(s) observed: "


def test_lone_request_is_a_registration_timeout(spark):
    found = incidents.classify_flows(cases(
        spark, {"ngap": "InitialUEMessage", "nas": nas("5GMMRegistrationRequest")})).first()
    assert (found.procedure, found.incident_type) == ("Registration", "registration_timeout")


def test_maintenance_procedures_are_no_incident(spark):
    from planeweave.operators import pfcp

    procs = pfcp.pair_procedures(n4(spark, [{"msg_type": 1}, {"msg_type": 5, "seq": 2},
                                            {"msg_type": 50, "seq": 3}]))
    found = incidents.classify_planes(incidents.n4_incidents(procs))
    assert rows(found, "procedure", "incident_type") == [
        ("session_establishment", "n4_upf_timeout")]


def test_association_request_beats_an_earlier_session_request(spark):
    df = n4(spark, [{"src_ip": "x", "dst_ip": "y"}, {
        "msg_type": 5, "name": "PFCP Association Setup Request", "src_ip": "smf", "dst_ip": "upf"}])
    assert rows(topology.n4_roles(df, df), "role", "ip") == [("SMF", "smf"), ("UPF", "upf")]
    beats = n4(spark, [{"msg_type": 1}])
    assert {r.evidence for r in topology.n4_roles(beats, beats).collect()} == {topology.NO_PROOF}
    quiet = n2(spark, [{"ngap": "Paging"}])
    assert {r.ip for r in topology.n2_roles(flows.assign_flows(quiet)).collect()} == {"unknown"}
    assert {r.evidence for r in topology.n4_roles(quiet, n4(spark, [])).collect()} == {
        topology.NO_N4}


def test_tolerance_is_strict_and_cause_must_match(spark):
    names = evidence.located_names(flows.visible_messages(n2(spark, [
        {"ngap": "A", "ts": 1001.500876, "nas": nas("B", inner="C", cause=5)}])))
    cites = spark.createDataFrame(
        [(0, "r", "A", None, 1001.501), (1, "r", "C", 5, 1001.5004), (2, "r", "B", 6, 1001.500876),
         (3, "r", "A", None, 1001.5014), (4, "r", "A", None, None), (5, "q", "A", None, 1001.501)],
        "cite_id int, run_id string, message string, cause int, ts double")
    got = evidence.ground(cites, evidence.inventory(names))
    assert rows(got, "cite_id", "grounded") == [
        (0, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    hit = {r.cite_id: r.plane for r in evidence.locate(cites, names).collect()}
    assert hit[2] == "n2" and hit[3] is None


def _episodes(spark, made):
    return spark.createDataFrame(made, EPISODE)


def test_consolidation_key_ignores_cause_order_and_narrative(spark):
    a = [("A", 1, 1.0), ("B", None, None)]
    held = _episodes(spark, [(1, "auth_failure", "x", a, T0)])
    batch = _episodes(spark, [
        (2, "auth_failure", "other words", [("B", 9, None), ("A", 2, 1.0), ("A", 3, 1.0)], T0),
        (3, "registration_reject", "x", a, T0), (4, "registration_reject", "y", a, T0),
        (5, "auth_failure", "x", [("A", 1, 1.0000001)], T0),
        (6, "nonsense", "x", a, T0), (7, "auth_failure", "", a, T0), (8, "auth_failure", "x", [], T0)])
    assert rows(memory.consolidate(batch, held, "id"), "id") == [(3,), (5,)]


def test_lookup_needs_message_and_cause_on_one_item(spark):
    df = _episodes(spark, [
        (i, "auth_failure", "n", [("A", 1, None), ("B", 2, None)], T0 + timedelta(days=i))
        for i in range(7)])
    assert memory.lookup(df, message="A", cause=2).count() == 0
    top = memory.lookup(df, message="A", cause=1).collect()
    assert [r.id for r in top] == [6, 5, 4, 3, 2] and {(r.matches, r.not_shown) for r in top} == {
        (7, 2)}


def test_similar_episodes_equal_brute_force(spark):
    rng = random.Random(2)
    names, kinds = list("ABCDE"), incidents.INCIDENT_TYPES
    made = [(i, rng.choice(kinds), "n", [
        (rng.choice(names), rng.choice([None, 0, 1, 2]), None) for _ in range(rng.randint(1, 3))],
        T0 + timedelta(days=rng.randint(0, 5))) for i in range(80)]
    profiles = [(j, rng.choice(["Registration", "PDU Session", "unknown"]),
                 rng.sample(names, rng.randint(0, 4)), rng.sample([0, 1, 2, 3], rng.randint(0, 3)))
                for j in range(25)]
    df = spark.createDataFrame(
        profiles, "inc int, procedure string, names array<string>, causes array<int>")
    about = {r.t: r.p for r in spark.createDataFrame([(k,) for k in kinds], "t string").select(
        "t", memory.procedure_of(F.col("t")).alias("p")).collect()}
    want = []
    for j, procedure, own, codes in profiles:
        scored = []
        for i, kind, _, cited, at in made:
            score = (3 * len({c for _, c, _ in cited if c} & {c for c in codes if c})
                     + len({m for m, _, _ in cited} & set(own)) + 2 * (about[kind] == procedure))
            if score >= 2:
                scored.append((-score, -at.toordinal(), i))
        want += [(j, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored)[:3])]
    got = memory.similar(df, _episodes(spark, made), "inc", "id")
    assert rows(got, "inc", "rank", "id", "score") == sorted(want, key=repr)


def test_store_keeps_line_separators_and_skips_corrupt_lines(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0
    one = _episodes(spark, [(1, "auth_failure", "a b", [("A", None, 1.5)], T0)]).drop("id")
    store.append(one, path)
    (tmp_path / "store" / "extra.json").write_text('\n{"incident_type": "auth\n[]\n{}\n')
    back = store.read_store(spark, path).collect()
    assert [(r.narrative, r.cited_evidence[0].ts, r.created_at) for r in back] == [
        ("a b", 1.5, T0)]
    again = store.remember(one.withColumn("n", F.lit(1)), path, "n")
    assert again.count() == 0 and store.read_store(spark, path).count() == 1


def test_evaluation_means(spark):
    entries = spark.createDataFrame(
        [(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 1, "y"), (4, "b", None, "y")],
        "entry_id int, fixture string, run int, label string")
    raw = spark.createDataFrame(
        [(1, "x", "1", "1", "1", "1"), (1, "z", "0", "2", "n/a", None),
         (3, "z", "NaN", "0.5", "-3", "inf")],
        "entry_id int, incident_type string, accuracy string, specificity string, "
        "evidence string, causality string")
    hyps = raw.select("entry_id", "incident_type", *[
        evaluate.clean_score(F.col(d)).alias(d) for d in evaluate.DIMENSIONS])
    scores = evaluate.run_scores(entries, hyps)
    m = evaluate.macro_scores(scores).first()
    assert (m.type_accuracy, m.runs, m.completed_runs, m.judged_hypotheses) == (0.25, 4, 2, 3)
    # a: runs (1 + .25) / 2 and 0; b: (0 + .5 + 0 + 1) / 4 and 0
    assert abs(m.diagnosis_quality - (0.625 / 2 + 0.375 / 2) / 2) < 1e-12 and m.target == 0.5
    assert rows(evaluate.still_to_run(spark.createDataFrame(
        [("b", 1), ("b", 2)], "fixture string, run int"), entries), "fixture", "run") == [("b", 2)]


def test_single_report_text(spark):
    visible, table, procs = flows.analyze(n2(spark, [
        {"ngap": "InitialUEMessage", "nas": nas("5GMMRegistrationRequest"), "ts": 1.0},
        {"ngap": "DownlinkNASTransport", "src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "ts": 1.5,
         "nas": nas("5GMMRegistrationReject", cause=7, cause_name="no services")}]))
    results = spark.createDataFrame(
        [("r", 1, "n2", 1, "Registration", "explicit reject", "cause code(s) observed: #7",
          "registration_reject", "The network refused.",
          [("5GMMRegistrationReject", 7, 1.5), ("Paging", None, None)], 0.9, 3,
          [["inspect flow:1", "Flow 1\nmore"], ["finalize"]], True)],
        """run_id string, incident_no bigint, plane string, flow_id bigint, procedure string,
        shape string, detail string, incident_type string, narrative string,
        cited_evidence array<struct<message: string, cause: int, ts: double>>, reward double,
        rollouts int, trajectory array<array<string>>, memory_wrote boolean""")
    cites = results.select("run_id", "incident_no", F.posexplode("cited_evidence").alias(
        "line_no", "e")).select("run_id", "incident_no", "line_no", F.col("line_no").alias(
            "cite_id"), "e.*")
    names = evidence.located_names(visible)
    shown = evidence.locate(evidence.ground(cites, evidence.inventory(names)), names).select(
        "run_id", "incident_no", "line_no", report.evidence_line(F.col("grounded")).alias("text"))
    timeline = report.flow_timeline(evidence.numbered(visible, ["run_id", "flow_id"]), table)
    kpis = spark.createDataFrame([("r", None, 0, 1)], "run_id string, attach_time_ms double, "
                                 "procedure_successes bigint, procedure_failures bigint")
    lines = report.assemble(results, shown, timeline, kpis).orderBy(
        "incident_no", "section", "line_no")
    text = "\n".join(r.text for r in lines.collect()).rstrip("\n") + "\n"
    assert text == """# Post-incident report — registration_reject

**Flow:** 1 — Registration, explicit reject
**Incident detail:** cause code(s) observed: #7
**Hypothesis:** registration_reject (reward 0.9, 3 rollouts)

## Root cause
The network refused.

## Evidence
- [verified] 5GMMRegistrationReject over N2 from AMF (10.0.0.2) to gNB (10.0.0.1) @ 1.500s — cause #7
- [unverified] Paging

## Timeline (flow 1)
[1] 1.000s  5GMMRegistrationRequest over N2 from gNB (10.0.0.1) to AMF (10.0.0.2)
[2] 1.500s  5GMMRegistrationReject over N2 from AMF (10.0.0.2) to gNB (10.0.0.1)  cause #7 (no services)

## Capture KPIs
attach_time_ms: None | procedure_successes: 0 | procedure_failures: 1

## Search path
[1] inspect flow:1 -> Flow 1
[2] finalize

## Memory
new Episode written (registration_reject)
"""


RESULT = """run_id string, incident_no bigint, plane string, flow_id bigint, procedure string,
  shape string, detail string, incident_type string, narrative string,
  cited_evidence array<struct<message: string, cause: int, ts: double>>, reward double,
  rollouts int, trajectory array<array<string>>, memory_wrote boolean"""


def _result(run, no, plane, flow, kind, procedure):
    return (run, no, plane, flow, procedure, "no terminal message (timeout)", None, kind, kind and f"{procedure} failed.",
            [("seen", None, None)] if kind else None, 0.5, 2, [], False)


def _reported(spark, repeat):
    """Documents of a run with one SBI incident, one with one N4 incident, one with several, one without messages of the
    plane, and one without incidents."""
    results = spark.createDataFrame([
        _result("s", 1, "sbi", 3, "sbi_udm_timeout", "Nudm_SDM"), _result("n", 1, "n4", None, "n4_upf_timeout", "session_establishment"),
        _result("m", 1, "n2", 1, None, "Registration"), _result("m", 2, "n4", 2, "n4_upf_timeout", "session_establishment"),
        _result("m", 3, "sbi", None, "sbi_udm_timeout", "Nausf_UEAuthentication"), _result("m", 4, "sbi", 1, "sbi_nssf_reject", "Nnssf_NSSelection"),
        _result("q", 1, "sbi", 1, "sbi_udm_timeout", "Nudm_SDM")], RESULT)
    planes = [(run, plane, i, f"[{i}] {plane} of {run}") for run, plane in (("s", "sbi"), ("n", "n4"), ("m", "n4"), ("m", "sbi"))
              for i in (1, 2)]
    plane_lines = spark.createDataFrame(planes, "run_id string, plane string, line_no bigint, text string")
    flow_lines = spark.createDataFrame([("m", 1, 1, "[1] flow 1")], "run_id string, flow_id bigint, line_no bigint, text string")
    kpis = spark.createDataFrame([("m", 12_345_678.5, 0.5, 3, 3), ("s", None, None, 0, 0)], "run_id string, attach_time_ms double, "
                                 "procedure_success_rate double, procedure_successes bigint, procedure_failures bigint")
    cited = results.filter("incident_type IS NOT NULL").select(
        "run_id", "incident_no", F.lit(0).cast("long").alias("line_no"), F.lit("- [unverified] seen").alias("text"))
    lines = report.assemble(results, cited, flow_lines, kpis, plane_lines=plane_lines, repeat_planes=repeat)
    runs = spark.createDataFrame([("s",), ("e",), ("e",)], "run_id string")
    return lines.unionByName(report.no_incident_lines(runs, results))


def _incident(marks, root, title, timeline, kind, kpis):
    return [f"{marks} Root cause", root, "", f"{marks} Evidence", "- [unverified] seen" if kind else "(none cited)", "", f"{marks} Timeline ({title})", *timeline, "",
            f"{marks} Capture KPIs", kpis, "", f"{marks} Search path", "(no trajectory — the search exhausted its rollouts)", "",
            f"{marks} Memory", f"Episode already recorded ({kind}) — not rewritten" if kind else "no Episode written (no hypothesis)", ""]


@pytest.mark.parametrize("repeat", [True, False])
def test_report_documents_of_all_planes(spark, tmp_path, repeat):
    lines = _reported(spark, repeat).repartition(5)
    documents.write_documents(lines, str(tmp_path / "reports"))
    got = {r.run_id: r.document for r in documents.read_documents(spark, str(tmp_path / "reports")).collect()}
    assert set(got) == {"s", "n", "m", "q", "e"}
    assert got["e"] == "# Post-incident report — no incidents\n\nNo failed Incidents to report.\n"

    def single(run, plane, label, kind, procedure, timeline, kpis):
        top = [f"# Post-incident report — {kind}", "", f"**Flow:** {label}, no terminal message (timeout)",
               f"**Hypothesis:** {kind} (reward 0.5, 2 rollouts)", ""]
        assert got[run] == "\n".join(top + _incident("##", f"{procedure} failed.", plane.upper(), timeline, kind, kpis)).rstrip() + "\n"

    silent = "(no KPIs in this capture)"
    single("s", "sbi", "SBI — Nudm_SDM (flow 3)", "sbi_udm_timeout", "Nudm_SDM", ["[1] sbi of s", "[2] sbi of s"],
           "attach_time_ms: None | procedure_success_rate: None | procedure_successes: 0 | procedure_failures: 0")
    single("n", "n4", "N4 — session_establishment", "n4_upf_timeout", "session_establishment", ["[1] n4 of n", "[2] n4 of n"], silent)
    single("q", "sbi", "SBI — Nudm_SDM (flow 1)", "sbi_udm_timeout", "Nudm_SDM", ["(no SBI messages in this capture)"], silent)

    kpis = "attach_time_ms: 12345678.5 | procedure_success_rate: 0.5 | procedure_successes: 3 | procedure_failures: 3"
    whole = {p: [f"[1] {p} of m", f"[2] {p} of m"] for p in ("n4", "sbi")}
    told = {p: whole[p] if repeat else [f"(see Timeline ({p.upper()}) after the last incident)"] for p in whole}
    want = ["# Post-incident report — 4 incidents", "", "| # | flow | hypothesis | reward | rollouts |",
            "|---|------|------------|--------|----------|", "| 1 | 1 | — | 0.5 | 2 |",
            "| 2 | N4 — session_establishment (flow 2) | n4_upf_timeout | 0.5 | 2 |",
            "| 3 | SBI — Nausf_UEAuthentication | sbi_udm_timeout | 0.5 | 2 |",
            "| 4 | SBI — Nnssf_NSSelection (flow 1) | sbi_nssf_reject | 0.5 | 2 |", "",
            "## Incident 1 — no hypothesis — flow 1", "",
            *_incident("###", "No hypothesis: the LATS search completed no finalize.", "flow 1", ["[1] flow 1"], None, kpis),
            "## Incident 2 — n4_upf_timeout — N4 — session_establishment (flow 2)", "",
            *_incident("###", "session_establishment failed.", "N4", told["n4"], "n4_upf_timeout", kpis),
            "## Incident 3 — sbi_udm_timeout — SBI — Nausf_UEAuthentication", "",
            *_incident("###", "Nausf_UEAuthentication failed.", "SBI", told["sbi"], "sbi_udm_timeout", kpis),
            "## Incident 4 — sbi_nssf_reject — SBI — Nnssf_NSSelection (flow 1)", "",
            *_incident("###", "Nnssf_NSSelection failed.", "SBI", told["sbi"], "sbi_nssf_reject", kpis)]
    if not repeat:
        want += [x for p in ("n4", "sbi") for x in (f"## Timeline ({p.upper()})", "", *whole[p], "")]
    assert got["m"] == "\n".join(want).rstrip() + "\n"


def test_numbers_as_plain_text(spark):
    made = [0.0, 0.5, -12.25, 1e7, 123456789.125, 1e12, 0.0001, -0.00025, None]
    df = spark.createDataFrame([(v,) for v in made], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == [
        "0.0", "0.5", "-12.25", "10000000.0", "123456789.125", "1000000000000.0", "0.0001", "-0.00025", None]


def test_label_files(spark, tmp_path):
    for name, body in (("one.label.json", '{"incident_type": "auth_failure", "scenario": "first",\n "more": 1}'),
                       ("two.label.json", '{"incident_type": "registration_reject"}')):
        (tmp_path / name).write_text(body)
    labels = store.read_labels(spark, str(tmp_path))
    assert rows(labels, "scenario", "incident_type") == [("first", "auth_failure"), ("two", "registration_reject")]
    entries = spark.createDataFrame([("first", 1), ("two", 2), ("other", 3)], "fixture string, run int")
    assert rows(evaluate.with_label(entries, labels), "fixture", "run", "label") == [
        ("first", 1, "auth_failure"), ("two", 2, "registration_reject")]


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path / "none")).count() == 0
    assert read_if_there(lambda: spark.read.parquet(str(tmp_path / "none"))) is None
    (tmp_path / "broken").mkdir()
    with pytest.raises(AnalysisException):
        read_if_there(lambda: spark.read.parquet(str(tmp_path / "broken")))
