import random

import pytest
from build import n2, nas, rows
from pyspark.sql import functions as F

from planeweave.operators import flows, kpi, kpi_state

REG, ACC, REJ = "5GMMRegistrationRequest", "5GMMRegistrationAccept", "5GMMRegistrationReject"
PREQ, PACC = "5GSMPDUSessionEstabRequest", "5GSMPDUSessionEstabAccept"


def procs(df, split=None):
    return rows(flows.analyze(df, split)[2], "kind", "start_no", "end_no", "outcome")


def test_flow_key_is_unordered_ports_and_null_ran_is_its_own_key(spark):
    df = n2(spark, [
        {"ngap": "InitialUEMessage"}, {"sport": 38412, "dport": 40000},
        {"ran_ue_id": None}, {"ran_ue_id": 2, "ngap": "Paging"},
        {"ran_ue_id": None, "amf_ue_id": None}, {"sport": 40001}])
    assert rows(flows.assign_flows(df), "msg_no", "flow_id") == [
        (0, 1), (1, 1), (2, 2), (3, 3), (5, 4)]
    assert rows(flows.unassociated(df), "msg_no") == [(4,)]
    attrs = {r.flow_id: r for r in flows.flow_attributes(flows.assign_flows(df)).collect()}
    assert not attrs[1].partial and attrs[3].partial and attrs[1].messages == 2


def test_amf_id_is_the_first_that_is_set(spark):
    df = n2(spark, [{"amf_ue_id": None}, {"amf_ue_id": 7}, {"amf_ue_id": 8}])
    assert flows.flow_attributes(flows.assign_flows(df)).first().amf_ue_id == 7


def test_visibility_needs_an_earlier_security_mode_command(spark):
    sealed = nas("Sec", protected=True, shdr=2, inner=ACC, cause=9)
    smc = nas("Sec", protected=True, shdr=3, inner="5GMMSecurityModeCommand", ciph_algo=0)
    df = n2(spark, [
        {"nas": sealed}, {"nas": smc}, {"nas": sealed}, {"ran_ue_id": 2, "nas": nas(
            "Sec", protected=True, shdr=1, inner="X", ciph_algo=2)}, {"ran_ue_id": 2, "nas": sealed},
        {"nas": nas("Sec", protected=True, shdr=None)},
        {"nas": nas("Sec", protected=True, shdr=2, inner=None)}])
    got = {r.msg_no: r.nas for r in flows.visible_messages(df).collect()}
    assert got[0].name is None and got[0].cause is None and got[0].protected
    assert got[0].unparsed == flows.NOTE_UNKNOWN_CIPHER
    assert got[1].inner == "5GMMSecurityModeCommand" and got[1].unparsed is None
    assert got[2].inner == ACC and got[2].cause == 9
    assert got[4].unparsed == "security-protected (ciphering 5G-EA2 not supported)"
    assert got[5].unparsed == flows.NOTE_UNREADABLE and got[6].unparsed


def test_latest_nas_start_wins_and_orphan_ends_are_ignored(spark):
    df = n2(spark, [{"nas": nas(ACC)}, {"nas": nas(REG)}, {"nas": nas(REG)}, {"nas": nas(PREQ)},
                    {"nas": nas(ACC)}, {"nas": nas(REJ)}, {"nas": nas("5GMMULNASTransport",
                                                                      inner=PACC)}])
    assert procs(df) == [("pdu_session_est", 3, 6, "accept"), ("registration", 2, 4, "accept")]


def test_release_makes_a_stale_start_dead(spark):
    df = n2(spark, [{"ngap": "InitialUEMessage"}, {"ngap": "UEContextReleaseComplete"},
                    {"ngap": "InitialUEMessage"}, {"ngap": "InitialUEMessage"},
                    {"ngap": "InitialContextSetupRequest"}, {"ngap": "InitialContextSetupRequest"}])
    assert procs(df) == [("registration", 2, 4, "accept")]


def test_nas_end_on_the_carrier_message_suppresses_the_fallback(spark):
    df = n2(spark, [{"ngap": "InitialUEMessage", "nas": nas(REG)},
                    {"ngap": "InitialContextSetupRequest", "nas": nas(ACC)},
                    {"ngap": "InitialUEMessage"}, {"ngap": "InitialContextSetupFailure"}])
    assert procs(df) == [("registration", 0, 1, "accept")]


@pytest.mark.parametrize("split", [None, 4])
def test_pairs_of_random_flows_keep_the_rules(spark, split):
    rng = random.Random(3)
    starts, ends = flows.NAS_START, {k: (flows.NAS_ACCEPT[k], flows.NAS_REJECT[k]) for k in flows.NAS_START}
    names = [None, None, *starts.values(), *flows.NAS_ACCEPT.values(), *flows.NAS_REJECT.values()]
    made, by_flow = [], {}
    for no in range(600):
        ue, name = rng.choice([1, 1, 1, *range(2, 40)]), rng.choice(names)
        made.append({"ran_ue_id": ue, "ngap": None, "nas": nas(name) if name else None})
        by_flow.setdefault(ue, []).append((no, name))
    _, _, found = flows.analyze(n2(spark, made), split)
    order = {i + 1: ue for i, ue in enumerate(by_flow)}
    got = {}
    for flow, kind, start, end, outcome in rows(found, "flow_id", "kind", "start_no", "end_no", "outcome"):
        got.setdefault((order[flow], kind), []).append((start, end, outcome))
    for ue, messages in by_flow.items():
        for kind, first in starts.items():
            at = {no: name for no, name in messages if name == first or name in ends[kind]}
            pairs = sorted(got.get((ue, kind), []))
            # A pair is a start and the next message of its kind that ends one.
            for start, end, outcome in pairs:
                assert at[start] == first and outcome == ("accept" if at[end] == ends[kind][0] else "reject")
                assert not [no for no in at if start < no < end]
            # Every end right after a start is paired, once.
            line = sorted(at)
            assert [e for _, e, _ in pairs] == [b for a, b in zip(line, line[1:])
                                                if at[a] == first and at[b] != first]


def test_kpi_means_and_rate(spark):
    df = n2(spark, [
        {"ngap": "InitialUEMessage", "nas": nas(REG), "ts": 0.0}, {"nas": nas(ACC), "ts": 0.1},
        {"nas": nas(REG), "ts": 1.0}, {"nas": nas(REJ), "ts": 1.03},
        {"nas": nas(PREQ), "ts": 2.0}, {"nas": nas(PACC), "ts": 2.05},
        {"ran_ue_id": 2, "nas": nas(REG), "ts": 3.0}, {"ran_ue_id": 2, "nas": nas(ACC), "ts": 9.0}])
    _, table, found = flows.analyze(df)
    k = kpi.run_kpis(found, table).first()
    assert round(k.attach_time_ms, 6) == 65 and round(k.pdu_session_time_ms, 6) == 50
    assert k.attach_n == 2 and (k.procedure_successes, k.procedure_failures) == (3, 1)
    assert k.procedure_success_rate == 0.75


def test_kpis_of_a_run_without_procedures_are_null(spark):
    _, table, found = flows.analyze(n2(spark, [{"ngap": "Paging"}]))
    k = kpi.run_kpis(found, table).first()
    assert k.attach_time_ms is None and k.procedure_success_rate is None and k.attach_n == 0


def test_next_terminal_gap(spark):
    df = n2(spark, [{"nas": nas(REG), "ts": 0.0}, {"nas": nas(REG), "ts": 6.0},
                    {"nas": nas(REJ), "ts": 10.0}, {"nas": nas(REG), "ts": 11.0}])
    name = F.col("nas")["name"]
    for split in (None, 2):
        gaps = kpi.next_terminal_gap(df, ["run_id"], name == REG, name == REJ, split=split)
        assert rows(gaps, "msg_no", "gap_s") == [(0, 10.0), (1, 4.0), (3, None)]


def _signalled(rng, n, ues):
    names = [REG, ACC, REJ, PREQ, PACC, None]
    return [{"ts": k + rng.random() / 3, "ran_ue_id": rng.choice(ues), "nas": nas(rng.choice(names)), "msg_no": k,
             "ngap": rng.choice(["InitialUEMessage", "InitialContextSetupRequest", "UplinkNASTransport"])} for k in range(n)]


def _indicators(df):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r)
                   for r in df.select("run_id", "attach_time_ms", "attach_n", "pdu_session_time_ms", "pdu_session_n",
                                      "procedure_successes", "procedure_failures", "procedure_success_rate").collect()), key=repr)


def test_states_merge_in_any_order_and_take_late_messages(spark):
    rng = random.Random(12)
    made = _signalled(rng, 160, [1, 2, 3, 4, None]) + [{**m, "run_id": "s"} for m in _signalled(rng, 60, [1, 9])]
    whole = n2(spark, made)
    _, table, found = flows.analyze(whole)
    want = _indicators(kpi.run_kpis(found, table))
    late = whole.filter("run_id = 'r' AND ran_ue_id = 2 AND msg_no % 3 = 0 OR run_id = 's' AND ran_ue_id = 9 AND msg_no > 50")
    early = whole.join(late, ["run_id", "msg_no"], "left_anti")
    first = kpi_state.flow_states(*[flows.analyze(early)[k] for k in (1, 2)])
    assert _indicators(kpi_state.indicators(first)) != want
    again = kpi_state.recounted(whole, late, version=2)
    assert {(r.run_id, r.ran_key) for r in again.collect()} == {("r", 2), ("s", 9)}
    one, two = first.filter("ran_key % 2 = 0"), first.filter("ran_key % 2 <> 0")
    for states in ([first, again], [again, two, one], [two, again, again, one, two]):
        assert _indicators(kpi_state.indicators(kpi_state.merge(*states))) == want
    step = kpi_state.merge(kpi_state.merge(two, again), one)
    assert _indicators(kpi_state.indicators(step)) == want
