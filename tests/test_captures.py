import json
import random

import pytest

from planeweave import schemas
from planeweave.sources import captures, exports


def pieces(text, size):
    return list(captures.JsonParts(iter([text[k:k + size] for k in range(0, len(text), size)])))


def made(rng, flows):
    def message(k):
        return {"ts": k + 0.125, "src_ip": "10.0.0.1", "ngap": rng.choice(["InitialUEMessage", 'a "quoted" ] } name', "é\n"]),
                "nas_cause": rng.choice([None, {"code": 7, "name": "no, [services]"}]), "unparsed": None}

    return {"kpis": {"attach_time_ms": 1.5, "procedure_successes": 2},
            "flows": [{"messages": [message(k) for k in range(rng.randint(0, 6))], "flow_id": f + 1, "partial": f % 2 == 0,
                       "ran_ue_ngap_id": 2 ** 40 + f, "procedures": [{"kind": "registration", "start_ts": 0.5}] * (f % 3),
                       "sbi_refs": [0, 2], "extra": {"deep": [1, {"messages": [2]}]}} for f in range(flows)],
            "n4": {"messages": [{"ts": 0.25, "name": "x", "seid": 2 ** 63 + k, "cause_code": k} for k in range(3)], "unpaired_requests": 1},
            "sbi": rng.choice([None, ["no object"], "text"]), "unassociated": [{"ts": 3.0, "ngap": "NGSetup"}]}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100_000])
def test_pieces_are_the_document(size):
    rng = random.Random(3)
    for indent in (None, 2):
        doc = made(rng, 4)
        found = pieces(json.dumps(doc, indent=indent, ensure_ascii=False), size)
        of = lambda part, flow=None: [json.loads(v) for p, f, _, v in found if p == part and f == flow]
        for k, flow in enumerate(doc["flows"]):
            assert of("flows.messages", k) == flow["messages"] and of("flows.procedures", k) == flow["procedures"]
            assert of("flows", k) == [{c: v for c, v in flow.items() if c not in ("messages", "procedures")}]
        assert of("n4.messages") == doc["n4"]["messages"] and of("n4") == [{"unpaired_requests": 1}]
        assert of("unassociated") == doc["unassociated"]
        assert of("") == [{"kpis": doc["kpis"], "sbi": doc["sbi"]}]


def test_odd_documents():
    assert pieces("[1, 2]", 2) == [] and pieces(' {"flows": [] , "n4":null} ', 3) == [("", None, 0, '{"n4": null}')]
    assert pieces('{"messages": [12, 34.5e1]}', 1)[:2] == [("messages", None, 0, "12"), ("messages", None, 1, "345.0")]
    for broken in ('{"flows": [', '{"flows": [{}}', '{"a" 1}', ""):
        with pytest.raises(ValueError):
            pieces(broken, 4)


def test_no_more_than_an_element_is_held():
    seen = []

    def texts():
        yield '{"messages": ['
        for k in range(20_000):
            yield ("," if k else "") + '{"name": "' + "x" * 100 + '"}'
            seen.append(len(parts.held))
        yield "]}"

    parts = captures.JsonParts(texts())
    assert sum(1 for _ in parts) == 20_001
    assert max(seen) <= 2 * captures.BLOCK


def test_pieces_equal_whole_documents(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    for run in ("one_n2", "two_merged", "three"):
        (folder / f"{run}.json").write_text(json.dumps(made(rng, 5), indent=1, ensure_ascii=False), encoding="utf-8")
    (folder / "note.txt").write_text("no document")
    parts = captures.read_parts(spark, str(folder)).cache()
    whole = exports.with_planes(exports.read_documents(spark, str(folder / "*.json"), schemas.N2_EXPORT))

    def same(got, want):
        assert got.count() > 0
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))

    same(captures.flow_lists(parts, "messages"), exports.flow_messages(whole))
    same(captures.flow_lists(parts, "procedures").withColumnRenamed("i", "proc_no"), exports.flow_procedures(whole))
    same(captures.flow_table(parts), exports.flow_table(whole))
    same(captures.plane_messages(parts, "n4", embedded=True), exports.plane_messages(whole, "n4"))
    one = captures.read_parts(spark, str(folder / "three.json"))
    assert {r.run_id for r in one.collect()} == {"three"}
