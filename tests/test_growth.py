"""Plans whose cost must not grow faster than the tables."""

import numpy as np
import pytest
from build import n2, nas, rows

from planeweave.functions import occur
from planeweave.operators import corpus, evidence, flows, graph, incidents, memory, report
from planeweave.plans import bridges as b
from planeweave.plans import catalog, graph_queries, incident_queries
from planeweave.plans.plane_queries import planes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planes_start_from_decoded_events(spark):
    for plane in planes(spark, "/root/testdata/sf0.001"):
        assert "get_json_object" not in _plan(plane)
    decoded = b.decoded(spark, "/root/testdata/sf0.001")
    assert decoded.count() == b.ev(spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["m4_similar_episodes", "i1_n2_incident_filter"])
def test_failed_flows_start_from_decoded_events_of_few_columns(spark, monkeypatch, name):
    given, analyze = [], flows.analyze
    monkeypatch.setattr(flows, "analyze", lambda messages: given.append(messages) or analyze(messages))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "get_json_object" not in _plan(given[0]) and not {"src_ip", "f_teids"} & set(given[0].columns)


def test_cited_items_are_worked_out_once_to_check_and_once_to_show(spark):
    episodes = incident_queries.episodes(spark, "/root/testdata/sf0.001")
    assert _plan(episodes).count("filter(array(") == 1
    assert _plan(memory.valid(episodes)).count("filter(array(") == 2
    odd = spark.createDataFrame(
        [(i, "auth_failure", "n", cited) for i, cited in enumerate(
            [None, [], [None], [("A", None)], [("A", 1), (None, 2)], [("A", 0), None]])],
        "id int, incident_type string, narrative string, cited_evidence array<struct<message string, cause int>>")
    assert rows(memory.valid(odd), "id") == [(3,)]


def test_episodes_fold_by_sets_whatever_order_and_repeats(spark, monkeypatch):
    kept, cut = [], memory.cut_lineage
    monkeypatch.setattr(memory, "cut_lineage", lambda df: kept.append(df) or cut(df))
    cited = [[("A", 1), ("B", 0)], [("B", 1), ("A", None)], [("A", 1), ("B", 1), ("A", 1)], [("B", None), ("A", 1)]]
    made = spark.createDataFrame(
        [(i, "auth_failure", "n", c) for i, c in enumerate(cited)],
        "id int, incident_type string, narrative string, cited_evidence array<struct<message string, cause int>>"
    ).selectExpr("*", "timestamp_seconds(id) AS created_at")
    asked = spark.createDataFrame([(0, "Registration", ["A"], [1])],
                                  "inc int, procedure string, names array<string>, causes array<int>")
    assert rows(memory.similar(asked, made, "inc", "id"), "rank", "id", "score") == [(1, 3, 6), (2, 2, 6), (3, 1, 6)]
    assert rows(kept[0], "id", "tokens") == [(i, ["c:1", "n:A", "n:B"]) for i in (1, 2, 3)]


def test_flows_are_folded_without_sorting_messages(spark):
    visible, table, procs = flows.analyze(n2(spark, [{"ngap": "InitialUEMessage", "nas": nas("A", cause=5)}]))
    assert "SortAggregate" not in _plan(table) and "ExistingRDD" not in _plan(visible)
    case = incidents.flow_cases(visible, table, procs)
    assert "SortAggregate" not in _plan(incidents._flow_features(visible))
    assert rows(case, "detail") == [("cause code(s) observed: #5",)]


def test_repeated_citations_meet_repeated_messages_once(spark):
    names = evidence.located_names(flows.visible_messages(n2(spark, [
        {"ngap": "A", "ts": 1000.5} for _ in range(30)])))
    cites = spark.createDataFrame([(i, "r", "A", None, 1000.5) for i in range(40)],
                                  "cite_id int, run_id string, message string, cause int, ts double")
    met = []
    near = evidence._near
    try:
        evidence._near = lambda *args: met.append(near(*args)) or met[-1]
        found = evidence.locate(cites, names)
    finally:
        evidence._near = near
    assert met[0].count() == 30 and found.count() == 40
    assert {r.plane for r in found.collect()} == {"n2"}


@pytest.mark.parametrize("ts", [0.0, 0.016, 1_704_067_200.016, 1_704_067_200.0159999])
def test_tolerance_reaches_over_cell_borders(spark, ts):
    names = evidence.located_names(flows.visible_messages(n2(spark, [{"ngap": "A", "ts": ts}])))
    cites = spark.createDataFrame([(i, "r", "A", None, ts + dt) for i, dt in enumerate((-4.9e-4, 4.9e-4, 5.1e-4))],
                                  "cite_id int, run_id string, message string, cause int, ts double")
    kept = evidence.about(names, cites)
    assert kept.count() == names.count()
    assert rows(evidence.ground(cites, evidence.inventory(kept)), "cite_id", "grounded") == [
        (0, True), (1, True), (2, False)]


def test_texts_and_titles_stay_out_of_the_scans_of_a_corpus(spark, monkeypatch):
    scanned, written = [], []
    scan, write = corpus.scan, corpus.written
    monkeypatch.setattr(corpus, "scan", lambda df, *a, **k: scanned.append(df.columns) or scan(df, *a, **k))
    monkeypatch.setattr(corpus, "written", lambda df: written.append(df.columns) or write(df))
    units = spark.createDataFrame([
        ("s", 0, "h", "1\tScope"), ("s", 1, "p", "a" * 50), ("s", 2, "h", "1.1\tMore"), ("s", 3, "p", "y " * 3500),
        ("s", 4, "p", "z" * 4000), ("s", 5, "h", "2\tContents"), ("s", 6, "p", "gone"), ("s", 7, "h", "3\tEnd"),
        ("s", 8, "p", "v" * 73), ("s", 9, "p", "")], "spec string, unit_no bigint, kind string, text string")
    specs = spark.createDataFrame([("s", "TS 1", "j30")], "spec string, title string, token string")
    made = rows(corpus.build(units, specs), "node_no", "body_no", "text", "chars")
    assert scanned and not any({"text", "title"} & set(columns) for columns in scanned)
    assert not any({"text", "piece"} & set(columns) for columns in written)
    # The text of the clause and two line feeds make the last clause 80 characters long.
    assert [(n, b, c) for n, b, _, c in made] == [(2, 0, 5999), (2, 1, 5002), (7, 0, 75)]
    whole = rows(corpus.pack(corpus.bodies(units, corpus.headings(units))), "node_no", "body_no", "body")
    assert [t.split("\n", 2 if "[under" in t else 1)[-1] for _, _, t, _ in made] == [
        body for node, _, body in whole if node != 0]
    assert rows(corpus.packed_bodies(units), "node_no", "body_no", "body") == whole


def test_spec_context_keeps_the_share_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(report, "PART_ANSWERS", 5)
    asked = spark.createDataFrame([("r", i, 2 * k, f"e{k % 8}") for i in range(4) for k in range(16)]
                                  + [("r", 9, 1, None), ("r", 9, 3, "e1"), ("r", 9, 3, "e1")],
                                  "run_id string, incident_no long, ask_no long, entity_id string")
    blocks = spark.createDataFrame([(f"e{k}", f"b{k}") for k in range(8)], "entity_id string, block string")
    shown = report.spec_context(asked, blocks)
    # 66 answers, 5 to a task.
    assert "REPARTITION_BY_NUM" in _plan(shown) and "incident_no#" in _plan(shown) and ", 14)" in _plan(shown)
    assert rows(shown, "incident_no", "line_no", "text") == sorted(
        [(i, k + 1, f"b{k}\n") for i in range(4) for k in range(6)] + [(i, 7, "… and 2 more") for i in range(4)]
        + [(9, 1, "b1\n")])


def test_chunks_are_put_together_once_and_mentions_worked_out_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(k, f"Word{k % 5} other{k % 3}\nword{k % 4} other{k % 3} the end") for k in range(60)],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, wrote = [], []
    entities, write = graph.entities, graph.written
    monkeypatch.setattr(graph, "entities", lambda chunks: given.append(chunks) or entities(chunks))
    monkeypatch.setattr(graph, "written", lambda df: wrote.append(_plan(df)) or write(df))
    catalog.QUERIES["x13_co_mentioned_edges"](spark, str(tmp_path))
    assert "regexp_extract" not in _plan(given[0]) and "split" not in _plan(given[0])
    # Of the written tables one reads the pairs that the search found.
    assert sum("sequence(1, (size(split(clause" in plan for plan in wrote) == 1


def test_first_words_are_those_of_the_sql(spark):
    texts = ["", " ", "a", "a b", "a\nb c", "\na", "a  b", "a\r\nb", "a\tb c", "é😀 b\n", None]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert rows(given.selectExpr(*graph_queries._FIRST), "doc_id", "w1", "w2") == rows(
        given.selectExpr(*graph_queries._WORDS), "doc_id", "w1", "w2")


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 40])
def test_first_bytes_of_every_place(size):
    data = np.arange(200, 200 + size).astype(np.uint8)
    for width in occur.WIDTHS:
        assert occur._first(data, width).tolist() == [
            int.from_bytes(data[k:k + width].tobytes()) for k in range(size - width + 1)]
