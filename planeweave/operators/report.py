"""Incident reports as line tables.

A report line is (run_id, incident_no, section, line_no, text); sorting by these
columns gives the document.  Nothing is gathered per run; `sources.documents`
writes the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.text import fixed, or_mark, or_none, plain_number, text_of
from planeweave.operators.memory import is_valid

# Who sends which message.
GNB_TO_AMF = ["InitialUEMessage", "UplinkNASTransport", "InitialContextSetupResponse",
              "InitialContextSetupFailure", "UEContextReleaseRequest", "UEContextReleaseComplete",
              "PDUSessionResourceSetupResponse", "PDUSessionResourceReleaseResponse",
              "PDUSessionResourceModifyResponse", "HandoverRequired", "PathSwitchRequest",
              "UplinkRANConfigurationTransfer", "NGSetupRequest"]
AMF_TO_GNB = ["DownlinkNASTransport", "InitialContextSetupRequest", "UEContextReleaseCommand",
              "PDUSessionResourceSetupRequest", "PDUSessionResourceReleaseCommand",
              "PDUSessionResourceModifyRequest", "Paging", "NASNonDeliveryIndication",
              "RerouteNASRequest", "NGSetupResponse", "PathSwitchRequestAcknowledge",
              "DownlinkRANConfigurationTransfer"]
SMF_TO_UPF = ["PFCP Session Establishment Request", "PFCP Session Report Response",
              "PFCP Node Report Response"]
UPF_TO_SMF = ["PFCP Session Establishment Response", "PFCP Session Report Request",
              "PFCP Node Report Request"]
SBI_PRODUCERS = {"namf": "AMF", "nsmf": "SMF", "nudm": "UDM", "nausf": "AUSF", "nnssf": "NSSF",
                 "nnrf": "NRF", "npcf": "PCF", "nudr": "UDR", "nbsf": "BSF", "nef": "NEF",
                 "naf": "AF", "nsmsf": "SMSF"}
KPI_ORDER = ["attach_time_ms", "pdu_session_time_ms", "procedure_success_rate",
             "procedure_successes", "procedure_failures"]
TIMELINE_CAP, SPEC_CAP, LINE_CAP = 50, 6, 78

# Answered questions in one task of the spec context.
PART_ANSWERS = 500_000

HEADER, ROOT_CAUSE, EVIDENCE, SPEC, TIMELINE, KPIS, SEARCH, MEMORY = range(8)


# --- attribution (W1) -------------------------------------------------------

def _over(plane: str, src_role: Column, dst_role: Column) -> Column:
    def end(role: Column, ip: str) -> Column:
        return F.coalesce(text_of(role, " (", F.col(ip), ")"), F.col(ip))

    said = text_of(f" over {plane} from ", end(src_role, "src_ip"), " to ", end(dst_role, "dst_ip"))
    return F.coalesce(said, F.lit(""))


def n2_attribution(name: Column) -> Column:
    up, down = name.isin(*GNB_TO_AMF), name.isin(*AMF_TO_GNB)
    return _over("N2", F.when(up, "gNB").when(down, "AMF"), F.when(up, "AMF").when(down, "gNB"))


def n4_attribution(name: Column) -> Column:
    down, up = name.isin(*SMF_TO_UPF), name.isin(*UPF_TO_SMF)
    return _over("N4", F.when(down, "SMF").when(up, "UPF"), F.when(down, "UPF").when(up, "SMF"))


def sbi_producer(name: Column) -> Column:
    """The function that produces a service: its longest known prefix."""
    found = F.lit(None).cast("string")
    for prefix in sorted(SBI_PRODUCERS, key=len):
        found = F.when(F.lower(name).startswith(prefix), SBI_PRODUCERS[prefix]).otherwise(found)
    return found


def sbi_attribution(name: Column, direction: Column) -> Column:
    producer, nobody = sbi_producer(name), F.lit(None).cast("string")
    answers = direction == "response"
    return _over("SBI", F.when(answers, producer).otherwise(nobody),
                 F.when(answers, nobody).otherwise(producer))


# --- timelines (W2, W3) -----------------------------------------------------

def flow_timeline(numbered_flow_messages: DataFrame, flows: DataFrame) -> DataFrame:
    """The first 50 messages of each flow and how many more there are."""
    nas = F.col("nas")
    name = F.coalesce(F.nullif(nas["inner"], F.lit("")), F.nullif(nas["name"], F.lit("")),
                      F.nullif(F.col("ngap"), F.lit("")), F.lit("?"))
    cause = F.when(nas["cause"].isNotNull(), text_of(
        "  cause #", nas["cause"].cast("string"), " (", or_none(nas["cause_name"]), ")"))
    shown = numbered_flow_messages.filter(F.col("i") <= TIMELINE_CAP).select(
        "run_id", "flow_id", F.col("i").alias("line_no"), F.concat(
            F.lit("["), F.col("i").cast("string"), F.lit("] "), fixed(F.col("ts")), F.lit("s  "),
            name, n2_attribution(F.col("ngap")), F.coalesce(cause, F.lit(""))).alias("text"))
    more = flows.filter(F.col("messages") > TIMELINE_CAP).select(
        "run_id", "flow_id", F.lit(TIMELINE_CAP + 1).cast("long").alias("line_no"),
        text_of("... (", (F.col("messages") - TIMELINE_CAP).cast("string"),
                " more not shown)").alias("text"))
    return shown.unionByName(more)


def _endpoint_key(src_ip: str, src_port: str, dst_ip: str, dst_port: str, own: str) -> Column:
    """Addresses, ports and the stream or sequence number as one comparable text."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-"))
                              for c in (src_ip, src_port, dst_ip, dst_port, own)])


def _answers(messages: DataFrame, is_answer: Column, own: str, answer: list[str]) -> DataFrame:
    """The last answer per path, one row per key, so requests look it up."""
    return messages.filter(is_answer).groupBy(
        "run_id", _endpoint_key("dst_ip", "dst_port", "src_ip", "src_port", own).alias("_key")
    ).agg(F.max_by(F.struct(*answer), "msg_no").alias("rsp"))


def sbi_timeline(numbered_messages: DataFrame) -> DataFrame:
    """SBI messages, each request with the status it was answered with."""
    asks = F.col("direction") == "request"
    answers = _answers(numbered_messages, F.col("direction") == "response", "stream_id", ["status"])
    keyed = numbered_messages.withColumn("_key", F.when(asks, _endpoint_key(
        "src_ip", "src_port", "dst_ip", "dst_port", "stream_id")))
    joined = keyed.join(answers, ["run_id", "_key"], "left")
    said = sbi_attribution(F.col("name"), F.col("direction"))
    body = F.when(asks, F.concat(
        or_mark(F.col("method")), F.lit(" "), or_mark(F.col("path")), said, F.lit(" -> "),
        F.coalesce(F.col("rsp.status").cast("string"), F.lit("no response")))
    ).otherwise(F.concat(F.lit("-> "), or_mark(F.col("status")), said))
    return joined.select("run_id", F.col("i").alias("line_no"), F.concat(
        F.lit("["), F.col("i").cast("string"), F.lit("] "), fixed(F.col("ts")), F.lit("s  "), body,
        F.lit("  ("), or_mark(F.col("name")), F.lit(")")).alias("text"))


def n4_timeline(numbered_messages: DataFrame) -> DataFrame:
    """N4 messages, each request with the cause it was answered with."""
    name = or_mark(F.col("name"))
    asks = name.contains(" Request")
    answers = _answers(numbered_messages, F.col("name").contains(" Response"), "seq", ["cause"])
    keyed = numbered_messages.withColumn("_key", F.when(asks, _endpoint_key(
        "src_ip", "src_port", "dst_ip", "dst_port", "seq")))
    joined = keyed.join(answers, ["run_id", "_key"], "left")
    said = n4_attribution(F.col("name"))
    outcome = F.when(F.col("rsp").isNull(), "no response").otherwise(
        or_mark(F.col("rsp.cause"), "answered"))
    body = F.when(asks, F.concat(name, said, F.lit(" -> "), outcome)).otherwise(F.concat(
        F.lit("-> "), F.coalesce("cause", F.lit("?")), F.lit(" ("), name, said, F.lit(")")))
    return joined.select("run_id", F.col("i").alias("line_no"), F.concat(
        F.lit("["), F.col("i").cast("string"), F.lit("] "), fixed(F.col("ts")), F.lit("s  "), body)
        .alias("text"))


# --- evidence lines (W4) ----------------------------------------------------

def evidence_line(verified: Column) -> Column:
    """One cited item: verified or not, its endpoints, time and cause.

    Expects message, cause, ts and the located plane, src_ip, dst_ip, ngap and
    direction.
    """
    plane = F.col("plane")
    said = (F.when(plane == "n2", n2_attribution(F.col("located_name")))
            .when(plane == "n4", n4_attribution(F.col("message")))
            .when(plane == "sbi", sbi_attribution(F.col("message"), F.col("direction")))
            .otherwise(""))
    return F.concat(
        F.when(verified, "- [verified] ").otherwise("- [unverified] "), or_mark(F.col("message")),
        said, F.coalesce(text_of(" @ ", fixed(F.col("ts")), "s"), F.lit("")),
        F.coalesce(text_of(" — cause #", F.col("cause").cast("string")), F.lit("")))


# --- spec context (W5) ------------------------------------------------------

def spec_queries(citations: DataFrame) -> DataFrame:
    """The questions a cited item asks the spec graph: its cause when the message
    names a protocol, then its message.  `ask_no` keeps their order."""
    upper = F.upper("message")
    protocol = (F.when(upper.contains("5GMM"), "5GMM").when(upper.contains("5GSM"), "5GSM")
                .when(upper.contains("PFCP"), "PFCP"))
    cause = text_of(protocol, " cause #", F.col("cause").cast("string"))
    return citations.select("*", F.posexplode(F.array(cause, F.col("message"))).alias(
        "_pos", "query")).filter(F.col("query").isNotNull()).withColumn(
        "ask_no", F.col("item_no") * 2 + F.col("_pos")).drop("_pos")


def spec_context(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Entity blocks per incident: first mention of each entity, six at most, then
    how many more (W5).

    `asked` has run_id, incident_no, ask_no, entity_id; `blocks` entity_id, block.
    Repeated questions do not matter.  Few of them fall together, so they are dealt out before they
    are folded, in as many parts as keep a task's share the same in any table.
    """
    from planeweave.functions.blocks import parts_of
    from planeweave.functions.top import top_rows

    key = ["run_id", "incident_no"]
    answered = asked.filter(F.col("entity_id").isNotNull()).select(*key, "entity_id", "ask_no")
    firsts = answered.repartition(parts_of(answered, PART_ANSWERS), *key).groupBy(*key, "entity_id").agg(
        F.min("ask_no").alias("ask_no"))
    shown = top_rows(firsts, key, ["ask_no", "entity_id"], SPEC_CAP, "line_no").join(blocks, "entity_id")
    more = firsts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > SPEC_CAP).select(*key, F.lit(SPEC_CAP + 1).cast("long").alias("line_no"),
                                      text_of("… and ", (F.col("n") - SPEC_CAP).cast("string"),
                                              " more").alias("text"))
    return shown.select(*key, "line_no", F.concat(F.col("block"), F.lit("\n")).alias("text")
                        ).unionByName(more)


# --- indicator, search-path and memory rows (W6) ----------------------------

def kpi_line(kpis: DataFrame) -> DataFrame:
    """The run's indicators in fixed order."""
    kinds = dict(kpis.dtypes)
    present = [c for c in KPI_ORDER if c in kinds]
    shown = [text_of(f"{c}: ", or_none(plain_number(F.col(c)) if kinds[c] == "double" else F.col(c)))
             for c in present]
    return kpis.select("run_id", (F.concat_ws(" | ", *shown) if shown else F.lit(
        "(no KPIs in this capture)")).alias("text"))


def search_path(trajectory: Column) -> Column:
    """One line per action of the winning path; the observation's first line, cut."""
    def line(pair: Column, i: Column) -> Column:
        head = F.substring_index(F.coalesce(F.get(pair, F.lit(1)), F.lit("")), "\n", 1)
        cut = F.when(F.length(head) <= LINE_CAP, head).otherwise(
            F.concat(F.substring(head, 1, LINE_CAP - 1), F.lit("…")))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.get(pair, F.lit(0)),
                        F.when(cut == "", "").otherwise(F.concat(F.lit(" -> "), cut)))

    return (F.when(trajectory.isNull(),
                   F.array(F.lit("(trajectory not recorded in this results file)")))
            .when(F.size(trajectory) == 0,
                  F.array(F.lit("(no trajectory — the search exhausted its rollouts)")))
            .otherwise(F.transform(trajectory, line)))


def memory_line(incident_type: Column, valid: Column, wrote: Column) -> Column:
    return (F.when(~valid, "no Episode written (no hypothesis)")
            .when(wrote, text_of("new Episode written (", incident_type, ")"))
            .otherwise(text_of("Episode already recorded (", incident_type,
                               ") — not rewritten")))


# --- assembly (W7) ----------------------------------------------------------

def _flow_label() -> Column:
    joined = F.coalesce(text_of(" (flow ", F.col("flow_id").cast("string"), ")"), F.lit(""))
    return F.when(F.col("plane").isin("sbi", "n4"), F.concat(
        F.upper("plane"), F.lit(" — "), or_mark(F.col("procedure"), "unknown"), joined)
    ).otherwise(text_of("flow ", or_none(F.col("flow_id"))))


def assemble(results: DataFrame, evidence: DataFrame, flow_lines: DataFrame, kpis: DataFrame,
             spec: DataFrame | None = None, plane_lines: DataFrame | None = None,
             repeat_planes: bool = True) -> DataFrame:
    """The report lines of every run.

    `results`: run_id, incident_no, plane, flow_id, procedure, shape, detail,
    episode fields (incident_type, narrative, cited_evidence; null without one),
    reward, rollouts, trajectory, memory_wrote.  `evidence`: run_id, incident_no,
    line_no, text (W4).  `flow_lines`: W2.  `spec`: W5.  `plane_lines`: run_id,
    plane, line_no, text (W3).

    A run with one incident gets the single form, with more the overview table
    and a chapter each.  The timeline of an SBI or N4 incident is that of its
    whole plane.  With `repeat_planes` every such incident holds it, so a run's
    report grows with its incidents times its messages; without, a report of
    several incidents names it and holds each plane's once, after the last
    incident.
    """
    key = ["run_id", "incident_no"]
    sizes = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("incidents"))
    known = results.withColumn("_valid", is_valid()).join(sizes, "run_id")
    single = F.col("incidents") == 1
    marks = F.when(single, "##").otherwise("###")
    kind = F.col("incident_type")
    other = F.col("plane").isin("sbi", "n4")
    shape = or_mark(F.col("shape"), "unknown")
    procedure = or_mark(F.col("procedure"), "unknown")

    title = F.when(single, F.coalesce(
        text_of("# Post-incident report — ", kind),
        text_of("# Post-incident report — no hypothesis (", _flow_label(), ")"))
    ).otherwise(text_of("## Incident ", F.col("incident_no").cast("string"), " — ",
                        F.coalesce(kind, F.lit("no hypothesis")), " — ", _flow_label()))
    flow = F.when(single, F.when(other, text_of("**Flow:** ", _flow_label(), ", ", shape)).otherwise(
        text_of("**Flow:** ", or_none(F.col("flow_id")), " — ", procedure, ", ", shape)))
    detail = text_of("**Incident detail:** ", F.nullif(F.col("detail"), F.lit("")))
    gap = F.when(~single & detail.isNotNull(), "")
    belief = F.when(single, text_of(
        "**Hypothesis:** ", kind, " (reward ", F.coalesce("reward", F.lit(0.0)).cast("string"),
        ", ", F.coalesce("rollouts", F.lit(0)).cast("string"), " rollouts)"))
    head = F.array_compact(F.concat(
        F.array(title, F.lit(""), flow, detail, gap, belief),
        F.when(single, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))

    def block(section: int, lines: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), lines.alias("lines"))

    story = F.when(F.col("_valid"), F.col("narrative")).otherwise(F.coalesce(
        F.nullif(F.col("narrative"), F.lit("")),
        F.lit("No hypothesis: the LATS search completed no finalize.")))
    named = F.when(other, text_of(" Timeline (", F.upper("plane"), ")")).otherwise(
        text_of(" Timeline (flow ", or_none(F.col("flow_id")), ")"))
    apart = other & ~single & F.lit(not repeat_planes)
    pointer = F.when(apart, text_of("(see Timeline (", F.upper("plane"), ") after the last incident)"))
    uncited = F.when(F.size(F.coalesce("cited_evidence", F.array().cast(
        results.schema["cited_evidence"].dataType))) == 0, "(none cited)")
    fixed_lines = F.array(
        block(HEADER, head),
        block(ROOT_CAUSE, F.array(text_of(marks, " Root cause"), story, F.lit(""))),
        block(EVIDENCE, F.array_compact(F.array(text_of(marks, " Evidence"), uncited))),
        block(TIMELINE, F.array_compact(F.array(F.concat(marks, named), pointer))),
        block(SEARCH, F.concat(F.array(F.lit(""), text_of(marks, " Search path")),
                               search_path(F.col("trajectory")))),
        block(MEMORY, F.array(F.lit(""), text_of(marks, " Memory"), memory_line(
            kind, F.col("_valid"), F.coalesce("memory_wrote", F.lit(False))), F.lit(""))))
    own = known.select(*key, F.explode(fixed_lines).alias("b")).select(
        *key, F.col("b.section").alias("section"), F.posexplode("b.lines").alias("pos", "text")
    ).select(*key, "section", F.col("pos").cast("long").alias("line_no"), "text")

    def placed(lines: DataFrame, section: int, first: int = 100) -> DataFrame:
        return lines.select(*key, F.lit(section).alias("section"),
                            (F.col("line_no") + first).alias("line_no"), "text")

    def closing(section: int, text: str = "") -> DataFrame:
        return known.select(*key, F.lit(section).alias("section"),
                            F.lit(1_000_000_000).cast("long").alias("line_no"),
                            F.lit(text).alias("text"))

    timelines = known.filter(~other).select(*key, "flow_id").join(flow_lines, ["run_id", "flow_id"])
    indicators = known.select(*key, marks.alias("m")).join(kpi_line(kpis), "run_id", "left").select(
        *key, F.posexplode(F.array(F.lit(""), text_of(F.col("m"), " Capture KPIs"), F.coalesce(
            "text", F.lit("(no KPIs in this capture)")))).alias("pos", "text")).select(
        *key, F.lit(KPIS).alias("section"), F.col("pos").cast("long").alias("line_no"), "text")
    whole = (own.unionByName(placed(evidence, EVIDENCE)).unionByName(closing(EVIDENCE))
             .unionByName(placed(timelines, TIMELINE)).unionByName(indicators))
    if plane_lines is not None:
        whole = whole.unionByName(placed(_plane_timelines(known.filter(other & ~apart), plane_lines), TIMELINE))
        whole = whole.unionByName(_plane_chapters(known.filter(apart), plane_lines))
    if spec is not None:
        heads = known.join(spec.select(*key).distinct(), key).select(
            *key, F.lit(SPEC).alias("section"), F.lit(0).cast("long").alias("line_no"),
            text_of(marks, " Spec context").alias("text"))
        after = heads.select(*key, "section", F.lit(1_000_000_000).cast("long").alias("line_no"),
                             F.lit("").alias("text"))
        whole = whole.unionByName(heads).unionByName(placed(spec, SPEC)).unionByName(after)
    return whole.unionByName(_overview(known))


def _plane_timelines(known: DataFrame, plane_lines: DataFrame) -> DataFrame:
    """The whole plane's lines for every incident; a plane without messages says so."""
    key, plane = ["run_id", "incident_no"], ["run_id", "plane"]
    shown = known.select(*key, "plane").join(plane_lines, plane).select(*key, "line_no", "text")
    silent = known.join(plane_lines.select(*plane).distinct(), plane, "left_anti").select(
        *key, F.lit(0).cast("long").alias("line_no"),
        text_of("(no ", F.upper("plane"), " messages in this capture)").alias("text"))
    return shown.unionByName(silent)


def _plane_chapters(known: DataFrame, plane_lines: DataFrame) -> DataFrame:
    """One chapter for each plane that incidents name, N4 before SBI, after the last of them."""
    after = known.groupBy("run_id", "plane").agg(
        (F.max("incidents") + F.when(F.col("plane") == "n4", 1).otherwise(2)).alias("incident_no"))
    place = ["run_id", "incident_no", F.lit(TIMELINE).alias("section")]
    head = after.select(*place, F.posexplode(F.array(
        text_of("## Timeline (", F.upper("plane"), ")"), F.lit(""))).alias("pos", "text")).select(
        "run_id", "incident_no", "section", F.col("pos").cast("long").alias("line_no"), "text")
    lines = _plane_timelines(after, plane_lines).select(
        *place, (F.col("line_no") + 100).alias("line_no"), "text")
    close = after.select(*place, F.lit(1_000_000_000).cast("long").alias("line_no"), F.lit("").alias("text"))
    return head.unionByName(lines).unionByName(close)


def _overview(known: DataFrame) -> DataFrame:
    """Title and table of a run with several incidents, as incident 0."""
    many = known.filter(F.col("incidents") > 1)
    cell = F.when(F.col("plane").isin("sbi", "n4"), _flow_label()).otherwise(
        or_none(F.col("flow_id")))
    rows = many.select(
        "run_id", F.lit(0).cast("long").alias("incident_no"), F.lit(HEADER).alias("section"),
        (F.col("incident_no") + 3).alias("line_no"), text_of(
            "| ", F.col("incident_no").cast("string"), " | ", cell, " | ",
            or_mark(F.col("incident_type"), "—"), " | ",
            F.coalesce("reward", F.lit(0.0)).cast("string"), " | ",
            F.coalesce("rollouts", F.lit(0)).cast("string"), " |").alias("text"))
    top = many.groupBy("run_id").agg(F.max("incidents").alias("n")).select(
        "run_id", F.lit(0).cast("long").alias("incident_no"), F.lit(HEADER).alias("section"),
        F.posexplode(F.array(
            text_of("# Post-incident report — ", F.col("n").cast("string"), " incidents"),
            F.lit(""), F.lit("| # | flow | hypothesis | reward | rollouts |"),
            F.lit("|---|------|------------|--------|----------|"))).alias("pos", "text")
    ).select("run_id", "incident_no", "section", F.col("pos").cast("long").alias("line_no"), "text")
    after = many.groupBy("run_id").agg((F.max("incidents") + 4).alias("line_no")).select(
        "run_id", F.lit(0).cast("long").alias("incident_no"), F.lit(HEADER).alias("section"),
        "line_no", F.lit("").alias("text"))
    return rows.unionByName(top).unionByName(after)


def no_incident_lines(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The report of runs without incidents."""
    return runs.select("run_id").distinct().join(
        results.select("run_id").distinct(), "run_id", "left_anti").select(
        "run_id", F.lit(0).cast("long").alias("incident_no"), F.lit(HEADER).alias("section"),
        F.posexplode(F.array(F.lit("# Post-incident report — no incidents"), F.lit(""),
                             F.lit("No failed Incidents to report."))).alias("pos", "text")
    ).select("run_id", "incident_no", "section", F.col("pos").cast("long").alias("line_no"), "text")
