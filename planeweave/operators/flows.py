"""N2 plane: per-device flows, payload visibility and procedures.

Message tables carry `msg_no`, unique and increasing in capture order within a
run.  What a flow knows from its first message on is looked up, one row per flow; what
depends on the order is scanned over the messages that take part in a procedure, which are
few and written once (see `functions.scan`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import Split, count_before, position, previous, scan
from planeweave.session import written

FLOW_KEY = ["run_id", "assoc_lo", "assoc_hi", "ran_key"]

# Message names that open, close or reset a procedure, and the
# refusal notes of a protected payload.
REGISTRATION = "registration"
SESSION = "pdu_session_est"
NAS_START = {REGISTRATION: "5GMMRegistrationRequest", SESSION: "5GSMPDUSessionEstabRequest"}
NAS_ACCEPT = {REGISTRATION: "5GMMRegistrationAccept", SESSION: "5GSMPDUSessionEstabAccept"}
NAS_REJECT = {REGISTRATION: "5GMMRegistrationReject", SESSION: "5GSMPDUSessionEstabReject"}
CARRIER_START = {REGISTRATION: "InitialUEMessage", SESSION: "PDUSessionResourceSetupRequest"}
CARRIER_ACCEPT = {REGISTRATION: "InitialContextSetupRequest",
                  SESSION: "PDUSessionResourceSetupResponse"}
CARRIER_REJECT = {REGISTRATION: "InitialContextSetupFailure",
                  SESSION: "PDUSessionResourceSetupFailure"}
CONTEXT_RELEASE = ["UEContextReleaseRequest", "UEContextReleaseCommand",
                   "UEContextReleaseComplete"]
NOTE_UNREADABLE = "security-protected (payload unreadable)"
NOTE_UNKNOWN_CIPHER = "security-protected (ciphering unknown: no SMC in capture)"
NOTE_CIPHER_BEFORE, NOTE_CIPHER_AFTER = "security-protected (ciphering 5G-EA", " not supported)"

KINDS = (REGISTRATION, SESSION)


def has_ue(messages: DataFrame) -> Column:
    return F.col("ran_ue_id").isNotNull() | F.col("amf_ue_id").isNotNull()


def associated(messages: DataFrame) -> DataFrame:
    """Messages that belong to a device."""
    return messages.filter(has_ue(messages))


def unassociated(messages: DataFrame) -> DataFrame:
    """Messages that carry no device id, refused ones included."""
    return messages.filter(~has_ue(messages))


def key_messages(messages: DataFrame) -> DataFrame:
    """Add the flow key: unordered port pair plus the RAN id.

    A missing RAN id is a key of its own; ids are unsigned, so -1 stands for it
    and later joins need no null-safe comparison.
    """
    return associated(messages).select(
        "*",
        F.least("sport", "dport").alias("assoc_lo"),
        F.greatest("sport", "dport").alias("assoc_hi"),
        F.coalesce("ran_ue_id", F.lit(-1)).cast("long").alias("ran_key"),
    )


def assign_flows(messages: DataFrame, split: Split = None) -> DataFrame:
    """Give each device message its flow_id, 1..n by first appearance.

    The lookup has one row per flow; adaptive execution splits a flow that is hot among the
    messages.
    """
    keyed = key_messages(messages)
    flows = keyed.groupBy(*FLOW_KEY).agg(F.min("msg_no").alias("first_msg_no"))
    numbered = scan(written(flows), ["run_id"], "first_msg_no", split=split, flow_id=position())
    return keyed.join(numbered, FLOW_KEY)


def flow_attributes(flow_messages: DataFrame) -> DataFrame:
    """One row per flow: ids, partial flag, span and size."""
    amf = F.col("amf_ue_id")
    return flow_messages.groupBy("run_id", "flow_id").agg(
        F.first("assoc_lo").alias("assoc_lo"),
        F.first("assoc_hi").alias("assoc_hi"),
        F.max("ran_ue_id").alias("ran_ue_id"),
        F.min_by(amf, F.when(amf.isNotNull(), F.col("msg_no"))).alias("amf_ue_id"),
        # Fixed-width values only, so that flows are folded by hash and no message table is sorted.
        (~F.coalesce(F.min_by(F.coalesce(F.col("ngap") == CARRIER_START[REGISTRATION], F.lit(False)),
                              "msg_no"), F.lit(False))).alias("partial"),
        F.min("msg_no").alias("first_msg_no"),
        F.min_by("ts", "msg_no").alias("first_ts"),
        F.max_by("ts", "msg_no").alias("last_ts"),
        F.count(F.lit(1)).alias("messages"),
    )


def carry_cipher(flow_messages: DataFrame) -> DataFrame:
    """Add `flow_algo`: the algorithm the flow selected before the row.

    Only a payload that is readable without knowing the algorithm can announce
    it, and a message never unlocks itself.  The first one counts, so it is looked up.
    """
    nas = F.col("nas")
    sealed = F.coalesce(nas.protected, F.lit(False))
    open_payload = (~sealed) | (nas.shdr.isin(1, 3) & nas.inner.isNotNull())
    announced = F.when(open_payload & nas.unparsed.isNull(), nas.ciph_algo)
    firsts = flow_messages.select(*FLOW_KEY, "msg_no", announced.alias("_algo")).filter(
        F.col("_algo").isNotNull()).groupBy(*FLOW_KEY).agg(
        F.min("msg_no").alias("_from"), F.min_by("_algo", "msg_no").alias("_algo"))
    return flow_messages.join(firsts, FLOW_KEY, "left").withColumn(
        "flow_algo", F.when(F.col("_from") < F.col("msg_no"), F.col("_algo"))).drop("_from", "_algo")


def refusal_note() -> Column:
    """Why a NAS payload stays closed, or null when it is visible."""
    nas, algo = F.col("nas"), F.col("flow_algo")
    sealed = nas.protected & ~nas.shdr.isin(1, 3)
    return (
        F.when(nas.protected & nas.shdr.isNull(), NOTE_UNREADABLE)
        .when(sealed & algo.isNull(), NOTE_UNKNOWN_CIPHER)
        .when(sealed & (algo != 0),
              F.concat(F.lit(NOTE_CIPHER_BEFORE), algo.cast("string"), F.lit(NOTE_CIPHER_AFTER)))
        .when(nas.protected & nas.inner.isNull(),
              F.coalesce(nas.unparsed, F.lit("inner NAS parse failed")))
        .otherwise(nas.unparsed)
    )


def resolve_visibility(flow_messages: DataFrame) -> DataFrame:
    """Close the payloads that could not have been read.

    A refused payload keeps its note and its `protected` flag only.
    """
    noted = carry_cipher(flow_messages).withColumn("_note", refusal_note())
    nas = F.col("nas")

    def if_open(field: str, kind: str) -> Column:
        return F.when(F.col("_note").isNull(), nas[field]).cast(kind).alias(field)

    resolved = F.when(nas.isNotNull(), F.struct(
        if_open("name", "string"), nas.protected.alias("protected"), nas.shdr.alias("shdr"),
        if_open("inner", "string"), if_open("cause", "int"), if_open("cause_name", "string"),
        if_open("ciph_algo", "int"), if_open("integ_algo", "int"), if_open("supi", "string"),
        if_open("guti", "string"), F.col("_note").alias("unparsed")))
    return noted.withColumn("nas", resolved).drop("_note")


def nas_name() -> Column:
    """The name a NAS payload is known by: inner first, none when refused."""
    nas = F.col("nas")
    return F.when(nas.unparsed.isNull() & nas["name"].isNotNull(), F.coalesce(nas.inner, nas["name"]))


def step_of(name: Column, kind: str, starts: dict, accepts: dict, rejects: dict) -> Column:
    """'start' / 'accept' / 'reject' when `name` plays that part for `kind`."""
    return (F.when(name == starts[kind], "start")
            .when(name == accepts[kind], "accept")
            .when(name == rejects[kind], "reject"))


def _names(*parts: dict) -> list[str]:
    return [name for part in parts for name in part.values()]


def _procedure(kind: str, start: str, end: str, source: int) -> Column:
    s, e = F.col(start), F.col(end)
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(source).alias("source"),
        s.ts.alias("start_ts"), s["name"].alias("start_msg"), s.msg_no.alias("start_no"),
        e.ts.alias("end_ts"), e["name"].alias("end_msg"), e.msg_no.alias("end_no"),
        e.step.alias("outcome"))


def _moves(name: Column, steps: dict[str, Column], prefix: str) -> list[Column]:
    """Per kind the step a message takes, as a struct, null when it takes none."""
    return [F.when(step.isNotNull(), F.struct(
        "msg_no", "ts", name.alias("name"), step.alias("step"))).alias(prefix + kind)
        for kind, step in steps.items()]


def _closed(paired: DataFrame, moves: str, before: str, source: int) -> list[Column]:
    """One procedure per end whose matching earlier message is a start."""
    return [F.when((F.col(moves + kind).step != "start")
                   & (F.col(before + kind).step == "start"),
                   _procedure(kind, before + kind, moves + kind, source))
            for kind in KINDS]


def paired_steps(visible: DataFrame, split: Split = None) -> DataFrame:
    """NAS procedures (source 0) and carrier candidates (source 1).

    NAS: the latest start before an end wins.  Carriers: the earliest start since
    the last context release.
    """
    name, ngap = F.col("_name"), F.col("ngap")
    nas_steps = {k: step_of(name, k, NAS_START, NAS_ACCEPT, NAS_REJECT) for k in KINDS}
    ngap_steps = {k: step_of(ngap, k, CARRIER_START, CARRIER_ACCEPT, CARRIER_REJECT) for k in KINDS}
    # A filter moves below the columns it names and works them out again, so it names few.
    takes_part = (ngap.isin(CONTEXT_RELEASE) | name.isin(_names(NAS_START, NAS_ACCEPT, NAS_REJECT))
                  | ngap.isin(_names(CARRIER_START, CARRIER_ACCEPT, CARRIER_REJECT)))
    moves = visible.select(
        *FLOW_KEY, "flow_id", "msg_no", "ts", "ngap", nas_name().alias("_name")).filter(takes_part).select(
        *FLOW_KEY, "flow_id", "msg_no",
        F.coalesce(ngap.isin(CONTEXT_RELEASE), F.lit(False)).alias("release"),
        *_moves(name, nas_steps, "nas_"), *_moves(ngap, ngap_steps, "ngap_"),
    )
    # Read by the scan, and what it gives by the lookup below: both are written, they are narrow.
    moves = written(moves)
    cycles = written(scan(
        moves, FLOW_KEY, "msg_no", split=split, cycle=count_before(F.col("release")),
        **{f"before_{k}": previous(F.col(f"nas_{k}"), "msg_no") for k in KINDS}))
    opens = {k: F.when(F.col(f"ngap_{k}").step == "start", F.col("msg_no")) for k in KINDS}
    firsts = cycles.groupBy(*FLOW_KEY, "cycle").agg(
        *[F.min_by(f"ngap_{k}", opens[k]).alias(f"first_{k}") for k in KINDS])
    opened = cycles.join(firsts, [*FLOW_KEY, "cycle"]).select("*", *[
        F.when(F.col(f"first_{k}").msg_no < F.col("msg_no"), F.col(f"first_{k}")).alias(f"open_{k}")
        for k in KINDS])
    found = F.array_compact(F.array(*_closed(opened, "nas_", "before_", 0),
                                    *_closed(opened, "ngap_", "open_", 1)))
    return opened.select(*FLOW_KEY, "flow_id", F.explode(found).alias("p")).select(
        *FLOW_KEY, "flow_id", "p.*")


def nas_procedures(visible: DataFrame, split: Split = None) -> DataFrame:
    """Procedures paired from NAS messages alone."""
    return paired_steps(visible, split).filter(F.col("source") == 0)


def settle(pairs: DataFrame, split: Split = None) -> DataFrame:
    """Keep NAS procedures and at most one carrier procedure per flow and kind,
    the earliest, if no NAS procedure of the kind closed at or before it (N7, N8).

    `proc_no` is completion order within the flow, NAS before carrier.
    """
    per_kind = [*FLOW_KEY, "kind"]
    is_nas, no = F.col("source") == 0, F.col("end_no")
    pairs = written(pairs)
    ends = pairs.groupBy(*per_kind).agg(F.min(F.when(is_nas, no)).alias("nas_end_no"),
                                        F.min(F.when(~is_nas, no)).alias("carrier_end_no"))
    known = pairs.join(ends, per_kind)
    stands = is_nas | ((no == F.col("carrier_end_no"))
                       & (F.col("nas_end_no").isNull() | (no < F.col("nas_end_no"))))
    ordered = known.filter(stands).drop("nas_end_no", "carrier_end_no").withColumn(
        "_order", no * 4 + F.col("source") * 2 + F.when(F.col("kind") == SESSION, 1).otherwise(0))
    return scan(ordered, FLOW_KEY, "_order", split=split,
                proc_no=position()).drop("_order", "assoc_lo", "assoc_hi", "ran_key")


def procedures(visible: DataFrame, split: Split = None) -> DataFrame:
    """All N2 procedures."""
    return settle(paired_steps(visible, split), split)


def with_duration(procs: DataFrame) -> DataFrame:
    """Milliseconds per procedure; null when the end time is missing or 0 (K4)."""
    end = F.col("end_ts")
    return procs.withColumn(
        "duration_ms",
        F.when(end.isNotNull() & (end != 0), (end - F.col("start_ts")) * 1000.0))


def visible_messages(messages: DataFrame, split: Split = None) -> DataFrame:
    """Device messages with flow_id and only the payloads that could be read."""
    return resolve_visibility(assign_flows(messages, split))


def analyze(messages: DataFrame, split: Split = None
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages with flows and visible payloads, the flow table, the procedures.

    All three come from the message table, which is written once for them.
    """
    visible = written(visible_messages(messages, split))
    return visible, flow_attributes(visible), procedures(visible, split)


def analyze_procedures(messages: DataFrame, split: Split = None) -> DataFrame:
    """The procedures alone; only what takes part in them is written."""
    return procedures(visible_messages(messages, split), split)
