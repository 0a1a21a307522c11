"""Failed procedures as incidents, and their classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, shapes, wording and the closed set of incident types.
PROCEDURE_LABELS = {"registration": "Registration", "pdu_session_est": "PDU Session"}
REJECT_SHAPE = "explicit reject"
TIMEOUT_SHAPE = "no terminal message (timeout)"
CAUSE_BEARING = "(?i)reject|status|failure"
N2_DETAIL = "cause code(s) observed: "
SBI_DETAIL = "SBI status code(s) observed: "
N4_DETAIL = "PFCP cause code(s) observed: "
SESSION_KINDS = ["session_establishment", "session_modification", "session_deletion",
                 "session_report"]
INCIDENT_TYPES = ["auth_failure", "registration_reject", "registration_timeout",
                  "pdu_session_reject_slice", "pdu_session_reject_other", "pdu_session_timeout",
                  "sbi_udm_timeout", "sbi_nssf_reject", "n4_upf_timeout"]
SLICE_CAUSE, ECHO_CAUSE, ECHO_GAP_S = 91, 90, 2.0

COLUMNS = ["run_id", "plane", "flow_id", "procedure", "shape", "detail", "source_no"]


def message_name() -> Column:
    """The name a flow message goes by: inner, else NAS, else NGAP."""
    nas = F.col("nas")
    return F.coalesce(F.nullif(nas["inner"], F.lit("")), F.nullif(nas["name"], F.lit("")),
                      F.nullif(F.col("ngap"), F.lit("")))


def _flow_features(flow_messages: DataFrame) -> DataFrame:
    nas = F.col("nas")
    cause = nas["cause"]
    named = message_name()
    nas_named = F.coalesce(F.nullif(nas["inner"], F.lit("")), F.nullif(nas["name"], F.lit("")))

    def seen(test: Column) -> Column:
        return F.coalesce(F.max(test), F.lit(False))

    key = ["run_id", "flow_id"]
    # Sets are collected of distinct codes only: folding the messages by hash needs fixed-width values.
    codes = flow_messages.select(*key, F.when(cause != 0, cause).alias("_code")).filter(
        F.col("_code").isNotNull()).distinct().groupBy(*key).agg(F.collect_set("_code").alias("codes"))
    features = flow_messages.groupBy(*key).agg(
        seen(named.contains("PDUSession") | named.contains("5GSMPDU")).alias("names_session"),
        seen(named.contains("Registration")).alias("names_registration"),
        seen(cause.isNotNull()).alias("has_cause"),
        seen(cause.isNotNull() & nas_named.rlike(CAUSE_BEARING)).alias("cause_on_reject"),
        seen(named.contains("AuthenticationFailure")).alias("auth_failure"),
        seen(named.contains("RegistrationReject")).alias("registration_reject"),
        seen(named.contains("RegistrationRequest")).alias("registration_request"),
        seen(named.contains("RegistrationAccept") | named.contains("RegistrationReject"))
        .alias("registration_end"),
        seen((cause == SLICE_CAUSE) & nas_named.rlike("(?i)5GMM.*status")).alias("slice_status"),
        seen(named.rlike("(?i)PDUSessionEstabReject")
             | (cause.isNotNull() & nas_named.rlike("(?i)5GSM.*(reject|status|failure)")))
        .alias("session_reject"),
        F.count(F.when((cause == ECHO_CAUSE) & named.contains("PDUSession"), 1)).alias("echoes"),
        (F.max(F.when((cause == ECHO_CAUSE) & named.contains("PDUSession"), F.col("ts")))
         - F.min(F.when((cause == ECHO_CAUSE) & named.contains("PDUSession"), F.col("ts"))))
        .alias("echo_span"),
        F.min("msg_no").alias("source_no"),
    )
    return features.join(codes, key, "left").withColumn(
        "codes", F.coalesce("codes", F.array().cast("array<int>")))


def _procedure_features(procs: DataFrame) -> DataFrame:
    failed = ~F.col("outcome").isin("accept", "unknown")
    return procs.groupBy("run_id", "flow_id").agg(
        F.count(F.lit(1)).alias("procedures"),
        F.coalesce(F.max(failed), F.lit(False)).alias("any_failed"),
        F.coalesce(F.max(failed & (F.col("outcome") == "reject")), F.lit(False))
        .alias("any_reject"),
        F.min_by("kind", F.when(failed, F.col("proc_no"))).alias("failed_kind"),
    )


def _label(kind: Column) -> Column:
    titled = F.initcap(F.regexp_replace(kind, "_", " "))
    return (F.when(kind == "registration", PROCEDURE_LABELS["registration"])
            .when(kind == "pdu_session_est", PROCEDURE_LABELS["pdu_session_est"])
            .otherwise(titled))


def flow_cases(flow_messages: DataFrame, flows: DataFrame, procs: DataFrame) -> DataFrame:
    """One row per failed flow, with the features its description is made of.

    A flow failed when a procedure did not succeed, a message carries a cause, no
    procedure closed at all, or its beginning is missing.  Codes per flow come
    from the small code space, so the collected set is bounded by it.
    """
    key = ["run_id", "flow_id"]
    joined = (_flow_features(flow_messages)
              .join(flows.select(*key, "partial"), key)
              .join(_procedure_features(procs), key, "left")
              .fillna(0, ["procedures"]).fillna(False, ["any_failed", "any_reject"]))
    cases = joined.filter(
        F.col("any_failed") | F.col("has_cause") | (F.col("procedures") == 0) | F.col("partial"))
    codes = F.array_join(F.transform(
        F.array_sort("codes"), lambda c: F.concat(F.lit("#"), c.cast("string"))), ", ")
    return cases.select(
        "*",
        F.when(F.col("any_failed"), _label(F.col("failed_kind")))
        .when(F.col("names_session"), PROCEDURE_LABELS["pdu_session_est"])
        .when(F.col("names_registration"), PROCEDURE_LABELS["registration"])
        .otherwise("unknown").alias("procedure"),
        F.when(F.col("any_reject") | F.col("cause_on_reject"), REJECT_SHAPE)
        .otherwise(TIMEOUT_SHAPE).alias("shape"),
        F.when(F.col("has_cause"), F.concat(F.lit(N2_DETAIL), codes)).alias("detail"))


def n2_incidents(flow_messages: DataFrame, flows: DataFrame, procs: DataFrame) -> DataFrame:
    """N2 incidents."""
    return flow_cases(flow_messages, flows, procs).select(
        "run_id", F.lit("n2").alias("plane"), "flow_id", "procedure", "shape", "detail",
        "source_no")


def _plane_incidents(procs: DataFrame, plane: str, detail: str, code: str) -> DataFrame:
    flow = F.col("flow_id") if "flow_id" in procs.columns else F.lit(None)
    rejected = F.col("outcome") == "reject"
    return procs.filter(F.col("outcome").isin("reject", "timeout")).select(
        "run_id", F.lit(plane).alias("plane"), flow.cast("long").alias("flow_id"),
        F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("unknown")).alias("procedure"),
        F.when(rejected, REJECT_SHAPE).otherwise(TIMEOUT_SHAPE).alias("shape"),
        F.when(rejected, F.concat(F.lit(detail), F.coalesce(
            F.col(code).cast("string"), F.lit("None")))).alias("detail"),
        F.col("req_no").alias("source_no"))


def sbi_incidents(procs: DataFrame) -> DataFrame:
    """Rejected and unanswered SBI requests."""
    return _plane_incidents(procs, "sbi", SBI_DETAIL, "status")


def n4_incidents(procs: DataFrame) -> DataFrame:
    """Rejected and unanswered session-management requests."""
    return _plane_incidents(procs.filter(F.col("kind").isin(*SESSION_KINDS)),
                            "n4", N4_DETAIL, "cause")


def all_incidents(n2: DataFrame, n4: DataFrame | None = None, sbi: DataFrame | None = None,
                  flow_id: int | None = None) -> DataFrame:
    """Incidents of all planes in the order N2, N4, SBI (`plane_rank`), optionally
    those of one flow; unlinked ones then drop out (I7)."""
    union = n2.withColumn("plane_rank", F.lit(0))
    for rank, more in ((1, n4), (2, sbi)):
        if more is not None:
            union = union.unionByName(more.withColumn("plane_rank", F.lit(rank)))
    return union if flow_id is None else union.filter(F.col("flow_id") == flow_id)


def classify_flows(cases: DataFrame) -> DataFrame:
    """Incident type of a failed flow by the wire-shape rules (I8), null when none fits."""
    def c(name: str) -> Column:
        return F.col(name)

    return cases.withColumn("incident_type", (
        F.when(c("auth_failure"), "auth_failure")
        .when(c("registration_reject"), "registration_reject")
        .when(c("slice_status"), "pdu_session_reject_slice")
        .when(c("session_reject"), "pdu_session_reject_other")
        .when((c("echoes") > 1) & (c("echo_span") >= ECHO_GAP_S), "pdu_session_timeout")
        .when(c("registration_request") & ~c("registration_end")
              & (c("shape") == TIMEOUT_SHAPE), "registration_timeout")))


def classify_planes(incidents: DataFrame) -> DataFrame:
    """Incident type of an SBI or N4 incident (I8).

    An unanswered identity request is counted whether the UDM service or the AUSF
    request waiting on it went unanswered.
    """
    plane, procedure = F.col("plane"), F.col("procedure")
    rejected = F.col("shape") == REJECT_SHAPE
    return incidents.withColumn("incident_type", (
        F.when((plane == "sbi") & rejected & procedure.startswith("Nnssf_NSSelection"),
               "sbi_nssf_reject")
        .when((plane == "sbi") & ~rejected
              & (procedure.startswith("Nudm_") | procedure.startswith("Nausf_")),
              "sbi_udm_timeout")
        .when((plane == "n4") & ~rejected & procedure.isin(*SESSION_KINDS), "n4_upf_timeout")))
