"""N4 plane: request/response pairing by direction and sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import Split, count_before, dealt, position, scan
from planeweave.session import written

# Request message type -> procedure kind; the response type is one higher.
REQUEST_KINDS = {
    1: "heartbeat",
    3: "pfd_management",
    5: "association_setup",
    7: "association_update",
    9: "association_release",
    12: "node_report",
    14: "session_set_deletion",
    50: "session_establishment",
    52: "session_modification",
    54: "session_deletion",
    56: "session_report",
}
ACCEPT_CAUSES = (1, 2, 3)

PAIR_KEY = ["run_id", "client_ip", "client_port", "server_ip", "server_port", "seq_key"]


def _kind_of(msg_type: Column) -> Column:
    pairs = [F.lit(x) for item in REQUEST_KINDS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), msg_type)


def with_kind(messages: DataFrame) -> DataFrame:
    """Add `role` (request / response / null) and `kind` by message type."""
    t = F.col("msg_type")
    asked, answered = _kind_of(t), _kind_of(t - 1)
    return messages.select(
        "*",
        F.when(asked.isNotNull(), "request").when(answered.isNotNull(), "response").alias("role"),
        F.coalesce(asked, answered).alias("kind"))


def outcome_of(cause: Column) -> Column:
    """No cause: unknown; 1, 2, 3: accept; anything else: reject."""
    return (F.when(cause.isNull(), "unknown")
            .when(cause.isin(*ACCEPT_CAUSES), "accept").otherwise("reject"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Decoded requests and responses under the key they share: a response
    travels the request's path in reverse."""
    known = with_kind(messages).filter(F.col("unparsed").isNull() & F.col("role").isNotNull())
    asks = F.col("role") == "request"

    def end(column: str, other: str, missing) -> Column:
        return F.coalesce(F.when(asks, F.col(column)).otherwise(F.col(other)), F.lit(missing))

    return known.select(
        "*",
        end("src_ip", "dst_ip", "").alias("client_ip"),
        end("src_port", "dst_port", -1).alias("client_port"),
        end("dst_ip", "src_ip", "").alias("server_ip"),
        end("dst_port", "src_port", -1).alias("server_port"),
        F.coalesce("seq", F.lit(-1)).cast("long").alias("seq_key"))


def pair_procedures(messages: DataFrame, split: Split = None) -> DataFrame:
    """One row per answered or timed-out request.

    Rows between two answers of a key form one round: the first request of the
    round is the one answered, later ones are retransmissions; a round without a
    request is an orphan response and gives nothing; a round without a response
    is a timeout of zero duration.  The kind of an answered procedure is its
    response's.  Messages that carry a flow_id give it on: the request's, else
    the response's (C7).
    """
    linked = ["flow_id"] if "flow_id" in messages.columns else []
    rounds = scan(exchanges(messages), PAIR_KEY, "msg_no", split=split,
                  round=count_before(F.col("role") == "response"))
    no = F.col("msg_no")
    asks, answers = F.col("role") == "request", F.col("role") == "response"
    paired = rounds.groupBy(*PAIR_KEY, "round").agg(
        F.min_by(F.struct("ts", "name", "kind", "msg_no", *linked), F.when(asks, no)).alias("req"),
        F.min_by(F.struct("ts", "name", "kind", "cause_code", "cause", "msg_no", *linked),
                 F.when(answers, no)).alias("rsp"),
        F.count(F.when(asks, 1)).alias("sends"),
    ).filter(F.col("req").isNotNull())
    req, rsp = F.col("req"), F.col("rsp")
    answered = rsp.isNotNull()
    return paired.select(
        "run_id",
        F.coalesce(rsp["kind"], req["kind"]).alias("kind"),
        req["ts"].alias("start_ts"),
        F.coalesce(rsp["ts"], req["ts"]).alias("end_ts"),
        req["name"].alias("start_msg"),
        rsp["name"].alias("end_msg"),
        F.when(answered, outcome_of(rsp["cause_code"])).otherwise("timeout").alias("outcome"),
        rsp["cause_code"].alias("cause"),
        rsp["cause"].alias("cause_name"),
        req["msg_no"].alias("req_no"),
        rsp["msg_no"].alias("rsp_no"),
        F.col("seq_key").alias("seq"),
        "sends",
        ((F.coalesce(rsp["ts"], req["ts"]) - req["ts"]) * 1000.0).alias("duration_ms"),
        *[F.coalesce(req[c], rsp[c]).alias(c) for c in linked])


def in_order(procs: DataFrame) -> DataFrame:
    """Number procedures by start time; answered ones first, in answer order (P5).

    Runs are cut by ranges of all of these, so any number of procedures may start at one time.
    """
    late = F.col("rsp_no").isNull()
    keyed = procs.select("*", F.when(late, 1).otherwise(0).alias("_late"),
                         F.coalesce("rsp_no", "req_no").alias("_arrival"))
    ties = ("_late", "_arrival")
    laid = dealt(written(keyed), ["run_id", "start_ts", *ties])
    return scan(laid, ["run_id"], "start_ts", ties=ties, bucket=F.col("_part"),
                proc_no=position()).drop(*ties, "_part")


def unpaired_requests(procs: DataFrame) -> DataFrame:
    """Requests never answered, per run."""
    return procs.groupBy("run_id").agg(
        F.count(F.when(F.col("outcome") == "timeout", 1)).alias("unpaired_requests"))


def flag_retransmits(messages: DataFrame, split: Split = None) -> DataFrame:
    """Flag the second and later messages with equal addresses and seq.

    Ports and message type are not compared, and missing values are equal.
    Only the first message of a key stays unflagged, so a hot key needs no order
    beyond its minimum.
    """
    keyed = messages.select(
        "*", F.coalesce("src_ip", F.lit("")).alias("_src"),
        F.coalesce("dst_ip", F.lit("")).alias("_dst"),
        F.coalesce("seq", F.lit(-1)).cast("long").alias("_seq"))
    key = ["run_id", "_src", "_dst", "_seq"]
    firsts = keyed.groupBy(*key).agg(F.min("msg_no").alias("msg_no")).select("run_id", "msg_no")
    return (messages.join(firsts.withColumn("_first", F.lit(True)), ["run_id", "msg_no"], "left")
            .withColumn("retransmit", F.col("_first").isNull()).drop("_first"))


def retransmit_bursts(messages: DataFrame, procs: DataFrame) -> DataFrame:
    """Sends per timed-out request beside all requests of its seq."""
    key = ["run_id", "seq"]
    sends = exchanges(messages).filter(F.col("role") == "request").groupBy(
        "run_id", F.col("seq_key").alias("seq")).agg(F.count(F.lit(1)).alias("requests"))
    lost = procs.filter(F.col("outcome") == "timeout").groupBy(*key).agg(
        F.count(F.lit(1)).alias("timeouts"), F.max("sends").alias("max_burst"))
    return sends.join(lost, key, "left").fillna(0, ["timeouts", "max_burst"])
