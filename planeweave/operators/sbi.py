"""SBI plane: HTTP messages, their refusal and pairing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions import http
from planeweave.functions.scan import dealt, position, scan
from planeweave.session import written

STREAM_KEY = ["run_id", "conn", "stream_id"]


def connection(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip",
               dst_port="dst_port") -> Column:
    """The unordered endpoint pair as text; a reused port joins its connections."""
    def endpoint(ip: str, port: str) -> Column:
        return F.concat(F.coalesce(F.col(ip), F.lit("?")), F.lit(":"),
                        F.coalesce(F.col(port).cast("string"), F.lit("?")))

    return F.array_join(F.array_sort(F.array(endpoint(src_ip, src_port),
                                             endpoint(dst_ip, dst_port))), "|")


def name_messages(raw: DataFrame) -> DataFrame:
    """Names, identities, problem details and refusals of raw HTTP messages.

    `note` says why a message was refused by itself (a reset stream, say).  A
    refused request loses its name; its response is refused with it; any other
    response takes the name of the last request on its stream.
    """
    is_request = F.col("direction") == "request"
    keyed = raw.withColumn("conn", connection())
    requests = keyed.filter(is_request).groupBy(*STREAM_KEY).agg(
        F.max_by(F.struct(
            F.col("note").alias("note"),
            F.when(F.col("note").isNull(), http.service_name(F.coalesce("path", F.lit(""))))
            .alias("name")), "msg_no").alias("req"))
    joined = keyed.join(requests, STREAM_KEY, "left")
    own, asked = F.col("note"), F.col("req")
    inherited = F.when(asked.isNotNull() & asked["name"].isNull(),
                       F.concat(F.lit("response to refused request: "), asked["note"]))
    unparsed = F.when(is_request, own).otherwise(F.coalesce(inherited, own))
    name = F.when(own.isNotNull(), None).otherwise(
        F.when(is_request, http.service_name(F.coalesce("path", F.lit(""))))
        .otherwise(asked["name"]))
    declared = http.agreed_identity(http.supi_from_path(F.coalesce("path", F.lit(""))),
                                    http.supi_from_body(F.col("body")))
    kept = [c for c in raw.columns if c not in ("note", "body")]
    return joined.select(
        *kept, "conn", name.alias("name"), unparsed.alias("unparsed"),
        F.when(is_request & own.isNull(), declared).alias("supi"),
        F.when(~is_request, http.problem_field(F.col("body"), "title")).alias("problem_title"),
        F.when(~is_request, http.problem_field(F.col("body"), "cause")).alias("problem_cause"))


def body_lengths(frames: DataFrame) -> DataFrame:
    """Flow-controlled bytes per stream and direction."""
    return frames.groupBy(*STREAM_KEY, "direction").agg(F.sum("length").alias("body_len"))


def in_capture_order(messages: DataFrame) -> DataFrame:
    """`msg_no`, 0-based: by time; ties by connection, client side first, then
    position within the direction (B8).

    Input rows carry `conn_first_no`, `dir_rank` and `seq_no`.  Runs are cut by ranges of
    all of these, so any number of messages may share one time.
    """
    ties = ("conn_first_no", "dir_rank", "seq_no")
    laid = dealt(written(messages), ["run_id", "ts", *ties])
    numbered = scan(laid, ["run_id"], "ts", ties=ties, bucket=F.col("_part"), _no=position())
    return numbered.withColumn("msg_no", F.col("_no") - 1).drop("_no", "_part")


def pair_procedures(messages: DataFrame) -> DataFrame:
    """One row per request stream, with its outcome.

    Refused messages take no part.  When a side repeats on a stream its last
    message counts; time order is not checked.  Any status but 2xx is a reject.
    Messages that carry a flow_id give it on: a procedure has the flow of the
    last request of its stream, which is none when that request was refused (C7).
    """
    asks = F.col("direction") == "request"
    decoded = F.col("unparsed").isNull()
    no = F.col("msg_no")
    linked = "flow_id" in messages.columns
    flow = [F.max_by("flow_id", F.when(asks, no)).alias("flow_id")] if linked else []
    paired = messages.filter(F.col("conn").isNotNull()).groupBy(*STREAM_KEY).agg(
        F.max_by(F.struct("ts", "name", "method", "path", "msg_no"),
                 F.when(asks & decoded, no)).alias("req"),
        F.max_by(F.struct("ts", "status", "msg_no"),
                 F.when(~asks & decoded, no)).alias("rsp"),
        *flow,
    ).filter(F.col("req").isNotNull())
    req, rsp = F.col("req"), F.col("rsp")
    status = F.coalesce(rsp["status"], F.lit(0))
    method = F.nullif(req["method"], F.lit(""))
    return paired.select(
        *STREAM_KEY,
        F.coalesce(F.nullif(req["name"], F.lit("")), F.lit("unknown")).alias("kind"),
        req["ts"].alias("start_ts"),
        F.coalesce(rsp["ts"], req["ts"]).alias("end_ts"),
        F.when(method.isNotNull(),
               F.concat(method, F.lit(" "), F.coalesce(req["path"], F.lit("None"))))
        .otherwise(F.coalesce(F.nullif(req["path"], F.lit("")), F.lit("?"))).alias("start_msg"),
        F.when(rsp.isNotNull(), F.coalesce(rsp["status"].cast("string"), F.lit("None")))
        .alias("end_msg"),
        F.when(rsp.isNull(), "timeout").when(status.between(200, 299), "accept")
        .otherwise("reject").alias("outcome"),
        rsp["status"].alias("status"),
        req["msg_no"].alias("req_no"),
        rsp["msg_no"].alias("rsp_no"),
        *(["flow_id"] if linked else []))


def unpaired_requests(procs: DataFrame) -> DataFrame:
    """Requests never answered, per run."""
    return procs.groupBy("run_id").agg(
        F.count(F.when(F.col("outcome") == "timeout", 1)).alias("unpaired_requests"))
