"""Streamed forms of deduplication (T5) and request/response pairing.

Messages carry `event_time`.  A stream has no end of capture: a request is timed
out when no answer came within the deadline, which the watermark decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_segments(segments: DataFrame, delay: str) -> DataFrame:
    """Segments without retransmissions that arrive within `delay` of the first."""
    return (segments.withWatermark("event_time", delay)
            .withColumn("size", F.length("payload"))
            .dropDuplicatesWithinWatermark(
                ["run_id", "src_ip", "sport", "dst_ip", "dport", "seq", "size"]).drop("size"))


def pair_requests(messages: DataFrame, deadline: str, delay: str) -> DataFrame:
    """Each request with its answer, or as a timeout once the deadline has passed.

    `messages`: run_id, conn, stream_id, direction, ts, event_time, msg_no, status.
    """
    def side(direction: str, prefix: str) -> DataFrame:
        return messages.filter(F.col("direction") == direction).withWatermark(
            "event_time", delay).select(
            *[F.col(c).alias(f"{prefix}_{c}") for c in (
                "run_id", "conn", "stream_id", "ts", "event_time", "msg_no", "status")])

    requests, responses = side("request", "req"), side("response", "rsp")
    on = ((F.col("req_run_id") == F.col("rsp_run_id")) & (F.col("req_conn") == F.col("rsp_conn"))
          & (F.col("req_stream_id") == F.col("rsp_stream_id"))
          & (F.col("rsp_event_time") >= F.col("req_event_time"))
          & (F.col("rsp_event_time") <= F.col("req_event_time") + F.expr(f"INTERVAL {deadline}")))
    status = F.col("rsp_status")
    return requests.join(responses, on, "leftOuter").select(
        F.col("req_run_id").alias("run_id"), F.col("req_conn").alias("conn"),
        F.col("req_stream_id").alias("stream_id"), F.col("req_ts").alias("start_ts"),
        F.coalesce("rsp_ts", "req_ts").alias("end_ts"),
        F.when(F.col("rsp_msg_no").isNull(), "timeout").when(status.between(200, 299), "accept")
        .otherwise("reject").alias("outcome"),
        F.col("req_msg_no").alias("req_no"), F.col("rsp_msg_no").alias("rsp_no"))
