"""Transport rules over tables of dissected packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import Split, any_ahead, count_before, scan
from planeweave.operators.sbi import connection

# Protocol id, ports, the HTTP/2 client preface and the refusal note.
NGAP_PPID, PFCP_PORT, SBI_PORT = 60, 8805, 7777
PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
MIDSTREAM = "h2 decode failed: no HTTP/2 client preface (capture started midstream?)"
STREAM_KEY = ["run_id", "sport", "dport", "stream_id"]


def _first_of(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row per key.  Copies are folded before the shuffle, so a key
    repeated millions of times sends one row per task."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(row, order).alias("r")).select("r.*")


def dedup_sctp(chunks: DataFrame) -> DataFrame:
    """N2 payload chunks without retransmissions.

    The key is directional (sport, dport) and TSN; addresses are not in it.
    """
    data = chunks.filter((F.col("ppid") == NGAP_PPID) & (F.length("data") > 0))
    return _first_of(data, ["run_id", "sport", "dport", "tsn"], F.struct("pkt_no", "chunk_no"))


def reassemble(chunks: DataFrame, split: Split = None) -> DataFrame:
    """Messages put together from chunks per association and stream.

    Chunks join in capture order, by packet and by place in it, up to one that ends the
    message, which gives the time and addresses.  A tail that no chunk ends is dropped before
    anything is collected, so a group is one message.
    """
    placed = scan(chunks, STREAM_KEY, "pkt_no", ties=("chunk_no",), split=split,
                  message=count_before(F.col("ending")), ends=any_ahead(F.col("ending")))
    part, last = F.struct("pkt_no", "chunk_no", "data"), F.struct("pkt_no", "chunk_no")
    joined = placed.filter("ends").groupBy(*STREAM_KEY, "message").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max_by(F.struct("ts", "src_ip", "dst_ip", "pkt_no", "chunk_no"), last).alias("last"))
    # Joined as text of hexadecimal digits, in one pass over the parts.
    data = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return joined.select(*STREAM_KEY, "last.*", data.alias("data"))


def pfcp_datagrams(datagrams: DataFrame) -> DataFrame:
    """Non-empty datagrams from or to the N4 port."""
    return datagrams.filter(((F.col("sport") == PFCP_PORT) | (F.col("dport") == PFCP_PORT))
                            & (F.length("payload") > 0))


def sbi_segments(segments: DataFrame) -> DataFrame:
    """Non-empty segments from or to the SBI port, trimmed to the length the IP
    header declares (T4).  A declared length of 0 keeps the segment, emptied."""
    expected = F.col("ip_len") - (F.col("ihl") + F.col("dataofs")) * 4
    padded = (expected >= 0) & (expected < F.length("payload"))
    kept = F.when(padded, F.substring("payload", F.lit(1), expected)).otherwise(F.col("payload"))
    return segments.filter(
        ((F.col("sport") == SBI_PORT) | (F.col("dport") == SBI_PORT))
        & (F.length("payload") > 0)).withColumn("payload", kept)


def dedup_tcp(segments: DataFrame) -> DataFrame:
    """Segments without retransmissions: same endpoints in the same direction, same
    sequence number, same trimmed length; the first one stays (T5)."""
    keyed = segments.select(
        "*", F.length("payload").alias("size"), F.coalesce("src_ip", F.lit("")).alias("src"),
        F.coalesce("dst_ip", F.lit("")).alias("dst"))
    return _first_of(keyed, ["run_id", "src", "sport", "dst", "dport", "seq", "size"],
                     F.col("pkt_no")).drop("size", "src", "dst")


def with_connection(segments: DataFrame) -> DataFrame:
    """Add `conn`, the unordered endpoint pair."""
    return segments.withColumn("conn", connection("src_ip", "sport", "dst_ip", "dport"))


def midstream_connections(segments: DataFrame) -> DataFrame:
    """One refused row per connection on which no direction starts with the client
    preface, stamped with the direction seen first (T7)."""
    conn = segments if "conn" in segments.columns else with_connection(segments)
    first = F.struct("ts", "pkt_no", "src_ip", "dst_ip", "sport", "dport")
    directions = conn.groupBy("run_id", "conn", "src_ip", "sport", "dst_ip", "dport").agg(
        F.min_by(F.substring("payload", 1, len(PREFACE)), "pkt_no").alias("head"),
        F.min_by(first, "pkt_no").alias("first"))
    opened = directions.groupBy("run_id", "conn").agg(
        F.max(F.col("head") == F.lit(PREFACE)).alias("synced"),
        F.min("first").alias("f"))
    return opened.filter(~F.col("synced")).select(
        "run_id", "conn", F.col("f.ts").alias("ts"), F.lit(0).cast("long").alias("stream_id"),
        F.lit("request").alias("direction"), F.lit(MIDSTREAM).alias("unparsed"),
        F.col("f.src_ip").alias("src_ip"), F.col("f.dst_ip").alias("dst_ip"),
        F.col("f.sport").alias("src_port"), F.col("f.dport").alias("dst_port"))
