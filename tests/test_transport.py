import pytest
from build import rows
from pyspark.sql import functions as F

from planeweave import schemas
from planeweave.operators import transport as t
from planeweave.streaming import pairing


def chunk(pkt, no=0, tsn=None, data=b"x", ending=True, ppid=60, sport=1, dport=2, stream=0, ip="a"):
    return ("r", pkt, no, float(pkt), ip, "b", sport, dport, ppid, pkt if tsn is None else tsn,
            stream, ending, bytearray(data))


def test_sctp_dedup_is_directional_and_ignores_addresses(spark):
    df = spark.createDataFrame([
        chunk(0, tsn=5), chunk(1, tsn=5, ip="other"), chunk(2, tsn=5, sport=2, dport=1),
        chunk(3, ppid=0), chunk(4, data=b"")], schemas.SCTP_CHUNKS)
    assert rows(t.dedup_sctp(df), "pkt_no") == [(0,), (2,)]


@pytest.mark.parametrize("split", [None, 2])
def test_reassembly_keeps_capture_order_and_drops_the_tail(spark, split):
    df = spark.createDataFrame([
        chunk(0, tsn=9, data=b"A", ending=False), chunk(1, tsn=3, data=b"B", ip="z"),
        chunk(1, no=1, data=b"C"), chunk(2, data=b"D", ending=False, stream=1),
        chunk(3, data=b"E", ending=False), chunk(4, data=b"F", stream=1)], schemas.SCTP_CHUNKS)
    got = t.reassemble(df, split).select("data", "ts", "src_ip").collect()
    assert sorted((bytes(r.data), r.ts, r.src_ip) for r in got) == [
        (b"AB", 1.0, "z"), (b"C", 1.0, "a"), (b"DF", 4.0, "a")]


def seg(pkt, payload, seq=0, ip_len=0, src="a", sport=1, dst="b", dport=7777):
    return ("r", pkt, float(pkt), src, dst, sport, dport, seq, ip_len, 5, 5, bytearray(payload))


def test_trim_keeps_an_emptied_segment_and_dedup_uses_the_trimmed_length(spark):
    df = spark.createDataFrame([
        seg(0, b"abc", ip_len=40), seg(1, b"abc", seq=1, ip_len=42), seg(2, b"ab", seq=1, ip_len=42),
        seg(3, b"abc", seq=1, ip_len=10), seg(4, b"x", dport=80), seg(5, b"")], schemas.TCP_SEGMENTS)
    trimmed = t.sbi_segments(df)
    assert [(r.pkt_no, bytes(r.payload)) for r in trimmed.orderBy("pkt_no").collect()] == [
        (0, b""), (1, b"ab"), (2, b"ab"), (3, b"abc")]
    assert rows(t.dedup_tcp(trimmed), "pkt_no") == [(0,), (1,), (3,)]


def test_midstream_is_judged_by_the_first_payload_of_each_direction(spark):
    back = {"src": "b", "sport": 7777, "dst": "a", "dport": 1}
    late = {"src": "c", "sport": 3}
    df = spark.createDataFrame([
        seg(0, b"late", **back), seg(1, t.PREFACE + b"x"), seg(2, b"y"),
        seg(3, b"junk", **late), seg(4, t.PREFACE, **late)], schemas.TCP_SEGMENTS)
    assert rows(t.midstream_connections(df), "src_ip", "src_port", "ts") == [("c", 3, 3.0)]


def test_pfcp_port_on_either_side(spark):
    df = spark.createDataFrame([("r", i, 0.0, "a", "b", s, d, bytearray(p)) for i, (s, d, p) in
                                enumerate([(8805, 1, b"x"), (1, 8805, b"x"), (1, 2, b"x"),
                                           (8805, 8805, b"")])], schemas.UDP_DATAGRAMS)
    assert rows(t.pfcp_datagrams(df), "pkt_no") == [(0,), (1,)]


def _streamed(spark, df, path, name, make):
    df.write.parquet(path)
    stream = make(spark.readStream.schema(df.schema).parquet(path))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_dedup_equals_the_batch_rule(spark, tmp_path):
    df = spark.createDataFrame([seg(0, b"a"), seg(1, b"a"), seg(2, b"ab"), seg(3, b"a", seq=1)],
                               schemas.TCP_SEGMENTS).coalesce(1)
    timed = df.withColumn("event_time", F.timestamp_seconds("ts"))
    got = _streamed(spark, timed, str(tmp_path / "s"), "dedup",
                    lambda s: pairing.dedup_segments(s, "1 minute"))
    assert got.count() == t.dedup_tcp(df).count() == 3


def test_streamed_pairing(spark, tmp_path):
    made = [("r", "c", 1, "request", 0.0, 0, None), ("r", "c", 1, "response", 2.0, 1, 404),
            ("r", "c", 3, "request", 3.0, 2, None), ("r", "c", 9, "request", 500.0, 3, None),
            ("r", "c", 9, "response", 500.5, 4, 204)]
    df = spark.createDataFrame(made, "run_id string, conn string, stream_id bigint, direction "
                               "string, ts double, msg_no bigint, status int").withColumn(
        "event_time", F.timestamp_seconds(F.col("ts") + 1e6))
    got = _streamed(spark, df, str(tmp_path / "s"), "pairs",
                    lambda s: pairing.pair_requests(s, "10 SECONDS", "5 seconds"))
    assert {(r.req_no, r.outcome) for r in got.collect()} >= {(0, "reject"), (2, "timeout"),
                                                              (3, "accept")}
