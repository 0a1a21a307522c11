import random

import pytest
from build import n2, n4, nas, rows
from pyspark.sql import functions as F

from planeweave import schemas
from planeweave.operators import flows, pfcp, transport
from planeweave.streaming import exchanges, procedures, reassembly

BASE = 1_000_000


def streamed(spark, df, path, name, make, last, late=3.0, batches=4):
    """Run `make` over `df` in several micro-batches; rows come up to `late` seconds out of order.

    `last`, one row far ahead in time, moves the watermark past all the others.
    """
    rng = random.Random(4)
    timed = lambda d: d.withColumn("event_time", F.timestamp_seconds(F.col("ts") + BASE))
    made = sorted(df.collect(), key=lambda r: r.ts + rng.uniform(0, late))
    cuts = [len(made) * k // batches for k in range(batches + 1)]
    schema = timed(df).schema
    for a, b in zip(cuts, cuts[1:]):
        timed(spark.createDataFrame(made[a:b], df.schema)).coalesce(1).write.mode("append").parquet(path)
    timed(last).coalesce(1).write.mode("append").parquet(path)
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    # The rows of `last` itself still wait or are pending.
    held = [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]
    return spark.table(name), held


def talk(rng, n):
    made = []
    for k in range(n):
        src, dst = ("u", "s") if rng.random() < .4 else ("s", "u")
        made.append({"src_ip": src, "dst_ip": dst, "seq": rng.choice([1, 1, 2, 3, None]), "ts": k * 0.5 + rng.choice([0, 0, 0.25]),
                     "msg_type": rng.choice([50, 50, 51, 51, 1, 2, 99]), "cause_code": rng.choice([None, 1, 64]),
                     "unparsed": rng.choice([None] * 9 + ["x"])})
    return made


def test_streamed_exchanges_equal_the_batch(spark, tmp_path):
    df = n4(spark, talk(random.Random(2), 250) + [{"ts": 126.0 + k, "seq": 50 + k % 3} for k in range(5)])
    last = n4(spark, [{"ts": 10_000.0, "seq": 99, "msg_no": 10_000}])
    got, held = streamed(spark, df, str(tmp_path / "s"), "exchanges",
                         lambda s: exchanges.pair_exchanges(s, "1000 seconds", "5 seconds"), last)
    want = pfcp.pair_procedures(df)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.filter("outcome = 'timeout'").count() > 2 and want.filter("sends > 1").count() > 2
    assert held <= 2                       # all that is left belongs to `last`


def test_a_round_times_out_and_its_number_is_used_again(spark, tmp_path):
    rsp = {"src_ip": "u", "dst_ip": "s", "msg_type": 51}
    df = n4(spark, [{"ts": 0.0}, {"ts": 4.0}, {"ts": 40.0}, {**rsp, "ts": 41.0, "cause_code": 1}, {**rsp, "ts": 42.0}])
    last = n4(spark, [{"ts": 10_000.0, "seq": 99, "msg_no": 9}])
    got, _ = streamed(spark, df, str(tmp_path / "s"), "rounds", lambda s: exchanges.pair_exchanges(s, "10 seconds", "5 seconds"),
                      last, late=0.0)
    assert rows(got, "req_no", "rsp_no", "outcome", "sends", "start_ts", "end_ts") == [
        (0, None, "timeout", 2, 0.0, 0.0), (2, 3, "accept", 1, 40.0, 41.0)]


NAS_NAMES = ["5GMMRegistrationRequest", "5GMMRegistrationAccept", "5GMMRegistrationReject", "5GSMPDUSessionEstabRequest",
             "5GSMPDUSessionEstabAccept", "5GSMPDUSessionEstabReject", "Other"]
NGAP_NAMES = ["InitialUEMessage", "InitialContextSetupRequest", "InitialContextSetupFailure", "PDUSessionResourceSetupRequest",
              "PDUSessionResourceSetupResponse", "PDUSessionResourceSetupFailure", "UEContextReleaseCommand", None]


def signalling(rng, n):
    made = []
    for k in range(n):
        sealed = rng.random() < .3
        payload = None if rng.random() < .3 else nas(
            rng.choice([*NAS_NAMES, None]), protected=sealed, shdr=rng.choice([None, 1, 2, 3, 4]) if sealed else None,
            inner=rng.choice([*NAS_NAMES, None]) if sealed else None, ciph_algo=rng.choice([None] * 6 + [0, 0, 2]),
            unparsed=rng.choice([None] * 8 + ["broken"]))
        made.append({"ts": k * 0.5, "ran_ue_id": rng.choice([1, 2, 3, 4, 5, 6, None]), "amf_ue_id": rng.choice([7, 7, None]),
                     "ngap": rng.choice(NGAP_NAMES), "nas": payload, "sport": rng.choice([40_000, 38_412]), "dport": 38_412})
    return made


def test_streamed_procedures_equal_the_batch(spark, tmp_path):
    df = n2(spark, signalling(random.Random(6), 700))
    last = n2(spark, [{"ts": 10_000.0, "ran_ue_id": 77, "msg_no": 10_000}])
    got, held = streamed(spark, df, str(tmp_path / "s"), "procedures",
                         lambda s: procedures.stream_procedures(s, "2000 seconds", "5 seconds"), last)
    keys = flows.assign_flows(df).select("flow_id", *flows.FLOW_KEY).distinct()
    want = flows.analyze_procedures(df).join(keys, ["run_id", "flow_id"]).select(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {(r.kind, r.source) for r in want.collect()} == {(k, s) for k in flows.KINDS for s in (0, 1)}
    assert held <= 2


def pieces(rng, n):
    out = []
    for pkt in range(n):
        for no in rng.sample([0, 1, 2, 4_097, 70_000], rng.choice([1, 1, 2, 3])):
            stream = rng.choice([0, 0, 1, 2])
            out.append(("r", pkt, no, float(pkt), f"a{pkt}", "b", 1, 2, 60, pkt, stream, rng.random() < .4,
                        bytearray(f"{pkt}.{no};".encode())))
    return out


@pytest.mark.parametrize("split", [None, 7])
def test_reassembly_of_any_chunk_number(spark, split):
    made = pieces(random.Random(8), 60)
    want, open_ = [], {}
    for r in sorted(made, key=lambda r: (r[1], r[2])):
        open_.setdefault(r[10], []).append(bytes(r[12]))
        if r[11]:
            want.append((r[10], r[1], r[2], b"".join(open_.pop(r[10]))))
    got = transport.reassemble(spark.createDataFrame(made, schemas.SCTP_CHUNKS), split)
    assert sorted((r.stream_id, r.pkt_no, r.chunk_no, bytes(r.data)) for r in got.collect()) == sorted(want)


def test_streamed_reassembly_equals_the_batch(spark, tmp_path):
    df = spark.createDataFrame(pieces(random.Random(9), 200), schemas.SCTP_CHUNKS)
    last = spark.createDataFrame([("r", 10_000, 0, 10_000.0, "a", "b", 1, 2, 60, 1, 99, False, bytearray(b"tail"))], schemas.SCTP_CHUNKS)
    got, held = streamed(spark, df, str(tmp_path / "s"), "messages",
                         lambda s: reassembly.stream_messages(s, "1000 seconds", "5 seconds"), last)
    want = transport.reassemble(df).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert held <= 2
