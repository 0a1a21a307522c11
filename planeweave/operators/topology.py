"""Network roles inferred from message directions, and per-device summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.text import fixed

# Messages whose direction proves a role, and the reasons given.
FIRST_UPLINK = "InitialUEMessage"
ASSOCIATION = "association setup request"
ESTABLISHMENT = "pfcp session establishment request"
NO_N2 = "no IP-carrying N2 message"
NO_N4 = "no N4 capture"
NO_PROOF = "no PFCP CP->UP message (only heartbeats)"


def seconds(ts: Column) -> Column:
    """A time with three decimals."""
    return fixed(ts)


def _roles(proof: DataFrame, src_role: str, dst_role: str) -> DataFrame:
    """Two rows per run from its proof row (src, dst, evidence)."""
    return proof.select("run_id", F.explode(F.array(
        F.struct(F.lit(src_role).alias("role"), F.col("src").alias("ip"), "evidence"),
        F.struct(F.lit(dst_role).alias("role"), F.col("dst").alias("ip"), "evidence"),
    )).alias("r")).select("run_id", "r.*")


def n2_roles(flow_messages: DataFrame) -> DataFrame:
    """gNB and AMF from the first InitialUEMessage in flow, then message order (O1)."""
    usable = ((F.col("ngap") == FIRST_UPLINK) & (F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    first = flow_messages.groupBy("run_id").agg(
        F.min("ts").alias("t0"),
        F.min_by(F.struct("src_ip", "dst_ip", "ts", "flow_id"),
                 F.when(usable, F.struct("flow_id", "msg_no"))).alias("m"))
    m = F.col("m")
    told = F.concat(F.lit(FIRST_UPLINK + " src/dst @ +"), seconds(m.ts - F.col("t0")),
                    F.lit("s (N2, flow "), m.flow_id.cast("string"), F.lit(")"))
    return _roles(first.select(
        "run_id", F.coalesce(m.src_ip, F.lit("unknown")).alias("src"),
        F.coalesce(m.dst_ip, F.lit("unknown")).alias("dst"),
        F.coalesce(told, F.lit(NO_N2)).alias("evidence")), "gNB", "AMF")


def n4_roles(runs: DataFrame, n4: DataFrame) -> DataFrame:
    """SMF and UPF from the first association set-up request, else the first
    session-establishment request (O2)."""
    name = F.lower("name")
    rank = F.when(name.contains(ASSOCIATION), 0).when(name.contains(ESTABLISHMENT), 1)
    usable = rank.isNotNull() & (F.col("src_ip") != "") & (F.col("dst_ip") != "")
    first = n4.groupBy("run_id").agg(
        F.min("ts").alias("t0"),
        F.min_by(F.struct("src_ip", "dst_ip", "ts", "name"),
                 F.when(usable, F.struct(rank, F.col("msg_no")))).alias("m"))
    m = F.col("m")
    told = F.concat(m["name"], F.lit(" src/dst @ +"), seconds(m.ts - F.col("t0")), F.lit("s (N4)"))
    return _roles(runs.select("run_id").distinct().join(first, "run_id", "left").select(
        "run_id", F.coalesce(m.src_ip, F.lit("unknown")).alias("src"),
        F.coalesce(m.dst_ip, F.lit("unknown")).alias("dst"),
        F.coalesce(told, F.when(F.col("t0").isNull(), NO_N4).otherwise(NO_PROOF))
        .alias("evidence")), "SMF", "UPF")


def ue_summary(flow_messages: DataFrame, flows: DataFrame, procs: DataFrame) -> DataFrame:
    """Per flow: ids, size, distinct causes in first-seen order, procedures (O3).

    Causes and procedures come as one text column each.
    """
    key = ["run_id", "flow_id"]
    nas = F.col("nas")
    causes = flow_messages.filter(nas["cause"].isNotNull()).groupBy(
        *key, nas["cause"].alias("code"), nas["cause_name"].alias("name")).agg(
        F.min("msg_no").alias("no"))
    listed = causes.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("no", "code", "name"))),
        lambda c: F.concat(F.lit("#"), c.code.cast("string"), F.lit(" "),
                           F.coalesce(c["name"], F.lit("None")))), "; ").alias("causes"))
    counted = procs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("procedures"),
        F.count(F.when(F.col("outcome") == "accept", 1)).alias("accepted"))
    return (flows.select(*key, "ran_ue_id", "amf_ue_id", "partial", "messages")
            .join(listed, key, "left").join(counted, key, "left")
            .fillna("", ["causes"]).fillna(0, ["procedures", "accepted"]))
