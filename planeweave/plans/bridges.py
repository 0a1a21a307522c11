"""Views that present the given tables as signalling tables.

Each view is a list of SQL expressions that Spark and an ANSI SQL engine read
alike, so the check SQL starts from the same rows.  Every row of the source
table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.session import tune, written

# ev: events with the time in epoch seconds and the JSON number as k.
EV_SPARK = [
    "event_id", "user_id", "event_type", "value",
    "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t",
    "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    "props",
]
EV_SQL = """SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events"""

RUN = "'run' || CAST(user_id % 8 AS STRING)"
UPLINK = "event_type IN ('signup', 'click', 'error')"

# n2: one N2 message per event, its NAS payload flattened.
N2_COLUMNS = [
    f"{RUN} AS run_id",
    "event_id AS msg_no",
    "t AS ts",
    f"CASE WHEN {UPLINK} THEN '10.53.0.2' ELSE '10.53.0.1' END || CAST(user_id % 8 AS STRING)"
    " AS src_ip",
    f"CASE WHEN {UPLINK} THEN '10.53.0.1' ELSE '10.53.0.2' END || CAST(user_id % 8 AS STRING)"
    " AS dst_ip",
    f"CAST(CASE WHEN {UPLINK} THEN 40000 + CAST(floor(user_id / 64) AS BIGINT) ELSE 38412 END"
    " AS INT) AS sport",
    f"CAST(CASE WHEN {UPLINK} THEN 38412 ELSE 40000 + CAST(floor(user_id / 64) AS BIGINT) END"
    " AS INT) AS dport",
    """CASE event_type
         WHEN 'signup' THEN 'InitialUEMessage'
         WHEN 'view' THEN CASE WHEN k = 98 THEN NULL
                               WHEN k % 3 = 0 THEN 'PDUSessionResourceSetupRequest'
                               ELSE 'DownlinkNASTransport' END
         WHEN 'click' THEN CASE WHEN k % 4 = 0 THEN 'InitialContextSetupRequest'
                                WHEN k % 4 = 1 THEN 'PDUSessionResourceSetupResponse'
                                WHEN k % 4 = 2 THEN 'UplinkNASTransport'
                                ELSE 'InitialContextSetupFailure' END
         WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'DownlinkNASTransport'
                                   ELSE 'InitialContextSetupRequest' END
         ELSE CASE WHEN k % 5 = 0 THEN 'UEContextReleaseCommand'
                   WHEN k % 5 = 1 THEN 'ErrorIndication'
                   ELSE 'UplinkNASTransport' END END AS ngap""",
    """CASE WHEN event_type = 'view' AND k = 98 THEN NULL
            WHEN event_type IN ('signup', 'error') THEN 'initiatingMessage'
            ELSE 'successfulOutcome' END AS kind""",
    """CASE WHEN event_type = 'error' AND k % 5 = 1 THEN NULL
            WHEN k = 99 THEN NULL ELSE user_id END AS ran_ue_id""",
    """CASE WHEN event_type = 'signup' THEN NULL
            WHEN event_type = 'error' AND k % 5 = 1 THEN NULL
            ELSE 1000 + user_id END AS amf_ue_id""",
    """CASE event_type
         WHEN 'signup' THEN CASE WHEN k < 70 THEN '5GMMRegistrationRequest' END
         WHEN 'view' THEN CASE WHEN k % 3 < 2 THEN 'FGMMSecProtNASMessage' END
         WHEN 'click' THEN CASE WHEN k % 4 = 2 THEN '5GMMULNASTransport' END
         WHEN 'purchase' THEN 'FGMMSecProtNASMessage'
         ELSE CASE WHEN k % 5 = 2 THEN '5GMMRegistrationReject'
                   WHEN k % 5 = 3 THEN 'FGMMSecProtNASMessage'
                   WHEN k % 5 = 4 THEN '5GMMStatus' END END AS nas_name""",
    """(event_type = 'view' AND k % 3 < 2) OR event_type = 'purchase'
       OR (event_type = 'error' AND k % 5 = 3) AS nas_protected""",
    """CAST(CASE WHEN event_type = 'view' AND k % 3 = 1 THEN 3
                 WHEN event_type = 'purchase' AND k = 97 THEN NULL
                 WHEN event_type IN ('view', 'purchase', 'error') THEN 2 END AS INT) AS nas_shdr""",
    """CASE event_type
         WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN '5GSMPDUSessionEstabRequest'
                               WHEN k % 3 = 1 THEN '5GMMSecurityModeCommand' END
         WHEN 'click' THEN CASE WHEN k % 4 = 2 THEN '5GSMPDUSessionEstabRequest' END
         WHEN 'purchase' THEN CASE WHEN k = 96 THEN NULL
                                   WHEN k % 2 = 0 THEN '5GSMPDUSessionEstabAccept'
                                   ELSE '5GMMRegistrationAccept' END
         ELSE CASE WHEN k % 5 = 3 THEN '5GSMPDUSessionEstabReject' END END AS nas_inner""",
    """CAST(CASE WHEN event_type = 'error' AND k % 5 = 2 THEN 3 + k % 7
                 WHEN event_type = 'error' AND k % 5 = 3 THEN 67
                 WHEN event_type = 'error' AND k % 5 = 4 THEN 91
                 WHEN event_type = 'click' AND k % 8 = 2 THEN 90 END AS INT) AS nas_cause""",
    """CAST(CASE WHEN event_type = 'view' AND k % 3 = 1
                 THEN CASE WHEN user_id % 7 = 0 THEN 2 ELSE 0 END END AS INT) AS nas_ciph""",
    """CASE WHEN event_type = 'signup' AND k < 70
            THEN '99970' || lpad(CAST(user_id % 120 AS STRING), 10, '0') END AS nas_supi""",
    """CASE WHEN event_type = 'click' AND k % 4 = 1 THEN user_id * 100 + k % 40
            WHEN event_type = 'view' AND k % 3 = 0 AND k < 98 THEN user_id * 100 + k % 40
       END AS teid""",
    """CASE WHEN event_type = 'click' THEN '10.53.0.20'
            WHEN k = 96 THEN '10.53.0.20' ELSE '10.53.0.30' END AS tip""",
    """CASE WHEN event_type = 'view' AND k = 98 THEN 'NGAP decode failed: truncated' END
       AS unparsed""",
]

# n4: one PFCP message per event.
N4_FORWARD = ("(event_type IN ('click', 'view', 'signup')) = (k % 10 < 9)")
N4_COLUMNS = [
    f"{RUN} AS run_id",
    "event_id AS msg_no",
    "t AS ts",
    f"CASE WHEN {N4_FORWARD} THEN '10.53.0.12' ELSE '10.53.0.13' END AS src_ip",
    f"CASE WHEN {N4_FORWARD} THEN '10.53.0.13' ELSE '10.53.0.12' END AS dst_ip",
    "CAST(8805 + user_id % 2 AS INT) AS src_port",
    "CAST(8805 + user_id % 2 AS INT) AS dst_port",
    """CAST(CASE WHEN k = 95 THEN NULL ELSE CASE event_type
         WHEN 'click' THEN 50
         WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 54 ELSE 52 END
         WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 1 ELSE 5 END
         WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 51 ELSE 53 END
         ELSE CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 51 ELSE 57 END END END AS INT)
       AS msg_type""",
    "k % 11 AS seq",
    """CAST(CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 4 = 1 THEN NULL
                                                        ELSE 1 + k % 3 END
                 WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN NULL
                                                     ELSE 64 + k % 10 END END AS INT)
       AS cause_code""",
    """CASE WHEN event_type IN ('click', 'purchase') THEN user_id * 100 + k % 40 END AS teid1""",
    """CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN user_id * 100 + (k + 1) % 40
            WHEN event_type = 'click' AND k % 6 = 0 THEN (user_id + 8) * 100 + k % 40 END
       AS teid2""",
    """CASE WHEN event_type = 'click' THEN '10.53.0.20' ELSE '10.53.0.30' END AS tip1""",
    """CASE WHEN event_type = 'click' THEN '10.53.0.20' ELSE '10.53.0.30' END AS tip2""",
    "CASE WHEN k = 95 THEN 'PFCP decode failed: error code 1' END AS unparsed",
]
# PFCP message names by type.
N4_NAMES = {
    1: "PFCP Heartbeat Request", 2: "PFCP Heartbeat Response",
    5: "PFCP Association Setup Request", 6: "PFCP Association Setup Response",
    50: "PFCP Session Establishment Request", 51: "PFCP Session Establishment Response",
    52: "PFCP Session Modification Request", 53: "PFCP Session Modification Response",
    54: "PFCP Session Deletion Request", 55: "PFCP Session Deletion Response",
    56: "PFCP Session Report Request", 57: "PFCP Session Report Response",
}
N4_NAME = "CASE msg_type " + " ".join(
    f"WHEN {n} THEN '{name}'" for n, name in N4_NAMES.items()) + " END AS name"
N4_CAUSE = ("CASE WHEN cause_code IS NOT NULL THEN 'cause ' || CAST(cause_code AS STRING) END"
            " AS cause")

# sbi: one HTTP message per event; path and body declare an identity now and then.
SBI_REQUEST = "event_type IN ('signup', 'click', 'view')"
SBI_COLUMNS = [
    f"{RUN} AS run_id",
    "event_id AS msg_no",
    "t AS ts",
    f"CASE WHEN {SBI_REQUEST} THEN '10.53.0.11' ELSE '10.53.0.' || CAST(12 + k % 3 AS STRING) END"
    " AS src_ip",
    f"CASE WHEN {SBI_REQUEST} THEN '10.53.0.' || CAST(12 + k % 3 AS STRING) ELSE '10.53.0.11' END"
    " AS dst_ip",
    f"CAST(CASE WHEN {SBI_REQUEST} THEN 30000 + user_id ELSE 7777 END AS INT) AS src_port",
    f"CAST(CASE WHEN {SBI_REQUEST} THEN 7777 ELSE 30000 + user_id END AS INT) AS dst_port",
    "2 * CAST(floor(k / 6) AS BIGINT) + 1 AS stream_id",
    f"CASE WHEN {SBI_REQUEST} THEN 'request' ELSE 'response' END AS direction",
    f"""CASE WHEN {SBI_REQUEST} AND k <> 94 THEN
          CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END END AS method""",
    f"""CASE WHEN {SBI_REQUEST} THEN CASE
          WHEN event_type = 'click' THEN '/nsmf-pdusession/v1/sm-contexts'
          WHEN k % 7 = 0 THEN '/nudm-ueau/v1/suci-0-999-70-0000-0-0-'
               || lpad(CAST(user_id % 120 AS STRING), 10, '0') || '/security-information'
          WHEN k % 7 = 1 THEN '/nudm-sdm/v2/imsi-99970'
               || lpad(CAST(user_id % 120 AS STRING), 10, '0') || '/am-data'
          WHEN k % 7 = 2 THEN '/nnssf-nsselection/v2/network-slice-information'
          WHEN k % 7 = 3 THEN '/nausf-auth/v1/ue-authentications'
          WHEN k % 7 = 4 THEN '/npcf-am_policy-control/v1/policies'
          WHEN k % 7 = 5 THEN '/nudm-uecm/v1/suci-0-999-70-0000-1-0-'
               || lpad(CAST(user_id AS STRING), 10, '0') || '/registrations'
          ELSE '/' END END AS path""",
    f"""CAST(CASE WHEN {SBI_REQUEST} THEN NULL WHEN k = 96 THEN NULL
             WHEN event_type = 'purchase' THEN 200 + k % 5
             ELSE 400 + k % 4 END AS INT) AS status""",
    """CASE WHEN event_type = 'click' AND k % 3 > 0
            THEN '{"supi": "imsi-99970' || lpad(CAST((user_id + CAST(floor(k / 90) AS BIGINT))
                 % 120 AS STRING), 10, '0') || '", "pduSessionId": ' || CAST(k AS STRING) || '}'
            WHEN event_type = 'signup' AND k % 7 = 1
            THEN '{"supi": "imsi-99970' || lpad(CAST(user_id % 120 + k % 2 AS STRING), 10, '0')
                 || '"}'
            WHEN event_type = 'error' AND k % 2 = 0
            THEN '{"title": "Denied ' || CAST(k % 3 AS STRING) || '", "cause": "'
                 || CASE WHEN k % 4 = 0 THEN 'USER_UNKNOWN' ELSE '' END || '"}'
       END AS body""",
    "CASE WHEN k = 93 THEN 'stream reset' END AS note",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*EV_SPARK)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planes need of `ev`, written once for all planes of a query.

    A filter on a plane moves below the view and would parse the JSON text again for every `k` in it;
    here `k` is a stored number.  Rows are dealt out anew, so a table of few files or row groups
    keeps every core busy.
    """
    return written(ev(spark, sf_dir).select("event_id", "user_id", "event_type", "t", "k").repartition("event_id"))


def _given(spark: SparkSession, sf_dir: str, events: DataFrame | None) -> DataFrame:
    return ev(spark, sf_dir) if events is None else events


def _n2_struct(flat: DataFrame) -> DataFrame:
    nas = F.when(F.col("nas_name").isNotNull(), F.struct(
        F.col("nas_name").alias("name"), F.col("nas_protected").alias("protected"),
        F.col("nas_shdr").alias("shdr"), F.col("nas_inner").alias("inner"),
        F.col("nas_cause").alias("cause"),
        F.concat(F.lit("cause "), F.col("nas_cause").cast("string")).alias("cause_name"),
        F.col("nas_ciph").alias("ciph_algo"), F.lit(None).cast("int").alias("integ_algo"),
        F.col("nas_supi").alias("supi"), F.lit(None).cast("string").alias("guti"),
        F.lit(None).cast("string").alias("unparsed")))
    tunnels = F.when(F.col("teid").isNotNull(), F.array(F.struct("teid", F.col("tip").alias("ip"))))
    return flat.select(
        "run_id", "msg_no", "ts", "src_ip", "dst_ip", "sport", "dport",
        F.lit(0).alias("stream_id"), "ngap", "kind", "ran_ue_id", "amf_ue_id",
        nas.alias("nas"), tunnels.alias("f_teids"), "unparsed")


def n2(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    return _n2_struct(_given(spark, sf_dir, events).selectExpr(*N2_COLUMNS))


def n4(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    flat = _given(spark, sf_dir, events).selectExpr(*N4_COLUMNS).selectExpr("*", N4_NAME, N4_CAUSE)
    keys = F.array_compact(F.array(
        F.when(F.col("teid1").isNotNull(), F.struct(F.col("teid1").alias("teid"),
                                                    F.col("tip1").alias("ip"))),
        F.when(F.col("teid2").isNotNull(), F.struct(F.col("teid2").alias("teid"),
                                                    F.col("tip2").alias("ip")))))
    return flat.withColumn("f_teids", keys).drop("teid1", "teid2", "tip1", "tip2").withColumn(
        "seid", F.lit(None).cast("decimal(20,0)")).withColumn(
        "user_id", F.lit(None).cast("string")).withColumn("ue_ip", F.lit(None).cast("string"))


def sbi_raw(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """SBI messages before naming and identity rules."""
    return _given(spark, sf_dir, events).selectExpr(*SBI_COLUMNS)
