"""Packet-table rules and code fields over the events and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import codes
from planeweave.operators import transport
from planeweave.plans import bridges as b
from planeweave.plans.oracle import block
from planeweave.plans.registry import query

_RUN = f"{b.RUN} AS run_id"
_SCTP = [_RUN, "CAST(floor(event_id / 2) AS BIGINT) AS pkt_no", "CAST(event_id % 2 AS INT) AS chunk_no",
         "t AS ts", "'10.0.0.' || CAST(k AS STRING) AS src_ip", "'10.0.1.1' AS dst_ip",
         "CAST(40000 + floor(user_id / 64) AS INT) AS sport", "38412 AS dport",
         "CASE WHEN k % 20 = 0 THEN 0 ELSE 60 END AS ppid",
         "CAST(floor(event_id / 40) AS BIGINT) * 3 + k % 3 AS tsn",
         "CAST(k % 2 AS INT) AS stream_id", "k % 3 <> 0 AND value < 400 AS ending",
         "CASE WHEN k = 11 THEN '' ELSE event_type || ':' || CAST(k AS STRING) || ';' END AS body"]
block("sctp", f"SELECT {', '.join(_SCTP)} FROM ev")
block("sctpuniq", """SELECT * FROM sctp WHERE ppid = 60 AND body <> '' QUALIFY row_number() OVER (
    PARTITION BY run_id, sport, dport, tsn ORDER BY pkt_no, chunk_no) = 1""")


def sctp(spark, d):
    return b.ev(spark, d).selectExpr(*_SCTP).withColumn("data", F.encode("body", "UTF-8")).drop(
        "body")


@query("t1_sctp_retransmission_dedup", """SELECT run_id, pkt_no, chunk_no, sport, dport, tsn, body
    FROM sctpuniq""")
def _(spark, d):
    return transport.dedup_sctp(sctp(spark, d)).select(
        "run_id", "pkt_no", "chunk_no", "sport", "dport", "tsn",
        F.decode("data", "UTF-8").alias("body"))


@query("t2_chunk_reassembly", """SELECT run_id, sport, stream_id, arg_max(ts, (pkt_no, chunk_no))
      AS ts, arg_max(src_ip, (pkt_no, chunk_no)) AS src_ip,
      string_agg(body, '' ORDER BY pkt_no, chunk_no) AS body
    FROM (SELECT *, coalesce(sum(CASE WHEN ending THEN 1 ELSE 0 END) OVER (
      PARTITION BY run_id, sport, dport, stream_id ORDER BY pkt_no, chunk_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS msg FROM sctpuniq)
    GROUP BY run_id, sport, dport, stream_id, msg HAVING bool_or(ending)""")
def _(spark, d):
    return transport.reassemble(transport.dedup_sctp(sctp(spark, d))).select(
        "run_id", "sport", "stream_id", "ts", "src_ip", F.decode("data", "UTF-8").alias("body"))


_UDP = [_RUN, "event_id AS pkt_no", "t AS ts", "'10.0.0.1' AS src_ip", "'10.0.0.2' AS dst_ip",
        "CAST(CASE WHEN k % 3 = 0 THEN 8805 ELSE 1000 + k END AS INT) AS sport",
        "CAST(CASE WHEN k % 4 = 0 THEN 8805 ELSE 2000 + k END AS INT) AS dport",
        "CASE WHEN k % 7 = 0 THEN '' ELSE props END AS body"]


@query("t3_pfcp_datagram_filter", f"""SELECT run_id, pkt_no, sport, dport, body
    FROM (SELECT {', '.join(_UDP)} FROM ev)
    WHERE (sport = 8805 OR dport = 8805) AND body <> ''""")
def _(spark, d):
    packets = b.ev(spark, d).selectExpr(*_UDP).withColumn("payload", F.encode("body", "UTF-8"))
    return transport.pfcp_datagrams(packets).select("run_id", "pkt_no", "sport", "dport", "body")


_TCP = [_RUN, "event_id AS pkt_no", "t AS ts",
        "CASE WHEN event_type < 'f' THEN '10.0.0.1' ELSE '10.0.0.2' END AS src_ip",
        "CASE WHEN event_type < 'f' THEN '10.0.0.2' ELSE '10.0.0.1' END AS dst_ip",
        "CAST(CASE WHEN event_type < 'f' THEN 30000 + user_id ELSE 7777 + k % 2 END AS INT) AS sport",
        "CAST(CASE WHEN event_type < 'f' THEN 7777 + k % 2 ELSE 30000 + user_id END AS INT) AS dport",
        "CAST(floor(event_id / 400) AS BIGINT) AS seq",
        """CAST(CASE WHEN k = 99 THEN 30 WHEN k = 98 THEN 40
             ELSE 40 + length(props) - k % 6 + 2 END AS INT) AS ip_len""",
        "5 AS ihl", "5 AS dataofs",
        """CASE WHEN k % 10 = 0 THEN 'PRI * HTTP/2.0' || chr(13) || chr(10) || chr(13) || chr(10)
             || 'SM' || chr(13) || chr(10) || chr(13) || chr(10) || props
             WHEN k = 97 THEN '' ELSE props END AS body"""]
block("tcp", f"SELECT {', '.join(_TCP)} FROM ev")
block("tcptrim", """SELECT * EXCLUDE (body), CASE WHEN ip_len - 40 >= 0 AND ip_len - 40 < length(body)
    THEN left(body, ip_len - 40) ELSE body END AS body FROM tcp
    WHERE (sport = 7777 OR dport = 7777) AND body <> ''""")
block("tcpuniq", """SELECT *, least(src_ip || ':' || sport, dst_ip || ':' || dport) || '|'
      || greatest(src_ip || ':' || sport, dst_ip || ':' || dport) AS conn FROM tcptrim
    QUALIFY row_number() OVER (PARTITION BY run_id, src_ip, sport, dst_ip, dport, seq, length(body)
      ORDER BY pkt_no) = 1""")


def tcp(spark, d):
    return b.ev(spark, d).selectExpr(*_TCP).withColumn(
        "payload", F.encode("body", "UTF-8")).drop("body")


@query("t4_tcp_trim", "SELECT run_id, pkt_no, body FROM tcptrim")
def _(spark, d):
    return transport.sbi_segments(tcp(spark, d)).select(
        "run_id", "pkt_no", F.decode("payload", "UTF-8").alias("body"))


@query("t5_tcp_retransmission_dedup", "SELECT run_id, pkt_no, seq, sport, dport FROM tcpuniq")
def _(spark, d):
    return transport.dedup_tcp(transport.sbi_segments(tcp(spark, d))).select(
        "run_id", "pkt_no", "seq", "sport", "dport")


@query("t6_connection_keying", """SELECT run_id, conn, count(*) AS segments, min(pkt_no) AS first_no
    FROM tcpuniq GROUP BY 1, 2""")
def _(spark, d):
    segments = transport.dedup_tcp(transport.sbi_segments(tcp(spark, d)))
    return transport.with_connection(segments).groupBy("run_id", "conn").agg(
        F.count(F.lit(1)).alias("segments"), F.min("pkt_no").alias("first_no"))


@query("t7_midstream_connections", """SELECT run_id, conn, arg_min(ts, pkt_no) AS ts,
    arg_min(src_ip, pkt_no) AS src_ip, arg_min(sport, pkt_no) AS src_port,
    'h2 decode failed: no HTTP/2 client preface (capture started midstream?)' AS unparsed
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, conn, src_ip, sport ORDER BY pkt_no) = 1
      AND body LIKE 'PRI * HTTP/2.0' || chr(13) || chr(10) || '%' || chr(13) || chr(10) || chr(13)
      || chr(10) || '%' AS opens FROM tcpuniq) GROUP BY 1, 2 HAVING NOT bool_or(opens)""")
def _(spark, d):
    segments = transport.dedup_tcp(transport.sbi_segments(tcp(spark, d)))
    return transport.midstream_connections(segments).select(
        "run_id", "conn", "ts", "src_ip", "src_port", "unparsed")


# --- code fields ------------------------------------------------------------
# Identity digits of an order, packed as the bytes of a swapped-nibble field.
_DIGITS = """lpad(CAST(o_custkey AS STRING), 6, '0') || CASE WHEN o_orderkey % 3 = 0 THEN 'F'
    ELSE CAST(o_orderkey % 10 AS STRING) END || CASE WHEN o_orderkey % 7 = 0 THEN 'B'
    ELSE CAST(o_orderkey % 9 AS STRING) END"""


def _bcd(spark, d):
    text = b.table(spark, d, "orders").selectExpr("o_orderkey", f"{_DIGITS} AS x")
    return text.select("o_orderkey", F.unhex(F.regexp_replace("x", "(.)(.)", "$2$1"))
                       .alias("raw"))


@query("n9_supi_normalization", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
    AND x NOT LIKE '%B%' THEN '99970' || replace(x, 'F', '') END AS supi
    FROM (SELECT o_orderkey, {_DIGITS} AS x FROM orders)""")
def _(spark, d):
    plmn = F.lit(bytes([0x99, 0xF9, 0x07]))
    return _bcd(spark, d).select("o_orderkey", codes.supi_from_suci(
        F.col("o_orderkey") % 2, plmn, F.col("raw")).alias("supi"))


@query("n10_guti_format", """SELECT o_orderkey, '99970-' || o_custkey % 256 || '-' || o_custkey % 1024
    || '-' || o_orderkey % 64 || '-' || o_orderkey AS guti FROM orders""")
def _(spark, d):
    plmn = F.lit(bytes([0x99, 0xF9, 0x07]))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return b.table(spark, d, "orders").select(
        "o_orderkey", codes.guti(plmn, c % 256, c % 1024, o % 64, o).alias("guti"))


_CAUSES = ["event_id", "CASE WHEN k % 3 = 0 THEN k END AS inside",
           "CASE WHEN k % 2 = 0 THEN k + 100 END AS carrier"]


@query("n11_cause_precedence", f"""SELECT event_id, coalesce(inside, carrier) AS cause
    FROM (SELECT {', '.join(_CAUSES)} FROM ev)""")
def _(spark, d):
    return b.ev(spark, d).selectExpr(*_CAUSES).select("event_id", codes.session_cause(
        F.col("inside"), F.col("carrier")).alias("cause"))


_T1 = "l_partkey || '@10.0.' || l_suppkey % 200 || '.1'"
_T2 = "l_suppkey || '@10.1.' || l_partkey % 200 || '.1'"


def _address(net: str, number):
    return F.concat(F.lit(net), (number % 200).cast("string"), F.lit(".1"))


def _listed(tunnels):
    return F.array_join(F.array_sort(F.transform(tunnels, lambda t: F.concat(
        t.teid.cast("string"), F.lit("@"), t.ip))), ",")


@query("n12_n2_tunnels", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    concat_ws(',', CASE WHEN a <= z THEN a ELSE coalesce(z, a) END,
      CASE WHEN a <= z THEN z WHEN z IS NOT NULL THEN a END) AS tunnels FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      CASE WHEN l_partkey % 10 > 0 AND (l_returnflag <> 'A' OR l_linenumber <= 3) THEN {_T1} END
        AS a,
      CASE WHEN l_suppkey % 10 > 0 AND l_returnflag <> 'A' THEN {_T2} END AS z FROM lineitem)""")
def _(spark, d):
    """A line item is a message with two tunnels, asked for or answered."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    asked = F.col("l_returnflag") == "A"
    one = F.when(part % 10 > 0, part), _address("10.0.", supp)
    two = supp, F.when(supp % 10 > 0, _address("10.1.", part))
    element = F.when(F.col("l_linenumber") <= 3, 139).otherwise(F.col("l_linenumber"))
    items = F.array(F.array(
        F.struct(element.alias("id"), one[0].alias("teid"), one[1].alias("ip")),
        F.struct(F.lit(134).alias("id"), two[0].alias("teid"), two[1].alias("ip"))))
    answers = F.array(F.array(F.struct(one[0].alias("teid"), one[1].alias("ip"))),
                      F.array(F.struct(two[0].alias("teid"), two[1].alias("ip"))))
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        _listed(codes.n2_tunnels(F.when(asked, items), F.when(~asked, answers))).alias("tunnels"))


@query("n13_ip_rendering", """SELECT o_orderkey, CASE o_orderkey % 3
    WHEN 0 THEN o_custkey % 256 || '.' || o_orderkey % 200 || '.0.' || o_orderkey % 7
    WHEN 1 THEN 'fd00:' || printf('%x', 1 + o_custkey % 65000) || '::'
      || printf('%x', 1 + o_orderkey % 60000) END AS ip FROM orders""")
def _(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")

    def hexed(value, width):
        return F.lpad(F.hex(value), width, "0")

    four = F.concat(hexed(c % 256, 2), hexed(o % 200, 2), F.lit("00"), hexed(o % 7, 2))
    sixteen = F.concat(F.lit("FD00"), hexed(1 + c % 65000, 4),
                       F.lit("0" * 20), hexed(1 + o % 60000, 4))
    raw = F.when(o % 3 == 0, F.unhex(four)).when(o % 3 == 1, F.unhex(sixteen)).otherwise(
        F.unhex(F.lit("0102")))
    return b.table(spark, d, "orders").select("o_orderkey", codes.ip_text(raw).alias("ip"))


@query("p6_tunnel_key_selection", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity, CASE WHEN l_partkey % 10 > 0 AND (l_linenumber = 1 OR (l_linenumber = 2
      AND l_linestatus = 'O')) THEN {_T1} ELSE '' END AS tunnels FROM lineitem""")
def _(spark, d):
    """A line item is a message; its line number says which element carries the key."""
    n = F.col("l_linenumber")
    path = (F.when(n == 1, F.array(F.lit(8), F.lit(21)))
            .when(n == 2, F.array(F.lit(10), F.lit(11), F.lit(84)))
            .when(n == 3, F.array(F.lit(1), F.lit(2), F.lit(21)))
            .otherwise(F.array(F.lit(3), F.lit(4), F.lit(84))))
    ie = F.struct(path.alias("path"), (F.col("l_linestatus") == "O").alias("gtp"),
                  F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey")).alias("teid"),
                  _address("10.0.", F.col("l_suppkey")).alias("ip"))
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        _listed(codes.n4_tunnels(F.array(ie))).alias("tunnels"))


@query("p7_evidence_fields", f"""SELECT o_orderkey, CASE WHEN x NOT LIKE '%B%'
    THEN replace(x, 'F', '') END AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN '10.45.0.'
    || o_custkey % 256 ELSE 'fd00::' || printf('%x', 1 + o_orderkey % 60000) END AS ue_ip
    FROM (SELECT *, {_DIGITS} AS x FROM orders)""")
def _(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    v4 = F.when(o % 2 == 0, F.unhex(F.concat(F.lit("0A2D00"), F.lpad(F.hex(c % 256), 2, "0"))))
    v6 = F.unhex(F.concat(F.lit("FD00" + "0" * 24), F.lpad(F.hex(1 + o % 60000), 4, "0")))
    return _bcd(spark, d).join(b.table(spark, d, "orders"), "o_orderkey").select(
        "o_orderkey", codes.bcd_digits(F.col("raw")).alias("user_id"),
        F.coalesce(codes.ip_text(v4), codes.ip_text(v6)).alias("ue_ip"))
