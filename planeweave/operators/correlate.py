"""Cross-plane links by strict key equality, ambiguous keys removed.

Every lookup side has one row per key, so a hot key only repeats on the message
side, where adaptive execution splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import Split, position, scan

SUPI_KEY = ["run_id", "supi"]
TUNNEL_KEY = ["run_id", "teid", "ip"]


def supi_claims(flow_messages: DataFrame) -> DataFrame:
    """Which flows declared which identity in their NAS messages."""
    supi = F.nullif(F.col("nas.supi"), F.lit(""))
    return flow_messages.select("run_id", supi.alias("supi"), "flow_id").filter(
        F.col("supi").isNotNull()).distinct()


def tunnel_claims(flow_messages: DataFrame) -> DataFrame:
    """Which flows declared which tunnel endpoint."""
    return flow_messages.select("run_id", "flow_id", F.explode("f_teids").alias("t")).select(
        "run_id", "t.teid", "t.ip", "flow_id").distinct()


def unambiguous(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Keys claimed by exactly one flow (C2): least and greatest claimant agree."""
    return claims.groupBy(*keys).agg(
        F.min("flow_id").alias("flow_id"), F.max("flow_id").alias("_other")
    ).filter(F.col("flow_id") == F.col("_other")).drop("_other")


def sbi_with_flow(sbi: DataFrame, flow_messages: DataFrame) -> DataFrame:
    """SBI messages with the flow they link to.

    A decoded request links when its identity names exactly one flow.  A response
    follows the last linked request of its stream, whether or not the response
    itself was refused.
    """
    stream = ["run_id", "conn", "stream_id"]
    owners = unambiguous(supi_claims(flow_messages), SUPI_KEY).withColumnRenamed(
        "flow_id", "_owner")
    joined = sbi.join(owners, SUPI_KEY, "left")
    own = F.when((F.col("direction") == "request") & F.col("unparsed").isNull()
                 & F.col("conn").isNotNull(), F.col("_owner"))
    marked = joined.withColumn("_own", own)
    # One row per stream that links, so a hot stream is only long on the message side.
    last = marked.filter(F.col("_own").isNotNull()).groupBy(*stream).agg(
        F.max_by("_own", "msg_no").alias("_last"))
    known = marked.join(last, stream, "left")
    follows = (F.col("direction") == "response") & F.col("conn").isNotNull()
    return known.withColumn(
        "flow_id", F.when(follows, F.col("_last")).otherwise(F.col("_own"))
    ).select(*sbi.columns, "flow_id")


def links(messages: DataFrame) -> DataFrame:
    """The link table (run_id, msg_no, flow_id) of messages that have a flow."""
    return messages.filter(F.col("flow_id").isNotNull()).select("run_id", "msg_no", "flow_id")


def link_n4(n4: DataFrame, flow_messages: DataFrame) -> DataFrame:
    """Links of N4 messages whose unambiguous tunnel keys name one flow.

    An ambiguous key is ignored; a message whose keys span flows links none; a
    refused message never links.
    """
    owners = unambiguous(tunnel_claims(flow_messages), TUNNEL_KEY)
    keys = n4.filter(F.col("unparsed").isNull()).select(
        "run_id", "msg_no", F.explode("f_teids").alias("t")).select(
        "run_id", "msg_no", "t.teid", "t.ip")
    return unambiguous(keys.join(owners, TUNNEL_KEY), ["run_id", "msg_no"])


def n4_with_flow(n4: DataFrame, flow_messages: DataFrame) -> DataFrame:
    """N4 messages with the flow they link to, null when they link to none."""
    return n4.join(link_n4(n4, flow_messages), ["run_id", "msg_no"], "left")


def flow_refs(links: DataFrame, part_rows: int = 100_000, split: Split = None) -> DataFrame:
    """Sorted message numbers per flow.

    A flow may own any number of messages, so its list comes in parts of so many
    entries: `refs` of part 0, 1, ... put together are the whole list.
    """
    placed = scan(links, ["run_id", "flow_id"], "msg_no", split=split, place=position())
    part = F.floor((F.col("place") - 1) / part_rows).cast("long")
    return placed.groupBy("run_id", "flow_id", part.alias("part")).agg(
        F.array_sort(F.collect_list("msg_no")).alias("refs"))


def bijection_violations(claims: DataFrame, key: Column | str = "supi") -> DataFrame:
    """Identities with several flows and flows with several identities."""
    several = F.min("other") != F.max("other")

    def side(group: str, other: str, what: str) -> DataFrame:
        return (claims.select("run_id", F.col(group).cast("string").alias("value"),
                              F.col(other).cast("string").alias("other"))
                .groupBy("run_id", "value").agg(several.alias("bad"))
                .filter("bad").select("run_id", F.lit(what).alias("side"), "value"))

    return side(key, "flow_id", "identity").unionByName(side("flow_id", key, "flow"))
