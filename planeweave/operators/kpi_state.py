"""Indicators kept up to date (K1, K2, K3): one mergeable state per flow.

A state holds counts and exact sums and the version it was counted at.  States of any number of
tables merge in any order, each flow by its latest version, so a new run adds its flows and a late
message replaces the states of the flows it belongs to; no other message is read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.operators.flows import FLOW_KEY, REGISTRATION, SESSION, analyze, key_messages

MEANS = {"attach": "attach_time_ms", "session": "pdu_session_time_ms", "sbi_to_n4": "sbi_to_n4_ms",
         "n4_to_n2": "n4_to_n2_ms", "sbi_to_n2": "sbi_to_n2_ms"}
_GAPS = ["sbi_to_n4", "n4_to_n2", "sbi_to_n2"]
_VALUES = [*(f"{m}_{part}" for m in MEANS for part in ("n", "sum")), "won", "lost"]


def _exact(ms: Column) -> Column:
    return ms.cast("decimal(38,9)")


def _of(name: str, ms: Column) -> list[Column]:
    return [F.count(ms).alias(f"{name}_n"), F.coalesce(F.sum(ms), F.lit(0)).cast("decimal(38,9)").alias(f"{name}_sum")]


def flow_states(flows: DataFrame, procs: DataFrame, gaps: DataFrame | None = None, version: int = 1) -> DataFrame:
    """The state of every flow of the flow table.

    `gaps` are the cross-plane gaps by flow; without them no leg counts.  The same version must
    stand for the same messages.
    """
    key = ["run_id", "flow_id"]
    ms = _exact((F.col("end_ts") - F.col("start_ts")) * 1000.0)
    known = procs.join(flows.select(*key, "partial"), key)

    def latency(kind: str) -> Column:
        return F.when(~F.col("partial") & (F.col("kind") == kind), ms)

    counted = known.groupBy(*key).agg(
        *_of("attach", latency(REGISTRATION)), *_of("session", latency(SESSION)),
        F.count(F.when(F.col("outcome") == "accept", 1)).alias("won"),
        F.count(F.when(F.col("outcome") == "reject", 1)).alias("lost"))
    named = flows.select(*key, "assoc_lo", "assoc_hi", F.coalesce("ran_ue_id", F.lit(-1)).cast("long").alias("ran_key"))
    joined = named.join(counted, key, "left")
    if gaps is None:
        joined = joined.select("*", *[F.lit(0).alias(f"{m}_{part}") for m in _GAPS for part in ("n", "sum")])
    else:
        legs = gaps.groupBy(*key).agg(*[c for m in _GAPS for c in _of(m, _exact(F.col(MEANS[m])))])
        joined = joined.join(legs, key, "left")
    return joined.select(
        *FLOW_KEY, F.lit(version).cast("long").alias("version"),
        *[F.coalesce(c, F.lit(0)).cast("decimal(38,9)" if c.endswith("_sum") else "long").alias(c) for c in _VALUES])


def merge(*states: DataFrame) -> DataFrame:
    """One state per flow, its latest; the order of the tables and of their rows is free."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*FLOW_KEY).agg(F.max_by(F.struct("version", *_VALUES), "version").alias("s")).select(*FLOW_KEY, "s.*")


def recounted(messages: DataFrame, late: DataFrame, version: int) -> DataFrame:
    """States, at `version`, of the flows that the messages `late` belong to (K1, K2).

    `messages` holds the late ones too; only those of the flows concerned are analysed again.
    """
    touched = key_messages(late).select(*FLOW_KEY).distinct()
    own = key_messages(messages).join(touched, FLOW_KEY, "left_semi").select(messages.columns)
    _, table, procs = analyze(own)
    return flow_states(table, procs, version=version)


def indicators(states: DataFrame) -> DataFrame:
    """The indicators of every run, as `kpi.run_kpis` and `kpi.cross_plane_kpis` give them."""
    sums = states.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in _VALUES])
    return sums.select(
        "run_id", *[F.try_divide(F.col(f"{m}_sum").cast("double"), F.col(f"{m}_n").cast("double")).alias(name)
                    for m, name in MEANS.items()],
        F.col("attach_n"), F.col("session_n").alias("pdu_session_n"),
        F.col("won").alias("procedure_successes"), F.col("lost").alias("procedure_failures"),
        F.try_divide(F.col("won").cast("double"), (F.col("won") + F.col("lost")).cast("double")).alias("procedure_success_rate"))
