"""Evaluation of proposed hypotheses against labelled scenarios.

`entries` (entry_id, fixture, run, label), one row per fixture run, a failed one
without `run`; `hypotheses` (entry_id, incident_type, and one column per
dimension), any number per entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.text import fixed, or_mark, or_none, text_of

# The judged dimensions.
DIMENSIONS = ["accuracy", "specificity", "evidence", "causality"]


def clean_score(raw: Column) -> Column:
    """A score within [0, 1]; anything that is no number scores 0 (V4)."""
    number = raw.try_cast("double")
    usable = F.when(number.isNotNull() & ~F.isnan(number), number).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), usable))


def run_scores(entries: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Per entry: type accuracy (label among the proposed types), diagnosis quality
    (mean of the dimension means, 0 without hypotheses) and the number judged."""
    quality = sum((F.col(d) for d in DIMENSIONS), F.lit(0.0)) / len(DIMENSIONS)
    labels = entries.select("entry_id", "label")
    judged = hypotheses.join(labels, "entry_id").groupBy("entry_id").agg(
        F.max(F.col("incident_type") == F.col("label")).alias("hit"),
        F.avg(quality).alias("quality"), F.count(F.lit(1)).alias("judged"))
    return entries.join(judged, "entry_id", "left").select(
        *entries.columns,
        F.when(F.coalesce("hit", F.lit(False)), 1.0).otherwise(0.0).alias("type_accuracy"),
        F.coalesce("quality", F.lit(0.0)).alias("diagnosis_quality"),
        F.coalesce("judged", F.lit(0)).cast("long").alias("judged"))


def fixture_scores(scores: DataFrame) -> DataFrame:
    """Means per fixture (V1, V2)."""
    return scores.groupBy("fixture").agg(
        F.avg("type_accuracy").alias("type_accuracy"),
        F.avg("diagnosis_quality").alias("diagnosis_quality"))


def macro_scores(scores: DataFrame) -> DataFrame:
    """Means of the fixture means, run counts and the accuracy target (V1, V2, V3)."""
    per_fixture = fixture_scores(scores).agg(
        F.avg("type_accuracy").alias("type_accuracy"),
        F.avg("diagnosis_quality").alias("diagnosis_quality"),
        F.count(F.lit(1)).alias("fixtures"))
    counts = scores.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("judged").alias("judged_hypotheses"),
        F.count(F.when(F.col("judged") > 0, 1)).alias("completed_runs"))
    return per_fixture.withColumns({
        "runs": counts.select("runs").scalar(),
        "judged_hypotheses": counts.select("judged_hypotheses").scalar(),
        "completed_runs": counts.select("completed_runs").scalar(),
        "target": F.when(F.col("fixtures") > 0,
                         (F.col("fixtures") - 1) / F.col("fixtures")).otherwise(0.0)})


def dimension_means(hypotheses: DataFrame) -> DataFrame:
    """Mean of each dimension over all hypotheses, 0 when there is none (V3)."""
    means = hypotheses.agg(*[F.coalesce(F.avg(d), F.lit(0.0)).alias(d) for d in DIMENSIONS])
    return means.unpivot([], DIMENSIONS, "dimension", "mean")


def own_plane(incidents: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The incidents each fixture is judged on: those of its plane, or all of a
    merged fixture (V5).  `fixtures` (fixture, plane), plane null when merged."""
    return incidents.join(fixtures.withColumnRenamed("plane", "_own"), "fixture").filter(
        F.col("_own").isNull() | (F.coalesce("plane", F.lit("n2")) == F.col("_own"))).drop("_own")


def with_label(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the incident type of the scenario of their name (V7)."""
    return entries.join(labels.select(F.col("scenario").alias("fixture"),
                                      F.col("incident_type").alias("label")), "fixture")


def still_to_run(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """(fixture, run) pairs not in the results yet; a failed record carries no run
    and so does not count as done (S9)."""
    done = results.filter(F.col("run").isNotNull() & (F.col("run") != 0)).select("fixture", "run")
    return wanted.join(done, ["fixture", "run"], "left_anti")


# --- judging briefs (V6) ----------------------------------------------------
# Briefs are line tables (run_id, handle, section, line_no, text); `section` puts
# the head before the messages and the messages before the procedures.

def _line(handle: Column, section: int, line_no: Column, text: Column) -> list[Column]:
    return [F.col("run_id"), handle.alias("handle"), F.lit(section).alias("section"),
            line_no.cast("long").alias("line_no"), text.alias("text")]


def flow_brief(flow_messages: DataFrame, flows: DataFrame, procs: DataFrame) -> DataFrame:
    """Span, messages and procedures of every flow."""
    handle = text_of("flow:", F.col("flow_id").cast("string"))
    nas = F.col("nas")
    name = F.coalesce(F.nullif(nas["inner"], F.lit("")), F.nullif(nas["name"], F.lit("")),
                      F.nullif(F.col("ngap"), F.lit("")), F.lit("?"))
    cause = F.when(nas["cause"] != 0, text_of(
        " cause #", nas["cause"].cast("string"), " (", or_none(nas["cause_name"]), ")"))
    span = flows.select(*_line(handle, 0, F.lit(0), text_of(
        "flow span: ", fixed(F.col("first_ts")), "s -> ", fixed(F.col("last_ts")), "s (",
        F.col("messages").cast("string"), " message(s))")))
    silent = flows.join(procs.select("run_id", "flow_id").distinct(), ["run_id", "flow_id"],
                        "left_anti").select(*_line(handle, 0, F.lit(1), F.lit(
                            "no procedure records: no terminal message ever arrived")))
    messages = flow_messages.select(*_line(handle, 1, F.col("msg_no"), F.concat(
        fixed(F.col("ts")), F.lit(" "), name, F.coalesce(cause, F.lit("")))))
    closed = procs.select(*_line(handle, 2, F.col("proc_no"), text_of(
        "procedure ", F.col("kind"), ": ", F.col("outcome"))))
    return span.unionByName(silent).unionByName(messages).unionByName(closed)


def _count_line(messages: DataFrame, handle: str, title: str) -> DataFrame:
    return messages.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(
        *_line(F.lit(handle), 0, F.lit(0),
               text_of(title + " (", F.col("n").cast("string"), "):")))


def sbi_brief(messages: DataFrame, procs: DataFrame) -> DataFrame:
    """SBI messages with their status and problem, and procedure outcomes."""
    asks = F.col("direction") == "request"
    first = F.concat(fixed(F.col("ts")), F.lit(" "), F.when(
        asks, text_of(or_mark(F.col("method")), " ", or_mark(F.col("path")))
    ).otherwise(text_of("-> ", or_none(F.col("status")))))
    problem = F.concat(
        F.lit("  problem: "), F.nullif(F.col("problem_title"), F.lit("")),
        F.coalesce(text_of(" (", F.nullif(F.col("problem_cause"), F.lit("")), ")"), F.lit("")))
    lines = messages.select(*_line(F.lit("sbi"), 1, F.col("msg_no"),
                                   F.concat_ws("\n", first, problem)))
    closed = procs.select(*_line(F.lit("sbi"), 2, F.col("req_no"), text_of(
        "procedure ", F.col("kind"), ": ", F.col("outcome"))))
    return _count_line(messages, "sbi", "SBI messages").unionByName(lines).unionByName(closed)


def n4_brief(messages: DataFrame, procs: DataFrame) -> DataFrame:
    """N4 messages with their cause, and procedure outcomes."""
    cause = text_of(" cause ", F.nullif(F.col("cause"), F.lit("")), " (",
                    or_none(F.col("cause_code")), ")")
    lines = messages.select(*_line(F.lit("n4"), 1, F.col("msg_no"), F.concat(
        fixed(F.col("ts")), F.lit(" "), or_mark(F.col("name")), F.coalesce(cause, F.lit("")))))
    ended = text_of(" cause ", F.col("cause").cast("string"), " (", or_none(F.col("cause_name")),
                    ")")
    closed = procs.select(*_line(F.lit("n4"), 2, F.col("req_no"), F.concat(
        F.lit("procedure "), F.col("kind"), F.lit(": "), F.col("outcome"),
        F.coalesce(ended, F.lit("")))))
    return _count_line(messages, "n4", "N4 messages").unionByName(lines).unionByName(closed)


def hypothesis_brief(hypotheses: DataFrame) -> DataFrame:
    """One text per hypothesis: its incident, type, narrative and cited evidence."""
    cited = F.array_join(F.transform("cited_evidence", lambda e: F.concat(
        e.message, F.coalesce(text_of(" cause #", e["cause"].cast("string")), F.lit("")),
        F.coalesce(text_of(" @", fixed(e.ts), "s"), F.lit("")))), "; ")
    other = F.col("plane").isin("sbi", "n4")
    flow = F.when(other, F.concat(
        F.upper("plane"), F.lit(" — "), or_none(F.col("procedure")),
        F.coalesce(text_of(" (flow ", F.col("flow_id").cast("string"), ")"), F.lit("")))
    ).otherwise(text_of("flow ", or_none(F.col("flow_id"))))
    return hypotheses.withColumn("brief", F.concat_ws(
        "\n",
        text_of("Procedure: ", F.col("procedure"), " (", F.col("shape"), "), ", flow),
        text_of("incident_type: ", F.col("incident_type")),
        text_of("narrative: ", F.col("narrative")),
        text_of("cited evidence: ", cited)))
