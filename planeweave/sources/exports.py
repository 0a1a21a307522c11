"""Reading and writing of decoded captures as JSON documents and message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave import schemas
from planeweave.functions.scan import Split, position, scan

# A document part holds at most this many message positions, so that a flow of
# any size is written without gathering it into one row.
PART_MESSAGES = 100_000

# The fields of the exported records.
N2_MESSAGE = ["ts", "src_ip", "dst_ip", "ngap", "kind", "nas", "nas_protected", "nas_inner",
              "nas_cause", "unparsed"]
PROCEDURE = ["kind", "start_ts", "end_ts", "start_msg", "end_msg", "outcome", "duration_ms"]
N4_MESSAGE = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "name", "seq", "seid", "cause",
              "cause_code", "user_id", "ue_ip", "unparsed"]
N4_PROCEDURE = ["kind", "start_ts", "end_ts", "start_msg", "end_msg", "outcome", "cause",
                "cause_name", "duration_ms"]
SBI_MESSAGE = ["ts", "src_ip", "dst_ip", "src_port", "dst_port", "stream_id", "direction",
               "method", "path", "status", "body_len", "service", "name", "problem_title",
               "problem_cause", "unparsed"]
SBI_PROCEDURE = ["kind", "start_ts", "end_ts", "start_msg", "end_msg", "outcome", "status"]


# --- S1: reading ------------------------------------------------------------

def read_documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Whole JSON documents, one row per file, with `run_id` from the file name."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn(
        "run_id", F.regexp_replace(name, r"(_(n2|n4|sbi|merged))?\.json$", ""))


def _section(text: Column, schema: str) -> Column:
    """An embedded section, null unless it is a JSON object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, schema))


def with_planes(n2: DataFrame, n4: DataFrame | None = None,
                sbi: DataFrame | None = None) -> DataFrame:
    """Captures with their N4 and SBI sections.

    An explicit document wins over the embedded section; a section that is no
    object is ignored.  `n4` and `sbi` are documents of the same runs.
    """
    out = n2.select(
        "run_id", "kpis", "flows", "unassociated",
        _section(F.col("n4"), schemas.N4_SECTION).alias("n4"),
        _section(F.col("sbi"), schemas.SBI_SECTION).alias("sbi"))
    for plane, explicit in (("n4", n4), ("sbi", sbi)):
        if explicit is None:
            continue
        given = explicit.select("run_id", F.struct(
            "messages", "procedures", "unpaired_requests").alias("_given"))
        out = out.join(given, "run_id", "left").withColumn(
            plane, F.coalesce("_given", plane)).drop("_given")
    return out


def flow_messages(captures: DataFrame) -> DataFrame:
    """One row per flow message, `i` being its 1-based place in the flow."""
    flows = captures.select("run_id", F.explode("flows").alias("f"))
    return flows.select("run_id", "f.flow_id", F.posexplode("f.messages").alias("pos", "m")).select(
        "run_id", "flow_id", (F.col("pos") + 1).cast("long").alias("i"), "m.*")


def flow_table(captures: DataFrame) -> DataFrame:
    return captures.select("run_id", F.explode("flows").alias("f")).select(
        "run_id", "f.flow_id", F.col("f.ran_ue_ngap_id").alias("ran_ue_id"),
        F.col("f.amf_ue_ngap_id").alias("amf_ue_id"), "f.partial",
        F.size("f.messages").cast("long").alias("messages"), "f.sbi_refs", "f.n4_refs")


def flow_procedures(captures: DataFrame) -> DataFrame:
    return captures.select("run_id", F.explode("flows").alias("f")).select(
        "run_id", "f.flow_id", F.posexplode("f.procedures").alias("pos", "p")).select(
        "run_id", "flow_id", (F.col("pos") + 1).cast("long").alias("proc_no"), "p.*")


def plane_messages(captures: DataFrame, plane: str) -> DataFrame:
    """The messages of a plane section, msg_no being the 0-based index."""
    return captures.select("run_id", F.posexplode(f"{plane}.messages").alias("pos", "m")).select(
        "run_id", F.col("pos").cast("long").alias("msg_no"), "m.*")


# --- S2-S5: documents -------------------------------------------------------

def _part(order: str) -> Column:
    return F.floor(F.col(order) / PART_MESSAGES).cast("long")


def _in_order(order: str, fields: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"),
                                                            fields.alias("r")))), lambda x: x.r)


def n2_message_record() -> Column:
    """A flow message as it is exported."""
    nas = F.col("nas")
    cause = F.when(nas["cause"].isNotNull(), F.struct(
        nas["cause"].alias("code"), nas["cause_name"].alias("name")))
    return F.struct(
        "ts", "src_ip", "dst_ip", "ngap", "kind", nas["name"].alias("nas"),
        nas["protected"].alias("nas_protected"), nas["inner"].alias("nas_inner"),
        cause.alias("nas_cause"),
        F.coalesce(F.nullif(F.col("unparsed"), F.lit("")), nas["unparsed"]).alias("unparsed"))


def n2_documents(messages: DataFrame, flows: DataFrame, procs: DataFrame,
                 split: Split = None) -> DataFrame:
    """Flow documents of the N2 export, in parts.

    One row per (run, flow, part) with the flow's header and that part of its
    messages and of its procedures, both in order; the parts of a flow put
    together are the flow.
    """
    key = ["run_id", "flow_id"]
    placed = scan(messages, key, "msg_no", split=split, _i=position()).withColumn(
        "_i", F.col("_i") - 1)
    parts = placed.groupBy(*key, _part("_i").alias("part")).agg(
        _in_order("msg_no", n2_message_record()).alias("messages"))
    closed = procs.withColumn("_p", F.col("proc_no") - 1).groupBy(
        *key, _part("_p").alias("part")).agg(
        _in_order("proc_no", F.struct(*PROCEDURE)).alias("procedures"))
    head = flows.select(*key, F.col("ran_ue_id").alias("ran_ue_ngap_id"),
                        F.col("amf_ue_id").alias("amf_ue_ngap_id"), "partial")
    none = F.array().cast(closed.schema["procedures"].dataType)
    return parts.join(head, key).join(closed, [*key, "part"], "left").select(
        *key, "part", "ran_ue_ngap_id", "amf_ue_ngap_id", "partial", "messages",
        F.coalesce("procedures", none).alias("procedures"))


def unassociated_records(messages: DataFrame) -> DataFrame:
    """The unassociated records of the N2 export."""
    return messages.select("run_id", "msg_no", "ts", "ngap", "unparsed")


def n4_records(messages: DataFrame) -> DataFrame:
    """N4 message records; identity fields always present, flow_id when merged (S3)."""
    linked = ["flow_id"] if "flow_id" in messages.columns else []
    return messages.select("run_id", "msg_no", *N4_MESSAGE, *linked)


def n4_procedure_records(procs: DataFrame) -> DataFrame:
    linked = ["flow_id"] if "flow_id" in procs.columns else []
    return procs.select("run_id", "proc_no", *N4_PROCEDURE, *linked)


def sbi_records(messages: DataFrame) -> DataFrame:
    """SBI message records; service and name both hold the service name."""
    linked = ["flow_id"] if "flow_id" in messages.columns else []
    named = messages.withColumn("service", F.col("name"))
    return named.select("run_id", "msg_no", *SBI_MESSAGE, *linked)


def sbi_procedure_records(procs: DataFrame) -> DataFrame:
    linked = ["flow_id"] if "flow_id" in procs.columns else []
    return procs.select("run_id", "req_no", *SBI_PROCEDURE, *linked)


def merged_documents(documents: DataFrame, sbi_refs: DataFrame | None = None,
                     n4_refs: DataFrame | None = None) -> DataFrame:
    """Flow documents with the message references of the planes given.

    References come in parts of their own (see `correlate.flow_refs`); part n of
    a list stands on part n of the flow, further parts on rows of their own that
    repeat the flow's header.
    """
    out = documents
    header = [c for c in documents.columns
              if c not in ("run_id", "flow_id", "part", "messages", "procedures")]
    heads = documents.filter("part = 0").select(
        "run_id", "flow_id", *[F.col(c).alias(f"_{c}") for c in header])
    for name, refs in (("sbi_refs", sbi_refs), ("n4_refs", n4_refs)):
        if refs is None:
            continue
        out = out.join(refs.withColumnRenamed("refs", name), ["run_id", "flow_id", "part"], "full")
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    out = out.join(heads, ["run_id", "flow_id"], "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in header}).drop(
        *[f"_{c}" for c in header])


def merged_kpis(kpis: DataFrame, cross: DataFrame | None) -> DataFrame:
    """Run indicators; the cross-plane means join them only when both planes were
    given (S5)."""
    return kpis if cross is None else kpis.join(cross, "run_id", "left")


def write_documents(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write records partitioned by run."""
    options = {"ignoreNullFields": "false"} if fmt == "json" else {}
    df.write.mode("overwrite").partitionBy("run_id").format(fmt).options(**options).save(path)


# --- S6: plane detection ----------------------------------------------------

def detect_plane(runs: DataFrame, n2: DataFrame, n4: DataFrame, sbi: DataFrame) -> DataFrame:
    """Which plane each run is read as: the first of N2, N4, SBI that has messages,
    null when none has (S6)."""
    def present(df: DataFrame, rank: int) -> DataFrame:
        return df.select("run_id").distinct().withColumn("rank", F.lit(rank))

    first = present(n2, 0).unionByName(present(n4, 1)).unionByName(present(sbi, 2)).groupBy(
        "run_id").agg(F.min("rank").alias("rank"))
    names = F.array(F.lit("n2"), F.lit("n4"), F.lit("sbi"))
    return runs.select("run_id").distinct().join(first, "run_id", "left").select(
        "run_id", F.get(names, F.col("rank")).alias("plane"))


# --- S10, S11: quality ------------------------------------------------------

def contract_violations(messages: DataFrame, name: str = "name") -> DataFrame:
    """Messages that are neither decoded nor refused, or both."""
    return messages.filter(F.col(name).isNull() == F.col("unparsed").isNull())


def unexpected_refusals(messages: DataFrame, allowed: list[str]) -> DataFrame:
    """Refused messages per run and plane, and those whose note is not allowed.

    `messages`: run_id, plane, unparsed.
    """
    note = F.col("unparsed")
    fine = F.lit(False)
    for prefix in allowed:
        fine = fine | note.startswith(prefix)
    return messages.groupBy("run_id", "plane").agg(
        F.count(note).alias("refused"),
        F.count(F.when(note.isNotNull() & ~fine, 1)).alias("unexpected"))
