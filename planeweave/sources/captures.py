"""Capture documents read piece by piece.

A document of any size is read as a stream of text: each element of its lists becomes a row of
its own, and what remains of an object, its header, a row when the object ends.  No more than
one element is held, so neither a document nor a flow has to fit in memory.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DataType, StructType

from planeweave import schemas

BLOCK = 1 << 20          # bytes read at a time
# The lists of a capture document and of its embedded planes.
LISTS = ["flows", "flows.messages", "flows.procedures", "unassociated", "messages", "procedures",
         "n4.messages", "n4.procedures", "sbi.messages", "sbi.procedures"]
OBJECTS = ["", "flows", "n4", "sbi"]
SCHEMA = "run_id string, part string, flow long, pos long, value string"
_BLANK = re.compile(r"[ \t\r\n]*")


class JsonParts:
    """The pieces (part, flow, pos, value) of one document, from an iterator of texts."""

    def __init__(self, texts: Iterator[str]):
        self.texts, self.held, self.at, self.ended = texts, "", 0, False
        self.decoder = json.JSONDecoder()

    def _more(self) -> bool:
        text = next(self.texts, None)
        if text is None:
            self.ended = True
            return False
        self.held, self.at = self.held[self.at:] + text, 0
        return True

    def _next(self) -> str:
        """The next character that is not blank, left where it is."""
        while True:
            self.at = _BLANK.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self._more():
                raise ValueError("the document ends early")

    def _take(self, wanted: str) -> str:
        found = self._next()
        if found not in wanted:
            raise ValueError(f"one of {wanted} expected, {found} found")
        self.at += 1
        return found

    def _value(self):
        """The next value, whole.  A number goes on until another character ends it."""
        self._next()
        size = BLOCK
        while True:
            try:
                value, end = self.decoder.raw_decode(self.held, self.at)
                if end < len(self.held) or self.ended or not isinstance(value, (int, float)) or isinstance(value, bool):
                    self.at = end
                    return value
            except json.JSONDecodeError:
                if self.ended:
                    raise
            # Twice as much each time, so a long value is not tried over and over.
            until = len(self.held) - self.at + size
            while len(self.held) - self.at < until and self._more():
                pass
            size *= 2

    def _members(self, close: str) -> Iterator[None]:
        """Once for each member up to `close`."""
        if self._next() == close:
            self.at += 1
            return
        while True:
            yield
            if self._take("," + close) == close:
                return

    def object(self, name: str, flow: int | None, pos: int) -> Iterator[tuple]:
        header = {}
        self._take("{")
        for _ in self._members("}"):
            key = self._value()
            self._take(":")
            inner = f"{name}.{key}" if name else key
            if inner in LISTS and self._next() == "[":
                yield from self.list(inner, flow)
            elif inner in OBJECTS and self._next() == "{":
                yield from self.object(inner, flow, 0)
            else:
                header[key] = self._value()
        yield name, flow, pos, json.dumps(header, ensure_ascii=False)

    def list(self, name: str, flow: int | None) -> Iterator[tuple]:
        self._take("[")
        for pos, _ in enumerate(self._members("]")):
            if name in OBJECTS and self._next() == "{":
                yield from self.object(name, pos, pos)
            else:
                yield name, flow, pos, json.dumps(self._value(), ensure_ascii=False)

    def __iter__(self) -> Iterator[tuple]:
        if self._next() == "{":
            yield from self.object("", None, 0)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """One per document."""
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(place)
        if found.type == fs.FileType.Directory:
            listed = files.get_file_info(fs.FileSelector(place, recursive=True))
            names = sorted(f.path for f in listed if f.type == fs.FileType.File and f.path.endswith(".json"))
        else:
            names = [place]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(f"{scheme}{n}") for n in names]

    def read(self, partition: _File):
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(partition.path)
        run = re.sub(r"(_(n2|n4|sbi|merged))?\.json$", "", place.rsplit("/", 1)[-1])
        with files.open_input_stream(place) as stream:
            decode = codecs.getincrementaldecoder("utf-8-sig")()
            texts = (decode.decode(block) for block in iter(lambda: stream.read(BLOCK), b""))
            for row in JsonParts(texts):
                yield (run, *row)


class CaptureSource(DataSource):
    """`spark.read.format("capture").load(path)`: the pieces of a document or of a folder of them."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, part, flow, pos, value): the list elements and headers of the documents.

    `part` names the list or the object ('' for the document), `flow` is the place of the flow
    around it, `pos` the place in its list, `value` its JSON text.
    """
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").load(path)


def _records(parts: DataFrame, part: str, kind: str) -> DataFrame:
    return parts.filter(F.col("part") == part).select("run_id", "flow", "pos", F.from_json("value", kind).alias("m"))


def _flow_type() -> StructType:
    return StructType.fromDDL(schemas.N2_EXPORT)["flows"].dataType.elementType


def flow_table(parts: DataFrame) -> DataFrame:
    """One row per flow without its lists, as `exports.flow_table` gives them; `flow` is its place."""
    own = StructType([f for f in _flow_type() if f.name not in ("messages", "procedures")])
    counted = parts.filter("part = 'flows.messages'").groupBy("run_id", "flow").agg(F.count(F.lit(1)).alias("messages"))
    return _records(parts, "flows", own.simpleString()).join(counted, ["run_id", "flow"], "left").select(
        "run_id", "flow", "m.flow_id", F.col("m.ran_ue_ngap_id").alias("ran_ue_id"),
        F.col("m.amf_ue_ngap_id").alias("amf_ue_id"), "m.partial", F.coalesce("messages", F.lit(0)).alias("messages"),
        "m.sbi_refs", "m.n4_refs")


def flow_lists(parts: DataFrame, name: str) -> DataFrame:
    """One row per element of the list `name` ('messages' or 'procedures') of a flow, with the
    flow's id and `i`, its 1-based place."""
    heads = _records(parts, "flows", "struct<flow_id: bigint>").select("run_id", "flow", "m.flow_id")
    kind = _flow_type()[name].dataType.elementType.simpleString()
    return _records(parts, f"flows.{name}", kind).join(heads, ["run_id", "flow"]).select(
        "run_id", "flow_id", (F.col("pos") + 1).alias("i"), "m.*")


def plane_messages(parts: DataFrame, plane: str, embedded: bool) -> DataFrame:
    """The messages of a plane, msg_no being the 0-based place, as `exports.plane_messages` gives
    them: those embedded in merged documents, or those of the plane's own documents."""
    section = DataType.fromDDL(schemas.SBI_SECTION if plane == "sbi" else schemas.N4_SECTION)
    kind = section["messages"].dataType.elementType.simpleString()
    return _records(parts, f"{plane}.messages" if embedded else "messages", kind).select(
        "run_id", F.col("pos").alias("msg_no"), "m.*")
