"""Streamed reassembly of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from planeweave.operators.transport import STREAM_KEY
from planeweave.streaming.ordered import InOrder, micros, row_of, run_in_order

_ROWS = "at long, pkt_no long, chunk_no long, ts double, src_ip string, dst_ip string, data binary, ending boolean"
OUTPUT = ("run_id string, sport int, dport int, stream_id long, ts double, src_ip string, dst_ip string, "
          "pkt_no long, chunk_no long, data binary")
_Message = row_of(OUTPUT)


class Streams(InOrder):
    """Parts are kept in order until one ends the message; parts that are followed by nothing for `idle`
    microseconds are dropped."""

    def __init__(self, idle: int):
        super().__init__(StructType.fromDDL(_ROWS), StructType.fromDDL("last long"), ["pkt_no", "chunk_no"])
        self.idle = idle

    def init(self, handle):
        super().init(handle)
        self.parts = handle.getListState("parts", "data binary")

    def step(self, key, state, rows, mark):
        found, held = [], None
        for r in rows:
            if held is None:
                late = state["last"] is not None and r.at > state["last"] + self.idle
                held = [] if late else [bytes(p[0]) for p in self.parts.get()]
            elif r.at > state["last"] + self.idle:
                held = []
            state["last"] = r.at
            held.append(bytes(r.data or b""))
            if r.ending:
                found.append(_Message(*key, r.ts, r.src_ip, r.dst_ip, r.pkt_no, r.chunk_no, b"".join(held)))
                held = []
        if held is not None:
            self.parts.clear()
            if held:
                self.parts.put([(p,) for p in held])
        if held == [] or mark > state["last"] + self.idle:
            self.parts.clear()
            return found, None
        return found, state["last"] + self.idle + 1


def stream_messages(chunks: DataFrame, idle: str, delay: str) -> DataFrame:
    """The rows of `transport.reassemble`, each when its last chunk is passed by the watermark.

    `chunks` carry `event_time`, which grows with (pkt_no, chunk_no), and may come `delay` late;
    a tail that no chunk ends is dropped after `idle`.
    """
    return run_in_order(chunks, STREAM_KEY, Streams(micros(idle)), OUTPUT, delay)
