"""Streamed N4 pairing (P2, P3, P4): one open round per reversed endpoint and sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planeweave.operators.pfcp import PAIR_KEY, exchanges, outcome_of
from planeweave.streaming.ordered import InOrder, micros, row_of, run_in_order

_ROWS = ("at long, msg_no long, ts double, name string, kind string, role string, cause_code int, "
         "cause string, outcome string")
_ROUND = "start_ts double, start_msg string, kind string, req_no long, sends long, last long"
OUTPUT = ("run_id string, kind string, start_ts double, end_ts double, start_msg string, end_msg string, "
          "outcome string, cause int, cause_name string, req_no long, rsp_no long, seq long, sends long, duration_ms double")
_Procedure = row_of(OUTPUT)


class Rounds(InOrder):
    """A round opens with a request, counts its retransmissions and closes with the answer, or as a
    timeout when nothing was sent for `deadline` microseconds.  The next request of the key opens
    a new one; an answer without a round gives nothing."""

    def __init__(self, deadline: int):
        super().__init__(StructType.fromDDL(_ROWS), StructType.fromDDL(_ROUND), ["msg_no"])
        self.deadline = deadline

    def step(self, key, state, rows, mark):
        found = []
        for r in rows:
            if state["req_no"] is not None and r.at > state["last"] + self.deadline:
                found.append(self._timeout(key, state))
            if r.role == "request":
                if state["req_no"] is None:
                    state.update(start_ts=r.ts, start_msg=r.name, kind=r.kind, req_no=r.msg_no, sends=0)
                state["sends"] += 1
                state["last"] = r.at
            elif state["req_no"] is not None:
                found.append(_Procedure(
                    key[0], r.kind, state["start_ts"], r.ts, state["start_msg"], r.name, r.outcome, r.cause_code, r.cause,
                    state["req_no"], r.msg_no, key[-1], state["sends"], (r.ts - state["start_ts"]) * 1000.0))
                state["req_no"] = None
        if state["req_no"] is not None and mark > state["last"] + self.deadline:
            found.append(self._timeout(key, state))
        return found, None if state["req_no"] is None else state["last"] + self.deadline + 1

    @staticmethod
    def _timeout(key, state) -> Row:
        lost = _Procedure(key[0], state["kind"], state["start_ts"], state["start_ts"], state["start_msg"], None, "timeout",
                          None, None, state["req_no"], None, key[-1], state["sends"], 0.0)
        state["req_no"] = None
        return lost


def pair_exchanges(messages: DataFrame, deadline: str, delay: str) -> DataFrame:
    """The rows of `pfcp.pair_procedures`, each when it is known.

    `messages` are N4 messages with `event_time`, which grows with msg_no, and may come `delay`
    late.  A request is a timeout when neither an answer nor a retransmission came for `deadline`;
    the batch form waits for the end of the capture, so both agree where answers keep the deadline.
    """
    known = exchanges(messages).withColumn("outcome", outcome_of(F.col("cause_code")))
    return run_in_order(known, PAIR_KEY, Rounds(micros(deadline)), OUTPUT, delay)
