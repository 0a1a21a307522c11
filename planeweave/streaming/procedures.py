"""Streamed N2 procedures (N4 to N8): the state of a flow, message by message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planeweave.operators.flows import (
    CARRIER_ACCEPT, CARRIER_REJECT, CARRIER_START, CONTEXT_RELEASE, FLOW_KEY, KINDS, NAS_ACCEPT, NAS_REJECT,
    NAS_START, key_messages, step_of)
from planeweave.streaming.ordered import InOrder, micros, row_of, run_in_order

_ROWS = ("at long, msg_no long, ts double, announced int, readable boolean, needs_algo boolean, nas_name string, "
         "nas_kind string, nas_step string, ngap string, ngap_kind string, ngap_step string, release boolean")
# Of a flow: the algorithm, how many procedures it has, when it spoke last; of each kind: the open
# NAS and carrier start, and whether one was completed.
_FLOW = ", ".join(["algo int", "count long", "last long", *(
    f"{part}_{kind}_{field}" for kind in KINDS for part in ("nas", "ngap") for field in ("ts double", "name string", "no long")),
    *(f"done_{kind} boolean" for kind in KINDS)])
OUTPUT = ("run_id string, assoc_lo int, assoc_hi int, ran_key long, kind string, source int, start_ts double, "
          "start_msg string, start_no long, end_ts double, end_msg string, end_no long, outcome string, proc_no long")
_Procedure = row_of(OUTPUT)


class Flows(InOrder):
    """NAS: the latest start counts.  Carriers: the first start since the last context release, and only
    while the flow has no procedure of the kind.  A flow that is silent for `idle` microseconds is forgotten."""

    def __init__(self, idle: int):
        super().__init__(StructType.fromDDL(_ROWS), StructType.fromDDL(_FLOW), ["msg_no"])
        self.idle = idle

    def initial(self):
        return {**super().initial(), "count": 0, **{f"done_{kind}": False for kind in KINDS}}

    def step(self, key, state, rows, mark):
        found = []
        for r in rows:
            if state["last"] is not None and r.at > state["last"] + self.idle:
                state.update(self.initial())
            state["last"] = r.at
            if r.release:
                for kind in KINDS:
                    state[f"ngap_{kind}_no"] = None
            if r.nas_kind is not None and r.readable and (not r.needs_algo or state["algo"] == 0):
                if r.nas_step == "start":
                    self._open(state, "nas", r.nas_kind, r, r.nas_name)
                elif state[f"nas_{r.nas_kind}_no"] is not None:
                    found.append(self._close(key, state, "nas", r.nas_kind, r, r.nas_name, r.nas_step))
            if r.ngap_kind is not None:
                if r.ngap_step == "start":
                    if state[f"ngap_{r.ngap_kind}_no"] is None:
                        self._open(state, "ngap", r.ngap_kind, r, r.ngap)
                elif not state[f"done_{r.ngap_kind}"] and state[f"ngap_{r.ngap_kind}_no"] is not None:
                    found.append(self._close(key, state, "ngap", r.ngap_kind, r, r.ngap, r.ngap_step))
            if state["algo"] is None:
                state["algo"] = r.announced
        if mark > state["last"] + self.idle:
            return found, None
        return found, state["last"] + self.idle + 1

    @staticmethod
    def _open(state, part, kind, r, name):
        state.update({f"{part}_{kind}_ts": r.ts, f"{part}_{kind}_name": name, f"{part}_{kind}_no": r.msg_no})

    @staticmethod
    def _close(key, state, part, kind, r, name, step) -> Row:
        state["count"] += 1
        state[f"done_{kind}"] = True
        start = [state[f"{part}_{kind}_{field}"] for field in ("ts", "name", "no")]
        state[f"{part}_{kind}_no"] = None
        return _Procedure(*key, kind, 0 if part == "nas" else 1, *start, r.ts, name, r.msg_no, step, state["count"])


def _part(name: Column, starts: dict, accepts: dict, rejects: dict) -> tuple[Column, Column]:
    """The kind a message name belongs to, and the step it takes."""
    steps = {k: step_of(name, k, starts, accepts, rejects) for k in KINDS}
    return (F.coalesce(*[F.when(s.isNotNull(), k) for k, s in steps.items()]), F.coalesce(*steps.values()))


def stream_procedures(messages: DataFrame, idle: str, delay: str) -> DataFrame:
    """The rows of `flows.procedures` with the flow key in place of the flow's number, each when it is known.

    `messages` are N2 messages with `event_time`, which grows with msg_no, and may come `delay`
    late.  A flow keeps its state until it is silent for `idle`.
    """
    nas = F.col("nas")
    sealed = F.coalesce(nas.protected, F.lit(False))
    plain_header = F.coalesce(nas.shdr.isin(1, 3), F.lit(False))
    name = F.when(nas["name"].isNotNull(), F.coalesce(nas.inner, nas["name"]))
    nas_kind, nas_step = _part(name, NAS_START, NAS_ACCEPT, NAS_REJECT)
    ngap_kind, ngap_step = _part(F.col("ngap"), CARRIER_START, CARRIER_ACCEPT, CARRIER_REJECT)
    keyed = key_messages(messages).select(
        *FLOW_KEY, "event_time", "msg_no", "ts", "ngap", name.alias("nas_name"), nas_kind.alias("nas_kind"),
        nas_step.alias("nas_step"), ngap_kind.alias("ngap_kind"), ngap_step.alias("ngap_step"),
        F.when((~sealed | (plain_header & nas.inner.isNotNull())) & nas.unparsed.isNull(), nas.ciph_algo).alias("announced"),
        (nas.unparsed.isNull() & ~(sealed & (nas.shdr.isNull() | nas.inner.isNull()))).alias("readable"),
        (sealed & ~plain_header).alias("needs_algo"),
        F.coalesce(F.col("ngap").isin(CONTEXT_RELEASE), F.lit(False)).alias("release"))
    return run_in_order(keyed, FLOW_KEY, Flows(micros(idle)), OUTPUT, delay)
