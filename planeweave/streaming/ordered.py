"""Keyed state machines over streams that arrive out of order.

Rows wait in the state of their key until the watermark has passed them and are then handed on
in the order of their event time and number, as a batch would read them.  A row later than the
watermark allows is dropped by Spark before it comes here.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, which keyed state machines need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class InOrder(StatefulProcessor):
    """Rows of a key in order, with one named state per key.

    A subclass gives `initial`, the state of a new key, and `step`.  Rows have the columns `rows`,
    among them `at`, their event time in microseconds; equal times go by the columns `order`.
    """

    def __init__(self, rows: StructType, state: StructType, order: list[str]):
        self.rows, self.fields, self.order = rows, state, order

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", self.fields)

    def initial(self) -> dict:
        return dict.fromkeys(self.fields.names)

    def step(self, key: tuple, state: dict, rows: list[Row], mark: int) -> tuple[list[Row], int | None]:
        """Take `rows`, all that came up to the time `mark`; change `state`, give what is found and
        the time at which to be called again though nothing comes, or None to forget the key."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come = [tuple(r[c] for c in self.rows.names) for r in rows]
        self.waiting.appendList(come)
        # One timer for the first of them; it sets the next.
        at = self.rows.names.index("at")
        self._wake(min(r[at] for r in come))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [Row(*self.rows.names)(*r) for r in self.waiting.get()]
        due = sorted((r for r in waiting if r.at <= mark), key=lambda r: (r.at, *(r[c] for c in self.order)))
        rest = [tuple(r) for r in waiting if r.at > mark]
        known = self.state.get()
        state = self.initial() if known is None else dict(zip(self.fields.names, known))
        # A timer that was set before another one did its work finds nothing to do.
        found, wake = ([], None) if known is None and not due else self.step(key, state, due, mark)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if wake is None:
            self.state.clear()
        else:
            self.state.update(tuple(state[c] for c in self.fields.names))
        if rest:
            at = self.rows.names.index("at")
            self._wake(min(r[at] for r in rest))
        if wake is not None:
            self._wake(wake)
        return iter(found)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def micros(interval: str) -> int:
    """Microseconds of an interval such as '30 seconds'."""
    import re

    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
    number, unit = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", interval).groups()
    return int(number) * units[unit] * 1_000_000


def row_of(ddl: str) -> Row:
    """A row type with the columns of a flat DDL."""
    return Row(*(column.split()[0] for column in ddl.split(",")))


def run_in_order(messages: DataFrame, keys: list[str], processor: InOrder, output: str, delay: str) -> DataFrame:
    """`messages` with `event_time` through `processor`, by `keys`; rows may come `delay` late."""
    use_state(messages.sparkSession)
    names = list(dict.fromkeys([*keys, *processor.rows.names]))
    return (messages.withColumn("at", F.unix_micros("event_time")).withWatermark("event_time", delay)
            .select(*names, "event_time").groupBy(*keys)
            .transformWithState(processor, output, "Append", "EventTime"))
