"""Greedy packing of ordered pieces, cut into runs.

Packing is a fold: the open body's size decides where the next cut falls.  Pieces are
dealt out in ranges, whatever groups they belong to, and a range depends on the one before only
through the size that its first group is entered with, and only until the first cut.  So the
first and the last group of a range are summarised by what follows each possible first cut,
the summaries of a group are chained in order, and each range is then folded on its own.  No task
sees more than the sizes of one range, or the short summaries of one group.
"""

from __future__ import annotations

from itertools import chain as chained

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.functions.scan import dealt

KEY = ["spec", "node_no"]
ORDER = [*KEY, "unit_no", "piece_no"]


def first_cuts(sizes: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """For each piece that may be the run's first cut: the size that has gathered
    up to and with it, the size left open at the end, and the cuts made."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    before = ends - sizes
    # next_cut[j]: first piece that no longer fits a body that starts at j.
    next_cut = np.searchsorted(ends, before + limit, side="right")
    next_cut = np.maximum(next_cut, np.arange(n) + 1)
    left, cuts = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    for j in range(n - 1, -1, -1):
        k = next_cut[j]
        if k >= n:
            left[j] = ends[-1] - before[j]
        else:
            left[j], cuts[j] = left[k], cuts[k] + 1
    last = int(np.searchsorted(ends, limit, side="right")) + 1
    return ends[:last].tolist(), left[:last].tolist(), cuts[:last].tolist()


def _chain(limit: int):
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry size and body number of each run; -1: no body is open yet."""
        rows, size, body = [], -1, 0
        for r in pdf.sort_values("_part").itertuples():
            rows.append((r.spec, r.node_no, r._1, size, body))
            if size < 0:
                # The first piece opens a body whatever its size.
                if len(r.left):
                    size, body = r.left[0], body + r.cuts[0] - 1
                continue
            at = int(np.searchsorted(np.asarray(r.ends), limit - size, side="right"))
            if at < len(r.left):
                size, body = r.left[at], body + r.cuts[at]
            else:
                size += r.total
        return pd.DataFrame(rows, columns=[*KEY, "_part", "entry", "body"])
    return chain


def _groups(it):
    """(part, spec, node_no), rows as lists of columns, for every group of every range."""
    held, rows = None, []
    for batch in chained(it, [None]):
        columns = None if batch is None else [batch.column(c).to_pylist() for c in batch.schema.names]
        size = 0 if columns is None else len(columns[0])
        at = [(columns[0][k], columns[1][k], columns[2][k]) for k in range(size)]
        cuts = [0, *(k for k in range(1, size) if at[k] != at[k - 1]), size] if size else [0]
        for start, end in zip(cuts, cuts[1:]):
            part = [c[start:end] for c in columns]
            if held == at[start]:
                for mine, more in zip(rows, part):
                    mine += more
                continue
            if held is not None:
                yield held, rows
            held, rows = at[start], part
    if held is not None:
        yield held, rows


def _summaries(limit: int, schema: pa.Schema):
    def summarize(it):
        """The first and the last group of every range."""
        def row(group, rows):
            sizes = np.array(rows[5], np.int64)
            ends, left, cuts = first_cuts(sizes, limit)
            return dict(zip(schema.names, (*group, int(sizes.sum()), ends, left, cuts)))

        part, last, made = None, None, []
        for group, rows in _groups(it):
            if group[0] != part:
                made += [] if last is None else [row(*last)]
                made.append(row(group, rows))
                part, last = group[0], None
            else:
                last = group, rows
        made += [] if last is None else [row(*last)]
        yield pa.RecordBatch.from_pylist(made, schema=schema)
    return summarize


def _numbers(limit: int, schema: pa.Schema):
    def number(it):
        for (_, spec, node), rows in _groups(it):
            size = -1 if rows[6][0] is None else rows[6][0]
            body, out = rows[7][0] or 0, []
            for n in rows[5]:
                if size >= 0 and size + n > limit:
                    body, size = body + 1, 0
                size = max(size, 0) + n
                out.append(body)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(([spec] * len(out), [node] * len(out), rows[3], rows[4], out), schema)],
                schema=schema)
    return number


def body_numbers(pieces: DataFrame, limit: int) -> DataFrame:
    """(spec, node_no, unit_no, piece_no, body_no): the body, 0, 1, ... per (spec, node_no), that each
    piece, given with its size, is packed into."""
    laid = dealt(pieces.select(*ORDER, F.col("size").cast("long").alias("size")), ORDER)
    kinds = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    key = [pa.field(c, types[kinds[c]]) for c in ORDER]
    lists = [pa.field(c, pa.list_(pa.int64())) for c in ("ends", "left", "cuts")]
    summary = pa.schema([pa.field("_part", pa.int32()), *key[:2], pa.field("total", pa.int64()), *lists])
    numbered = pa.schema([*key, pa.field("body_no", pa.int64())])
    ddl = f"spec {kinds['spec']}, node_no {kinds['node_no']}"

    def ranges(df: DataFrame) -> DataFrame:
        return df.repartition("_part").sortWithinPartitions("_part", *ORDER)

    runs = ranges(laid.select("_part", *ORDER, "size")).mapInArrow(
        _summaries(limit, summary), f"_part int, {ddl}, total long, ends array<long>, left array<long>, cuts array<long>")
    entries = runs.groupBy(*KEY).applyInPandas(_chain(limit), f"{ddl}, _part int, entry long, body long")
    entered = laid.join(entries, [*KEY, "_part"], "left").select("_part", *ORDER, "size", "entry", "body")
    return ranges(entered).mapInArrow(
        _numbers(limit, numbered), f"{ddl}, unit_no {kinds['unit_no']}, piece_no {kinds['piece_no']}, body_no long")
