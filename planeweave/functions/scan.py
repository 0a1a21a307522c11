"""Ordered scans whose work stays bounded when one key holds most of the rows.

Every key is cut into chunks along its order, so that a window only ever sees the rows of one
(key, chunk).  A summary row per (key, chunk) is scanned over the chunks of the key and joined
back as the state a chunk starts from; a key of one chunk has no such row, and where all keys
are short adaptive execution drops the join.  Positions (such as `msg_no`) are cut at fixed
distances.  Orders of any other kind, where very many rows can share one value, are cut by
sampled ranges, see `dealt`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from planeweave.session import written

CHUNK_ROWS = 262_144

# Positions in a chunk; None: CHUNK_ROWS.
Split = int | None


@dataclass(frozen=True)
class Scan:
    """One running value: inside a chunk, per chunk, across chunks, and merged.  A null carry
    is what a first chunk starts from."""

    local: Callable[[WindowSpec], Column]
    summary: Column
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def _where_set(value: Column, order: str) -> Column:
    return F.when(value.isNotNull(), F.col(order))


def previous(value: Column, order: str) -> Scan:
    """Last non-null value strictly before the row."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(_before(w)),
        F.max_by(value, _where_set(value, order)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda local, carry: F.coalesce(local, carry),
    )


def latest(value: Column, order: str) -> Scan:
    """Last non-null value up to and including the row."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)),
        F.max_by(value, _where_set(value, order)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda local, carry: F.coalesce(local, carry),
    )


def earliest(value: Column, order: str) -> Scan:
    """First non-null value strictly before the row."""
    return Scan(
        lambda w: F.first(value, ignorenulls=True).over(_before(w)),
        F.min_by(value, _where_set(value, order)),
        lambda s, w: F.first(s, ignorenulls=True).over(_before(w)),
        lambda local, carry: F.coalesce(carry, local),
    )


def upcoming(value: Column, order: str) -> Scan:
    """First non-null value strictly after the row."""
    return Scan(
        lambda w: F.first(value, ignorenulls=True).over(_after(w)),
        F.min_by(value, _where_set(value, order)),
        lambda s, w: F.first(s, ignorenulls=True).over(_after(w)),
        lambda local, carry: F.coalesce(local, carry),
    )


def any_ahead(flag: Column) -> Scan:
    """True when the flag holds on the row or on a later one."""
    return Scan(
        lambda w: F.max(flag).over(w.rowsBetween(0, Window.unboundedFollowing)),
        F.max(flag),
        lambda s, w: F.max(s).over(_after(w)),
        lambda local, carry: local | F.coalesce(carry, F.lit(False)),
    )


def _zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)).cast("long")


def count_before(flag: Column) -> Scan:
    """Number of rows strictly before the row on which the flag holds."""
    one = F.when(flag, 1).otherwise(0)
    return Scan(
        lambda w: _zero(F.sum(one).over(_before(w))),
        F.sum(one),
        lambda s, w: _zero(F.sum(s).over(_before(w))),
        lambda local, carry: local + _zero(carry),
    )


def position() -> Scan:
    """1-based row number."""
    return Scan(
        lambda w: F.row_number().over(w).cast("long"),
        F.count(F.lit(1)),
        lambda s, w: _zero(F.sum(s).over(_before(w))),
        lambda local, carry: local + _zero(carry),
    )


def total_to(value: Column) -> Scan:
    """Sum of a value that is never null up to and including the row."""
    return Scan(
        lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.sum(value),
        lambda s, w: _zero(F.sum(s).over(_before(w))),
        lambda local, carry: local + _zero(carry),
    )


def xor_to(value: Column) -> Scan:
    """Bitwise exclusive or of a value that is never null up to and including the row."""
    return Scan(
        lambda w: F.bit_xor(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.bit_xor(value),
        lambda s, w: _zero(F.bit_xor(s).over(_before(w))),
        lambda local, carry: local.bitwiseXOR(_zero(carry)),
    )


def dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """`df` written in ranges of `by`, with the number of the range as `_part`.

    Spark samples the columns of `by` for the splitters, so a key with very many rows, or rows
    of one time, takes as many ranges as it fills.  As the `bucket` of a scan in the order of `by`,
    `_part` splits every key there.
    """
    return written(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))


def chunk_of(order: str, rows: int) -> Column:
    """The chunk a position falls into."""
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    split: Split = None,
    ties: Sequence[str] = (),
    bucket: Column | None = None,
    **specs: Scan,
) -> DataFrame:
    """Add one column per spec, scanned in `order` within `keys`.

    `bucket` replaces the cut into chunks where `order` is no position; it must
    grow with `order`.  The keys must not be null.
    """
    cut = chunk_of(order, split or CHUNK_ROWS) if bucket is None else bucket
    chunked = df.withColumn("_chunk", cut)
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(order, *ties)
    across = Window.partitionBy(*keys).orderBy("_chunk")

    local = chunked.select("*", *[s.local(inside).alias(f"_in_{n}") for n, s in specs.items()])
    summaries = chunked.groupBy(*part).agg(*[s.summary.alias(n) for n, s in specs.items()])
    # A chunk beside which its key has no other starts from nothing.
    carried = summaries.select(
        *part, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_chunks"),
        *[s.carry(F.col(n), across).alias(f"_at_{n}") for n, s in specs.items()]
    ).filter("_chunks > 1").drop("_chunks")
    return local.join(carried, part, "left").select(
        *df.columns,
        *[s.merge(F.col(f"_in_{n}"), F.col(f"_at_{n}")).alias(n) for n, s in specs.items()])
