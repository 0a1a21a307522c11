import random

import pytest
from pyspark.sql import functions as F

from planeweave.functions import scan as s
from planeweave.functions.top import top_rows


def _data(spark, n=300):
    rng = random.Random(7)
    # One key holds most of the rows.
    return spark.createDataFrame(
        [(rng.choice("hhhhab"), i, rng.choice([None, rng.randint(0, 9)]), rng.random() < .3)
         for i in rng.sample(range(1000), n)], "k string, o bigint, v int, f boolean")


def specs():
    return {
        "prev": s.previous(F.col("v"), "o"), "last": s.latest(F.col("v"), "o"),
        "early": s.earliest(F.col("v"), "o"), "ahead": s.upcoming(F.col("v"), "o"),
        "any": s.any_ahead(F.col("f")), "cnt": s.count_before(F.col("f")), "no": s.position()}


@pytest.mark.parametrize("width", [1, 7, 100_000, None])
def test_scan_equals_a_loop(spark, width):
    df = _data(spark)
    plain = {r.o: r.asDict() for r in s.scan(df, ["k"], "o", split=width, **specs()).collect()}
    assert len(plain) == 300
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r.o):
        groups.setdefault(r.k, []).append(r)
    for rows in groups.values():
        for i, r in enumerate(rows):
            before = [x.v for x in rows[:i] if x.v is not None]
            after = [x.v for x in rows[i + 1:] if x.v is not None]
            got = plain[r.o]
            assert got["prev"] == (before[-1] if before else None)
            assert got["last"] == (r.v if r.v is not None else got["prev"])
            assert got["early"] == (before[0] if before else None)
            assert got["ahead"] == (after[0] if after else None)
            assert got["any"] == any(x.f for x in rows[i:])
            assert got["cnt"] == sum(x.f for x in rows[:i])
            assert got["no"] == i + 1


def test_top_rows_limits_each_task_before_the_shuffle(spark):
    top = top_rows(_data(spark), ["k"], ["o"], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 6


def test_dealt_ranges_split_a_key(spark):
    df = _data(spark).withColumn("w", F.coalesce("v", F.lit(0)).cast("long"))
    # Few rows would be joined to one range.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    laid = s.dealt(df.repartition(3), ["k", "o"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert laid.filter("k = 'h'").select("_part").distinct().count() > 1
    more = {"total": s.total_to(F.col("w")), "mixed": s.xor_to(F.xxhash64("o"))}
    got = s.scan(laid, ["k"], "o", bucket=F.col("_part"), **specs(), **more).drop("_part")
    want = s.scan(df, ["k"], "o", **specs(), **more)
    assert {r.o: r for r in got.collect()} == {r.o: r for r in want.collect()}
