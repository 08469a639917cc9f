"""Means whose sums are formed row by row, whatever the partitions are."""

import random

from pyspark.sql import functions as F

from spanwise.functions.scalar import round_scaled
from spanwise.operators import aggregates as A
from spanwise.plans import catalog


def plain(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def test_sums_follow_the_order_of_rows(spark):
    r = random.Random(3)
    rows = [(key, seq, r.randrange(101) / 100.0) for key in range(40) for seq in range(60)]
    want = {key: plain([v for k, _, v in rows if k == key]) for key in range(40)}
    assert want != {key: plain([v for k, _, v in rows if k == key][::-1]) for key in range(40)}
    df = spark.createDataFrame(r.sample(rows, len(rows)), "key long, seq long, v double").repartition(7)
    got = A.means_in_order(df, ["key"], ["seq"], {"m": F.col("v"), "some": F.when(F.col("seq") < 2, F.col("v")), "none": F.lit(None).cast("double")}, F.count(F.lit(1)).alias("n")).collect()
    assert {x.key: x.m for x in got} == want and all(x.n == 60 and x.none is None for x in got)
    assert {x.key: x.some for x in got} == {key: plain([v for k, s, v in rows if k == key and s < 2]) for key in range(40)}
    assert A.means_in_order(df.limit(0), ["key"], ["seq"], {"m": F.col("v")}).count() == 0


def test_rounded_after_scaling(spark):
    # one unit of the last place below a half of the last digit
    row = spark.range(1).select(round_scaled(F.lit(0.5242964999999999)).alias("a"), round_scaled(F.lit(-1.25), 1).alias("b"), round_scaled(F.lit(None).cast("double")).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.524297, -1.3, None)


def test_gates_do_not_depend_on_partitions(spark, tmp_path):
    """Confidences 0.57, 0.0, ... in shuffled files give the same means as in one file in order."""
    e = spark.createDataFrame([(i, u, "view", 0.0, '{"k": 5}', i * 1000) for u in range(30) for i in range(u * 50, u * 50 + 50)], "event_id long, user_id long, event_type string, value double, props string, s long")
    e = e.withColumn("ts", F.timestamp_seconds(F.col("s") + 1704067200)).drop("s")
    e.coalesce(1).write.parquet(str(tmp_path / "a/events.parquet"))
    e.orderBy(F.xxhash64("event_id")).repartition(9).write.parquet(str(tmp_path / "b/events.parquet"))
    for name in ("f10_threshold_gate", "f12_failure_modes", "c25_measure_issues", "c66_rhythm_diagnosis", "w14_low_confidence_regions"):
        a, b = (sorted(map(repr, catalog.QUERIES[name](spark, str(tmp_path / x)).collect())) for x in "ab")
        assert a == b
