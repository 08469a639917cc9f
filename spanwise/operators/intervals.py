"""Joins, merges and sweeps of half-open intervals within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, pick=F.max, before: bool = True, bucket: Column | None = None) -> DataFrame:
    """Adds `name`: max, min or sum of `value` over the rows of the key before a row (before=False: up to it).

    With `bucket`, a number that never falls along the order, no task needs a whole key: rows
    are dealt by key and bucket, and what the buckets before add up to, one row a bucket, is
    computed apart and joined.
    """
    last = -1 if before else 0
    if bucket is None:
        return df.withColumn(name, pick(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, last)))
    rows = df.withColumns({"__bucket": bucket, "__value": value})
    own = pick("__value").over(W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, last))
    carried = rows.groupBy(*keys, "__bucket").agg(pick("__value").alias("__whole"))
    carried = carried.withColumn("__carry", pick("__whole").over(W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))).drop("__whole")
    joined = rows.withColumn("__own", own).join(carried, [*keys, "__bucket"])
    if pick is F.sum:
        both = F.when(F.col("__own").isNotNull() | F.col("__carry").isNotNull(), F.coalesce("__own", F.lit(0)) + F.coalesce("__carry", F.lit(0)))
    else:
        both = (F.greatest if pick is F.max else F.least)("__own", "__carry")
    return joined.withColumn(name, both).drop("__bucket", "__value", "__own", "__carry")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, bucket: Column) -> DataFrame:
    """Adds `name`: `value` of the row of the key just before, null for its first.

    Rows are dealt by key and bucket, a number that never falls along the order; the first row of a
    bucket gets the last value of the bucket before, of which there is one row each.
    """
    rows = df.withColumn("__bucket", bucket)
    lasts = rows.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
    lasts = lasts.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
    own = F.lag(F.struct(value)).over(W.partitionBy(*keys, "__bucket").orderBy(*order))
    return rows.withColumn("__own", own).join(lasts, [*keys, "__bucket"]).withColumn(name, F.coalesce("__own", "__carry")[value]).drop("__bucket", "__own", "__carry")


def _bucket(time: str, width: float | None) -> Column | None:
    return None if width is None else F.floor(F.col(time) / width)


def island_ids(df: DataFrame, keys: list[str], order: list[str], boundary: Column, name: str = "island", bucket: Column | None = None) -> DataFrame:
    """Numbers the runs of rows from 0; a row for which `boundary` holds starts a new one, and the first row of a key the first."""
    w = W.partitionBy(*keys).orderBy(*order)
    if bucket is None:
        return df.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).when(F.coalesce(boundary, F.lit(False)), 1).otherwise(0)).withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    return prefix(df, keys, order, F.coalesce(boundary, F.lit(False)).cast("int"), name, F.sum, before=False, bucket=bucket)


def reach(keys: list[str], order: list[str], end: str = "end_sec") -> Column:
    """The latest end among the rows before."""
    return F.max(end).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def merge_spans(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec", gap: float = 0.0, width: float | None = None) -> DataFrame:
    """Unions of intervals that overlap or stand at most `gap` apart: keys, start, end, n_merged. width: seconds of a key that one task takes."""
    order = [start, end]
    cut = prefix(df.select(*keys, start, end), keys, order, F.col(end), "__reach", bucket=_bucket(start, width))
    runs = island_ids(cut, keys, order, F.col(start) > F.col("__reach") + gap, "__run", _bucket(start, width))
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("__run")


def coverage(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec", width: float | None = None) -> DataFrame:
    """Per key: span, length of the union, share of the span that it covers, and the longest silence inside."""
    cut = prefix(df.select(*keys, start, end), keys, [start, end], F.col(end), "__reach", bucket=_bucket(start, width))
    own = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce("__reach", start)))
    silence = F.greatest(F.lit(0.0), F.col(start) - F.coalesce("__reach", start))
    out = cut.groupBy(*keys).agg((F.max(end) - F.min(start)).alias("span_sec"), F.sum(own).alias("covered_sec"), F.max(silence).alias("longest_silence_sec"))
    return out.withColumn("coverage", F.coalesce(F.try_divide("covered_sec", "span_sec"), F.lit(0.0)))


def gaps(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec", least: float = 0.0, width: float | None = None) -> DataFrame:
    """Spaces longer than `least` between the union of the rows so far and the next row: keys, gap_start, gap_end, gap_sec."""
    cut = prefix(df.select(*keys, start, end), keys, [start, end], F.col(end), "gap_start", bucket=_bucket(start, width))
    return cut.where(F.col(start) - F.col("gap_start") > least).select(*keys, "gap_start", F.col(start).alias("gap_end"), (F.col(start) - F.col("gap_start")).alias("gap_sec"))


def _buckets(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """A row for each bucket of time that an interval touches."""
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, l_start: str, l_end: str, r_start: str, r_end: str, condition: Column | None = None) -> DataFrame:
    """Inner join on keys and overlap: l_end > r_start and l_start < r_end.

    Both sides are dealt to buckets of `width` seconds, so the join is an equi-join and no
    task holds a whole key. A pair that meets in several buckets is kept in the first of
    them, so nothing has to be made distinct. Apart from the keys, columns must differ.
    """
    a = _buckets(left, F.col(l_start), F.col(l_end), width)
    b = _buckets(right, F.col(r_start), F.col(r_end), width)
    joined = a.join(b, [*keys, "__bucket"]).where((F.col(l_end) > F.col(r_start)) & (F.col(l_start) < F.col(r_end)))
    joined = joined.where(F.col("__bucket") == F.floor(F.greatest(l_start, r_start) / width)).drop("__bucket")
    return joined if condition is None else joined.where(condition)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], l_time: str, r_time: str, tolerance: float) -> DataFrame:
    """Inner join on keys and |l_time - r_time| <= tolerance, by buckets as wide as the tolerance."""
    a = left.withColumn("__bucket", F.floor(F.col(l_time) / tolerance))
    b = right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(r_time) / tolerance) - 1, F.floor(F.col(r_time) / tolerance) + 1)))
    return a.join(b, [*keys, "__bucket"]).drop("__bucket").where(F.abs(F.col(l_time) - F.col(r_time)) <= tolerance)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], l_time: str, r_time: str, carry: list[str], forward: bool = False, width: float | None = None) -> DataFrame:
    """Adds to each left row `carry` of the last right row at or before it (forward: the first at or after it), or nulls.

    One union and one window: the keys are shuffled once and nothing is multiplied. With `width`,
    rows are dealt by key and buckets of so many seconds, and the last right row before each bucket
    is found apart, so that no task needs a whole key.
    """
    tagged = left.withColumns({"__time": F.col(l_time), "__side": F.lit(1)})
    other = right.select(*keys, F.col(r_time).alias("__time"), F.lit(0).alias("__side"), F.struct(*carry).alias("__found"))
    both = tagged.unionByName(other, allowMissingColumns=True)
    order = [F.desc("__time"), "__side"] if forward else ["__time", "__side"]
    upto = lambda *by: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if width is None:
        both = both.withColumn("__found", F.last("__found", ignorenulls=True).over(upto(*keys))).where("__side = 1")
    else:
        both = both.withColumn("__bucket", F.floor(F.col("__time") / width))
        edge = (F.min_by if forward else F.max_by)("__found", F.when(F.col("__side") == 0, F.col("__time")))
        along = W.partitionBy(*keys).orderBy(F.desc("__bucket") if forward else "__bucket").rowsBetween(W.unboundedPreceding, -1)
        edges = both.groupBy(*keys, "__bucket").agg(edge.alias("__edge")).withColumn("__carry", F.last("__edge", ignorenulls=True).over(along)).drop("__edge")
        both = both.withColumn("__found", F.last("__found", ignorenulls=True).over(upto(*keys, "__bucket"))).where("__side = 1")
        both = both.join(edges, [*keys, "__bucket"]).withColumn("__found", F.coalesce("__found", "__carry"))
    return both.select(*left.columns, *(F.col("__found")[c].alias(c) for c in carry))


def skyline(df: DataFrame, keys: list[str], start: str, end: str, value: str, width: float, merge_gap: float = 0.06, least: float = 0.08) -> DataFrame:
    """The highest active value of each elementary slice; slices of one value merge over short gaps, and short ones go."""
    points = df.select(*keys, F.explode(F.array(start, end)).alias("slice_start")).distinct()
    slices = points.withColumn("slice_end", F.lead("slice_start").over(W.partitionBy(*keys).orderBy("slice_start"))).where("slice_end is not null")
    active = interval_join(df.select(*keys, start, end, value), slices, keys, width, start, end, "slice_start", "slice_end")
    top = active.groupBy(*keys, "slice_start", "slice_end").agg(F.max(value).alias(value))
    w = W.partitionBy(*keys).orderBy("slice_start")
    cut = (F.col(value) != F.lag(value).over(w)) | (F.col("slice_start") - F.lag("slice_end").over(w) > merge_gap)
    runs = island_ids(top, keys, ["slice_start"], cut)
    merged = runs.groupBy(*keys, "island", value).agg(F.min("slice_start").alias(start), F.max("slice_end").alias(end)).drop("island")
    return merged.where(F.col(end) - F.col(start) >= least)


def active_counts(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """How many intervals are active from each boundary on: keys, time, active. Ends come before starts at the same time."""
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("time"), F.lit(1).alias("step")), F.struct(F.col(end).alias("time"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.time", "e.step")
    steps = steps.groupBy(*keys, "time").agg(F.sum("step").alias("step"))
    return steps.withColumn("active", F.sum("step").over(W.partitionBy(*keys).orderBy("time").rowsBetween(W.unboundedPreceding, 0))).drop("step")
