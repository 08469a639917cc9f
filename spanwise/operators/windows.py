"""Operators on ordered rows of a key: deltas, moving statistics, smoothing, checks of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*order)


def with_next(df: DataFrame, keys: list[str], order: list[str], **columns: str) -> DataFrame:
    """Adds columns of the next row: new name to column."""
    w = ordered(keys, order)
    return df.withColumns({new: F.lead(old).over(w) for new, old in columns.items()})


def moving_median(x: str, keys: list[str], order: list[str], half: int) -> Column:
    """Median of the values at most `half` rows away; nulls do not count."""
    return F.percentile(x, 0.5).over(ordered(keys, order).rowsBetween(-half, half))


def moving_mad(x: str, keys: list[str], order: list[str], half: int) -> Column:
    """Median distance from the median among the values at most `half` rows away."""
    near = F.array_sort(F.collect_list(x).over(ordered(keys, order).rowsBetween(-half, half)))
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2
    center = middle(near)
    return F.when(F.size(near) > 0, middle(F.array_sort(F.transform(near, lambda v: F.abs(v - center)))))


def rolling_median(x: str, keys: list[str], order: list[str], n: int) -> Column:
    """Median of this value and the n - 1 after it; null where there are fewer."""
    w = ordered(keys, order).rowsBetween(0, n - 1)
    return F.when(F.count(x).over(w) == n, F.percentile(x, 0.5).over(w))


def frame_weights(df: DataFrame, keys: list[str], time: str, name: str = "weight") -> DataFrame:
    """Time to the next row; for the last one of a key, the median of the others."""
    step = F.lead(time).over(ordered(keys, [time])) - F.col(time)
    out = df.withColumn("__step", step)
    return out.withColumn(name, F.coalesce("__step", F.median("__step").over(W.partitionBy(*keys)), F.lit(0.0))).drop("__step")


def turns(df: DataFrame, keys: list[str], order: list[str], x: str, dead_band: float) -> DataFrame:
    """Per key, how often the direction changes; steps of at most `dead_band` have no direction."""
    w = ordered(keys, order)
    steps = df.withColumn("__d", F.col(x) - F.lag(x).over(w)).where(F.abs("__d") > dead_band).withColumn("__s", F.signum("__d"))
    changed = (F.col("__s") != F.lag("__s").over(w)).cast("int")
    counted = steps.withColumn("__c", changed).groupBy(*keys).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("turns"))
    return df.select(*keys).distinct().join(counted, keys, "left").fillna(0, ["turns"])


def running_max_violations(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """The rows whose x is below what came before."""
    w = ordered(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("max_before", F.max(x).over(w)).where(F.col(x) < F.col("max_before"))


def smooth_short(df: DataFrame, keys: list[str], order: list[str], most_sec: float, most_step: float, most_gap: float) -> DataFrame:
    """`smoothed`: the median pitch of the two rows before and after for short notes in an unbroken phrase, if it is near."""
    w = ordered(keys, order)
    out = df.withColumn("__gap_ok", F.coalesce(F.lead("start_sec").over(w) - F.col("end_sec") <= most_gap, F.lit(True)))
    near = w.rowsBetween(-2, 2)
    out = out.withColumn("__median", F.percentile("pitch", 0.5).over(near)).withColumn("__ok", F.bool_and("__gap_ok").over(w.rowsBetween(-2, 1)))
    takes = F.col("__ok") & (F.col("end_sec") - F.col("start_sec") <= most_sec) & (F.abs(F.col("__median") - F.col("pitch")) <= most_step)
    return out.withColumn("smoothed", F.when(takes, F.col("__median")).otherwise(F.col("pitch").cast("double"))).drop("__gap_ok", "__median", "__ok")


def sustain(df: DataFrame, keys: list[str], order: list[str], most_gap: float, most_jump: int) -> DataFrame:
    """Ends move to the next start over short gaps to near pitches."""
    w = ordered(keys, order)
    gap, jump = F.lead("start_sec").over(w) - F.col("end_sec"), F.abs(F.lead("pitch").over(w) - F.col("pitch"))
    return df.withColumn("sustained_end", F.when((gap > 0) & (gap <= most_gap) & (jump <= most_jump), F.lead("start_sec").over(w)).otherwise(F.col("end_sec")))


def row_ids(df: DataFrame, keys: list[str], order: list[str], prefix: str, name: str = "row_id") -> DataFrame:
    """Ids such as n_00001 in order."""
    return df.withColumn(name, F.format_string(f"{prefix}_%05d", F.row_number().over(ordered(keys, order))))


def midpoints(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The points, and one half-way to each next."""
    w = ordered(keys, [time])
    between = df.select(*keys, ((F.col(time) + F.lead(time).over(w)) / 2).alias(time)).where(F.col(time).isNotNull())
    return df.select(*keys, time).unionByName(between)
