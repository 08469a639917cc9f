"""Weighted and robust statistics, histograms and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import ratio_or_zero


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Per key and share p the least value at which the running weight reaches p of the total. name to p.

    Weights of equal values are summed before the window, so a window holds distinct values only.
    """
    rows = df.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    w = W.partitionBy(*keys)
    rows = rows.withColumn("__run", F.sum("__w").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("__all", F.sum("__w").over(w))
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col("__run") >= p * F.col("__all") - 1e-12, F.col(value))).alias(name) for name, p in shares.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_histogram(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Per key and bin (value rounded half to even): weight, count and share of the key's weight."""
    bins = df.groupBy(*keys, F.bround(value).cast("int").alias("bin")).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
    return bins.withColumn("share", ratio_or_zero(F.col("weight"), F.sum("weight").over(W.partitionBy(*keys))))


def histogram_overlap(a: DataFrame, b: DataFrame, keys: list[str], shifts: list[int]) -> DataFrame:
    """Per key the shift of `b` under which the shared weight is largest (then the smallest shift), and that weight. Columns: bin, share."""
    moved = b.select(*keys, F.explode(F.array(*map(F.lit, shifts))).alias("shift"), "bin", F.col("share").alias("share_b")).withColumn("bin", F.col("bin") + F.col("shift"))
    both = a.select(*keys, "bin", F.col("share").alias("share_a")).join(moved, [*keys, "bin"])
    by_shift = both.groupBy(*keys, "shift").agg(F.sum(F.least("share_a", "share_b")).alias("shared"))
    best = F.max(F.struct(F.round("shared", 9).alias("shared"), (-F.abs("shift")).alias("near"), F.col("shift").alias("shift")))
    return by_shift.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.shared").alias("shared"), F.col("best.shift").alias("shift"))


def median_deviation(df: DataFrame, keys: list[str], value: str, name: str = "mad") -> DataFrame:
    """Median distance from the key's median."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("__m"))
    return df.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias(name))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, low: float, high: float, least: int) -> DataFrame:
    """Mean of the values between two percentiles for keys with `least` rows or more, else of all."""
    bounds = df.groupBy(*keys).agg(F.percentile(value, low).alias("__lo"), F.percentile(value, high).alias("__hi"), F.count(value).alias("__n"))
    inside = (F.col("__n") < least) | F.col(value).between(F.col("__lo"), F.col("__hi"))
    return df.join(bounds, keys).where(inside).groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"), F.count(value).alias("n_used"))


def reason_counts(df: DataFrame, keys: list[str], reasons: str) -> DataFrame:
    """How often each code of an array column occurs, by key."""
    return df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def continuity(df: DataFrame, keys: list[str], order: list[str], gap_sec: float, phrase_sec: float, short_sec: float, jump: int) -> DataFrame:
    """Per key: counts and shares of gaps, short notes and jumps, the jumps within a phrase and across phrases apart."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.select(
        *keys,
        (F.col("end_sec") - F.col("start_sec")).alias("dur"),
        (F.lead("start_sec").over(w) - F.col("end_sec")).alias("gap"),
        F.abs(F.lead("pitch").over(w) - F.col("pitch")).alias("step"),
    )
    big = F.col("step") > jump
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.count("gap").alias("n_pairs"),
        F.count_if(F.col("gap") > gap_sec).alias("n_gaps"),
        F.count_if(F.col("dur") < short_sec).alias("n_short"),
        F.count_if(big).alias("n_jumps"),
        F.count_if(big & (F.col("gap") <= phrase_sec)).alias("n_local_jumps"),
        F.count_if(big & (F.col("gap") > phrase_sec)).alias("n_phrase_jumps"),
        F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 6).alias("max_gap_sec"),
    )
    share = lambda a, b: F.round(ratio_or_zero(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return out.withColumns({"gap_ratio": share("n_gaps", "n_pairs"), "short_ratio": share("n_short", "n_notes"), "jump_ratio": share("n_jumps", "n_pairs")})


def sums_in_order(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], *others: Column) -> DataFrame:
    """The sums of each key, formed row by row along `order`, and the aggregates `others`. Nulls add nothing.

    A sum of fractions depends on its order in the last digit, which decides where a mean lies just at a threshold or
    between two rounded values. The sums are those of a window, which Spark spills; no key is gathered in memory.
    """
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.withColumns({f"__sum_{name}": F.sum(c).over(so_far) for name, c in sums.items()})
    return rows.groupBy(*keys).agg(*(F.max_by(f"__sum_{name}", F.struct(*order)).alias(name) for name in sums), *others)


def means_in_order(df: DataFrame, keys: list[str], order: list[str], means: dict[str, Column], *others: Column) -> DataFrame:
    """The means of each key, by `sums_in_order`, and the aggregates `others`."""
    rows = df.withColumns({f"__of_{name}": c for name, c in means.items()})
    counts = [F.count(f"__of_{name}").alias(f"__n_{name}") for name in means]
    found = sums_in_order(rows, keys, order, {name: F.col(f"__of_{name}") for name in means}, *counts, *others)
    return found.withColumns({name: F.try_divide(name, f"__n_{name}") for name in means}).drop(*(f"__n_{name}" for name in means))
