"""Rejection reasons, gates and funnels from lists of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import labels


def with_reasons(df: DataFrame, tests: list[tuple[Column, str]], name: str = "reasons") -> DataFrame:
    """Adds the codes of all the tests that a row fails by meeting their condition."""
    return df.withColumn(name, labels(*tests))


def waive(reasons: str, codes: list[str], condition: Column) -> Column:
    """Accepted: without reasons, or with none but `codes` where the condition holds."""
    rest = F.array_except(reasons, F.array(*map(F.lit, codes)))
    return (F.size(reasons) == 0) | ((F.size(rest) == 0) & condition)


def gate(df: DataFrame, keys: list[str], checks: list[tuple[str, str, float]]) -> DataFrame:
    """A row per key and check (metric, '<=' or '>=', threshold): value and whether it passes; null never does."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(F.col(m) <= t if op == "<=" else F.col(m) >= t, F.lit(False)).alias("passed")) for m, op, t in checks]
    return df.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")


def funnel(df: DataFrame, keys: list[str], layers: dict[str, Column], digits: int = 6) -> DataFrame:
    """Counts of the rows that reach each layer, and the share of the layer before that each keeps, in one pass."""
    out = df.groupBy(*keys).agg(*(F.count_if(c).alias(f"n_{name}") for name, c in layers.items()))
    names = list(layers)
    return out.withColumns({f"keep_{b}": F.round(F.try_divide(f"n_{b}", f"n_{a}"), digits) for a, b in zip(names, names[1:], strict=False)})


def rhythm_issues(tempo_stability: Column, downbeat_confidence: Column, bar_phase_confidence: Column, off_grid_ratio: Column, pickup: Column, rubato: Column) -> tuple[Column, Column]:
    """A diagnosis and its sorted flags from measures of 0 to 1; a measure that is null tells nothing."""
    unstable = F.coalesce(tempo_stability < 0.65, F.lit(False))
    issues = labels(
        (unstable, "possible_tempo_instability"),
        (downbeat_confidence < 0.35, "possible_downbeat_uncertainty"),
        (bar_phase_confidence < 0.45, "possible_bar_phase_error"),
        (off_grid_ratio > 0.35, "possible_off_grid_quantization"),
        (pickup >= 0.7, "possible_pickup_or_leading_silence"),
        ((rubato >= 0.7) & ~unstable, "possible_tempo_instability"),
    )
    diagnosis = F.when(F.size(issues) > 1, "mixed_rhythm_issue").otherwise(F.coalesce(F.get(issues, F.lit(0)), F.lit("stable_grid")))
    flags = F.array_sort(F.array_union(issues, F.when(F.size(issues) > 1, F.array(F.lit("mixed_rhythm_issue"))).otherwise(F.array().cast("array<string>"))))
    return diagnosis, flags


def looked_up(values: Column, table: dict[str, list[str]], default: str) -> Column:
    """What `table` lists for each of the values, in order and once each; `default` where that is nothing."""
    of = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = F.array_distinct(F.flatten(F.filter(F.transform(values, lambda v: of[v]), lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def is_voiced(voiced: Column, state: Column, pitch: Column, frequency: Column) -> Column:
    """The flag where there is one, else a state that says so, else any pitch or a frequency above 0."""
    said = F.coalesce(F.lower(state).isin("voiced", "active", "vocal", "singing"), F.lit(False))
    return F.coalesce(voiced, said | pitch.isNotNull() | F.coalesce(frequency > 0, F.lit(False)))


def all_flags(texts: list[Column], lists: list[Column], maps: list[Column]) -> Column:
    """The sorted flags named by texts, by lists, or by maps of a flag to whether it is set; null where there are none."""
    found = [F.array(t) for t in texts] + lists + [F.map_keys(F.map_filter(m, lambda _, v: v)) for m in maps]
    found = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in found)))
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(found) > 0, found)
