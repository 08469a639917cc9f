"""Latest versions, comparisons of two tables, pairing by key, and edits as rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extreme(df: DataFrame, keys: list[str], order: list[str], columns: list[str], pick) -> DataFrame:
    best = pick(F.struct(*columns), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last in a total order. An aggregate: it combines before it shuffles."""
    return _extreme(df, keys, order, columns, F.max_by)


def earliest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return _extreme(df, keys, order, columns, F.min_by)


def compare_runs(a: DataFrame, b: DataFrame, key: str, old: str, new: str, lower_is_better: bool = False) -> DataFrame:
    """Full outer by key: both values, delta and signal."""
    gain = (F.col(old) - F.col(new)) if lower_is_better else (F.col(new) - F.col(old))
    joined = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    signal = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")
    return joined.select(key, old, new, (F.col(new) - F.col(old)).alias("delta"), signal.alias("signal"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys, and kind: added, deleted, changed or same."""
    a = before.select(*keys, F.struct(*columns).alias("__a"))
    b = after.select(*keys, F.struct(*columns).alias("__b"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("kind"))


def pair_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key how often it occurs on either side, and whether that makes a pair."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    n = both.groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    status = F.when(F.col("n_left") == 0, "right_only").when(F.col("n_right") == 0, "left_only").when(F.col("n_left") + F.col("n_right") > 2, "duplicate").otherwise("paired")
    return n.withColumn("status", status)


def get_or_create(have: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """What there is, and what is wanted besides, marked as created."""
    return have.withColumn("created", F.lit(False)).unionByName(want.join(have, keys, "left_anti").withColumn("created", F.lit(True)))


def apply_note_edits(notes: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Notes after edits (op, amount): delete, pitch (+ amount), move (+ amount seconds), resize (times amount)."""
    e = notes.join(edits.select(*keys, "op", "amount"), keys, "left").where("op is null or op <> 'delete'")
    op, amount = F.col("op"), F.col("amount")
    return e.withColumns(
        {
            "pitch": F.when(op == "pitch", (F.col("pitch") + amount).cast("int")).otherwise(F.col("pitch")),
            "end_sec": F.when(op == "move", F.col("end_sec") + amount).when(op == "resize", F.col("start_sec") + (F.col("end_sec") - F.col("start_sec")) * amount).otherwise(F.col("end_sec")),
            "start_sec": F.when(op == "move", F.col("start_sec") + amount).otherwise(F.col("start_sec")),
            "op": F.coalesce(op, F.lit("none")),
        }
    ).drop("amount")
