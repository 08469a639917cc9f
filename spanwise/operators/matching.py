"""One-to-one matching of two event sets, and scores of the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import circular_distance, overlap, ratio_or_zero
from .intervals import band_join
from .lineage import cut


def pitch_cost(pitch_a: Column, pitch_b: Column, tolerance: int = 0, octave: int = 12, any_octave: bool = False) -> Column:
    """Semitones apart within the tolerance; 100 more for one semitone, for any octaves if they count, or for just `octave`; null for no match."""
    far = F.abs(pitch_a - pitch_b)
    cost = F.when(far <= tolerance, far.cast("double")).when(far == 1, far + 100.0)
    if any_octave:
        cost = cost.when(circular_distance(pitch_a, pitch_b) <= tolerance, 100 + far * 0.01)
    return cost.when(far == octave, far + 100.0) if octave > 0 else cost


def duration_iou(a: str, b: str) -> Column:
    """Intersection over union of the intervals of the sides a and b."""
    both = overlap(F.col(f"{a}_start_sec"), F.col(f"{a}_end_sec"), F.col(f"{b}_start_sec"), F.col(f"{b}_end_sec"))
    return ratio_or_zero(both, F.greatest(f"{a}_end_sec", f"{b}_end_sec") - F.least(f"{a}_start_sec", f"{b}_start_sec"))


def match_edges(expected: DataFrame, predicted: DataFrame, keys: list[str], tolerance: float, octave: int = 12, any_octave: bool = False) -> DataFrame:
    """Pairs of notes that start within the tolerance and whose pitches may match: keys, e and p (sequence numbers), cost, and both intervals.

    The cost is seconds apart, cost of the pitches and a hundredth of what the intervals do not share.
    """
    side = lambda df, x: df.select(*keys, F.col("note_seq").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("start_sec", "end_sec", "pitch")))
    pairs = band_join(side(expected, "e"), side(predicted, "p"), keys, "e_start_sec", "p_start_sec", tolerance)
    cost = F.abs(F.col("p_start_sec") - F.col("e_start_sec")) + pitch_cost(F.col("e_pitch"), F.col("p_pitch"), octave=octave, any_octave=any_octave) + (1 - duration_iou("e", "p")) * 0.01
    return pairs.withColumn("cost", F.round(cost, 9)).where("cost is not null")


def greedy_match(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges that a greedy choice by (cost, e, p) takes, found in rounds of joins.

    An edge that is the least of all edges at both its ends is taken by the greedy choice too, so
    each round takes all those at once and drops the edges that share an end with them. Long
    chains of ever better edges take a round each; events in time give a few rounds.
    """
    rank = F.struct("cost", "e", "p")
    left, taken = cut(edges), None
    while not left.isEmpty():
        of_e = left.groupBy(*keys, "e").agg(F.min(rank).alias("best")).select(*keys, "e", F.col("best.p").alias("p"))
        of_p = left.groupBy(*keys, "p").agg(F.min(rank).alias("best")).select(*keys, F.col("best.e").alias("e"), "p")
        now = cut(left.join(of_e.join(of_p, [*keys, "e", "p"]), [*keys, "e", "p"], "left_semi"))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select(*keys, "e"), [*keys, "e"], "left_anti").join(now.select(*keys, "p"), [*keys, "p"], "left_anti"))
    return left if taken is None else taken


def match_scores(expected: DataFrame, predicted: DataFrame, matched: DataFrame, keys: list[str], octave_matched: DataFrame | None = None) -> DataFrame:
    """Per key: counts, precision, recall, F1, rates of exact, semitone and octave pitches, mean onset error and mean intersection over union.

    octave_matched: a match for which octaves count, whose figures come with `octave_` before them, and how much they lift recall and F1.
    """
    far = F.abs(F.col("e_pitch") - F.col("p_pitch"))
    share = lambda c: F.avg(c.cast("double"))
    counts = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_expected")).join(predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_predicted")), keys, "full_outer")
    m = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_matched"), share(far == 0).alias("pitch_accuracy"), share(far == 1).alias("semitone_error_rate"), share(far == 12).alias("octave_error_rate"),
        F.avg(F.abs(F.col("p_start_sec") - F.col("e_start_sec"))).alias("onset_mae"), F.avg(duration_iou("e", "p")).alias("mean_iou"),
    )
    rates = ["pitch_accuracy", "semitone_error_rate", "octave_error_rate"]
    out = counts.join(m, keys, "left").fillna(0, ["n_expected", "n_predicted", "n_matched", *rates])
    if octave_matched is not None:
        same = circular_distance(F.col("e_pitch"), F.col("p_pitch")) == 0
        o = octave_matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("octave_n_matched"), share(same).alias("octave_pitch_accuracy"), share(same & (far > 0)).alias("octave_octave_error_rate"), F.avg(far.cast("double")).alias("octave_mean_pitch_delta"))
        out = out.join(o, keys, "left").fillna(0, ["octave_n_matched", "octave_pitch_accuracy", "octave_octave_error_rate"])
    for before in ("", "octave_") if octave_matched is not None else ("",):
        n = F.col(f"{before}n_matched").cast("double")
        out = out.withColumns({f"{before}precision": ratio_or_zero(n, F.col("n_predicted").cast("double")), f"{before}recall": ratio_or_zero(n, F.col("n_expected").cast("double"))})
        p, r = F.col(f"{before}precision"), F.col(f"{before}recall")
        out = out.withColumn(f"{before}f1", ratio_or_zero(2 * p * r, p + r))
    if octave_matched is not None:
        out = out.withColumns({f"octave_{c}_lift": F.col(f"octave_{c}") - F.col(c) for c in ("recall", "f1")})
    return out


def match_details(expected: DataFrame, predicted: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, kind (matched, unmatched_expected, unmatched_predicted), e, p, and for pairs the predicted less the expected start and pitch, and the shared part."""
    pairs = matched.select(*keys, F.lit("matched").alias("kind"), "e", "p", (F.col("p_start_sec") - F.col("e_start_sec")).alias("onset_delta_sec"), (F.col("p_pitch") - F.col("e_pitch")).alias("pitch_delta"), duration_iou("e", "p").alias("duration_iou"))
    for df, side in ((expected, "e"), (predicted, "p")):
        rest = df.select(*keys, F.col("note_seq").alias(side)).join(matched.select(*keys, side), [*keys, side], "left_anti")
        pairs = pairs.unionByName(rest.withColumn("kind", F.lit("unmatched_expected" if side == "e" else "unmatched_predicted")), allowMissingColumns=True)
    return pairs


def pair_starts_with_ends(events: DataFrame, keys: list[str], order: list[str], starts: str = "on") -> DataFrame:
    """Each end closes the oldest open start of its key, and an end with none open is passed over: keys, k, is_start and the other columns.

    The two rows of a pair get the same `k`; a start that is never closed has a `k` to itself. `starts` is a boolean column.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    # an end finds nothing open when the balance of starts and ends falls below all that it was, and below 0
    e = events.withColumn("__balance", F.sum(F.when(F.col(starts), 1).otherwise(-1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("__least", F.least(F.lit(0), F.min("__balance").over(w.rowsBetween(W.unboundedPreceding, -1))))
    e = e.where(F.col(starts) | (F.col("__balance") >= F.col("__least"))).drop("__balance", "__least")
    return e.withColumn("k", F.row_number().over(W.partitionBy(*keys, starts).orderBy(*order)))
