"""Contours clipped to the pauses of a selection, each judged on its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import labels
from .gap_reports import nearest_center
from .intervals import asof_join, interval_join, previous
from .lineage import cut
from .ragged import positions


@dataclass(frozen=True)
class GapBridgeRules:
    # Confidence, shares, seconds, semitones.
    sure: float = 0.70
    sure_if_long: float = 0.74
    voiced: float = 0.9
    least: float = 0.18
    longest: float = 2.5
    least_gap: float = 0.5
    vocal: float = 0.6
    stability: float = 0.35
    lowest: float = 48.0
    highest: float = 84.0


def pauses(notes: DataFrame, key: str, width: float) -> DataFrame:
    """The pauses between each note and the one before it in order of start and end: key, gap_index (from 1), gap_start, gap_end, in whole microseconds."""
    n = notes.select(key, "note_seq", "start_sec", "end_sec")
    order, at = ["start_sec", "end_sec", "note_seq"], F.floor(F.col("start_sec") / width)
    found = previous(n, [key], order, "end_sec", "__before", at).where(F.col("start_sec") > F.col("__before"))
    found = found.select(key, F.round("__before", 6).alias("gap_start"), F.round("start_sec", 6).alias("gap_end"))
    return positions(found, key, ["gap_start", "gap_end"], "gap_index", F.floor(F.col("gap_start") / width)).withColumn("gap_index", F.col("gap_index") + 1)


def bridge_gaps(contours: DataFrame, selected: DataFrame, raw: DataFrame, key: str, vocal: DataFrame | None = None, rules: GapBridgeRules = GapBridgeRules(), width: float = 60.0) -> DataFrame:
    """A row for each stretch of a contour that lies in a long pause of the selection, and one for each contour without any: what it lacks, and what it was judged by.

    contours: key, contour_id, start_sec, end_sec, pitch, confidence, voiced_ratio, stability. selected and raw: key, note_seq, start_sec, end_sec. vocal: start_sec,
    end_sec; a key without vocal stretches is judged without them. A key without raw candidates gets no rows.

    A stretch is in a pause of its own; a contour without any is told the pause that holds its middle, or else the nearest. Unsteadiness alone, or being
    too long, rejects nothing. Pauses do not overlap, so a contour meets few; every join is by buckets of time.
    """
    r = rules
    spans = contours.join(raw.select(key).distinct(), key, "left_semi").withColumns({"c_start": F.round("start_sec", 6), "c_end": F.round("end_sec", 6)}).drop("start_sec", "end_sec")
    spans = cut(spans.select(key, "contour_id", "c_start", "c_end", "pitch", "confidence", "voiced_ratio", "stability"))
    gaps = cut(pauses(selected, key, width))
    long_gaps = gaps.where(F.round(F.col("gap_end") - F.col("gap_start"), 6) >= r.least_gap)
    inside = interval_join(spans, long_gaps, [key], width, "c_start", "c_end", "gap_start", "gap_end")
    inside = inside.withColumns({"start_sec": F.greatest("c_start", "gap_start"), "end_sec": F.least("c_end", "gap_end")}).where(F.round(F.col("end_sec") - F.col("start_sec"), 6) >= r.least)
    inside = cut(inside)

    # the others: the nearest pause by its middle, but one that holds the middle of the contour before it
    rest = spans.join(inside.select(key, "contour_id").distinct(), [key, "contour_id"], "left_anti").withColumns({"start_sec": F.col("c_start"), "end_sec": F.col("c_end"), "__mid": (F.col("c_start") + F.col("c_end")) / 2})
    middles = gaps.select(key, "gap_index", F.col("gap_start").alias("start_sec"), F.col("gap_end").alias("end_sec"))
    rest = nearest_center(rest, middles, key, "gap_index", limit=float("inf"), width=width)
    starts = gaps.groupBy(key, F.col("gap_start").alias("__t")).agg(F.min_by(F.struct("gap_index", "gap_start", "gap_end"), "gap_index").alias("__holds"))
    rest = asof_join(rest, starts, [key], "__mid", "__t", ["__holds"], width=width)
    near = gaps.select(key, F.col("gap_index").alias("near_id"), F.struct("gap_index", "gap_start", "gap_end").alias("__near"))
    rest = rest.join(near, [key, "near_id"], "left")
    holds = lambda g: F.when(F.col("__mid").between(F.col(f"{g}.gap_start"), F.col(f"{g}.gap_end")), F.col(g))
    rest = rest.withColumn("__gap", F.coalesce(holds("__near"), holds("__holds"), F.col("__near")))
    both = inside.withColumn("clipped", F.lit(True)).unionByName(rest.select(*spans.columns, "start_sec", "end_sec", "__gap.*", F.lit(False).alias("clipped")))
    by = [key, "contour_id", "gap_index"]
    both = both.withColumn("gap_index", F.coalesce("gap_index", F.lit(0)))

    def longest(others: DataFrame, name: str, whole: bool = False) -> DataFrame:
        o = others.select(key, F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"))
        met = interval_join(both.select(*by, "start_sec", "end_sec"), o, [key], width, "start_sec", "end_sec", "__a", "__b")
        shared = F.least("end_sec", "__b") - F.greatest("start_sec", "__a")
        return met.groupBy(*by).agg((F.sum if whole else F.max)(F.greatest(F.lit(0.0), shared)).alias(name))

    out = both.join(longest(selected, "selected_sec"), by, "left").join(longest(raw, "raw_sec"), by, "left")
    long = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    if vocal is None:
        out = out.withColumn("vocal_share", F.lit(None).cast("double"))
    else:
        heard = vocal.where(F.col("end_sec") > F.col("start_sec"))
        out = out.join(longest(heard, "__sung", whole=True), by, "left").join(heard.select(key).distinct().withColumn("__heard", F.lit(True)), key, "left")
        out = out.withColumn("vocal_share", F.when(F.col("__heard"), F.round(F.coalesce(F.try_divide(F.coalesce("__sung", F.lit(0.0)), long), F.lit(0.0)), 6)))
    out = out.withColumns({"duration_sec": F.round(long, 6), "selected_sec": F.coalesce(F.round("selected_sec", 6), F.lit(0.0)), "raw_sec": F.coalesce(F.round("raw_sec", 6), F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0))})
    too_long = F.col("duration_sec") > r.longest
    hard = labels(
        (F.col("confidence") < r.sure, "low_confidence"), (F.col("duration_sec") < r.least, "too_short"), (F.coalesce(~F.col("pitch").between(r.lowest, r.highest), F.lit(True)), "outside_vocal_range"),
        (F.coalesce(F.col("voiced_ratio") < r.voiced, F.lit(True)), "low_voiced_ratio"), (too_long & (F.col("confidence") < r.sure_if_long), "bridge_low_confidence_long_contour"), (~F.col("clipped"), "bridge_no_selected_gap"),
        (F.col("selected_sec") > 0, "bridge_overlaps_selected_note"), (F.col("raw_sec") > 0, "bridge_overlaps_raw_candidate"), (F.col("vocal_share") < r.vocal, "bridge_vocal_activity_unsupported"),
    )
    soft = labels((F.coalesce(F.col("stability") < r.stability, F.lit(False)) | too_long, "too_unstable"))
    out = out.withColumns({"__hard": hard, "unsteady": F.size(soft) > 0})
    reasons = F.when(F.size("__hard") > 0, F.concat("__hard", soft)).otherwise(F.array().cast("array<string>"))
    return out.select(*by, "clipped", "start_sec", "end_sec", "duration_sec", "gap_start", "gap_end", "selected_sec", "raw_sec", "vocal_share", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"), ((F.size(reasons) == 0) & F.col("unsteady")).alias("unsteady"))
