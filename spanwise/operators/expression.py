"""How notes are sung: steadiness, vibrato, slides and distance from the written pitch, from the pitch frames inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import interval_join


def direction_changes(values: Column, dead_band: float = 0.05) -> Column:
    """How often an array changes direction; steps under `dead_band` have none."""
    following = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    leading = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    steps = F.zip_with(following(values), leading(values), lambda b, a: b - a)
    signs = F.transform(F.filter(steps, lambda d: F.abs(d) >= dead_band), F.signum)
    return F.size(F.filter(F.zip_with(following(signs), leading(signs), lambda b, a: b != a), lambda x: x))


def expression_features(notes: DataFrame, frames: DataFrame, key: str, note_id: str, width: float = 10.0, least_frames: int = 5) -> DataFrame:
    """Per note with `least_frames` voiced frames or more: n_frames, stability, vibrato (rate, extent, confidence), slide (semitones, confidence), off_pitch.

    notes: key, note_id, start_sec, end_sec, pitch (or null). frames: key, frame_index, time_sec, pitch_midi, voiced. Both ends of a note count. Frames meet notes
    in buckets of time and are put in order for each note by itself, so no task needs a whole key.
    """
    heard = frames.where("voiced and pitch_midi > 0").select(key, "frame_index", "time_sec", F.col("time_sec").alias("__time"), "pitch_midi")
    spans = notes.where("end_sec > start_sec").select(key, note_id, "start_sec", "end_sec", "pitch", (F.col("start_sec") - 1e-6).alias("__from"), (F.col("end_sec") + 1e-6).alias("__to"))
    inside = interval_join(spans, heard, [key], width, "__from", "__to", "time_sec", "__time", F.col("time_sec").between(F.col("start_sec"), F.col("end_sec")))
    rows = inside.groupBy(key, note_id, "start_sec", "end_sec", "pitch").agg(F.transform(F.array_sort(F.collect_list(F.struct("time_sec", "frame_index", "pitch_midi"))), lambda x: x["pitch_midi"]).alias("__v")).where(F.size("__v") >= least_frames)
    v = F.col("__v")
    sorted_ = F.array_sort(v)
    n = F.size(v)
    middle = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, (F.floor(n / 2) + 1).cast("int"))) / 2
    rows = rows.withColumns({"n_frames": n, "__spread": F.array_max(v) - F.array_min(v), "__length": F.col("end_sec") - F.col("start_sec"), "__turns": direction_changes(v), "__slide": F.element_at(v, -1) - v[0], "__middle": middle})
    spread, length, slide = F.col("__spread"), F.col("__length"), F.col("__slide")
    rate = F.col("__turns") / F.greatest(length, F.lit(0.001))
    bounded = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3)
    # Seconds, turns a second and semitones of vibrato; seconds and semitones of a slide; semitones off the pitch.
    shakes = (length >= 0.45) & rate.between(4.0, 9.5) & spread.between(0.25, 2.5)
    slides = (length >= 0.18) & (F.abs(slide) >= 1.5)
    return rows.select(
        key, note_id, "n_frames", F.greatest(F.lit(0.0), 1.0 - F.least(spread / 2.0, F.lit(1.0))).alias("stability"),
        F.when(shakes, F.round(rate, 2)).alias("vibrato_rate"), F.when(shakes, F.round(spread, 2)).alias("vibrato_extent"), F.when(shakes, bounded((spread / 2.0 + F.least(rate / 8.0, F.lit(1.0))) / 2.0)).alias("vibrato_confidence"),
        F.when(slides, F.round(slide, 2)).alias("slide_semitones"), F.when(slides, bounded(F.least(F.abs(slide) / 6.0, F.lit(1.0)))).alias("slide_confidence"), F.coalesce(F.abs(F.col("__middle") - F.col("pitch")) >= 1.5, F.lit(False)).alias("off_pitch"),
    )
