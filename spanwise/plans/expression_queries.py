"""Queries on how notes are sung."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as E
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

r6 = lambda c: F.round(c, 6)
_TURNS = "list_filter(list_transform(list_zip(v[2:], v[:-2]), lambda x: x[1] - x[2]), lambda d: abs(d) >= 0.05)"


@REGISTRY.query(
    "c18_expression",
    f"""WITH {NOTES}, frame AS (SELECT sample_id, note_seq, start_sec AS t, 60 + (note_seq * 7 % 16) / 8.0::DOUBLE AS p FROM notes WHERE voiced),
  note AS (SELECT sample_id, note_seq AS note_id, start_sec AS a, start_sec + 1.5::DOUBLE + pitch % 3 AS b, 59 + pitch % 4 AS pitch FROM notes WHERE note_seq % 2 = 0),
  g AS (SELECT n.sample_id, note_id, a, b, pitch, list(p ORDER BY t, note_seq) AS v FROM note n JOIN frame f ON f.sample_id = n.sample_id AND t BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 5),
  d AS (SELECT *, list_max(v) - list_min(v) AS spread, b - a AS len, list_transform({_TURNS}, lambda d: sign(d)) AS s, v[-1] - v[1] AS slide FROM g),
  r AS (SELECT *, len(list_filter(list_zip(s[2:], s[:-2]), lambda x: x[1] <> x[2])) / greatest(len, 0.001) AS rate FROM d),
  x AS (SELECT *, len >= 0.45 AND rate BETWEEN 4.0 AND 9.5 AND spread BETWEEN 0.25 AND 2.5 AS shakes, len >= 0.18 AND abs(slide) >= 1.5 AS slides FROM r)
  SELECT sample_id, note_id, CAST(len(v) AS INT) AS n_frames, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(spread / 2, 1.0::DOUBLE)), 6) AS stability,
    CASE WHEN shakes THEN round(rate, 2)::DOUBLE END AS vibrato_rate, CASE WHEN shakes THEN round(spread, 2) END AS vibrato_extent, CASE WHEN shakes THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (spread / 2 + least(rate / 8, 1.0::DOUBLE)) / 2)), 3)::DOUBLE END AS vibrato_confidence,
    CASE WHEN slides THEN round(slide, 2) END AS slide_semitones, CASE WHEN slides THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(abs(slide) / 6, 1.0::DOUBLE))), 3) END AS slide_confidence, abs(list_aggregate(v, 'median') - pitch) >= 1.5 AS off_pitch FROM x""",
)
def c18_expression(spark, sf):
    """Steadiness, vibrato, slides and distance from the pitch of notes of one to four seconds."""
    n = T.notes(spark, sf)
    seq = F.col("note_seq")
    frames = n.select("sample_id", seq.alias("frame_index"), F.col("start_sec").alias("time_sec"), (60 + (seq * 7 % 16) / F.lit(8.0)).alias("pitch_midi"), "voiced")
    notes = n.where("note_seq % 2 = 0").select("sample_id", seq.alias("note_id"), "start_sec", (F.col("start_sec") + 1.5 + F.col("pitch") % 3).alias("end_sec"), (59 + F.col("pitch") % 4).alias("pitch"))
    out = E.expression_features(notes, frames, "sample_id", "note_id", 5.0)
    return out.withColumn("stability", r6("stability"))
