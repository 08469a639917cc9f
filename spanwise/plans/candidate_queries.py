"""Queries on note candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import windows as X
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

_ENRICH = f"""WITH {NOTES},
  raw AS (SELECT sample_id, note_seq AS candidate_id, start_sec, end_sec, CASE WHEN note_seq % 21 > 0 THEN pitch END AS pitch, CASE WHEN note_seq % 2 = 0 THEN confidence END AS confidence,
    CASE WHEN note_seq % 5 = 0 THEN 0.8::DOUBLE END AS voiced_ratio, CASE WHEN note_seq % 7 = 0 THEN 0.5::DOUBLE END AS stability, CASE WHEN note_seq % 4 = 0 THEN ['c' || (note_seq + 1), ' ', 'c' || (note_seq + 1), 'x' || note_seq] END AS contour_ids FROM notes WHERE note_seq % 3 = 0),
  frame AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq) AS frame_index, start_sec AS time_sec, CASE WHEN event_type <> 'error' OR note_seq % 2 = 0 THEN pitch END AS pitch, CASE WHEN note_seq % 8 > 0 THEN confidence END AS confidence, CASE WHEN note_seq % 10 > 0 THEN voiced END AS voiced FROM notes),
  contour AS (SELECT sample_id, 'c' || note_seq AS contour_id, start_sec, end_sec + 0.3::DOUBLE AS end_sec, CASE WHEN note_seq % 11 > 0 THEN (note_seq % 10) / 10.0::DOUBLE END AS stability FROM notes WHERE note_seq % 3 = 1),
  own AS (SELECT * REPLACE (CASE WHEN contour_ids IS NULL THEN NULL ELSE list_filter(list_distinct(contour_ids), lambda x: trim(x) <> '') END AS contour_ids) FROM raw WHERE pitch IS NOT NULL),
  ranged AS (SELECT o.sample_id, o.candidate_id, arg_min(frame_index, frame_index) AS first_frame, arg_max(frame_index, frame_index) AS last_frame FROM own o JOIN frame f ON f.sample_id = o.sample_id AND time_sec BETWEEN start_sec - 0.02::DOUBLE AND end_sec + 0.02::DOUBLE GROUP BY 1, 2),
  seen AS (SELECT r.*, CAST(count(*) AS BIGINT) AS frame_count, CAST(count(*) FILTER (coalesce(voiced, pitch IS NOT NULL) AND pitch IS NOT NULL) AS BIGINT) AS voiced_count, max(pitch) - min(pitch) AS spread, avg(confidence) AS sure FROM ranged r JOIN frame f ON f.sample_id = r.sample_id AND frame_index BETWEEN first_frame AND last_frame GROUP BY ALL),
  met AS (
    SELECT sample_id, candidate_id, unnest(contour_ids) AS contour_id FROM own WHERE len(contour_ids) > 0
    UNION ALL SELECT o.sample_id, candidate_id, contour_id FROM own o JOIN contour c ON c.sample_id = o.sample_id AND least(o.end_sec, c.end_sec) > greatest(o.start_sec, c.start_sec) WHERE coalesce(len(contour_ids), 0) = 0),
  stable AS (SELECT m.sample_id, candidate_id, list_sort(list(DISTINCT m.contour_id)) AS ids, max(CASE WHEN c.contour_id IS NOT NULL THEN coalesce(stability, 0) END) AS stable FROM met m LEFT JOIN contour c ON c.sample_id = m.sample_id AND c.contour_id = m.contour_id GROUP BY 1, 2)
SELECT o.sample_id, o.candidate_id, round(o.start_sec, 6) AS start_sec, round(o.end_sec, 6) AS end_sec, CAST(o.pitch AS DOUBLE) AS pitch, round(end_sec - start_sec, 6) AS duration_sec, round(coalesce(confidence, sure, 0), 6)::DOUBLE AS confidence,
  round(coalesce(voiced_ratio, voiced_count / frame_count::DOUBLE, 1), 6) AS voiced_ratio, coalesce(voiced_ratio, voiced_count / frame_count::DOUBLE, 1) >= 0.72 AS voiced,
  round(coalesce(stability, stable, greatest(0, 1 - coalesce(spread, 0) / 2.5::DOUBLE)), 6)::DOUBLE AS stability, array_to_string(ids, ',') AS contour_ids, first_frame, last_frame, coalesce(frame_count, 0) AS frame_count, coalesce(voiced_count, 0) AS voiced_count
FROM own o JOIN stable s ON s.sample_id = o.sample_id AND s.candidate_id = o.candidate_id LEFT JOIN seen e ON e.sample_id = o.sample_id AND e.candidate_id = o.candidate_id"""


@REGISTRY.query("c49_enrich_candidates", _ENRICH)
def c49_enrich_candidates(spark, sf):
    """Raw candidates with confidence, voiced share, stability and contours taken from the frames and contours around them."""
    n, seq = T.notes(spark, sf), F.col("note_seq")
    name = F.concat(F.lit("c"), (seq + 1).cast("string"))
    raw = n.where("note_seq % 3 = 0").select(
        "sample_id", seq.alias("candidate_id"), "start_sec", "end_sec", F.when(seq % 21 > 0, F.col("pitch").cast("double")).alias("pitch"), F.when(seq % 2 == 0, F.col("confidence")).alias("confidence"),
        F.when(seq % 5 == 0, 0.8).alias("voiced_ratio"), F.when(seq % 7 == 0, 0.5).alias("stability"), F.when(seq % 4 == 0, F.array(name, F.lit(" "), name, F.concat(F.lit("x"), seq.cast("string")))).alias("contour_ids"),
    )
    place = F.row_number().over(X.ordered(["sample_id"], ["start_sec", "note_seq"])).cast("long")
    frames = n.select("sample_id", place.alias("frame_index"), F.col("start_sec").alias("time_sec"), F.when((F.col("event_type") != "error") | (seq % 2 == 0), F.col("pitch")).alias("pitch"), F.when(seq % 8 > 0, F.col("confidence")).alias("confidence"), F.when(seq % 10 > 0, F.col("voiced")).alias("voiced"))
    contours = n.where("note_seq % 3 = 1").select("sample_id", F.concat(F.lit("c"), seq.cast("string")).alias("contour_id"), "start_sec", (F.col("end_sec") + 0.3).alias("end_sec"), F.when(seq % 11 > 0, seq % 10 / 10.0).alias("stability"))
    out = C.enrich_candidates(raw, frames, contours, "sample_id", width=10.0)
    return out.withColumn("contour_ids", F.array_join(F.array_sort("contour_ids"), ","))


@REGISTRY.query("c50_seed_candidates")
def c50_seed_candidates(spark, sf):
    """Candidates seeded by contours against all accepted before, unsteady ones in steady parts.

    Two thirds of the events are raw candidates, the others contours; every fourth of those is unsteady and has frames.
    """
    n, seq = T.notes(spark, sf), F.col("note_seq")
    n = n.withColumn("pitch", 46 + F.col("pitch") % 24).withColumn("end_sec", F.when(seq % 12 == 0, F.col("start_sec") + 1.6).otherwise(F.col("end_sec")))
    frame = lambda k: F.struct((F.col("start_sec") + k * 0.02).alias("time_sec"), (F.col("pitch") + F.floor(k / 20) % 3 * 2).cast("double").alias("pitch_midi"), F.when(k % 33 == 0, 0.3).otherwise(0.9).alias("confidence"))
    contours = n.where("note_seq % 3 = 0").select(
        "sample_id", seq.alias("contour_id"), "start_sec", "end_sec", "pitch", (0.5 + F.col("confidence") / 2).alias("confidence"), F.when(seq % 5 == 0, 0.6).otherwise(0.95).alias("voiced_ratio"),
        F.when(seq % 12 == 0, 0.2).otherwise(0.9).alias("stability"), F.when(seq % 12 == 0, 4.0).otherwise(seq % 7 / 2).alias("pitch_range"), F.when(seq % 12 == 0, F.transform(F.sequence(F.lit(0), F.lit(79)), frame)).alias("frames"),
    )
    out = C.seed_candidates(contours, n.where("note_seq % 3 > 0"), "sample_id", width=10.0)
    doubles = ("start_sec", "end_sec", "stable_start_sec", "stable_end_sec", "pitch", "confidence", "stability")
    return out.select("sample_id", "contour_id", "part", *(F.round(c, 6).alias(c) for c in doubles), "state", F.array_join("reasons", ",").alias("reasons"))
