"""Queries on contours that become notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidate_bridge as B
from ..operators import gap_bridge as G
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

r6 = lambda c: F.round(c, 6)


@REGISTRY.query("c47_candidate_bridge")
def c47_candidate_bridge(spark, sf):
    """Contours that fill pauses between notes, in order, each accepted one being context for the next; long ones also in parts.

    Two thirds of the events are notes, the others contours; every fourth of those is long and has frames.
    """
    n = T.notes(spark, sf).withColumn("pitch", F.when(F.col("note_seq") % 9 == 0, 45).otherwise(52 + F.col("pitch") % 20))
    n = n.withColumn("end_sec", F.when(F.col("note_seq") % 12 == 0, F.col("start_sec") + 2.8).otherwise(F.greatest("end_sec", F.col("start_sec") + 0.2))).withColumn("confidence", 0.6 + F.col("confidence") * 0.4)
    c = n.where("note_seq % 3 = 0")
    steps = F.sequence(F.lit(0), F.lit(139))
    frame = lambda k: F.struct((F.col("start_sec") + k * 0.02).alias("time_sec"), (F.col("pitch") + F.floor(k / 20) % 3 * 2).cast("double").alias("pitch_midi"), F.when(k % 35 == 0, 0.5).otherwise(0.9).alias("confidence"))
    seq = F.col("note_seq")
    contours = c.select("sample_id", seq.alias("contour_id"), "start_sec", "end_sec", "pitch", "confidence", F.when(seq % 5 == 0, 0.8).otherwise(0.95).alias("voiced_ratio"), (seq % 10 / 10.0).alias("stability"), (seq % 4 == 0).alias("glides"), (seq % 6 == 0).alias("vibrato"), F.when(seq % 12 == 0, F.transform(steps, frame)).alias("frames"))
    out = B.bridge_candidates(contours, n.where("note_seq % 3 > 0"), "sample_id", width=10.0)
    return out.select("sample_id", "contour_id", "part", *(r6(x).alias(x) for x in ("start_sec", "end_sec", "pitch", "confidence")), "accepted", "reasons")


_GAP_TESTS = {
    "low_confidence": "confidence < 0.7", "too_short": "dur < 0.18", "outside_vocal_range": "NOT pitch BETWEEN 48 AND 84", "low_voiced_ratio": "coalesce(voiced_ratio < 0.9, TRUE)", "bridge_low_confidence_long_contour": "dur > 2.5 AND confidence < 0.74",
    "bridge_no_selected_gap": "NOT clipped", "bridge_overlaps_selected_note": "selected_sec > 0", "bridge_overlaps_raw_candidate": "raw_sec > 0", "bridge_vocal_activity_unsupported": "vocal_share < 0.6",
}
_GAP_HARD = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _GAP_TESTS.items()) + "], lambda x: x IS NOT NULL)"


@REGISTRY.query(
    "c48_bridge_gaps",
    f"""WITH {NOTES},
  selected AS (SELECT sample_id, note_seq, start_sec, CASE WHEN note_seq % 20 = 0 THEN start_sec + 1.2::DOUBLE ELSE end_sec END AS end_sec FROM notes WHERE note_seq % 4 = 0),
  raw AS (SELECT sample_id, start_sec, end_sec FROM notes WHERE sample_id % 11 > 0 AND note_seq % 7 = 1),
  vocal AS (SELECT sample_id, start_sec - 0.3::DOUBLE AS start_sec, end_sec + 0.6::DOUBLE AS end_sec FROM notes WHERE sample_id % 3 > 0 AND note_seq % 2 = 1),
  c AS (SELECT sample_id, note_seq AS contour_id, round(start_sec, 6) AS c_start, round(CASE WHEN note_seq % 5 = 0 THEN start_sec + 1.5::DOUBLE WHEN note_seq % 13 = 0 THEN start_sec + 3.2::DOUBLE ELSE end_sec END, 6) AS c_end, 44 + pitch % 43 AS pitch, 0.6::DOUBLE + confidence * 0.4::DOUBLE AS confidence,
    CASE WHEN note_seq % 6 > 0 THEN 0.85::DOUBLE + note_seq % 4 * 0.05::DOUBLE END AS voiced_ratio, CASE WHEN note_seq % 9 > 0 THEN (note_seq % 10) / 10.0::DOUBLE END AS stability FROM notes WHERE note_seq % 4 = 2 AND sample_id IN (SELECT sample_id FROM raw)),
  gap AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY a, b) AS gap_index, a AS gap_start, b AS gap_end FROM (SELECT sample_id, round(lag(end_sec) OVER w, 6) AS a, round(start_sec, 6) AS b, lag(end_sec) OVER w AS x, start_sec AS y FROM selected WINDOW w AS (PARTITION BY sample_id ORDER BY start_sec, end_sec, note_seq)) WHERE y > x),
  inside AS (SELECT c.*, gap_index, gap_start, gap_end, greatest(c_start, gap_start) AS start_sec, least(c_end, gap_end) AS end_sec, TRUE AS clipped FROM c JOIN gap g ON g.sample_id = c.sample_id AND round(gap_end - gap_start, 6) >= 0.5 AND round(least(c_end, gap_end) - greatest(c_start, gap_start), 6) >= 0.18),
  rest AS (SELECT * FROM c WHERE (sample_id, contour_id) NOT IN (SELECT (sample_id, contour_id) FROM inside)),
  ranked AS (SELECT r.*, g.gap_index, gap_start, gap_end, row_number() OVER (PARTITION BY r.sample_id, contour_id ORDER BY CASE WHEN (c_start + c_end) / 2 BETWEEN gap_start AND gap_end THEN 0 ELSE 1 END, abs((c_start + c_end) / 2 - (gap_start + gap_end) / 2), g.gap_index) AS k FROM rest r LEFT JOIN gap g ON g.sample_id = r.sample_id),
  b AS (SELECT * FROM inside UNION ALL SELECT * EXCLUDE (k), c_start, c_end, FALSE FROM ranked WHERE k = 1),
  e AS (SELECT *, round(end_sec - start_sec, 6) AS dur, coalesce(round((SELECT max(least(b.end_sec, s.end_sec) - greatest(b.start_sec, s.start_sec)) FROM selected s WHERE s.sample_id = b.sample_id AND s.end_sec > b.start_sec AND s.start_sec < b.end_sec), 6), 0) AS selected_sec,
    coalesce(round((SELECT max(least(b.end_sec, s.end_sec) - greatest(b.start_sec, s.start_sec)) FROM raw s WHERE s.sample_id = b.sample_id AND s.end_sec > b.start_sec AND s.start_sec < b.end_sec), 6), 0) AS raw_sec,
    CASE WHEN sample_id IN (SELECT sample_id FROM vocal) THEN round(coalesce((SELECT sum(least(b.end_sec, s.end_sec) - greatest(b.start_sec, s.start_sec)) FROM vocal s WHERE s.sample_id = b.sample_id AND s.end_sec > b.start_sec AND s.start_sec < b.end_sec), 0) / (end_sec - start_sec), 6) END AS vocal_share FROM b),
  f AS (SELECT *, {_GAP_HARD} AS hard, coalesce(stability < 0.35, FALSE) OR dur > 2.5 AS soft FROM e)
  SELECT sample_id, contour_id, coalesce(gap_index, 0) AS gap_index, clipped, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, dur AS duration_sec, gap_start, gap_end, selected_sec, raw_sec, vocal_share,
    array_to_string(CASE WHEN len(hard) > 0 AND soft THEN list_append(hard, 'too_unstable') ELSE hard END, ',') AS reasons, len(hard) = 0 AS accepted, len(hard) = 0 AND soft AS unsteady FROM f""",
)
def c48_bridge_gaps(spark, sf):
    """Contours clipped to the pauses of a selection, each judged on its own, with the evidence."""
    n, seq, s = T.notes(spark, sf), F.col("note_seq"), F.col("sample_id")
    selected = n.where("note_seq % 4 = 0").withColumn("end_sec", F.when(seq % 20 == 0, F.col("start_sec") + 1.2).otherwise(F.col("end_sec")))
    raw = n.where((s % 11 > 0) & (seq % 7 == 1))
    vocal = n.where((s % 3 > 0) & (seq % 2 == 1)).select("sample_id", (F.col("start_sec") - 0.3).alias("start_sec"), (F.col("end_sec") + 0.6).alias("end_sec"))
    end = F.when(seq % 5 == 0, F.col("start_sec") + 1.5).when(seq % 13 == 0, F.col("start_sec") + 3.2).otherwise(F.col("end_sec"))
    contours = n.where("note_seq % 4 = 2").select("sample_id", seq.alias("contour_id"), "start_sec", end.alias("end_sec"), (44 + F.col("pitch") % 43).alias("pitch"), (0.6 + F.col("confidence") * 0.4).alias("confidence"), F.when(seq % 6 > 0, 0.85 + seq % 4 * 0.05).alias("voiced_ratio"), F.when(seq % 9 > 0, seq % 10 / 10.0).alias("stability"))
    out = G.bridge_gaps(contours, selected, raw, "sample_id", vocal, width=10.0)
    return out.withColumns({"start_sec": r6("start_sec"), "end_sec": r6("end_sec"), "reasons": F.array_join("reasons", ",")})
