"""Queries on what a selection left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gap_reports as G
from ..operators import intervals as I
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

# Raw candidates are the notes, every ninth without confidence; a third of them is selected, some moved in time or pitch; lost notes stand between.
_TABLES = f"""{NOTES},
  raw AS (SELECT sample_id, note_seq, start_sec, end_sec, pitch, CASE WHEN note_seq % 9 > 0 THEN 0.3::DOUBLE + confidence * 0.7::DOUBLE END AS confidence FROM notes),
  selected AS (SELECT sample_id, note_seq, start_sec + (note_seq % 5) * 0.03::DOUBLE AS start_sec, end_sec + (note_seq % 5) * 0.03::DOUBLE AS end_sec, pitch + note_seq % 2 * 2 AS pitch FROM notes WHERE note_seq % 3 = 0),
  lost AS (SELECT sample_id, note_seq, start_sec + 0.4::DOUBLE AS start_sec, end_sec + 0.5::DOUBLE AS end_sec FROM notes WHERE note_seq % 7 = 3),
  pair AS (SELECT r.sample_id, r.note_seq, r.pitch AS p, s.pitch AS q, s.note_seq AS o_seq, s.start_sec AS o_start, least(r.end_sec, s.end_sec) - greatest(r.start_sec, s.start_sec) AS shared FROM raw r JOIN selected s ON s.sample_id = r.sample_id AND least(r.end_sec, s.end_sec) > greatest(r.start_sec, s.start_sec)),
  met AS (SELECT sample_id, note_seq, bool_or(shared >= 0.05 AND abs(p - q) <= 1) AS matched, max(shared) AS shared, arg_max(o_seq, {{'a': shared, 'b': -o_start, 'c': -o_seq}}) AS overlap_with FROM pair GROUP BY 1, 2)"""


def _tables(spark, sf):
    n, seq = T.notes(spark, sf), F.col("note_seq")
    raw = n.select("sample_id", "note_seq", "start_sec", "end_sec", "pitch", F.when(seq % 9 > 0, 0.3 + F.col("confidence") * 0.7).alias("confidence"))
    moved = (seq % 5) * 0.03
    selected = n.where("note_seq % 3 = 0").select("sample_id", "note_seq", (F.col("start_sec") + moved).alias("start_sec"), (F.col("end_sec") + moved).alias("end_sec"), (F.col("pitch") + seq % 2 * 2).alias("pitch"))
    lost = n.where("note_seq % 7 = 3").select("sample_id", "note_seq", (F.col("start_sec") + 0.4).alias("start_sec"), (F.col("end_sec") + 0.5).alias("end_sec"))
    return raw, selected, lost


def _named(prefix: str, tests: dict[str, str]) -> str:
    return f"list_filter([{', '.join(f'''CASE WHEN {t} THEN '{prefix}_{name}' END''' for name, t in tests.items())}], lambda x: x IS NOT NULL)"


_DELETED = {"selector_removed": "TRUE", "low_confidence": "confidence < 0.35", "short_duration": "end_sec - start_sec < 0.18", "large_pitch_jump": "jump >= 7", "overlap": "round(shared, 6) > 0"}


@REGISTRY.query(
    "c9_deleted_candidates",
    f"""WITH {_TABLES},
  around AS (SELECT *, greatest(abs(pitch - lag(pitch) OVER w), abs(pitch - lead(pitch) OVER w)) AS jump FROM raw WINDOW w AS (PARTITION BY sample_id ORDER BY start_sec, note_seq)),
  near AS (SELECT r.sample_id, r.note_seq, min({{'d': abs((r.start_sec + r.end_sec) / 2 - (l.start_sec + l.end_sec) / 2), 'id': l.note_seq}}) AS near FROM raw r JOIN lost l ON l.sample_id = r.sample_id AND abs((r.start_sec + r.end_sec) / 2 - (l.start_sec + l.end_sec) / 2) <= 0.75 GROUP BY 1, 2),
  gone AS (SELECT a.*, m.shared, m.overlap_with, near.id AS near_id, near.d AS near_sec, round(coalesce(confidence, 0.5) * (end_sec - start_sec), 6) AS impact FROM around a LEFT JOIN met m ON m.sample_id = a.sample_id AND m.note_seq = a.note_seq LEFT JOIN near n ON n.sample_id = a.sample_id AND n.note_seq = a.note_seq WHERE NOT coalesce(matched, FALSE))
  SELECT sample_id, note_seq, array_to_string({_named("deleted_candidate", _DELETED)}, ',') AS reasons, CAST(jump AS INT) AS pitch_jump, coalesce(round(shared, 6), 0) AS overlap_sec, overlap_with, near_id, round(near_sec, 6) AS near_sec, impact, CAST(place AS INT) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY impact DESC, start_sec, note_seq) AS place FROM gone) WHERE place <= 12""",
)
def c9_deleted_candidates(spark, sf):
    """The twelve candidates of each sample whose removal weighs most, why they may be gone, and the nearest lost note."""
    out = G.deleted_candidates(*_tables(spark, sf), "sample_id", width=10.0)
    return out.select("sample_id", "note_seq", F.array_join("reasons", ",").alias("reasons"), "pitch_jump", "overlap_sec", "overlap_with", "near_id", "near_sec", "impact", "place")


_STAGES = f"""{NOTES}, selected AS (SELECT *, CASE WHEN note_seq % 6 > 0 THEN note_seq // 2 END AS candidate_id FROM notes WHERE note_seq % 5 > 0),
  quantized AS (SELECT sample_id, note_seq, note_seq // 2 AS source_id, CASE WHEN note_seq % 8 > 0 THEN round(start_sec * 4) / 4 END AS quantized_start_sec, CASE WHEN note_seq % 11 > 0 THEN 0.25::DOUBLE END AS quantized_sec FROM notes WHERE note_seq % 5 > 0 AND (sample_id % 3 > 0 OR note_seq % 7 > 0)),
  score AS (SELECT * FROM quantized WHERE sample_id % 3 <> 1 OR note_seq % 13 > 0),
  scored AS (SELECT s.sample_id, s.note_seq, n.start_sec, n.end_sec FROM score s JOIN notes n ON n.note_seq = s.note_seq AND n.sample_id = s.sample_id),
  predicted AS (SELECT sample_id, note_seq, start_sec + (note_seq % 7) * 0.01::DOUBLE AS start_sec, end_sec + (note_seq % 7) * 0.02::DOUBLE AS end_sec FROM scored WHERE sample_id % 4 > 0 OR note_seq % 9 > 0)"""


def _stages(spark, sf):
    n, seq, s = T.notes(spark, sf), F.col("note_seq"), F.col("sample_id")
    half = F.floor(seq / 2)
    selected = n.where("note_seq % 5 > 0").withColumn("candidate_id", F.when(seq % 6 > 0, half))
    quantized = n.where((seq % 5 > 0) & ((s % 3 > 0) | (seq % 7 > 0))).select("sample_id", "note_seq", half.alias("source_id"), F.when(seq % 8 > 0, F.round(F.col("start_sec") * 4) / 4).alias("quantized_start_sec"), F.when(seq % 11 > 0, 0.25).alias("quantized_sec"), "start_sec", "end_sec")
    score = quantized.where((s % 3 != 1) | (seq % 13 > 0))
    predicted = score.where((s % 4 > 0) | (seq % 9 > 0)).select("sample_id", "note_seq", (F.col("start_sec") + seq % 7 * 0.01).alias("start_sec"), (F.col("end_sec") + seq % 7 * 0.02).alias("end_sec"))
    return selected, quantized, score, predicted


_SHIFTS = """last AS (SELECT sample_id, candidate_id, arg_max({'a': start_sec, 'b': end_sec}, note_seq) AS s FROM selected WHERE candidate_id IS NOT NULL GROUP BY 1, 2),
  shift AS (
    SELECT 'quantized' AS kind, q.sample_id, q.note_seq, round(quantized_start_sec - s.a, 6) AS onset_shift_sec, round(quantized_sec / nullif(greatest(0, s.b - s.a), 0), 6) AS duration_ratio FROM quantized q JOIN last l ON l.sample_id = q.sample_id AND l.candidate_id = q.source_id
    UNION ALL SELECT 'exported', a.sample_id, a.note_seq, round(b.start_sec - a.start_sec, 6), round((b.end_sec - b.start_sec) / (a.end_sec - a.start_sec), 6)
    FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq) AS k FROM scored) a JOIN (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq) AS k FROM predicted) b ON a.sample_id = b.sample_id AND a.k = b.k)"""


def _shifts(spark, sf):
    selected, quantized, score, predicted = _stages(spark, sf)
    made = G.quantization_shifts(quantized, selected, "sample_id").drop("source_id").withColumn("kind", F.lit("quantized"))
    return made.unionByName(G.export_shifts(score, predicted, "sample_id", width=10.0).withColumn("kind", F.lit("exported")))


@REGISTRY.query(
    "c10_largest_shifts",
    f"""WITH {_STAGES}, {_SHIFTS} SELECT kind, sample_id, note_seq, onset_shift_sec, duration_ratio, CAST(place AS INT) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, kind ORDER BY abs(coalesce(onset_shift_sec, 0)) DESC, note_seq) AS place FROM shift) WHERE place <= 12""",
)
def c10_largest_shifts(spark, sf):
    """The twelve largest shifts of onset from selection to quantisation and from score to export."""
    return G.top_of(_shifts(spark, sf), ["sample_id", "kind"], [F.desc(F.abs(F.coalesce("onset_shift_sec", F.lit(0.0)))), "note_seq"])


@REGISTRY.query(
    "c10_shift_summary",
    f"""WITH {_STAGES}, {_SHIFTS}, ids AS (SELECT DISTINCT sample_id FROM notes),
  n AS (SELECT sample_id, (SELECT count(*) FROM selected x WHERE x.sample_id = i.sample_id) AS n_selected, (SELECT count(*) FROM quantized x WHERE x.sample_id = i.sample_id) AS n_quantized, (SELECT count(*) FROM score x WHERE x.sample_id = i.sample_id) AS n_score_ir, (SELECT count(*) FROM predicted x WHERE x.sample_id = i.sample_id) AS n_predicted_midi FROM ids i)
  SELECT n.*, CASE WHEN n_quantized < n_selected THEN 'selected_to_quantized' WHEN n_score_ir < n_quantized THEN 'quantized_to_score_ir' WHEN n_predicted_midi < n_score_ir THEN 'score_ir_to_predicted_midi' END AS drop_stage,
    (SELECT max(abs(onset_shift_sec)) FROM shift s WHERE s.sample_id = n.sample_id AND kind = 'quantized') AS max_quantized_shift, (SELECT max(abs(onset_shift_sec)) FROM shift s WHERE s.sample_id = n.sample_id AND kind = 'exported') AS max_exported_shift FROM n WHERE n_selected + n_quantized + n_score_ir + n_predicted_midi > 0""",
)
def c10_shift_summary(spark, sf):
    """How many notes each stage has, the first stage that loses some, and the largest shifts."""
    selected, quantized, score, predicted = _stages(spark, sf)
    counts = G.stage_losses({"selected": selected, "quantized": quantized, "score_ir": score, "predicted_midi": predicted}, "sample_id")
    largest = lambda kind: F.max(F.when(F.col("kind") == kind, F.abs("onset_shift_sec"))).alias(f"max_{kind}_shift")
    return counts.join(_shifts(spark, sf).groupBy("sample_id").agg(largest("quantized"), largest("exported")), "sample_id", "left")


_AGAINST = {
    "too_short": "end_sec - start_sec < 0.18", "low_confidence": "coalesce(confidence < 0.62, TRUE)", "low_coverage": "coalesce(coverage < 0.45, TRUE)", "pitch_out_of_range": "NOT shifted_pitch BETWEEN 48 AND 84",
    "no_local_context": "left_pitch IS NULL AND right_pitch IS NULL", "context_pitch_mismatch": "least(abs(shifted_pitch - left_pitch), abs(shifted_pitch - right_pitch)) > 4", "splits_big_gap": "gap_end - gap_start > 0.5 AND start_sec - gap_start > 0.5 AND gap_end - end_sec > 0.5",
}


@REGISTRY.query(
    "c11_fragment_clusters",
    f"""WITH {_TABLES},
  reach AS (SELECT *, max(end_sec) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM selected),
  gap AS (SELECT DISTINCT sample_id, gap_start, start_sec AS gap_end FROM reach WHERE start_sec - gap_start > 0.2),
  gone AS (SELECT r.* FROM raw r LEFT JOIN met m ON m.sample_id = r.sample_id AND m.note_seq = r.note_seq WHERE NOT coalesce(matched, FALSE)),
  g AS (SELECT g.sample_id, gap_start, gap_end, count(*) AS n_candidates, min(start_sec) AS start_sec, max(end_sec) AS end_sec, sum(end_sec - start_sec) AS fragment_sec, sum(pitch * (end_sec - start_sec)) / sum(end_sec - start_sec) AS pitch,
    sum(confidence * (end_sec - start_sec)) / sum(end_sec - start_sec) FILTER (confidence IS NOT NULL) AS confidence, bool_or(end_sec - start_sec < 0.18) AS short FROM gap g JOIN gone r ON r.sample_id = g.sample_id AND least(gap_end, end_sec) - greatest(gap_start, start_sec) >= 0.05 GROUP BY 1, 2, 3),
  c AS (SELECT *, CASE WHEN pitch < 48 THEN pitch + 12 ELSE pitch END AS shifted_pitch, fragment_sec / (end_sec - start_sec) AS coverage,
    (SELECT arg_max({{'p': s.pitch, 't': s.end_sec}}, {{'a': s.end_sec, 'b': -s.start_sec, 'c': -s.note_seq}}) FROM selected s WHERE s.sample_id = g.sample_id AND s.end_sec <= gap_start) AS l,
    (SELECT arg_min({{'p': s.pitch, 't': s.start_sec}}, {{'a': s.start_sec, 'c': s.note_seq}}) FROM selected s WHERE s.sample_id = g.sample_id AND s.start_sec >= gap_end) AS r FROM g),
  d AS (SELECT *, l.p AS left_pitch, r.p AS right_pitch FROM c), e AS (SELECT *, {_named("candidate_formation", _AGAINST)} AS against FROM d)
  SELECT sample_id, round(gap_start, 6) AS gap_start, round(gap_end, 6) AS gap_end, n_candidates, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, round(fragment_sec, 6) AS fragment_sec, round(coverage, 9) AS coverage, round(pitch, 9) AS pitch, round(shifted_pitch, 9) AS shifted_pitch, round(confidence, 9) AS confidence,
    left_pitch, right_pitch, round(start_sec - l.t, 6) AS left_gap_sec, round(r.t - end_sec, 6) AS right_gap_sec,
    array_to_string(list_concat({_named("candidate_formation", {"low_octave_cluster": "pitch < 48", "short_fragment_cluster": "pitch >= 48 AND short"})}, CASE WHEN len(against) = 0 THEN ['candidate_formation_safe'] ELSE against END), ',') AS reasons FROM e""",
)
def c11_fragment_clusters(spark, sf):
    """C11: removed candidates in a gap of the selection, taken as one note that could fill it."""
    raw, selected, _ = _tables(spark, sf)
    gaps = I.gaps(selected, ["sample_id"], least=0.2, width=10.0).select("sample_id", "gap_start", "gap_end").distinct()
    out = G.fragment_clusters(gaps, raw, selected, "sample_id", width=10.0)
    # weighted means in nine digits: with six they may lie halfway between two, where the order of a sum decides
    digits = dict.fromkeys(("gap_start", "gap_end", "start_sec", "end_sec", "fragment_sec", "left_gap_sec", "right_gap_sec"), 6) | dict.fromkeys(("coverage", "pitch", "shifted_pitch", "confidence"), 9)
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumn("reasons", F.array_join("reasons", ","))
