"""Queries that report on a run over many samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import run_reports as R
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

_IDS = ["current_grid", "half_tempo_grid", "double_tempo_grid", "downbeat_phase_shift_0", "downbeat_phase_shift_1", "offset_grid"]
_GRIDS = f"""{NOTES}, c AS (SELECT sample_id, [{", ".join(repr(x) for x in _IDS)}][CAST(1 + note_seq % 6 AS INT)] AS candidate_id, round(avg(confidence), 6) AS candidate_score, round(avg(end_sec - start_sec), 6) AS off_grid_onset_ratio, CASE WHEN count(*) % 5 > 0 THEN round(avg(velocity) / 128, 6) END AS downbeat_confidence, round(max(confidence), 6) AS bar_phase_confidence, round(avg(pitch) / 85, 6) AS pickup_likelihood FROM notes WHERE sample_id % 8 > 0 GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY candidate_score DESC, candidate_id) AS k FROM c),
  grid AS (SELECT sample_id, sample_id % 9 > 0 AS available, max(candidate_id) FILTER (k = 1) AS best_id, CAST(max(k) FILTER (candidate_id = 'current_grid') AS INT) AS current_rank, round(max(candidate_score) - max(candidate_score) FILTER (candidate_id = 'current_grid'), 6) AS score_delta FROM ranked WHERE sample_id % 7 > 0 GROUP BY 1),
  result AS (SELECT DISTINCT sample_id FROM notes)"""


def _grids(spark, sf):
    """Six candidate grids a sample, scored by sixths of its notes; some samples have no candidates or no ranking."""
    n = T.notes(spark, sf)
    name = F.element_at(F.array(*map(F.lit, _IDS)), (1 + F.col("note_seq") % 6).cast("int"))
    mean = lambda c, by=1: F.round(F.avg(c) / by, 6)
    c = n.where("sample_id % 8 > 0").groupBy("sample_id", name.alias("candidate_id")).agg(
        mean("confidence").alias("candidate_score"), mean(F.col("end_sec") - F.col("start_sec")).alias("off_grid_onset_ratio"), F.when(F.count(F.lit(1)) % 5 > 0, mean("velocity", 128)).alias("downbeat_confidence"),
        F.round(F.max("confidence"), 6).alias("bar_phase_confidence"), mean("pitch", 85).alias("pickup_likelihood"),
    )
    # six rows a sample
    ranked = c.where("sample_id % 7 > 0").withColumn("k", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("candidate_score"), "candidate_id")))
    now = F.col("candidate_id") == R.CURRENT
    grids = ranked.groupBy("sample_id").agg(F.max(F.when(F.col("k") == 1, F.col("candidate_id"))).alias("best_id"), F.max(F.when(now, F.col("k"))).alias("current_rank"), F.round(F.max("candidate_score") - F.max(F.when(now, F.col("candidate_score"))), 6).alias("score_delta"))
    return n.select("sample_id").distinct(), grids.withColumn("available", F.col("sample_id") % 9 > 0), c


@REGISTRY.query(
    "c44_grid_suspicions",
    f"""WITH {_GRIDS}, s AS (SELECT sample_id, max(candidate_score) FILTER (candidate_id = 'current_grid') AS now, max(candidate_score) FILTER (candidate_id = 'half_tempo_grid') AS half, max(candidate_score) FILTER (candidate_id = 'double_tempo_grid') AS twice, max(pickup_likelihood) AS p FROM c GROUP BY 1)
  SELECT s.sample_id, CASE WHEN half - now >= 0.12 THEN 'half_tempo_grid' WHEN twice - now >= 0.12 THEN 'double_tempo_grid' ELSE 'none' END AS tempo, CASE WHEN starts_with(best_id, 'downbeat_phase_shift_') AND best_id <> 'downbeat_phase_shift_0' THEN best_id ELSE 'none' END AS phase, CASE WHEN p >= 0.7 THEN 'possible' ELSE 'none' END AS pickup,
    CASE WHEN now IS NOT NULL AND best_id <> 'current_grid' AND score_delta >= 0.12 THEN CASE WHEN best_id IN ('half_tempo_grid', 'double_tempo_grid') THEN 'possible_half_or_double_tempo_grid' WHEN starts_with(best_id, 'downbeat_phase_shift_') THEN 'possible_downbeat_phase_issue' ELSE 'diagnostic_candidate_scores_much_better_than_current_grid' END END AS warning
  FROM s LEFT JOIN grid g ON g.sample_id = s.sample_id""",
)
def c44_grid_suspicions(spark, sf):
    """What the candidate grids of a sample make one suspect."""
    _, grids, c = _grids(spark, sf)
    out = R.grid_suspicions(c, grids, "sample_id").join(grids, "sample_id", "left")
    return out.select("sample_id", "tempo", "phase", "pickup", R.grid_warning(F.col("best_id"), F.col("current_rank").isNotNull(), F.col("score_delta")).alias("warning"))


_SUMMARY = f"""{_GRIDS}, m AS (SELECT r.sample_id, g.best_id, current_rank, score_delta, {", ".join(f"max(c.{x}) FILTER (c.candidate_id = 'current_grid') AS current_{x}, max(c.{x}) FILTER (c.candidate_id = g.best_id) AS best_{x}" for x in R.MEASURES)},
    CASE WHEN NOT coalesce(bool_or(available), FALSE) OR count(c.candidate_id) = 0 THEN 'regenerate_debug_package' WHEN current_rank = 1 OR score_delta <= 0.05 THEN 'keep_current_grid' WHEN score_delta >= 0.12 AND g.best_id IN ('half_tempo_grid', 'double_tempo_grid') THEN 'inspect_half_double_tempo' WHEN score_delta >= 0.12 AND starts_with(g.best_id, 'downbeat_phase_shift_') THEN 'inspect_downbeat_phase' ELSE 'manual_review' END AS next_action
    FROM result r LEFT JOIN grid g ON g.sample_id = r.sample_id LEFT JOIN c ON c.sample_id = r.sample_id GROUP BY 1, 2, 3, 4),
  o(next_action, "group", place) AS (VALUES {", ".join(f"('{a}', '{g}', {k})" for k, (a, g) in enumerate(R.GROUPS.items()))})"""


@REGISTRY.query("c56_rhythm_summary", f'WITH {_SUMMARY} SELECT m.*, o."group" FROM m JOIN o USING (next_action)')
def c56_rhythm_summary(spark, sf):
    """Current and best grid of each sample, and what to do next."""
    return R.rhythm_summary(*_grids(spark, sf), "sample_id")


@REGISTRY.query("c56_rhythm_groups", f'WITH {_SUMMARY} SELECT CAST(place AS INT) AS place, o."group", count(m.sample_id) AS n_samples FROM o LEFT JOIN m USING (next_action) GROUP BY 1, 2')
def c56_rhythm_groups(spark, sf):
    """Samples by what to do next."""
    return R.group_counts(R.rhythm_summary(*_grids(spark, sf), "sample_id"))


@REGISTRY.query(
    "c59_dataset_status",
    """WITH s AS (SELECT o_orderkey AS sample_id, o_orderstatus <> 'F' AS enabled, CASE WHEN o_orderkey % 5 > 0 THEN 1 END AS expected_track, 'in/' || o_orderkey || '.mp4' AS a, CASE WHEN o_orderkey % 3 > 0 THEN upper(sha256(CAST(o_orderkey AS VARCHAR))) END AS a_sha, 'out/' || o_custkey || '.mid' AS b, CASE WHEN o_orderkey % 4 > 0 THEN sha256(CAST(o_custkey AS VARCHAR)) END AS b_sha FROM orders),
  f AS (SELECT 'in/' || o_orderkey || '.mp4' AS path, sha256(CAST(o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS sha FROM orders WHERE o_orderkey % 7 > 0 UNION ALL SELECT 'out/' || c_custkey || '.mid', sha256(CAST(c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR)) FROM customer WHERE c_custkey % 10 > 0),
  x AS (SELECT s.*, fa.path IS NOT NULL AS a_there, fb.path IS NOT NULL AS b_there, lower(a_sha) <> fa.sha AS a_other, b_sha <> fb.sha AS b_other FROM s LEFT JOIN f fa ON fa.path = a LEFT JOIN f fb ON fb.path = b)
  SELECT sample_id, enabled, a_there AS input_mp4_exists, b_there AS expected_midi_exists,
    array_to_string(list_filter([CASE WHEN NOT a_there THEN 'MISSING_INPUT_MP4' END, CASE WHEN NOT b_there THEN 'MISSING_EXPECTED_MIDI' END, CASE WHEN enabled AND expected_track IS NULL THEN 'MISSING_MELODY_TRACK' END, CASE WHEN a_other THEN 'CHECKSUM_MISMATCH:input_mp4' END, CASE WHEN b_other THEN 'CHECKSUM_MISMATCH:expected_midi' END], lambda v: v IS NOT NULL), ',') AS errors,
    array_to_string(list_filter([CASE WHEN a_sha IS NULL THEN 'CHECKSUM_NOT_CONFIGURED:input_mp4' END, CASE WHEN b_sha IS NULL THEN 'CHECKSUM_NOT_CONFIGURED:expected_midi' END], lambda v: v IS NOT NULL), ',') AS warnings FROM x""",
)
def c59_dataset_status(spark, sf):
    """Whether the files of each sample are there and as configured. Orders are the samples, they and customers the files."""
    o, k, c = T.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    sha = lambda x: F.sha2(x.cast("string"), 256)
    path = lambda a, x, b: F.concat(F.lit(a), x.cast("string"), F.lit(b))
    samples = o.select(
        k.alias("sample_id"), (F.col("o_orderstatus") != "F").alias("enabled"), F.when(k % 5 > 0, 1).alias("expected_track"), path("in/", k, ".mp4").alias("input_mp4"), F.when(k % 3 > 0, F.upper(sha(k))).alias("input_mp4_sha256"),
        path("out/", c, ".mid").alias("expected_midi"), F.when(k % 4 > 0, sha(c)).alias("expected_midi_sha256"),
    )
    w = F.col("c_custkey")
    files = o.where("o_orderkey % 7 > 0").select(path("in/", k, ".mp4").alias("path"), sha(k + F.when(k % 11 == 0, 1).otherwise(0)).alias("sha256"))
    files = files.unionByName(T.table(spark, sf, "customer").where("c_custkey % 10 > 0").select(path("out/", w, ".mid").alias("path"), sha(w + F.when(w % 13 == 0, 1).otherwise(0)).alias("sha256")))
    return R.dataset_status(samples, files).withColumns({x: F.array_join(x, ",") for x in ("errors", "warnings")})
