"""Reports on a run over many samples: rhythm candidates, next steps, and whether the inputs are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import labels

# Differences of scores, names of grids, groups by next step in their order.
LARGE_DELTA, SMALL_DELTA = 0.12, 0.05
PICKUP = 0.7
CURRENT = "current_grid"
TEMPO_GRIDS = ("half_tempo_grid", "double_tempo_grid")
PHASE = "downbeat_phase_shift_"
GROUPS = {"keep_current_grid": "Current Grid Looks Stable", "inspect_half_double_tempo": "Half/Double Tempo Suspicion", "inspect_downbeat_phase": "Downbeat Phase Suspicion", "regenerate_debug_package": "Candidate Diagnostics Missing", "manual_review": "Manual Review"}
MEASURES = ("candidate_score", "off_grid_onset_ratio", "downbeat_confidence", "bar_phase_confidence")


def grid_warning(best_id: Column, has_current: Column, score_delta: Column) -> Column:
    """What it means that another grid scores much better than the current one; null if it does not."""
    much = has_current & (best_id != CURRENT) & (score_delta >= LARGE_DELTA)
    return F.when(much, F.when(best_id.isin(*TEMPO_GRIDS), "possible_half_or_double_tempo_grid").when(best_id.startswith(PHASE), "possible_downbeat_phase_issue").otherwise("diagnostic_candidate_scores_much_better_than_current_grid"))


def grid_suspicions(candidates: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """For each key what its candidate grids make one suspect: tempo, phase, pickup, each `none` where there is nothing.

    candidates: key, candidate_id, candidate_score, pickup_likelihood. best: key, best_id. A key without candidates has no row.
    """
    score = lambda name: F.max(F.when(F.col("candidate_id") == name, F.col("candidate_score"))).alias(f"__{name}")
    g = candidates.groupBy(key).agg(*(score(x) for x in (CURRENT, *TEMPO_GRIDS)), F.max("pickup_likelihood").alias("__pickup"))
    tempo = F.coalesce(*(F.when(F.col(f"__{x}") - F.col(f"__{CURRENT}") >= LARGE_DELTA, x) for x in TEMPO_GRIDS), F.lit("none"))
    phase = F.when(F.col("best_id").startswith(PHASE) & (F.col("best_id") != f"{PHASE}0"), F.col("best_id")).otherwise("none")
    return g.join(best.select(key, "best_id"), key, "left").select(key, tempo.alias("tempo"), phase.alias("phase"), F.when(F.col("__pickup") >= PICKUP, "possible").otherwise("none").alias("pickup"))


def next_action(missing: Column, best_id: Column, current_rank: Column, score_delta: Column) -> Column:
    """The step that is recommended for a sample."""
    large = score_delta >= LARGE_DELTA
    return (
        F.when(missing, "regenerate_debug_package")
        .when((current_rank == 1) | (score_delta <= SMALL_DELTA), "keep_current_grid")
        .when(large & best_id.isin(*TEMPO_GRIDS), "inspect_half_double_tempo")
        .when(large & best_id.startswith(PHASE), "inspect_downbeat_phase")
        .otherwise("manual_review")
    )


def rhythm_summary(results: DataFrame, grids: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Results with the measures of their current and their best grid, the next step and its group.

    results: key and others. grids: key, available, best_id, current_rank, score_delta. candidates: key, candidate_id (once a key) and MEASURES.
    A result without an available grid or without candidates is told to be missing them. One aggregation over the candidates, no window.
    """
    told = candidates.join(grids.select(key, F.col("best_id").alias("__best")), key, "left")
    of = lambda which, m: F.max(F.when(which, F.col(m)))
    now, best = F.col("candidate_id") == CURRENT, F.col("candidate_id") == F.col("__best")
    g = told.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *(of(now, m).alias(f"current_{m}") for m in MEASURES), *(of(best, m).alias(f"best_{m}") for m in MEASURES))
    out = results.join(grids.select(key, "available", "best_id", "current_rank", "score_delta"), key, "left").join(g, key, "left")
    missing = ~F.coalesce("available", F.lit(False)) | F.col("__n").isNull()
    out = out.withColumn("next_action", next_action(missing, F.col("best_id"), F.col("current_rank"), F.col("score_delta")))
    group = F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv))[F.col("next_action")]
    return out.withColumn("group", group).drop("__n", "available")


def group_counts(summary: DataFrame) -> DataFrame:
    """How many samples each group has, groups without any too."""
    return summary.select(F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("group"), (F.col("group") == name).cast("int").alias("one")) for k, name in enumerate(GROUPS.values())))).alias("x")).groupBy("x.place", "x.group").agg(F.sum("x.one").alias("n_samples"))


def dataset_status(samples: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("input_mp4", "expected_midi")) -> DataFrame:
    """Samples with input_exists, expected_exists, their errors and warnings.

    samples: sample_id, enabled, expected_track, and for each of `kinds` <kind> (a path) and <kind>_sha256, null if none is configured. files: path, sha256.
    A file of which nothing is configured is warned of, one of another checksum is an error; a missing file has no checksum to compare.
    """
    # one join for both kinds: a row for each path asked for
    asked = samples.select("sample_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("path"), F.col(f"{k}_sha256").alias("want")) for k in kinds))).alias("x")).select("sample_id", "x.*")
    have = files.groupBy("path").agg(F.max("sha256").alias("sha256"), F.lit(True).alias("there"))
    g = asked.join(have, "path", "left").groupBy("sample_id").agg(*(x for k in kinds for x in (F.max(F.when(F.col("kind") == k, F.coalesce("there", F.lit(False)))).alias(f"__{k}_there"), F.max(F.when(F.col("kind") == k, F.lower("want") != F.lower("sha256"))).alias(f"__{k}_other"))))
    errors = labels(
        *((~F.col(f"__{k}_there"), f"MISSING_{k.upper()}") for k in kinds), (F.col("enabled") & F.col("expected_track").isNull(), "MISSING_MELODY_TRACK"), *((F.col(f"__{k}_other"), f"CHECKSUM_MISMATCH:{k}") for k in kinds),
    )
    warnings = labels(*((F.col(f"{k}_sha256").isNull(), f"CHECKSUM_NOT_CONFIGURED:{k}") for k in kinds))
    out = samples.join(g, "sample_id")
    return out.select("sample_id", "enabled", *(F.col(f"__{k}_there").alias(f"{k}_exists") for k in kinds), errors.alias("errors"), warnings.alias("warnings"))
