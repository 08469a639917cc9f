"""Reports on what a selection left out: deleted candidates, shifts between stages, and fragments that could fill a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import asof_join, interval_join, previous
from .lineage import cut
from .ragged import positions

# Seconds, semitones, confidence, rows of a report.
EVIDENCE_SEC = 0.05
NEARBY_SEC = 0.75
SHORT_SEC = 0.18
BIG_GAP_SEC = 0.5
JUMP = 7.0
UNSURE = 0.35
TOP = 12
LOWEST, HIGHEST = 48.0, 84.0
CLUSTER_SURE = 0.62
CLUSTER_COVERAGE = 0.45
CONTEXT_SEMITONES = 4.0


def _codes(prefix: str, tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.filter(F.array(*(F.when(t, f"{prefix}_{name}") for name, t in tests.items())), lambda x: x.isNotNull())


def top_of(df: DataFrame, keys: list[str], order: list, top: int = TOP) -> DataFrame:
    """The first `top` rows of each key, numbered by `place`; Spark keeps so many of each task before it shuffles."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= top)


def nearest_center(left: DataFrame, right: DataFrame, key: str, right_id: str, limit: float = NEARBY_SEC, width: float = 60.0) -> DataFrame:
    """Adds near_id and near_sec, the right row whose middle is nearest to that of a left row within `limit`; of equally near ones the smallest id.

    Both have start_sec and end_sec. Two as-of joins by buckets of time; no pair is listed but the nearest before and after.
    """
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    points = cut(right.groupBy(key, middle.alias("__at")).agg(F.min(right_id).alias("__id"))).withColumn("__point", F.col("__at"))
    rows = left.withColumn("__mid", middle)
    for name, forward in (("__before", False), ("__after", True)):
        found = points.select(key, "__at", F.struct("__point", "__id").alias(name))
        rows = asof_join(rows, found, [key], "__mid", "__at", [name], forward=forward, width=width)
    near = lambda n: F.when(F.abs(F.col("__mid") - F.col(n)["__point"]) <= limit, F.struct(F.abs(F.col("__mid") - F.col(n)["__point"]).alias("d"), F.col(n)["__id"].alias("id")))
    rows = rows.withColumn("__near", F.least(near("__before"), near("__after")))
    return rows.select(*left.columns, F.col("__near.id").alias("near_id"), F.col("__near.d").alias("near_sec"))


def _met(records: DataFrame, others: DataFrame, key: str, width: float) -> DataFrame:
    """For each record that overlaps others: whether one is its match, and how long and which the longest overlap is; of equal ones the first to begin."""
    o = others.select(key, F.col("start_sec").alias("o_start"), F.col("end_sec").alias("o_end"), F.col("pitch").alias("o_pitch"), F.col("note_seq").alias("o_seq"))
    pairs = interval_join(records.select(key, "note_seq", "start_sec", "end_sec", "pitch"), o, [key], width, "start_sec", "end_sec", "o_start", "o_end")
    shared = F.least("end_sec", "o_end") - F.greatest("start_sec", "o_start")
    match = (shared >= EVIDENCE_SEC) & (F.coalesce(F.abs(F.col("pitch") - F.col("o_pitch")), F.lit(0)) <= 1)
    pairs = pairs.withColumns({"__shared": shared, "__match": match}).where("__shared > 0")
    best = F.struct(F.col("__shared"), (-F.col("o_start")).alias("s"), (-F.col("o_seq")).alias("q"))
    return pairs.groupBy(key, "note_seq").agg(F.max("__match").alias("matched"), F.max("__shared").alias("overlap_sec"), F.max_by("o_seq", best).alias("overlap_with"))


def deleted_candidates(raw: DataFrame, selected: DataFrame, lost: DataFrame, key: str, width: float = 60.0, top: int | None = TOP) -> DataFrame:
    """Raw candidates that no selected note matches (overlap, pitch within 1), with what may be why, the nearest lost note and their impact.

    All have key, note_seq, start_sec, end_sec; raw and selected also pitch, raw confidence. Neighbours are those in order of start and note_seq.
    The `top` of each key by impact (confidence, or 0.5, times length) and start; None for all.
    """
    columns = [key, "note_seq", "start_sec", "end_sec", "pitch", "confidence"]
    rows = raw.select(*columns).withColumns({"__s": -F.col("start_sec"), "__q": -F.col("note_seq")})
    at = F.floor(F.col("start_sec") / width)
    rows = previous(rows, [key], ["start_sec", "note_seq"], "pitch", "__last", at)
    rows = previous(rows, [key], ["__s", "__q"], "pitch", "__next", -at)
    gone = rows.join(_met(raw, selected, key, width), [key, "note_seq"], "left").where("NOT coalesce(matched, false)")
    gone = nearest_center(gone, lost, key, "note_seq", width=width)
    jump = F.greatest(F.abs(F.col("pitch") - F.col("__last")), F.abs(F.col("pitch") - F.col("__next")))
    long = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    reasons = _codes("deleted_candidate", {"selector_removed": F.lit(True), "low_confidence": F.col("confidence") < UNSURE, "short_duration": long < SHORT_SEC, "large_pitch_jump": jump >= JUMP, "overlap": F.round("overlap_sec", 6) > 0})
    out = gone.select(*columns, reasons.alias("reasons"), jump.alias("pitch_jump"), F.coalesce(F.round("overlap_sec", 6), F.lit(0.0)).alias("overlap_sec"), "overlap_with", "near_id", F.round("near_sec", 6).alias("near_sec"), F.round(F.coalesce("confidence", F.lit(0.5)) * long, 6).alias("impact"))
    return out if top is None else top_of(out, [key], [F.desc("impact"), "start_sec", "note_seq"], top)


def quantization_shifts(quantized: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Onset shift and ratio of lengths of each quantised note against the selected note it comes from; of several of one id the last.

    quantized: key, note_seq, source_id, quantized_start_sec, quantized_sec. selected: key, note_seq, candidate_id, start_sec, end_sec.
    """
    last = selected.where("candidate_id IS NOT NULL").groupBy(key, F.col("candidate_id").alias("source_id")).agg(F.max_by(F.struct("start_sec", "end_sec"), "note_seq").alias("__s"))
    start, long = F.col("__s.start_sec"), F.greatest(F.lit(0.0), F.col("__s.end_sec") - F.col("__s.start_sec"))
    ratio = F.try_divide("quantized_sec", F.when(long > 0, long))
    return quantized.join(last, [key, "source_id"]).select(key, "note_seq", "source_id", F.round(F.col("quantized_start_sec") - start, 6).alias("onset_shift_sec"), F.round(ratio, 6).alias("duration_ratio"))


def export_shifts(score: DataFrame, predicted: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Onset shift and ratio of lengths of score notes and predicted ones at the same place in order of start and note_seq."""
    at, order = F.floor(F.col("start_sec") / width), ["start_sec", "note_seq"]
    a = positions(score.select(key, "note_seq", "start_sec", "end_sec"), key, order, "__at", at)
    b = positions(predicted.select(key, "note_seq", "start_sec", "end_sec"), key, order, "__at", at)
    b = b.select(key, "__at", F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"))
    long = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    ratio = F.greatest(F.lit(0.0), F.col("__b") - F.col("__a")) / F.when(long > 0, long)
    return a.join(b, [key, "__at"]).select(key, "note_seq", F.round(F.col("__a") - F.col("start_sec"), 6).alias("onset_shift_sec"), F.round(ratio, 6).alias("duration_ratio"))


def stage_losses(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of each stage, n_<stage>, and drop_stage, `<stage>_to_<next>` for the first step that loses rows."""
    counted = [df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).select(key, F.lit(name).alias("__stage"), "__n") for name, df in stages.items()]
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    names = list(stages)
    sums = rows.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col("__stage") == name, F.col("__n"))), F.lit(0)).alias(f"n_{name}") for name in names))
    step = F.coalesce(*(F.when(F.col(f"n_{b}") < F.col(f"n_{a}"), F.lit(f"{a}_to_{b}")) for a, b in zip(names, names[1:], strict=False)))
    return sums.withColumn("drop_stage", step)


def fragment_clusters(gaps: DataFrame, raw: DataFrame, selected: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """C11: for each gap, the unmatched raw candidates inside as one note that could fill it: span, weighted pitch and confidence, coverage, and what speaks against it.

    gaps: key, gap_start, gap_end (none twice). raw and selected as in `deleted_candidates`. A gap without such candidates has no row.
    A cluster is aggregated as it is found, never gathered.
    """
    gone = raw.join(_met(raw, selected, key, width).where("matched").select(key, "note_seq"), [key, "note_seq"], "left_anti")
    r = gone.select(key, "note_seq", "start_sec", "end_sec", "pitch", "confidence")
    inside = interval_join(gaps.select(key, "gap_start", "gap_end"), r, [key], width, "gap_start", "gap_end", "start_sec", "end_sec")
    inside = inside.where(F.least("gap_end", "end_sec") - F.greatest("gap_start", "start_sec") >= EVIDENCE_SEC)
    long = F.col("end_sec") - F.col("start_sec")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * long), F.sum(F.when(F.col(c).isNotNull(), long)))
    g = inside.groupBy(key, "gap_start", "gap_end").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum(long).alias("fragment_sec"),
        weighted("pitch").alias("pitch"), weighted("confidence").alias("confidence"), F.max(long < SHORT_SEC).alias("__short"),
    )
    s = cut(selected.select(key, "start_sec", "end_sec", "pitch", "note_seq"))
    first = F.struct("start_sec", "note_seq")
    left = s.groupBy(key, F.col("end_sec").alias("__t")).agg(F.min_by(F.struct("pitch", F.col("end_sec").alias("at")), first).alias("__left"))
    right = s.groupBy(key, F.col("start_sec").alias("__t")).agg(F.min_by(F.struct("pitch", F.col("start_sec").alias("at")), F.col("note_seq")).alias("__right"))
    g = asof_join(g, left, [key], "gap_start", "__t", ["__left"], width=width)
    g = asof_join(g, right, [key], "gap_end", "__t", ["__right"], forward=True, width=width)
    span = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    coverage = F.try_divide("fragment_sec", span)
    low = F.coalesce(F.col("pitch") < LOWEST, F.lit(False))
    shifted = F.when(low, F.col("pitch") + 12).otherwise(F.col("pitch"))
    nearest = F.least(F.abs(shifted - F.col("__left.pitch")), F.abs(shifted - F.col("__right.pitch")))
    no_context = F.coalesce("__left.pitch", "__right.pitch").isNull()
    over = lambda x: (F.greatest(F.lit(0.0), x) > BIG_GAP_SEC).cast("int")
    splits = (F.col("gap_end") - F.col("gap_start") > BIG_GAP_SEC) & (over(F.col("start_sec") - F.col("gap_start")) + over(F.col("gap_end") - F.col("end_sec")) > 1)
    kind = _codes("candidate_formation", {"low_octave_cluster": low, "short_fragment_cluster": ~low & F.col("__short")})
    against = _codes("candidate_formation", {
        "too_short": span < SHORT_SEC, "low_confidence": F.coalesce(F.col("confidence") < CLUSTER_SURE, F.lit(True)), "low_coverage": F.coalesce(coverage < CLUSTER_COVERAGE, F.lit(True)),
        "pitch_out_of_range": F.coalesce(~shifted.between(LOWEST, HIGHEST), F.lit(True)), "no_local_context": no_context, "context_pitch_mismatch": ~no_context & (nearest > CONTEXT_SEMITONES), "splits_big_gap": splits,
    })
    safe = F.when(F.size(against) == 0, F.array(F.lit("candidate_formation_safe"))).otherwise(against)
    return g.select(
        key, "gap_start", "gap_end", "n_candidates", "start_sec", "end_sec", "fragment_sec", coverage.alias("coverage"), "pitch", shifted.alias("shifted_pitch"), "confidence",
        F.col("__left.pitch").alias("left_pitch"), F.col("__right.pitch").alias("right_pitch"), (F.col("start_sec") - F.col("__left.at")).alias("left_gap_sec"), (F.col("__right.at") - F.col("end_sec")).alias("right_gap_sec"), F.concat(kind, safe).alias("reasons"),
    )
