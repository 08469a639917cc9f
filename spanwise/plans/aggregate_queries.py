"""Queries that filter, label and aggregate notes: rejection reasons, gates, profiles, histograms, funnels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import rules as R
from ..operators import windows as X
from . import fixtures as T
from .fixtures import EXPECTED, NOTES, PREDICTED
from .registry import REGISTRY

KEY, ORDER = ["sample_id"], ["start_sec", "note_seq"]
r6 = lambda c: F.round(c, 6)
dur = lambda: F.col("end_sec") - F.col("start_sec")
BY = "(PARTITION BY sample_id ORDER BY start_sec, note_seq)"


@REGISTRY.query("f1_pitch_range", f"WITH {NOTES} SELECT sample_id, note_seq, pitch FROM notes WHERE pitch BETWEEN 52 AND 76")
def f1_pitch_range(spark, sf):
    return T.notes(spark, sf).where(F.col("pitch").between(52, 76)).select("sample_id", "note_seq", "pitch")


@REGISTRY.query("f2_ornament_filter", f"WITH {NOTES} SELECT sample_id, note_seq FROM notes WHERE NOT (end_sec - start_sec < 0.12 OR confidence < 0.52 OR (end_sec - start_sec < 0.16 AND confidence < 0.6))")
def f2_ornament_filter(spark, sf):
    """Also the noise floor."""
    drop = (dur() < 0.12) | (F.col("confidence") < 0.52) | ((dur() < 0.16) & (F.col("confidence") < 0.6))
    return T.notes(spark, sf).where(~drop).select("sample_id", "note_seq")


REASONS = [("pitch < 45 OR pitch > 80", "out_of_range"), ("confidence < 0.3", "low_confidence"), ("end_sec - start_sec < 0.1", "too_short"), ("NOT voiced", "unvoiced")]
REASON_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in REASONS) + "], lambda x: x IS NOT NULL)"


@REGISTRY.query("f4_rejection_reasons", f"WITH {NOTES}, r AS (SELECT *, {REASON_SQL} AS reasons FROM notes) SELECT sample_id, note_seq, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted, len(reasons) = 0 OR reasons = ['low_confidence'] AND end_sec - start_sec > 0.3 AS accepted_softly FROM r")
def f4_rejection_reasons(spark, sf):
    """Every failing test adds its code; the soft variant waives one of them for long notes."""
    n = R.with_reasons(T.notes(spark, sf), [(F.expr(c), name) for c, name in REASONS])
    waived = R.waive("reasons", ["low_confidence"], dur() > 0.3)
    return n.select("sample_id", "note_seq", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"), waived.alias("accepted_softly"))


@REGISTRY.query("f6_sequential_counters", f"WITH {NOTES}, b AS (SELECT sample_id, CASE WHEN NOT voiced THEN 'unvoiced' WHEN pitch < 45 THEN 'low' WHEN confidence < 0.3 THEN 'weak' ELSE 'kept' END AS bucket, end_sec - start_sec < 0.12 AS short FROM notes) SELECT sample_id, bucket, count(*) AS n, count(*) FILTER (short) AS n_short FROM b GROUP BY 1, 2")
def f6_sequential_counters(spark, sf):
    bucket = S.first_label((~F.col("voiced"), "unvoiced"), (F.col("pitch") < 45, "low"), (F.col("confidence") < 0.3, "weak"), otherwise="kept")
    return T.notes(spark, sf).groupBy("sample_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(dur() < 0.12).alias("n_short"))


@REGISTRY.query("f8_shift_projection", f"WITH {NOTES} SELECT sample_id, note_seq, round(start_sec + 0.25, 6) AS start_sec, round(end_sec + 0.25, 6) AS end_sec, pitch + 12 AS pitch, pitch + 12 <= 96 AS in_range FROM notes")
def f8_shift_projection(spark, sf):
    n = T.notes(spark, sf)
    return n.select("sample_id", "note_seq", r6(F.col("start_sec") + 0.25).alias("start_sec"), r6(F.col("end_sec") + 0.25).alias("end_sec"), (F.col("pitch") + 12).alias("pitch")).withColumn("in_range", F.col("pitch") <= 96)


METRICS_SQL = """m AS (SELECT sample_id, min(start_sec) AS first_onset, avg(voiced::INT) AS voiced_ratio, avg(confidence) AS confidence, count(*)::DOUBLE AS n_notes FROM notes GROUP BY 1)"""
GATES = [("first_onset", "<=", 1.0), ("voiced_ratio", ">=", 0.75), ("confidence", ">=", 0.45), ("n_notes", ">=", 60.0)]


@REGISTRY.query(
    "f10_threshold_gate",
    f"WITH {NOTES}, {METRICS_SQL}, c AS (" + " UNION ALL ".join(f"SELECT sample_id, '{m}' AS metric, round({m}, 6) AS value, {t}::DOUBLE AS threshold, {m} {op} {t} AS passed FROM m" for m, op, t in GATES) + ") SELECT *, bool_and(passed) OVER (PARTITION BY sample_id) AS all_passed FROM c",
)
def f10_threshold_gate(spark, sf):
    """Check rows from thresholds, and the status of the whole."""
    others = F.min("start_sec").alias("first_onset"), F.avg(F.col("voiced").cast("int")).alias("voiced_ratio"), F.count(F.lit(1)).cast("double").alias("n_notes")
    m = A.means_in_order(T.notes(spark, sf), KEY, ["note_seq"], {"confidence": F.col("confidence")}, *others)
    c = R.gate(m, KEY, GATES)
    return c.select("sample_id", "metric", S.round_scaled(F.col("value")).alias("value"), "threshold", "passed", F.bool_and("passed").over(W.partitionBy("sample_id")).alias("all_passed"))


@REGISTRY.query("f12_failure_modes", f"WITH {NOTES}, {METRICS_SQL} SELECT sample_id, array_to_string(list_filter([CASE WHEN first_onset > 1 THEN 'late_start' END, CASE WHEN voiced_ratio < 0.75 THEN 'unvoiced' END, CASE WHEN confidence < 0.45 THEN 'weak' END], lambda x: x IS NOT NULL), ',') AS modes, CASE WHEN first_onset > 1 THEN 'start' WHEN voiced_ratio < 0.75 THEN 'voice' ELSE 'none' END AS stage, round(least(0.45, n_notes / 150 * 0.85), 6) AS threshold FROM m")
def f12_failure_modes(spark, sf):
    """A set of labels, the first label of a cascade (F13), and a threshold that follows the data."""
    others = F.min("start_sec").alias("a"), F.avg(F.col("voiced").cast("int")).alias("v"), F.count(F.lit(1)).alias("n")
    m = A.means_in_order(T.notes(spark, sf), KEY, ["note_seq"], {"c": F.col("confidence")}, *others)
    late, mute, weak = F.col("a") > 1, F.col("v") < 0.75, F.col("c") < 0.45
    return m.select("sample_id", F.array_join(S.labels((late, "late_start"), (mute, "unvoiced"), (weak, "weak")), ",").alias("modes"), S.first_label((late, "start"), (mute, "voice"), otherwise="none").alias("stage"), r6(F.least(F.lit(0.45), F.col("n") / 150 * 0.85)).alias("threshold"))


@REGISTRY.query("a4_audibility", f"WITH {NOTES} SELECT sample_id, round(min(start_sec), 6) AS first_onset, round(min(end_sec - start_sec), 6) AS min_sec, round(avg(end_sec - start_sec), 6) AS mean_sec, round(max(end_sec - start_sec), 6) AS max_sec, min(velocity) AS min_velocity, round(avg(velocity), 6) AS mean_velocity, max(velocity) AS max_velocity FROM notes GROUP BY 1")
def a4_audibility(spark, sf):
    return T.notes(spark, sf).groupBy("sample_id").agg(r6(F.min("start_sec")).alias("first_onset"), r6(F.min(dur())).alias("min_sec"), r6(F.avg(dur())).alias("mean_sec"), r6(F.max(dur())).alias("max_sec"), F.min("velocity").alias("min_velocity"), r6(F.avg("velocity")).alias("mean_velocity"), F.max("velocity").alias("max_velocity"))


@REGISTRY.query("a6_median_percentiles", f"WITH {NOTES} SELECT sample_id, median(pitch::DOUBLE) AS median_pitch, round(quantile_cont(pitch::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(pitch::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(end_sec - start_sec, 0.9) - quantile_cont(end_sec - start_sec, 0.1), 6) AS robust_span, round(stddev_pop(pitch::DOUBLE), 6) AS deviation, round(stddev_pop(pitch::DOUBLE) / avg(pitch), 6) AS variation FROM notes GROUP BY 1")
def a6_median_percentiles(spark, sf):
    """Median, percentiles (A7), robust span (A15), deviation."""
    p = F.col("pitch").cast("double")
    return T.notes(spark, sf).groupBy("sample_id").agg(F.median(p).alias("median_pitch"), r6(F.percentile(p, 0.05)).alias("p05"), r6(F.percentile(p, 0.95)).alias("p95"), r6(F.percentile(dur(), 0.9) - F.percentile(dur(), 0.1)).alias("robust_span"), r6(F.stddev_pop(p)).alias("deviation"), r6(F.stddev_pop(p) / F.avg(p)).alias("variation"))


@REGISTRY.query(
    "a8_weighted_percentile",
    f"""WITH {NOTES}, g AS (SELECT sample_id, pitch, sum(end_sec - start_sec) AS w FROM notes GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY sample_id ORDER BY pitch) AS run, sum(w) OVER (PARTITION BY sample_id) AS total FROM g)
  SELECT sample_id, min(pitch) FILTER (run >= 0.05 * total - 1e-12) AS p05, min(pitch) FILTER (run >= 0.5 * total - 1e-12) AS p50, min(pitch) FILTER (run >= 0.95 * total - 1e-12) AS p95 FROM r GROUP BY 1""",
)
def a8_weighted_percentile(spark, sf):
    return A.weighted_percentile(T.notes(spark, sf).withColumn("w", dur()), KEY, "pitch", "w", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@REGISTRY.query("a9_weighted_mean", f"WITH {NOTES} SELECT sample_id, round(sum(pitch * (end_sec - start_sec)) / sum(end_sec - start_sec), 6) AS by_duration, round(sum(pitch * (end_sec - start_sec) * confidence) / nullif(sum((end_sec - start_sec) * confidence), 0), 6) AS by_confidence FROM notes GROUP BY 1")
def a9_weighted_mean(spark, sf):
    return T.notes(spark, sf).groupBy("sample_id").agg(r6(A.weighted_mean(F.col("pitch"), dur())).alias("by_duration"), r6(A.weighted_mean(F.col("pitch"), dur() * F.col("confidence"))).alias("by_confidence"))


@REGISTRY.query("a10_weighted_histogram", f"WITH {NOTES}, h AS (SELECT sample_id, CAST(round_even(pitch / 2.0, 0) AS INT) AS bin, sum(end_sec - start_sec) AS weight, count(*) AS n FROM notes GROUP BY 1, 2) SELECT sample_id, bin, n, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY sample_id), 6) AS share FROM h")
def a10_weighted_histogram(spark, sf):
    n = T.notes(spark, sf).withColumns({"half": F.col("pitch") / 2.0, "w": dur()})
    return A.weighted_histogram(n, KEY, "half", "w").select("sample_id", "bin", "n", r6("weight").alias("weight"), r6("share").alias("share"))


@REGISTRY.query(
    "a11_histogram_overlap",
    f"""WITH {NOTES}, h AS (SELECT sample_id, state, CAST(pitch AS INT) AS bin, sum(end_sec - start_sec) AS w FROM notes GROUP BY 1, 2, 3), s AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id, state) AS share FROM h),
  j AS (SELECT a.sample_id, shift, round(sum(least(a.share, b.share)), 9) AS shared FROM s a JOIN (SELECT *, unnest([-24, -12, 0, 12, 24]) AS shift FROM s WHERE state = 'instrumental') b ON a.sample_id = b.sample_id AND a.bin = b.bin + b.shift WHERE a.state = 'vocal' GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY shared DESC, abs(shift), shift DESC) AS k FROM j) SELECT sample_id, round(shared, 6) AS shared, CAST(shift AS INT) AS shift FROM r WHERE k = 1""",
)
def a11_histogram_overlap(spark, sf):
    n = T.notes(spark, sf).withColumn("w", dur())
    h = A.weighted_histogram(n, ["sample_id", "state"], "pitch", "w")
    out = A.histogram_overlap(h.where("state = 'vocal'"), h.where("state = 'instrumental'"), KEY, [-24, -12, 0, 12, 24])
    return out.select("sample_id", r6("shared").alias("shared"), "shift")


@REGISTRY.query("a14_median_deviation", f"WITH {NOTES}, m AS (SELECT sample_id, median(pitch::DOUBLE) AS m FROM notes GROUP BY 1) SELECT sample_id, median(abs(pitch - m)) AS mad FROM notes JOIN m USING (sample_id) GROUP BY 1")
def a14_median_deviation(spark, sf):
    return A.median_deviation(T.notes(spark, sf).withColumn("pitch", F.col("pitch").cast("double")), KEY, "pitch")


@REGISTRY.query(
    "a16_trimmed_interval",
    f"""WITH {NOTES}, d AS (SELECT sample_id, lead(start_sec) OVER {BY} - start_sec AS step FROM notes), b AS (SELECT sample_id, quantile_cont(step, 0.1) AS lo, quantile_cont(step, 0.9) AS hi, count(step) AS n FROM d GROUP BY 1)
  SELECT sample_id, round(avg(step), 6) AS trimmed_mean, count(step) AS n_used FROM d JOIN b USING (sample_id) WHERE n < 12 OR step BETWEEN lo AND hi GROUP BY 1""",
)
def a16_trimmed_interval(spark, sf):
    d = T.notes(spark, sf).select("sample_id", (F.lead("start_sec").over(X.ordered(KEY, ORDER)) - F.col("start_sec")).alias("step"))
    return A.trimmed_mean(d, KEY, "step", 0.1, 0.9, 12).withColumn("trimmed_mean", r6("trimmed_mean"))


@REGISTRY.query("a17_reason_counts", f"WITH {NOTES}, r AS (SELECT sample_id, unnest({REASON_SQL}) AS reason FROM notes) SELECT sample_id, reason, count(*) AS n FROM r GROUP BY 1, 2")
def a17_reason_counts(spark, sf):
    return A.reason_counts(R.with_reasons(T.notes(spark, sf), [(F.expr(c), name) for c, name in REASONS]), KEY, "reasons")


@REGISTRY.query(
    "a18_pitch_class_mode",
    f"""WITH {NOTES}, p AS (SELECT sample_id, pitch % 12 AS pitch_class, count(*) AS n, sum((end_sec - start_sec) * confidence) AS weight FROM notes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, pitch_class) AS rank FROM p)
  SELECT sample_id, pitch_class, n, round(weight, 6) AS weight, rank FROM r WHERE rank <= 5""",
)
def a18_pitch_class_mode(spark, sf):
    """A top-k report: the five most frequent pitch classes."""
    p = T.notes(spark, sf).groupBy("sample_id", S.pitch_class(F.col("pitch")).alias("pitch_class")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(dur() * F.col("confidence"))).alias("weight"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("n"), "pitch_class")).cast("long")).where("rank <= 5")


@REGISTRY.query(
    "a19_best_group",
    f"""WITH {NOTES}, g AS (SELECT sample_id, event_type, count(*) AS n, median(pitch::DOUBLE) AS med, min(pitch) AS low, max(pitch) AS high FROM notes GROUP BY 1, 2),
  s AS (SELECT *, n * (CASE WHEN med BETWEEN 52 AND 76 THEN 2 ELSE 1 END) + (CASE WHEN high - low <= 40 THEN 10 ELSE 0 END) AS score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, event_type) AS k FROM s)
  SELECT sample_id, event_type, n, med AS median_pitch, low, high, score FROM r WHERE k = 1""",
)
def a19_best_group(spark, sf):
    p = F.col("pitch").cast("double")
    g = T.notes(spark, sf).groupBy("sample_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.median(p).alias("median_pitch"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    g = g.withColumn("score", F.col("n") * F.when(F.col("median_pitch").between(52, 76), 2).otherwise(1) + F.when(F.col("high") - F.col("low") <= 40, 10).otherwise(0))
    return g.withColumn("k", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "event_type"))).where("k = 1").drop("k")


@REGISTRY.query("a22_layer_funnel", f"WITH {NOTES}, f AS (SELECT sample_id, count(*) AS n_all, count(*) FILTER (voiced) AS n_voiced, count(*) FILTER (voiced AND confidence >= 0.4) AS n_confident, count(*) FILTER (voiced AND confidence >= 0.4 AND pitch BETWEEN 45 AND 80) AS n_selected FROM notes GROUP BY 1) SELECT *, round(n_voiced / n_all, 6) AS keep_voiced, round(CASE WHEN n_voiced > 0 THEN n_confident / n_voiced END, 6) AS keep_confident, round(CASE WHEN n_confident > 0 THEN n_selected / n_confident END, 6) AS keep_selected FROM f")
def a22_layer_funnel(spark, sf):
    voiced, sure, inside = F.col("voiced"), F.col("confidence") >= 0.4, F.col("pitch").between(45, 80)
    return R.funnel(T.notes(spark, sf), KEY, {"all": F.lit(True), "voiced": voiced, "confident": voiced & sure, "selected": voiced & sure & inside}, 6)


@REGISTRY.query(
    "a23_stage_continuity",
    f"""WITH {NOTES}, l AS (SELECT 'all' AS stage, * FROM notes UNION ALL SELECT 'voiced', * FROM notes WHERE voiced UNION ALL SELECT 'confident', * FROM notes WHERE voiced AND confidence >= 0.4),
  d AS (SELECT stage, sample_id, lead(start_sec) OVER w - end_sec AS gap, abs(lead(pitch) OVER w - pitch) AS step FROM l WINDOW w AS (PARTITION BY stage, sample_id ORDER BY start_sec, note_seq))
  SELECT stage, sample_id, count(*) AS n_notes, count(*) FILTER (gap > 0.5) AS n_gaps, count(*) FILTER (step > 12) AS n_jumps, round(coalesce(max(gap), 0), 6) AS max_gap_sec FROM d GROUP BY 1, 2""",
)
def a23_stage_continuity(spark, sf):
    """All layers in one pass: the stages are an array that is exploded, not separate scans."""
    n = T.notes(spark, sf)
    stage = S.labels((F.lit(True), "all"), (F.col("voiced"), "voiced"), (F.col("voiced") & (F.col("confidence") >= 0.4), "confident"))
    n = n.withColumn("stage", F.explode(stage))
    return A.continuity(n, ["stage", "sample_id"], ORDER, 0.5, 0.35, 0.12, 12).select("stage", "sample_id", "n_notes", "n_gaps", "n_jumps", "max_gap_sec")


@REGISTRY.query("a24_means_by_status", f"WITH {NOTES} SELECT CASE WHEN grouping(event_type) = 1 THEN 'total' ELSE event_type END AS status, round(avg(confidence), 6) AS confidence, round(avg(end_sec - start_sec), 6) AS seconds, count(*) AS n FROM notes GROUP BY GROUPING SETS ((event_type), ())")
def a24_means_by_status(spark, sf):
    n = T.notes(spark, sf).rollup("event_type").agg(r6(F.avg("confidence")).alias("confidence"), r6(F.avg(dur())).alias("seconds"), F.count(F.lit(1)).alias("n"), F.grouping("event_type").alias("all"))
    return n.select(F.when(F.col("all") == 1, "total").otherwise(F.col("event_type")).alias("status"), "confidence", "seconds", "n")


@REGISTRY.query("a26_direction_counts", f"WITH {NOTES}, d AS (SELECT sample_id, lead(pitch) OVER {BY} - pitch AS d FROM notes), c AS (SELECT sample_id, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS repeats FROM d GROUP BY 1) SELECT *, CASE WHEN up > down * 1.2 THEN 'rising' WHEN down > up * 1.2 THEN 'falling' ELSE 'balanced' END AS bias FROM c")
def a26_direction_counts(spark, sf):
    d = T.notes(spark, sf).select("sample_id", (F.lead("pitch").over(X.ordered(KEY, ORDER)) - F.col("pitch")).alias("d"))
    c = d.groupBy("sample_id").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("repeats"))
    return c.withColumn("bias", S.first_label((F.col("up") > F.col("down") * 1.2, "rising"), (F.col("down") > F.col("up") * 1.2, "falling"), otherwise="balanced"))


@REGISTRY.query("a27_tessitura", f"WITH {NOTES}, r AS (SELECT sample_id, pitch, row_number() OVER (PARTITION BY sample_id ORDER BY pitch, note_seq) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM notes) SELECT sample_id, min(pitch) AS low, max(pitch) AS high, min(pitch) FILTER (k >= floor(n * 0.1) AND k < ceil(n * 0.9)) AS tessitura_low, max(pitch) FILTER (k >= floor(n * 0.1) AND k < ceil(n * 0.9)) AS tessitura_high FROM r GROUP BY 1")
def a27_tessitura(spark, sf):
    w = W.partitionBy("sample_id")
    r = T.notes(spark, sf).select("sample_id", "pitch", (F.row_number().over(w.orderBy("pitch", "note_seq")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    middle = (F.col("k") >= F.floor(F.col("n") * 0.1)) & (F.col("k") < F.ceil(F.col("n") * 0.9))
    return r.groupBy("sample_id").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"), F.min(F.when(middle, F.col("pitch"))).alias("tessitura_low"), F.max(F.when(middle, F.col("pitch"))).alias("tessitura_high"))


#: Major and minor key profiles of Krumhansl and Kessler: fixed values.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


@REGISTRY.query(
    "a28_key_estimate",
    f"""WITH {NOTES}, h AS (SELECT s.sample_id, CAST(pc AS INT) AS pc, coalesce(sum(end_sec - start_sec), 0) AS w FROM (SELECT DISTINCT sample_id FROM notes) s CROSS JOIN range(12) t(pc) LEFT JOIN notes n ON n.sample_id = s.sample_id AND n.pitch % 12 = pc GROUP BY 1, 2),
  k AS (SELECT tonic, mode, pc, profile[1 + (pc - tonic + 12) % 12] AS p FROM range(12) a(tonic), range(12) b(pc), (VALUES ('major', {MAJOR}::DOUBLE[]), ('minor', {MINOR}::DOUBLE[])) v(mode, profile)),
  c AS (SELECT sample_id, tonic, mode, round(corr(w, p), 9) AS r FROM h JOIN k USING (pc) GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, mode, tonic) AS k FROM c)
  SELECT a.sample_id, CAST(a.tonic AS INT) AS tonic, a.mode, round(a.r, 6) AS correlation, round(a.r - b.r, 6) AS margin FROM o a JOIN o b ON a.sample_id = b.sample_id AND a.k = 1 AND b.k = 2""",
)
def a28_key_estimate(spark, sf):
    """24 correlations with key profiles. The profiles are literals, so nothing but the histogram is shuffled."""
    bins = [F.sum(F.when(S.pitch_class(F.col("pitch")) == k, dur()).otherwise(0.0)) for k in range(12)]
    h = T.notes(spark, sf).groupBy("sample_id").agg(F.array(*bins).alias("w"))
    profiles = F.array(*(F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*(F.lit(p[(pc - t) % 12]) for pc in range(12))).alias("p")) for m, p in (("major", MAJOR), ("minor", MINOR)) for t in range(12)))
    k = h.select("sample_id", "w", F.explode(profiles).alias("k")).select("sample_id", "k.tonic", "k.mode", F.explode(F.arrays_zip("w", F.col("k.p").alias("p"))).alias("x"))
    c = k.groupBy("sample_id", "tonic", "mode").agg(F.round(F.corr(F.col("x.w"), F.col("x.p")), 9).alias("r"))
    w = W.partitionBy("sample_id").orderBy(F.desc("r"), "mode", "tonic")
    c = c.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("r").over(w)).where("k = 1")
    return c.select("sample_id", "tonic", "mode", r6("r").alias("correlation"), r6(F.col("r") - F.col("second")).alias("margin"))


@REGISTRY.query(
    "a29_downbeat_phase",
    f"""WITH {NOTES}, i AS (SELECT sample_id, (row_number() OVER {BY} - 1) % 4 AS phase, velocity FROM notes), m AS (SELECT sample_id, phase, round(avg(velocity), 9) AS strength FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY strength DESC, phase) AS k FROM m)
  SELECT sample_id, CAST(phase AS INT) AS phase, round(strength, 6) AS strength FROM r WHERE k = 1""",
)
def a29_downbeat_phase(spark, sf):
    i = T.notes(spark, sf).select("sample_id", ((F.row_number().over(X.ordered(KEY, ORDER)) - 1) % 4).alias("phase"), "velocity")
    m = i.groupBy("sample_id", "phase").agg(F.round(F.avg("velocity"), 9).alias("strength"))
    best = m.groupBy("sample_id").agg(F.max(F.struct("strength", (-F.col("phase")).alias("p"))).alias("b"))
    return best.select("sample_id", (-F.col("b.p")).alias("phase"), r6("b.strength").alias("strength"))


@REGISTRY.query("a31_off_grid", f"WITH {NOTES}, o AS (SELECT sample_id, abs(start_sec / 0.5 - round_even(start_sec / 0.5, 0)) * 0.5 AS d FROM notes) SELECT sample_id, round(avg((d > 0.08)::INT), 6) AS off_grid_ratio, round(avg(d), 6) AS mean_offset, round(quantile_cont(d, 0.95), 6) AS p95_offset FROM o GROUP BY 1")
def a31_off_grid(spark, sf):
    """Distance of onsets from the half-second grid."""
    o = T.notes(spark, sf).select("sample_id", F.abs(F.col("start_sec") - S.snap(F.col("start_sec"), 0.5)).alias("d"))
    return o.groupBy("sample_id").agg(r6(F.avg((F.col("d") > 0.08).cast("int"))).alias("off_grid_ratio"), r6(F.avg("d")).alias("mean_offset"), r6(F.percentile("d", 0.95)).alias("p95_offset"))


@REGISTRY.query(
    "c5_pitch_range_iou",
    f"""WITH {NOTES}, r AS (SELECT sample_id, quantile_cont(pitch::DOUBLE, 0.05) FILTER (state = 'vocal') AS a1, quantile_cont(pitch::DOUBLE, 0.95) FILTER (state = 'vocal') AS b1, quantile_cont(pitch::DOUBLE, 0.05) FILTER (state <> 'vocal') AS a2, quantile_cont(pitch::DOUBLE, 0.95) FILTER (state <> 'vocal') AS b2 FROM notes GROUP BY 1)
  SELECT sample_id, round(greatest(0, least(b1, b2) - greatest(a1, a2)) / nullif(greatest(b1, b2) - least(a1, a2), 0), 6) AS range_iou FROM r""",
)
def c5_pitch_range_iou(spark, sf):
    """Intersection over union of robust ranges."""
    p = lambda vocal, q: F.percentile(F.when((F.col("state") == "vocal") == F.lit(vocal), F.col("pitch").cast("double")), q)
    r = T.notes(spark, sf).groupBy("sample_id").agg(p(True, 0.05).alias("a1"), p(True, 0.95).alias("b1"), p(False, 0.05).alias("a2"), p(False, 0.95).alias("b2"))
    return r.select("sample_id", r6(F.try_divide(F.greatest(F.lit(0.0), F.least("b1", "b2") - F.greatest("a1", "a2")), F.greatest("b1", "b2") - F.least("a1", "a2"))).alias("range_iou"))


@REGISTRY.query("c26_ornament_flags", f"WITH {NOTES}, n AS (SELECT *, lag(pitch) OVER w AS p1, lead(pitch) OVER w AS p2, lead(start_sec) OVER w - end_sec AS gap FROM notes WINDOW w AS {BY}) SELECT sample_id, note_seq, end_sec - start_sec < 0.12 AND abs(coalesce(p2, pitch) - pitch) <= 2 AS ornament, coalesce(p2 = pitch AND gap <= 0.02, FALSE) AS tie FROM n")
def c26_ornament_flags(spark, sf):
    w = X.ordered(KEY, ORDER)
    nxt = F.lead("pitch").over(w)
    return T.notes(spark, sf).select("sample_id", "note_seq", ((dur() < 0.12) & (F.abs(F.coalesce(nxt, F.col("pitch")) - F.col("pitch")) <= 2)).alias("ornament"), F.coalesce((nxt == F.col("pitch")) & (F.lead("start_sec").over(w) - F.col("end_sec") <= 0.02), F.lit(False)).alias("tie"))


@REGISTRY.query("c62_primary_pitch_class", f"WITH {NOTES}, r AS (SELECT sample_id, pitch % 12 AS pitch_class, row_number() OVER (PARTITION BY sample_id ORDER BY round(end_sec - start_sec, 9) DESC, confidence DESC, start_sec) AS k FROM notes) SELECT sample_id, pitch_class FROM r WHERE k = 1")
def c62_primary_pitch_class(spark, sf):
    best = F.max_by(S.pitch_class(F.col("pitch")), F.struct(F.round(dur(), 9), "confidence", -F.col("start_sec")))
    return T.notes(spark, sf).groupBy("sample_id").agg(best.alias("pitch_class"))


@REGISTRY.query(
    "c53_source_comparisons",
    f"""WITH {NOTES}, h AS (SELECT sample_id, event_type AS source, pitch AS bin, sum(end_sec - start_sec) AS w FROM notes GROUP BY 1, 2, 3), s AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id, source) AS share FROM h)
  SELECT a.sample_id, a.source AS source_a, b.source AS source_b, round(sum(least(a.share, b.share)), 6) AS shared FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.bin = b.bin AND a.source < b.source GROUP BY 1, 2, 3""",
)
def c53_source_comparisons(spark, sf):
    h = A.weighted_histogram(T.notes(spark, sf).withColumnRenamed("event_type", "source").withColumn("w", dur()), ["sample_id", "source"], "pitch", "w")
    a = h.select("sample_id", "bin", F.col("source").alias("source_a"), F.col("share").alias("x"))
    b = h.select("sample_id", "bin", F.col("source").alias("source_b"), F.col("share").alias("y"))
    return a.join(b, ["sample_id", "bin"]).where("source_a < source_b").groupBy("sample_id", "source_a", "source_b").agg(r6(F.sum(F.least("x", "y"))).alias("shared"))
