"""Queries over ordered events and intervals: continuity, windows, islands, coverage, interval joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import intervals as I
from ..operators import windows as X
from . import fixtures as T
from .fixtures import EXPECTED, GRID, NOTES, PREDICTED
from .registry import REGISTRY

KEY, ORDER = ["sample_id"], ["start_sec", "note_seq"]
r6 = lambda c: F.round(c, 6)
BY = "(PARTITION BY sample_id ORDER BY start_sec, note_seq)"


@REGISTRY.query(
    "a5_continuity",
    f"""WITH {NOTES}, d AS (
  SELECT sample_id, end_sec - start_sec AS dur, lead(start_sec) OVER w - end_sec AS gap, abs(lead(pitch) OVER w - pitch) AS step
  FROM notes WINDOW w AS {BY}),
a AS (SELECT sample_id, count(*) AS n_notes, count(gap) AS n_pairs, count(*) FILTER (gap > 0.5) AS n_gaps, count(*) FILTER (dur < 0.12) AS n_short,
  count(*) FILTER (step > 12) AS n_jumps, count(*) FILTER (step > 12 AND gap <= 0.35) AS n_local_jumps, count(*) FILTER (step > 12 AND gap > 0.35) AS n_phrase_jumps,
  round(coalesce(max(gap), 0), 6) AS max_gap_sec FROM d GROUP BY sample_id)
SELECT *, round(CASE WHEN n_pairs > 0 THEN n_gaps::DOUBLE / n_pairs ELSE 0 END, 6) AS gap_ratio, round(n_short::DOUBLE / n_notes, 6) AS short_ratio,
  round(CASE WHEN n_pairs > 0 THEN n_jumps::DOUBLE / n_pairs ELSE 0 END, 6) AS jump_ratio FROM a""",
)
def a5_continuity(spark, sf):
    return A.continuity(T.notes(spark, sf), KEY, ORDER, 0.5, 0.35, 0.12, 12)


@REGISTRY.query(
    "w1_adjacent_deltas",
    f"""WITH {NOTES} SELECT sample_id, note_seq, round(start_sec - lag(end_sec) OVER w, 6) AS gap, pitch - lag(pitch) OVER w AS step,
  last_value(CASE WHEN voiced THEN pitch END IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_voiced_pitch
  FROM notes WINDOW w AS {BY}""",
)
def w1_adjacent_deltas(spark, sf):
    w = X.ordered(KEY, ORDER)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return T.notes(spark, sf).select("sample_id", "note_seq", r6(F.col("start_sec") - F.lag("end_sec").over(w)).alias("gap"), (F.col("pitch") - F.lag("pitch").over(w)).alias("step"), F.last(F.when(F.col("voiced"), F.col("pitch")), ignorenulls=True).over(before).alias("last_voiced_pitch"))


@REGISTRY.query(
    "w2_moving_median",
    f"""WITH {NOTES} SELECT sample_id, note_seq, quantile_cont(CASE WHEN voiced THEN pitch::DOUBLE END, 0.5) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median_pitch FROM notes""",
)
def w2_moving_median(spark, sf):
    n = T.notes(spark, sf).withColumn("p", F.when(F.col("voiced"), F.col("pitch").cast("double")))
    return n.select("sample_id", "note_seq", X.moving_median("p", KEY, ORDER, 2).alias("median_pitch"))


@REGISTRY.query(
    "w3_moving_mad",
    f"""WITH {NOTES}, f AS (SELECT sample_id, note_seq, list(pitch::DOUBLE) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM notes)
  SELECT sample_id, note_seq, list_median(list_transform(near, lambda v: abs(v - list_median(near)))) AS mad FROM f""",
)
def w3_moving_mad(spark, sf):
    n = T.notes(spark, sf).withColumn("p", F.col("pitch").cast("double"))
    return n.select("sample_id", "note_seq", X.moving_mad("p", KEY, ORDER, 3).alias("mad"))


@REGISTRY.query(
    "w4_local_tempo",
    f"""WITH {NOTES}, d AS (SELECT sample_id, note_seq, start_sec, lead(start_sec) OVER {BY} - start_sec AS step FROM notes),
  m AS (SELECT sample_id, note_seq, count(step) OVER f AS n, quantile_cont(step, 0.5) OVER f AS med FROM d WINDOW f AS (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  SELECT sample_id, note_seq, round(60.0 / med, 6) AS bpm FROM m WHERE n = 8 AND med > 0""",
)
def w4_local_tempo(spark, sf):
    n = T.notes(spark, sf).withColumn("step", F.lead("start_sec").over(X.ordered(KEY, ORDER)) - F.col("start_sec"))
    n = n.withColumn("med", X.rolling_median("step", KEY, ORDER, 8)).where("med > 0")
    return n.select("sample_id", "note_seq", r6(60.0 / F.col("med")).alias("bpm"))


@REGISTRY.query(
    "w5_frame_weights",
    f"""WITH {NOTES}, d AS (SELECT sample_id, note_seq, lead(start_sec) OVER (PARTITION BY sample_id ORDER BY start_sec) - start_sec AS step FROM notes)
  SELECT sample_id, note_seq, round(coalesce(step, median(step) OVER (PARTITION BY sample_id), 0), 6) AS weight FROM d""",
)
def w5_frame_weights(spark, sf):
    return X.frame_weights(T.notes(spark, sf), KEY, "start_sec").select("sample_id", "note_seq", r6("weight").alias("weight"))


@REGISTRY.query(
    "w6_phrase_smoothing",
    f"""WITH {NOTES}, g AS (SELECT *, coalesce(lead(start_sec) OVER {BY} - end_sec <= 0.5, TRUE) AS gap_ok FROM notes),
  m AS (SELECT *, quantile_cont(pitch::DOUBLE, 0.5) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med,
    bool_and(gap_ok) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS ok FROM g)
  SELECT sample_id, note_seq, CASE WHEN ok AND end_sec - start_sec <= 0.24 AND abs(med - pitch) <= 4 THEN med ELSE pitch::DOUBLE END AS smoothed FROM m""",
)
def w6_phrase_smoothing(spark, sf):
    return X.smooth_short(T.notes(spark, sf), KEY, ORDER, 0.24, 4, 0.5).select("sample_id", "note_seq", "smoothed")


@REGISTRY.query(
    "w7_sustain",
    f"""WITH {NOTES}, n AS (SELECT *, lead(start_sec) OVER w AS s2, lead(pitch) OVER w AS p2 FROM notes WINDOW w AS {BY})
  SELECT sample_id, note_seq, round(CASE WHEN s2 - end_sec > 0 AND s2 - end_sec <= 0.2 AND abs(p2 - pitch) <= 7 THEN s2 ELSE end_sec END, 6) AS sustained_end FROM n""",
)
def w7_sustain(spark, sf):
    return X.sustain(T.notes(spark, sf), KEY, ORDER, 0.2, 7).select("sample_id", "note_seq", r6("sustained_end").alias("sustained_end"))


@REGISTRY.query(
    "w8_turn_count",
    f"""WITH {NOTES}, d AS (SELECT sample_id, start_sec, note_seq, pitch - lag(pitch) OVER {BY} AS d FROM notes),
  s AS (SELECT sample_id, sign(d) <> lag(sign(d)) OVER {BY} AS c FROM d WHERE abs(d) > 3)
  SELECT sample_id, coalesce(t.turns, 0) AS turns FROM (SELECT DISTINCT sample_id FROM notes) LEFT JOIN (SELECT sample_id, count(*) FILTER (c) AS turns FROM s GROUP BY 1) t USING (sample_id)""",
)
def w8_turn_count(spark, sf):
    return X.turns(T.notes(spark, sf), KEY, ORDER, "pitch", 3.0)


@REGISTRY.query(
    "w9_rank_by_score",
    f"""WITH {NOTES}, s AS (SELECT sample_id, event_type, round(avg(confidence), 9) AS score FROM notes GROUP BY 1, 2)
  SELECT sample_id, event_type, round(score, 6) AS score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, event_type) AS rank, round(max(score) OVER (PARTITION BY sample_id) - score, 6) AS behind FROM s""",
)
def w9_rank_by_score(spark, sf):
    s = T.notes(spark, sf).groupBy("sample_id", "event_type").agg(F.round(F.avg("confidence"), 9).alias("score"))
    w = W.partitionBy("sample_id")
    return s.select("sample_id", "event_type", r6("score").alias("score"), F.row_number().over(w.orderBy(F.desc("score"), "event_type")).cast("long").alias("rank"), r6(F.max("score").over(w) - F.col("score")).alias("behind"))


@REGISTRY.query("w10_row_ids", f"""WITH {NOTES} SELECT sample_id, note_seq, format('qn_{{:05d}}', row_number() OVER {BY}) AS row_id FROM notes""")
def w10_row_ids(spark, sf):
    return X.row_ids(T.notes(spark, sf), KEY, ORDER, "qn").select("sample_id", "note_seq", "row_id")


@REGISTRY.query(
    "w11_order_violations",
    f"""WITH {NOTES}, m AS (SELECT sample_id, note_seq, pitch, max(pitch) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_before FROM notes)
  SELECT sample_id, note_seq, pitch, max_before FROM m WHERE pitch < max_before""",
)
def w11_order_violations(spark, sf):
    return X.running_max_violations(T.notes(spark, sf), KEY, ORDER, "pitch").select("sample_id", "note_seq", "pitch", "max_before")


@REGISTRY.query(
    "w12_double_and_half_grid",
    f"""WITH {NOTES}, p AS (SELECT sample_id, start_sec AS t FROM notes UNION ALL SELECT sample_id, (start_sec + lead(start_sec) OVER {BY}) / 2 FROM notes),
  k AS (SELECT sample_id, t, row_number() OVER (PARTITION BY sample_id ORDER BY t) - 1 AS idx FROM p WHERE t IS NOT NULL)
  SELECT sample_id, idx, round(t, 6) AS time_sec, idx % 2 = 0 AS in_half_grid FROM k""",
)
def w12_double_and_half_grid(spark, sf):
    w = W.partitionBy("sample_id").orderBy("start_sec")
    p = X.midpoints(T.notes(spark, sf), KEY, "start_sec").where("start_sec is not null")
    return p.select("sample_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), r6("start_sec").alias("time_sec")).withColumn("in_half_grid", F.col("idx") % 2 == 0)


@REGISTRY.query(
    "w13_pair_diagnostics",
    f"""WITH {NOTES}, n AS (SELECT *, lead(note_seq) OVER w AS next_seq, lead(start_sec) OVER w AS s2, lead(end_sec) OVER w AS e2, lead(pitch) OVER w AS p2 FROM notes WINDOW w AS {BY})
  SELECT sample_id, note_seq, next_seq, round(greatest(0, end_sec - s2), 6) AS overlap_sec, CASE WHEN end_sec > s2 THEN 'overlap' ELSE 'fragment' END AS kind
  FROM n WHERE end_sec > s2 OR (p2 = pitch AND s2 - end_sec <= 0.1 AND (end_sec - start_sec < 0.12 OR e2 - s2 < 0.12))""",
)
def w13_pair_diagnostics(spark, sf):
    n = X.with_next(T.notes(spark, sf), KEY, ORDER, next_seq="note_seq", s2="start_sec", e2="end_sec", p2="pitch")
    lap = F.col("end_sec") > F.col("s2")
    short = (F.col("end_sec") - F.col("start_sec") < 0.12) | (F.col("e2") - F.col("s2") < 0.12)
    n = n.where(lap | ((F.col("p2") == F.col("pitch")) & (F.col("s2") - F.col("end_sec") <= 0.1) & short))
    return n.select("sample_id", "note_seq", "next_seq", r6(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("s2"))).alias("overlap_sec"), F.when(lap, "overlap").otherwise("fragment").alias("kind"))


@REGISTRY.query(
    "w14_low_confidence_regions",
    f"""WITH {NOTES}, m AS (SELECT sample_id, CAST(floor(start_sec / 2) AS BIGINT) AS measure, avg(confidence) AS c FROM notes GROUP BY 1, 2),
  g AS (SELECT *, measure - row_number() OVER (PARTITION BY sample_id ORDER BY measure) AS run FROM m WHERE c < 0.45)
  SELECT sample_id, min(measure) AS first_measure, max(measure) AS last_measure, count(*) AS n_measures, round(avg(c), 6) AS confidence FROM g GROUP BY sample_id, run""",
)
def w14_low_confidence_regions(spark, sf):
    n = T.notes(spark, sf).withColumn("measure", F.floor(F.col("start_sec") / 2))
    m = A.means_in_order(n, ["sample_id", "measure"], ["note_seq"], {"c": F.col("confidence")}).where("c < 0.45")
    g = I.island_ids(m, KEY, ["measure"], F.col("measure") - F.lag("measure").over(W.partitionBy("sample_id").orderBy("measure")) > 1)
    g = A.means_in_order(g, ["sample_id", "island"], ["measure"], {"confidence": F.col("c")}, F.min("measure").alias("first_measure"), F.max("measure").alias("last_measure"), F.count(F.lit(1)).alias("n_measures"))
    return g.select("sample_id", "first_measure", "last_measure", "n_measures", S.round_scaled(F.col("confidence")).alias("confidence"))


@REGISTRY.query(
    "i1_voiced_runs",
    f"""WITH {NOTES}, v AS (SELECT *, coalesce(start_sec - lag(start_sec) OVER {BY} > 0.4, TRUE)::INT AS new FROM notes WHERE voiced),
  k AS (SELECT *, sum(new) OVER {BY} AS run FROM v)
  SELECT sample_id, CAST(run - 1 AS BIGINT) AS island, count(*) AS n_frames, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, median(pitch::DOUBLE) AS pitch_center, min(pitch) AS low, max(pitch) AS high,
    round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence FROM k GROUP BY 1, 2""",
)
def i1_voiced_runs(spark, sf):
    """Also the per-run aggregate of contours."""
    v = T.notes(spark, sf).where("voiced")
    k = I.island_ids(v, KEY, ORDER, F.col("start_sec") - F.lag("start_sec").over(X.ordered(KEY, ORDER)) > 0.4)
    return k.groupBy("sample_id", "island").agg(F.count(F.lit(1)).alias("n_frames"), r6(F.min("start_sec")).alias("start_sec"), r6(F.max("end_sec")).alias("end_sec"), F.median(F.col("pitch").cast("double")).alias("pitch_center"), F.min("pitch").alias("low"), F.max("pitch").alias("high"), r6(F.avg("confidence")).alias("mean_confidence"), F.max("confidence").alias("max_confidence"))


@REGISTRY.query(
    "i2_state_runs",
    f"""WITH {NOTES}, c AS (SELECT *, coalesce(state <> lag(state) OVER {BY}, FALSE)::INT AS new FROM notes), k AS (SELECT *, sum(new) OVER {BY} AS run FROM c)
  SELECT sample_id, CAST(run AS BIGINT) AS island, state, count(*) AS n, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, round(avg(voiced::INT), 6) AS voiced_ratio FROM k GROUP BY 1, 2, 3""",
)
def i2_state_runs(spark, sf):
    k = I.island_ids(T.notes(spark, sf), KEY, ORDER, F.col("state") != F.lag("state").over(X.ordered(KEY, ORDER)))
    return k.groupBy("sample_id", "island", "state").agg(F.count(F.lit(1)).alias("n"), r6(F.min("start_sec")).alias("start_sec"), r6(F.max("end_sec")).alias("end_sec"), r6(F.avg(F.col("voiced").cast("int"))).alias("voiced_ratio"))


@REGISTRY.query(
    "i3_fill_short_gaps",
    f"""WITH {NOTES}, c AS (SELECT *, coalesce(voiced <> lag(voiced) OVER {BY}, FALSE)::INT AS new FROM notes), k AS (SELECT *, sum(new) OVER {BY} AS run FROM c),
  z AS (SELECT *, count(*) OVER (PARTITION BY sample_id, run) AS len, max(run) OVER (PARTITION BY sample_id) AS last_run FROM k)
  SELECT sample_id, note_seq, voiced, voiced OR (run > 0 AND run < last_run AND len <= 2) AS filled FROM z""",
)
def i3_fill_short_gaps(spark, sf):
    k = I.island_ids(T.notes(spark, sf), KEY, ORDER, F.col("voiced") != F.lag("voiced").over(X.ordered(KEY, ORDER)))
    size, last = F.count(F.lit(1)).over(W.partitionBy("sample_id", "island")), F.max("island").over(W.partitionBy("sample_id"))
    return k.select("sample_id", "note_seq", "voiced", (F.col("voiced") | ((F.col("island") > 0) & (F.col("island") < last) & (size <= 2))).alias("filled"))


@REGISTRY.query(
    "i4_gap_or_jump_segments",
    f"""WITH {NOTES}, v AS (SELECT *, coalesce(start_sec - lag(start_sec) OVER {BY} > 0.6 OR abs(pitch - lag(pitch) OVER {BY}) > 20, FALSE)::INT AS new FROM notes WHERE voiced), k AS (SELECT *, sum(new) OVER {BY} AS run FROM v)
  SELECT sample_id, CAST(run AS BIGINT) AS island, count(*) AS n, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, median(pitch::DOUBLE) AS pitch FROM k GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def i4_gap_or_jump_segments(spark, sf):
    w = X.ordered(KEY, ORDER)
    v = T.notes(spark, sf).where("voiced")
    cut = (F.col("start_sec") - F.lag("start_sec").over(w) > 0.6) | (F.abs(F.col("pitch") - F.lag("pitch").over(w)) > 20)
    return I.island_ids(v, KEY, ORDER, cut).groupBy("sample_id", "island").agg(F.count(F.lit(1)).alias("n"), r6(F.min("start_sec")).alias("start_sec"), r6(F.max("end_sec")).alias("end_sec"), F.median(F.col("pitch").cast("double")).alias("pitch")).where("n >= 2")


MERGED = """x AS (SELECT sample_id, start_sec, end_sec, max(end_sec) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM notes)"""


@REGISTRY.query(
    "i7_merge_spans",
    f"""WITH {NOTES}, {MERGED}, k AS (SELECT *, sum((reach IS NULL OR start_sec > reach + 0.06)::INT) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS run FROM x)
  SELECT sample_id, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, count(*) AS n_merged FROM k GROUP BY sample_id, run""",
)
def i7_merge_spans(spark, sf):
    m = I.merge_spans(T.notes(spark, sf), KEY, gap=0.06, width=10.0)
    return m.select("sample_id", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "n_merged")


@REGISTRY.query(
    "i8_coverage",
    f"""WITH {NOTES}, {MERGED}, a AS (SELECT sample_id, max(end_sec) - min(start_sec) AS span, sum(greatest(0, end_sec - greatest(start_sec, coalesce(reach, start_sec)))) AS cov, max(greatest(0, start_sec - coalesce(reach, start_sec))) AS sil FROM x GROUP BY 1)
  SELECT sample_id, round(span, 6) AS span_sec, round(cov, 6) AS covered_sec, round(sil, 6) AS longest_silence_sec, round(cov / span, 6) AS coverage FROM a""",
)
def i8_coverage(spark, sf):
    c = I.coverage(T.notes(spark, sf), KEY, width=10.0)
    return c.select("sample_id", *(r6(x).alias(x) for x in ("span_sec", "covered_sec", "longest_silence_sec", "coverage")))


@REGISTRY.query("i10_gaps", f"""WITH {NOTES}, {MERGED} SELECT sample_id, round(reach, 6) AS gap_start, round(start_sec, 6) AS gap_end, round(start_sec - reach, 6) AS gap_sec FROM x WHERE start_sec - reach > 0.25""")
def i10_gaps(spark, sf):
    return I.gaps(T.notes(spark, sf), KEY, least=0.25, width=10.0).select("sample_id", r6("gap_start").alias("gap_start"), r6("gap_end").alias("gap_end"), r6("gap_sec").alias("gap_sec"))


@REGISTRY.query(
    "t5_longest_gaps",
    f"""WITH {NOTES}, {MERGED}, g AS (SELECT sample_id, reach AS gap_start, start_sec - reach AS gap_sec FROM x WHERE start_sec > reach),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY gap_sec DESC, gap_start) AS rank FROM g)
  SELECT sample_id, rank, round(gap_start, 6) AS gap_start, round(gap_sec, 6) AS gap_sec FROM r WHERE rank <= 12""",
)
def t5_longest_gaps(spark, sf):
    """A top-k report by sample."""
    w = W.partitionBy("sample_id").orderBy(F.desc("gap_sec"), "gap_start")
    g = I.gaps(T.notes(spark, sf), KEY, width=10.0).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 12")
    return g.select("sample_id", "rank", r6("gap_start").alias("gap_start"), r6("gap_sec").alias("gap_sec"))


@REGISTRY.query(
    "i9_skyline",
    f"""WITH {NOTES}, p AS (SELECT DISTINCT sample_id, unnest([start_sec, end_sec]) AS a FROM notes), s AS (SELECT sample_id, a, lead(a) OVER (PARTITION BY sample_id ORDER BY a) AS b FROM p),
  t AS (SELECT s.sample_id, a, b, max(pitch) AS pitch FROM s JOIN notes n ON n.sample_id = s.sample_id AND n.end_sec > a AND n.start_sec < b WHERE b IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, coalesce(pitch <> lag(pitch) OVER w OR a - lag(b) OVER w > 0.06, FALSE)::INT AS new FROM t WINDOW w AS (PARTITION BY sample_id ORDER BY a)),
  k AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY a) AS run FROM c)
  SELECT sample_id, pitch, round(min(a), 6) AS start_sec, round(max(b), 6) AS end_sec FROM k GROUP BY sample_id, run, pitch HAVING max(b) - min(a) >= 0.08""",
)
def i9_skyline(spark, sf):
    s = I.skyline(T.notes(spark, sf), KEY, "start_sec", "end_sec", "pitch", 1.0)
    return s.select("sample_id", "pitch", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"))


@REGISTRY.query(
    "i22_polyphony",
    f"""WITH {NOTES}, e AS (SELECT sample_id, start_sec AS t, 1 AS d FROM notes UNION ALL SELECT sample_id, end_sec, -1 FROM notes), s AS (SELECT sample_id, t, sum(d) AS d FROM e GROUP BY 1, 2),
  c AS (SELECT sample_id, sum(d) OVER (PARTITION BY sample_id ORDER BY t) AS active FROM s) SELECT sample_id, CAST(max(active) AS BIGINT) AS most_active FROM c GROUP BY 1""",
)
def i22_polyphony(spark, sf):
    return I.active_counts(T.notes(spark, sf), KEY).groupBy("sample_id").agg(F.max("active").alias("most_active"))


@REGISTRY.query(
    "i23_extend_to_midpoints",
    f"""WITH {NOTES}, n AS (SELECT *, start_sec - lag(end_sec) OVER w AS gb, lead(start_sec) OVER w - end_sec AS ga FROM notes WINDOW w AS {BY})
  SELECT sample_id, note_seq, round(start_sec - least(0.1, greatest(0, coalesce(gb, 0) / 2)), 6) AS start_sec, round(end_sec + least(0.1, greatest(0, coalesce(ga, 0) / 2)), 6) AS end_sec FROM n""",
)
def i23_extend_to_midpoints(spark, sf):
    w = X.ordered(KEY, ORDER)
    room = lambda gap: F.least(F.lit(0.1), F.greatest(F.lit(0.0), F.coalesce(gap, F.lit(0.0)) / 2))
    n = T.notes(spark, sf)
    return n.select("sample_id", "note_seq", r6(F.col("start_sec") - room(F.col("start_sec") - F.lag("end_sec").over(w))).alias("start_sec"), r6(F.col("end_sec") + room(F.lead("start_sec").over(w) - F.col("end_sec"))).alias("end_sec"))


@REGISTRY.query(
    "i24_measures",
    f"""WITH {NOTES}, {GRID}, d AS (SELECT sample_id, time_sec AS a, lead(time_sec) OVER (PARTITION BY sample_id ORDER BY time_sec) AS b FROM grid WHERE is_downbeat),
  m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY a) AS measure FROM d WHERE b IS NOT NULL)
  SELECT m.sample_id, measure, a AS start_sec, b AS end_sec, count(n.note_seq) AS n_notes, count(n.note_seq) = 0 AS empty FROM m LEFT JOIN notes n ON n.sample_id = m.sample_id AND n.start_sec >= a AND n.start_sec < b GROUP BY ALL""",
)
def i24_measures(spark, sf):
    """Measures from downbeats, and how many notes start in each."""
    n = T.notes(spark, sf)
    w = W.partitionBy("sample_id").orderBy("time_sec")
    m = T.grid(n).where("is_downbeat").select("sample_id", F.col("time_sec").alias("a"), F.lead("time_sec").over(w).alias("b"), F.row_number().over(w).cast("long").alias("measure")).where("b is not null")
    starts = n.select("sample_id", F.floor(F.col("start_sec") / 2).alias("slot")).groupBy("sample_id", "slot").agg(F.count(F.lit(1)).alias("n_notes"))
    out = m.join(starts, (m["sample_id"] == starts["sample_id"]) & (F.floor(m["a"] / 2) == starts["slot"]), "left")
    return out.select(m["sample_id"], "measure", F.col("a").alias("start_sec"), F.col("b").alias("end_sec"), F.coalesce("n_notes", F.lit(0)).alias("n_notes")).withColumn("empty", F.col("n_notes") == 0)


@REGISTRY.query(
    "j4_interval_join",
    f"""WITH {NOTES}, seg AS (SELECT sample_id, idx // 8 AS seg_id, min(time_sec) AS a, max(time_sec) + 0.5 AS b FROM (SELECT sample_id, idx, idx * 0.5::DOUBLE AS time_sec FROM (SELECT DISTINCT sample_id FROM notes), range(121) t(idx)) GROUP BY 1, 2)
  SELECT n.sample_id, note_seq, seg_id, round(least(end_sec, b) - greatest(start_sec, a), 6) AS overlap_sec FROM notes n JOIN seg s ON n.sample_id = s.sample_id AND end_sec > a AND start_sec < b""",
)
def j4_interval_join(spark, sf):
    """Notes by the four-second segments that they reach into; with the clipped overlap."""
    n = T.notes(spark, sf)
    seg = T.grid(n).groupBy("sample_id", F.floor(F.col("idx") / 8).alias("seg_id")).agg(F.min("time_sec").alias("a"), (F.max("time_sec") + 0.5).alias("b"))
    j = I.interval_join(n, seg, KEY, 4.0, "start_sec", "end_sec", "a", "b")
    return j.select("sample_id", "note_seq", "seg_id", r6(S.overlap(F.col("start_sec"), F.col("end_sec"), F.col("a"), F.col("b"))).alias("overlap_sec"))


@REGISTRY.query(
    "j5_overlap_with_tolerance",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED} SELECT e.sample_id, e.note_seq AS expected_seq, p.note_seq AS predicted_seq, round(least(e.end_sec, p.end_sec) - greatest(e.start_sec, p.start_sec), 6) AS overlap_sec
  FROM expected e JOIN predicted p ON e.sample_id = p.sample_id AND e.end_sec > p.start_sec AND e.start_sec < p.end_sec AND abs(e.pitch - p.pitch) <= 1 AND least(e.end_sec, p.end_sec) - greatest(e.start_sec, p.start_sec) >= 0.03""",
)
def j5_overlap_with_tolerance(spark, sf):
    n = T.notes(spark, sf)
    e = T.expected(n).select("sample_id", F.col("note_seq").alias("expected_seq"), F.col("start_sec").alias("s1"), F.col("end_sec").alias("e1"), F.col("pitch").alias("p1"))
    p = T.predicted(n).select("sample_id", F.col("note_seq").alias("predicted_seq"), F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2"), F.col("pitch").alias("p2"))
    lap = F.least("e1", "e2") - F.greatest("s1", "s2")
    j = I.interval_join(e, p, KEY, 0.5, "s1", "e1", "s2", "e2", (F.abs(F.col("p1") - F.col("p2")) <= 1) & (lap >= 0.03))
    return j.select("sample_id", "expected_seq", "predicted_seq", r6(lap).alias("overlap_sec"))


@REGISTRY.query(
    "j6_asof_measure",
    f"""WITH {NOTES}, {GRID}, d AS (SELECT sample_id, idx // 4 AS measure, time_sec FROM grid WHERE is_downbeat)
  SELECT n.sample_id, n.note_seq, CAST(d.measure AS BIGINT) AS measure, round(n.start_sec - d.time_sec, 6) AS into_measure FROM notes n ASOF LEFT JOIN d ON n.sample_id = d.sample_id AND n.start_sec >= d.time_sec""",
)
def j6_asof_measure(spark, sf):
    n = T.notes(spark, sf).select("sample_id", "note_seq", "start_sec")
    d = T.grid(n).where("is_downbeat").select("sample_id", F.floor(F.col("idx") / 4).alias("measure"), "time_sec")
    j = I.asof_join(n, d, KEY, "start_sec", "time_sec", ["measure", "time_sec"], width=10.0)
    return j.select("sample_id", "note_seq", "measure", r6(F.col("start_sec") - F.col("time_sec")).alias("into_measure"))


@REGISTRY.query(
    "j7_nearest_beat",
    f"""WITH {NOTES}, {GRID}, r AS (SELECT n.sample_id, note_seq, start_sec, idx, time_sec, row_number() OVER (PARTITION BY n.sample_id, note_seq ORDER BY abs(start_sec - time_sec), time_sec) AS k FROM notes n JOIN grid g ON n.sample_id = g.sample_id AND abs(start_sec - time_sec) <= 0.75)
  SELECT sample_id, note_seq, idx AS beat, round(start_sec - time_sec, 6) AS offset_sec FROM r WHERE k = 1""",
)
def j7_nearest_beat(spark, sf):
    """The nearest of the last beat before and the first after; the earlier of two equally near ones."""
    n = T.notes(spark, sf).select("sample_id", "note_seq", "start_sec")
    g = T.grid(n)
    b = I.asof_join(n, g.select("sample_id", F.col("idx").alias("i1"), F.col("time_sec").alias("t1")), KEY, "start_sec", "t1", ["i1", "t1"], width=10.0)
    b = I.asof_join(b, g.select("sample_id", F.col("idx").alias("i2"), F.col("time_sec").alias("t2")), KEY, "start_sec", "t2", ["i2", "t2"], forward=True, width=10.0)
    first = F.col("i2").isNull() | (F.col("start_sec") - F.col("t1") <= F.col("t2") - F.col("start_sec"))
    b = b.select("sample_id", "note_seq", F.when(first, F.col("i1")).otherwise(F.col("i2")).alias("beat"), r6(F.col("start_sec") - F.when(first, F.col("t1")).otherwise(F.col("t2"))).alias("offset_sec"))
    return b.where("beat is not null")


@REGISTRY.query(
    "j8_bounded_context",
    f"""WITH {NOTES}, v AS (SELECT sample_id, note_seq, start_sec, pitch FROM notes WHERE confidence >= 0.5), u AS (SELECT * FROM notes WHERE confidence < 0.5),
  l AS (SELECT u.sample_id, u.note_seq, v.pitch AS left_pitch, u.start_sec - v.start_sec AS d FROM u ASOF LEFT JOIN v ON u.sample_id = v.sample_id AND u.start_sec >= v.start_sec),
  r AS (SELECT u.sample_id, u.note_seq, v.pitch AS right_pitch, v.start_sec - u.start_sec AS d FROM u ASOF LEFT JOIN v ON u.sample_id = v.sample_id AND u.start_sec <= v.start_sec)
  SELECT sample_id, note_seq, CASE WHEN l.d <= 1 THEN left_pitch END AS left_pitch, CASE WHEN r.d <= 1 THEN right_pitch END AS right_pitch FROM l JOIN r USING (sample_id, note_seq)""",
)
def j8_bounded_context(spark, sf):
    n = T.notes(spark, sf)
    good = n.where("confidence >= 0.5")
    bad = n.where("confidence < 0.5").select("sample_id", "note_seq", "start_sec")
    j = I.asof_join(bad, good.select("sample_id", F.col("start_sec").alias("t1"), F.col("pitch").alias("p1")), KEY, "start_sec", "t1", ["t1", "p1"], width=10.0)
    j = I.asof_join(j, good.select("sample_id", F.col("start_sec").alias("t2"), F.col("pitch").alias("p2")), KEY, "start_sec", "t2", ["t2", "p2"], forward=True, width=10.0)
    return j.select("sample_id", "note_seq", F.when(F.col("start_sec") - F.col("t1") <= 1, F.col("p1")).alias("left_pitch"), F.when(F.col("t2") - F.col("start_sec") <= 1, F.col("p2")).alias("right_pitch"))


@REGISTRY.query(
    "j10_band_join",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED} SELECT e.sample_id, e.note_seq AS expected_seq, p.note_seq AS predicted_seq, round(p.start_sec - e.start_sec, 6) AS delta_sec FROM expected e JOIN predicted p ON e.sample_id = p.sample_id AND abs(e.start_sec - p.start_sec) <= 0.1""",
)
def j10_band_join(spark, sf):
    n = T.notes(spark, sf)
    e = T.expected(n).select("sample_id", F.col("note_seq").alias("expected_seq"), F.col("start_sec").alias("t1"))
    p = T.predicted(n).select("sample_id", F.col("note_seq").alias("predicted_seq"), F.col("start_sec").alias("t2"))
    return I.band_join(e, p, KEY, "t1", "t2", 0.1).select("sample_id", "expected_seq", "predicted_seq", r6(F.col("t2") - F.col("t1")).alias("delta_sec"))


@REGISTRY.query(
    "a32_shift_votes",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED}, v AS (SELECT e.sample_id, p.start_sec - e.start_sec AS shift FROM expected e JOIN predicted p ON e.sample_id = p.sample_id AND e.pitch = p.pitch AND abs(e.start_sec - p.start_sec) <= 2),
  h AS (SELECT sample_id, CAST(floor(shift / 0.05 + 0.5) AS BIGINT) AS bin, count(*) AS votes, round(avg(shift), 6) AS mean_shift FROM v GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, abs(bin), bin) AS rank FROM h)
  SELECT sample_id, bin, votes, mean_shift, rank FROM r WHERE rank <= 30""",
)
def a32_shift_votes(spark, sf):
    """A top-k report: the shifts that most pairs of equal pitch vote for."""
    n = T.notes(spark, sf)
    e = T.expected(n).select("sample_id", "pitch", F.col("start_sec").alias("t1"))
    p = T.predicted(n).select("sample_id", "pitch", F.col("start_sec").alias("t2"))
    v = I.band_join(e, p, ["sample_id", "pitch"], "t1", "t2", 2.0).withColumn("shift", F.col("t2") - F.col("t1"))
    h = v.groupBy("sample_id", F.floor(F.col("shift") / 0.05 + 0.5).alias("bin")).agg(F.count(F.lit(1)).alias("votes"), r6(F.avg("shift")).alias("mean_shift"))
    w = W.partitionBy("sample_id").orderBy(F.desc("votes"), F.abs("bin"), "bin")
    return h.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 30")


@REGISTRY.query(
    "j16_overlap_semi_join",
    f"""WITH {NOTES} SELECT sample_id, note_seq FROM notes s WHERE state = 'instrumental' AND NOT EXISTS (SELECT 1 FROM notes l WHERE l.state = 'vocal' AND l.sample_id = s.sample_id AND l.end_sec > s.start_sec AND l.start_sec < s.end_sec)""",
)
def j16_overlap_semi_join(spark, sf):
    """Support notes that overlap no lead note."""
    n = T.notes(spark, sf)
    lead = n.where("state = 'vocal'").select("sample_id", F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    support = n.where("state = 'instrumental'").select("sample_id", "note_seq", "start_sec", "end_sec")
    hit = I.interval_join(support, lead, KEY, 1.0, "start_sec", "end_sec", "a", "b").select("sample_id", "note_seq")
    return support.join(hit, ["sample_id", "note_seq"], "left_anti").select("sample_id", "note_seq")


@REGISTRY.query(
    "i26_beat_to_time",
    f"""WITH {NOTES}, {GRID}, s AS (SELECT sample_id, idx, time_sec AS t1, lead(time_sec) OVER (PARTITION BY sample_id ORDER BY idx) AS t2 FROM grid)
  SELECT n.sample_id, n.note_seq, round(s.idx + (n.start_sec - s.t1) / (s.t2 - s.t1), 6) AS beat FROM notes n ASOF JOIN s ON n.sample_id = s.sample_id AND n.start_sec >= s.t1 WHERE s.t2 IS NOT NULL""",
)
def i26_beat_to_time(spark, sf):
    n = T.notes(spark, sf).select("sample_id", "note_seq", "start_sec")
    g = T.grid(n).select("sample_id", "idx", F.col("time_sec").alias("t1"), F.lead("time_sec").over(W.partitionBy("sample_id").orderBy("idx")).alias("t2"))
    j = I.asof_join(n, g, KEY, "start_sec", "t1", ["idx", "t1", "t2"], width=10.0).where("t2 is not null")
    return j.select("sample_id", "note_seq", r6(F.col("idx") + (F.col("start_sec") - F.col("t1")) / (F.col("t2") - F.col("t1"))).alias("beat"))
