"""Queries composed of several operators: profiles, attributions, measure reports, tempo maps, pairing of starts and ends."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import folds as D
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import rules as R
from ..operators import windows as X
from . import fixtures as T
from .fixtures import EXPECTED, GRID, NOTES, PREDICTED
from .registry import REGISTRY

KEY, ORDER = ["sample_id"], ["start_sec", "note_seq"]
r6 = lambda c: F.round(c, 6)
dur = lambda: F.col("end_sec") - F.col("start_sec")
BY = "(PARTITION BY sample_id ORDER BY start_sec, note_seq)"


def _sides(spark, sf):
    """Expected and predicted notes in one pass over the events, told apart by `side`."""
    n = T.notes(spark, sf)
    shift = (F.col("note_seq") % 7 - 3) * F.lit(0.02)
    sides = S.labels((F.col("note_seq") % 3 != 0, "expected"), (F.col("note_seq") % 4 != 0, "predicted"))
    n = n.withColumn("side", F.explode(sides)).withColumn("by", F.when(F.col("side") == "predicted", shift).otherwise(0.0))
    return n.withColumns({"start_sec": F.col("start_sec") + F.col("by"), "end_sec": F.col("end_sec") + F.col("by")})


@REGISTRY.query(
    "c1_note_profile",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED}, u AS (SELECT 'expected' AS side, * FROM expected UNION ALL SELECT 'predicted', * FROM predicted)
  SELECT sample_id, side, count(*) AS n, round(max(end_sec) - min(start_sec), 6) AS span_sec, round(count(*) / (max(end_sec) - min(start_sec)), 6) AS density, round(median(end_sec - start_sec), 6) AS median_sec, round(avg((end_sec - start_sec < 0.12)::INT), 6) AS short_ratio, min(pitch) AS low, max(pitch) AS high FROM u GROUP BY 1, 2""",
)
def c1_note_profile(spark, sf):
    span = F.max("end_sec") - F.min("start_sec")
    return _sides(spark, sf).groupBy("sample_id", "side").agg(F.count(F.lit(1)).alias("n"), r6(span).alias("span_sec"), r6(F.count(F.lit(1)) / span).alias("density"), r6(F.median(dur())).alias("median_sec"), r6(F.avg((dur() < 0.12).cast("int"))).alias("short_ratio"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))


@REGISTRY.query("c2_frame_profile", f"WITH {NOTES}, d AS (SELECT *, lead(start_sec) OVER {BY} - start_sec AS hop FROM notes) SELECT sample_id, count(*) AS n_frames, round(avg(voiced::INT), 6) AS voiced_ratio, round(median(confidence), 6) AS median_confidence, round(count(*) FILTER (voiced) * median(hop), 6) AS voiced_sec FROM d GROUP BY 1")
def c2_frame_profile(spark, sf):
    d = T.notes(spark, sf).withColumn("hop", F.lead("start_sec").over(X.ordered(KEY, ORDER)) - F.col("start_sec"))
    return d.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_frames"), r6(F.avg(F.col("voiced").cast("int"))).alias("voiced_ratio"), r6(F.median("confidence")).alias("median_confidence"), r6(F.count_if("voiced") * F.median("hop")).alias("voiced_sec"))


@REGISTRY.query("c3_activity_profile", f"WITH {NOTES}, c AS (SELECT *, (state IS DISTINCT FROM lag(state) OVER {BY})::INT AS new FROM notes) SELECT sample_id, CAST(sum(new) AS BIGINT) AS n_segments, round(sum(CASE WHEN state = 'vocal' THEN end_sec - start_sec ELSE 0 END) / (max(end_sec) - min(start_sec)), 6) AS active_ratio FROM c GROUP BY 1")
def c3_activity_profile(spark, sf):
    c = T.notes(spark, sf).withColumn("new", (~F.col("state").eqNullSafe(F.lag("state").over(X.ordered(KEY, ORDER)))).cast("int"))
    return c.groupBy("sample_id").agg(F.sum("new").alias("n_segments"), r6(F.sum(F.when(F.col("state") == "vocal", dur()).otherwise(0.0)) / (F.max("end_sec") - F.min("start_sec"))).alias("active_ratio"))


@REGISTRY.query(
    "c8_layer_attribution",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED}, c AS (SELECT e.sample_id, e.note_seq, count(p.note_seq) AS n_near, count(p.note_seq) FILTER (p.pitch = e.pitch) AS n_same, count(p.note_seq) FILTER (p.pitch <> e.pitch AND (p.pitch - e.pitch) % 12 = 0) AS n_octave
    FROM expected e LEFT JOIN predicted p ON p.sample_id = e.sample_id AND p.end_sec > e.start_sec AND p.start_sec < e.end_sec GROUP BY 1, 2)
  SELECT *, CASE WHEN n_same > 0 THEN 'found' WHEN n_octave > 0 THEN 'octave' WHEN n_near > 0 THEN 'other_pitch' ELSE 'missing' END AS stage FROM c""",
)
def c8_layer_attribution(spark, sf):
    """What became of each expected note: what overlaps it in the other layer, by a cascade."""
    n = T.notes(spark, sf)
    e = T.expected(n).select("sample_id", "note_seq", F.col("start_sec").alias("s1"), F.col("end_sec").alias("e1"), F.col("pitch").alias("p1"))
    p = T.predicted(n).select("sample_id", F.col("start_sec").alias("s2"), F.col("end_sec").alias("e2"), F.col("pitch").alias("p2"))
    same, octave = F.col("p1") == F.col("p2"), (F.col("p1") != F.col("p2")) & ((F.col("p1") - F.col("p2")) % 12 == 0)
    met = I.interval_join(e, p, KEY, 0.5, "s1", "e1", "s2", "e2").groupBy("sample_id", "note_seq").agg(F.count(F.lit(1)).alias("n_near"), F.count_if(same).alias("n_same"), F.count_if(octave).alias("n_octave"))
    out = e.select("sample_id", "note_seq").join(met, ["sample_id", "note_seq"], "left").fillna(0)
    return out.withColumn("stage", S.first_label((F.col("n_same") > 0, "found"), (F.col("n_octave") > 0, "octave"), (F.col("n_near") > 0, "other_pitch"), otherwise="missing"))


@REGISTRY.query("c15_recommended_focus", f"WITH {NOTES}, r AS (SELECT sample_id, unnest(list_filter([CASE WHEN NOT voiced THEN 'unvoiced' END, CASE WHEN confidence < 0.3 THEN 'weak' END, CASE WHEN end_sec - start_sec < 0.1 THEN 'short' END], lambda x: x IS NOT NULL)) AS reason FROM notes), c AS (SELECT sample_id, reason, count(*) AS n FROM r GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, reason) AS k FROM c) SELECT sample_id, reason, n, CASE reason WHEN 'short' THEN 'segmentation' WHEN 'weak' THEN 'detection' ELSE 'activity' END AS focus FROM o WHERE k = 1")
def c15_recommended_focus(spark, sf):
    """The most frequent reason of each sample, by an aggregate, and what to look at (C14)."""
    n = R.with_reasons(T.notes(spark, sf), [(~F.col("voiced"), "unvoiced"), (F.col("confidence") < 0.3, "weak"), (dur() < 0.1, "short")])
    c = A.reason_counts(n, KEY, "reasons")
    best = c.groupBy("sample_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "reason")).alias("b")).select("sample_id", F.col("b.reason").alias("reason"), (-F.col("b.m")).alias("n"))
    return best.withColumn("focus", S.first_label((F.col("reason") == "short", "segmentation"), (F.col("reason") == "weak", "detection"), otherwise="activity"))


@REGISTRY.query("c22_issue_detection", f"WITH {NOTES}, d AS (SELECT *, abs(lead(pitch) OVER {BY} - pitch) AS step FROM notes), m AS (SELECT sample_id, avg((end_sec - start_sec < 0.12)::INT) AS s, avg((confidence < 0.4)::INT) AS w, avg((step > 12)::INT) AS l FROM d GROUP BY 1), i AS (SELECT sample_id, unnest(list_filter([CASE WHEN s > 0.2 THEN 'short_notes' END, CASE WHEN w > 0.4 THEN 'low_confidence' END, CASE WHEN l > 0.5 THEN 'leaps' END], lambda x: x IS NOT NULL)) AS issue, round(s, 6) AS short_ratio, round(w, 6) AS weak_ratio, round(l, 6) AS leap_ratio FROM m) SELECT * FROM i")
def c22_issue_detection(spark, sf):
    d = T.notes(spark, sf).withColumn("step", F.abs(F.lead("pitch").over(X.ordered(KEY, ORDER)) - F.col("pitch")))
    share = lambda c: F.avg(c.cast("int"))
    m = d.groupBy("sample_id").agg(share(dur() < 0.12).alias("s"), share(F.col("confidence") < 0.4).alias("w"), share(F.col("step") > 12).alias("l"))
    issue = F.explode(S.labels((F.col("s") > 0.2, "short_notes"), (F.col("w") > 0.4, "low_confidence"), (F.col("l") > 0.5, "leaps")))
    return m.select("sample_id", issue.alias("issue"), r6("s").alias("short_ratio"), r6("w").alias("weak_ratio"), r6("l").alias("leap_ratio"))


@REGISTRY.query("c25_measure_issues", f"WITH {NOTES}, m AS (SELECT sample_id, CAST(floor(start_sec / 2) AS BIGINT) AS measure, count(*) AS n, count(*) FILTER (end_sec - start_sec < 0.12) AS n_short, avg(confidence) AS c FROM notes GROUP BY 1, 2) SELECT sample_id, measure, n, n >= 5 AND n_short >= 2 AS dense_short, c < 0.4 AS weak FROM m WHERE (n >= 5 AND n_short >= 2) OR c < 0.4")
def c25_measure_issues(spark, sf):
    """Measures of two seconds, located by arithmetic (C60), with many short notes or little confidence."""
    n = T.notes(spark, sf).withColumn("measure", F.floor(F.col("start_sec") / 2))
    m = A.means_in_order(n, ["sample_id", "measure"], ["note_seq"], {"c": F.col("confidence")}, F.count(F.lit(1)).alias("n"), F.count_if(dur() < 0.12).alias("k"))
    return m.select("sample_id", "measure", "n", ((F.col("n") >= 5) & (F.col("k") >= 2)).alias("dense_short"), (F.col("c") < 0.4).alias("weak")).where("dense_short or weak")


@REGISTRY.query("c28_notes_in_measures", f"WITH {NOTES} SELECT sample_id, CAST(floor(start_sec / 2) AS BIGINT) AS measure, string_agg(CAST(note_seq AS VARCHAR), ' ' ORDER BY start_sec, note_seq) AS note_ids, string_agg(CAST(pitch AS VARCHAR), ' ' ORDER BY start_sec, note_seq) AS pitches FROM notes GROUP BY 1, 2")
def c28_notes_in_measures(spark, sf):
    """Notes nested in their measures, in order."""
    m = T.notes(spark, sf).groupBy("sample_id", F.floor(F.col("start_sec") / 2).alias("measure")).agg(F.array_sort(F.collect_list(F.struct("start_sec", "note_seq", "pitch"))).alias("x"))
    text = lambda c: F.array_join(F.transform("x", lambda x: x[c].cast("string")), " ")
    return m.select("sample_id", "measure", text("note_seq").alias("note_ids"), text("pitch").alias("pitches"))


@REGISTRY.query("c37_octave_support", f"WITH {NOTES}, {PREDICTED} SELECT sample_id, note_seq FROM predicted p WHERE EXISTS (SELECT 1 FROM notes n WHERE n.sample_id = p.sample_id AND n.pitch = p.pitch - 12 AND abs(n.start_sec - p.start_sec) <= 1)")
def c37_octave_support(spark, sf):
    """Predicted notes with a note an octave below near them: a band semi-join."""
    n = T.notes(spark, sf)
    p = T.predicted(n).select("sample_id", "note_seq", (F.col("pitch") - 12).alias("pitch"), F.col("start_sec").alias("t1"))
    below = n.select("sample_id", "pitch", F.col("start_sec").alias("t2"))
    return I.band_join(p, below, ["sample_id", "pitch"], "t1", "t2", 1.0).select("sample_id", "note_seq").distinct()


@REGISTRY.query("a21_chord_summary", f"WITH {NOTES}, p AS (SELECT sample_id, CAST(floor(start_sec / 2) AS BIGINT) AS measure, pitch % 12 AS pc, sum((end_sec - start_sec) * confidence) AS w FROM notes GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, measure ORDER BY round(w, 9) DESC, pc) AS k FROM p), q AS (SELECT r.sample_id, r.measure, r.pc AS root, bool_or((p.pc - r.pc + 12) % 12 = 4) AS major, bool_or((p.pc - r.pc + 12) % 12 = 3) AS minor FROM r JOIN p ON r.sample_id = p.sample_id AND r.measure = p.measure WHERE k = 1 GROUP BY 1, 2, 3) SELECT sample_id, measure, root, CASE WHEN major THEN 'major' WHEN minor THEN 'minor' ELSE 'open' END AS quality FROM q")
def a21_chord_summary(spark, sf):
    p = T.notes(spark, sf).groupBy("sample_id", F.floor(F.col("start_sec") / 2).alias("measure"), S.pitch_class(F.col("pitch")).alias("pc")).agg(F.sum(dur() * F.col("confidence")).alias("w"))
    m = p.groupBy("sample_id", "measure").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("pc")).alias("p"))).alias("b"), F.collect_set("pc").alias("pcs")).withColumn("root", -F.col("b.p"))
    has = lambda k: F.array_contains("pcs", F.pmod(F.col("root") + k, F.lit(12)))
    return m.select("sample_id", "measure", "root", S.first_label((has(4), "major"), (has(3), "minor"), otherwise="open").alias("quality"))


@REGISTRY.query("a30_bar_phase", f"WITH {NOTES}, {GRID}, d AS (SELECT n.sample_id, g.idx % 4 AS phase, n.velocity FROM notes n ASOF JOIN grid g ON n.sample_id = g.sample_id AND n.start_sec >= g.time_sec) SELECT sample_id, round(avg((phase = 0)::INT), 6) AS on_first, round(avg(velocity) FILTER (phase = 0), 6) AS first_strength FROM d GROUP BY 1")
def a30_bar_phase(spark, sf):
    n = T.notes(spark, sf).select("sample_id", "start_sec", "velocity")
    d = I.asof_join(n, T.grid(n), KEY, "start_sec", "time_sec", ["idx"]).where("idx is not null")
    first = F.col("idx") % 4 == 0
    return d.groupBy("sample_id").agg(r6(F.avg(first.cast("int"))).alias("on_first"), r6(F.avg(F.when(first, F.col("velocity")))).alias("first_strength"))


@REGISTRY.query("a36_confidence_composite", f"WITH {NOTES}, m AS (SELECT sample_id, count(*) AS n, avg(confidence) AS c, avg(voiced::INT) AS v FROM notes GROUP BY 1) SELECT sample_id, round(least(1, greatest(0, 0.2 + 0.41 * c + 0.3 * v + 0.1 * least(1, n / 80))), 6) AS confidence, round(least(1, greatest(0, (c - 0.3) / (0.7::DOUBLE - 0.3::DOUBLE))), 6) AS ramp FROM m")
def a36_confidence_composite(spark, sf):
    m = T.notes(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("voiced").cast("int")).alias("v"))
    whole = S.clamp(0.2 + 0.41 * F.col("c") + 0.3 * F.col("v") + 0.1 * F.least(F.lit(1.0), F.col("n") / 80))
    return m.select("sample_id", r6(whole).alias("confidence"), r6(S.ramp(F.col("c"), 0.3, 0.7)).alias("ramp"))


@REGISTRY.query("a33_keep_ratio", f"WITH {NOTES} SELECT sample_id, count(*) AS n_in, count(*) FILTER (pitch BETWEEN 52 AND 76 AND end_sec - start_sec >= 0.12) AS n_kept, round(count(*) FILTER (pitch BETWEEN 52 AND 76 AND end_sec - start_sec >= 0.12) / count(*), 6) AS keep_ratio, min(confidence) AS min_confidence, round(avg(confidence), 6) AS mean_confidence, max(confidence) AS max_confidence FROM notes GROUP BY 1")
def a33_keep_ratio(spark, sf):
    """With minimum, mean and maximum."""
    kept = F.count_if(F.col("pitch").between(52, 76) & (dur() >= 0.12))
    return T.notes(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_in"), kept.alias("n_kept"), r6(kept / F.count(F.lit(1))).alias("keep_ratio"), F.min("confidence").alias("min_confidence"), r6(F.avg("confidence")).alias("mean_confidence"), F.max("confidence").alias("max_confidence"))


_KEPT = {"candidate": "note_seq % 5 > 0", "selector": "note_seq % 5 > 0 AND confidence >= 0.3", "quantizer": "note_seq % 5 > 0 AND confidence >= 0.3 AND note_seq % 9 > 0"}
_SEEN = "EXISTS (SELECT 1 FROM notes q WHERE q.sample_id = e.sample_id AND q.pitch = e.pitch AND abs(q.start_sec - e.start_sec) <= 0.1 AND ({0}) AND (q.end_sec - q.start_sec <= 0.25::DOUBLE * 1.5::DOUBLE OR greatest(0, least(e.end_sec, q.end_sec) - greatest(e.start_sec, q.start_sec)) / nullif(greatest(e.end_sec, q.end_sec) - least(e.start_sec, q.start_sec), 0) >= 0.35))"


@REGISTRY.query(
    "a35_short_note_recall",
    f"""WITH RECURSIVE {NOTES}, {EXPECTED}, {PREDICTED}, es AS (SELECT * FROM expected WHERE end_sec - start_sec < 0.25), ps AS (SELECT * FROM predicted WHERE end_sec - start_sec < 0.25),
  o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pitch ORDER BY start_sec, note_seq) AS k FROM es),
  s AS (SELECT DISTINCT sample_id, pitch, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS p, CAST([] AS BIGINT[]) AS used FROM es UNION ALL
    SELECT sample_id, pitch, k, e, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT s.sample_id, s.pitch, o.k, o.note_seq AS e, any_value(s.used) AS used, arg_min(q.note_seq, {{'d': abs(q.start_sec - o.start_sec), 't': q.start_sec, 'n': q.note_seq}}) AS p
      FROM s JOIN o ON o.sample_id = s.sample_id AND o.pitch = s.pitch AND o.k = s.k + 1 LEFT JOIN ps q ON q.sample_id = s.sample_id AND q.pitch = s.pitch AND abs(q.start_sec - o.start_sec) <= 0.08 AND NOT list_contains(s.used, q.note_seq) GROUP BY 1, 2, 3, 4)),
  stage AS (SELECT e.sample_id, CASE WHEN m.p IS NOT NULL THEN 'matched' WHEN NOT {_SEEN.format(_KEPT["candidate"])} THEN 'candidate' WHEN NOT {_SEEN.format(_KEPT["selector"])} THEN 'selector' WHEN NOT {_SEEN.format(_KEPT["quantizer"])} THEN 'quantizer' ELSE 'export' END AS stage
    FROM es e LEFT JOIN s m ON m.sample_id = e.sample_id AND m.e = e.note_seq)
  SELECT g.sample_id, n_expected, coalesce(n, 0) AS n_predicted, n_matched, n_expected - n_matched AS n_missed, coalesce(n, 0) - n_matched AS n_false, round(n_matched / n_expected, 6) AS recall, round(coalesce(n_matched / n, 0), 6) AS precision, at_candidate, at_selector, at_quantizer, at_export
  FROM (SELECT sample_id, count(*) AS n_expected, count(*) FILTER (stage = 'matched') AS n_matched, count(*) FILTER (stage = 'candidate') AS at_candidate, count(*) FILTER (stage = 'selector') AS at_selector, count(*) FILTER (stage = 'quantizer') AS at_quantizer, count(*) FILTER (stage = 'export') AS at_export FROM stage GROUP BY 1) g
  LEFT JOIN (SELECT sample_id, count(*) AS n FROM ps GROUP BY 1) p USING (sample_id)""",
)
def a35_short_note_recall(spark, sf):
    """Short notes matched one to one (J13), and for each missed one the first stage that does not have it."""
    n = T.notes(spark, sf)
    e, p = T.expected(n).where(dur() < 0.25), T.predicted(n).where(dur() < 0.25)
    found = D.match_each_left(e, p, "sample_id", 0.08).select("sample_id", F.col("left_seq").alias("note_seq"), F.lit(True).alias("matched"))
    rows = e.select("sample_id", "pitch", "note_seq", F.col("start_sec").alias("e_start_sec"), F.col("end_sec").alias("e_end_sec"))
    of = n.select("sample_id", "pitch", F.col("start_sec").alias("q_start_sec"), F.col("end_sec").alias("q_end_sec"), *(F.expr(c).alias(f"in_{s}") for s, c in _KEPT.items()))
    near = I.band_join(rows, of, ["sample_id", "pitch"], "e_start_sec", "q_start_sec", 0.1).where((F.col("q_end_sec") - F.col("q_start_sec") <= 0.25 * 1.5) | (M.duration_iou("e", "q") >= 0.35))
    seen = near.groupBy("sample_id", "note_seq").agg(*(F.bool_or(f"in_{s}").alias(s) for s in _KEPT))
    missing = lambda s: ~F.coalesce(s, F.lit(False))
    stage = F.when(F.col("matched"), "matched").when(missing("candidate"), "candidate").when(missing("selector"), "selector").when(missing("quantizer"), "quantizer").otherwise("export")
    staged = rows.join(found, ["sample_id", "note_seq"], "left").join(seen, ["sample_id", "note_seq"], "left").withColumn("stage", stage)
    at = lambda s: F.count_if(F.col("stage") == s)
    g = staged.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_expected"), at("matched").alias("n_matched"), *(at(s).alias(f"at_{s}") for s in (*_KEPT, "export")))
    g = g.join(p.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_predicted")), "sample_id", "left").fillna(0, ["n_predicted"])
    hits = F.col("n_matched")
    return g.select("sample_id", "n_expected", "n_predicted", "n_matched", (F.col("n_expected") - hits).alias("n_missed"), (F.col("n_predicted") - hits).alias("n_false"), r6(hits / F.col("n_expected")).alias("recall"), r6(F.coalesce(F.try_divide(hits, F.col("n_predicted")), F.lit(0.0))).alias("precision"), *(f"at_{s}" for s in (*_KEPT, "export")))


@REGISTRY.query("i6_predicate_spans", f"WITH {NOTES}, c AS (SELECT *, (confidence < 0.5) AS p, coalesce((confidence < 0.5) <> lag(confidence < 0.5) OVER {BY}, FALSE)::INT AS new FROM notes), k AS (SELECT *, sum(new) OVER {BY} AS run FROM c) SELECT sample_id, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, count(*) AS n FROM k WHERE p GROUP BY sample_id, run HAVING max(end_sec) - min(start_sec) >= 0.5")
def i6_predicate_spans(spark, sf):
    """Runs of rows for which any given condition holds, of some least length."""
    weak = F.col("confidence") < 0.5
    k = I.island_ids(T.notes(spark, sf).withColumn("p", weak), KEY, ORDER, F.col("p") != F.lag("p").over(X.ordered(KEY, ORDER)))
    s = k.where("p").groupBy("sample_id", "island").agg(F.min("start_sec").alias("a"), F.max("end_sec").alias("b"), F.count(F.lit(1)).alias("n")).where("b - a >= 0.5")
    return s.select("sample_id", r6("a").alias("start_sec"), r6("b").alias("end_sec"), "n")


@REGISTRY.query("i27_uncertain_regions", f"WITH {NOTES}, n AS (SELECT *, abs(lead(pitch) OVER {BY} - pitch) AS step FROM notes) SELECT sample_id, note_seq, round(start_sec, 6) AS start_sec, unnest(list_filter([CASE WHEN confidence < 0.1 THEN 'confidence' END, CASE WHEN NOT voiced AND end_sec - start_sec > 0.3 THEN 'unvoiced' END, CASE WHEN step > 40 THEN 'leap' END], lambda x: x IS NOT NULL)) AS kind FROM n")
def i27_uncertain_regions(spark, sf):
    """Rows that any of several tests marks, one for each test, in a single pass instead of a union."""
    n = T.notes(spark, sf).withColumn("step", F.abs(F.lead("pitch").over(X.ordered(KEY, ORDER)) - F.col("pitch")))
    kinds = S.labels((F.col("confidence") < 0.1, "confidence"), (~F.col("voiced") & (dur() > 0.3), "unvoiced"), (F.col("step") > 40, "leap"))
    return n.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), F.explode(kinds).alias("kind"))


@REGISTRY.query(
    "j9_gap_choice",
    f"""WITH {NOTES}, v AS (SELECT * FROM notes WHERE voiced), x AS (SELECT sample_id, start_sec, max(end_sec) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
  g AS (SELECT sample_id, reach AS a, start_sec AS b FROM x WHERE start_sec > reach), u AS (SELECT sample_id, note_seq, (start_sec + end_sec) / 2 AS mid, start_sec, end_sec FROM notes WHERE NOT voiced),
  r AS (SELECT u.sample_id, note_seq, a, row_number() OVER (PARTITION BY u.sample_id, note_seq ORDER BY NOT (mid >= a AND mid < b), abs(mid - (a + b) / 2), a) AS k FROM u JOIN g ON u.sample_id = g.sample_id AND end_sec > a AND start_sec < b)
  SELECT sample_id, note_seq, round(a, 6) AS gap_start FROM r WHERE k = 1""",
)
def j9_gap_choice(spark, sf):
    """For each unvoiced note the gap between voiced ones that holds its middle, else the one with the nearest middle."""
    n = T.notes(spark, sf)
    g = I.gaps(n.where("voiced"), KEY).select("sample_id", F.col("gap_start").alias("a"), F.col("gap_end").alias("b"))
    u = n.where("not voiced").select("sample_id", "note_seq", "start_sec", "end_sec", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"))
    j = I.interval_join(u, g, KEY, 1.0, "start_sec", "end_sec", "a", "b")
    inside = (F.col("mid") >= F.col("a")) & (F.col("mid") < F.col("b"))
    best = F.min(F.struct((~inside).alias("o"), F.abs(F.col("mid") - (F.col("a") + F.col("b")) / 2).alias("d"), "a"))
    return j.groupBy("sample_id", "note_seq").agg(best.alias("m")).select("sample_id", "note_seq", r6("m.a").alias("gap_start"))


@REGISTRY.query(
    "s6_on_off_pairing",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(props->>'k' AS INT) % 4 AS channel, CAST(props->>'k' AS INT) // 4 % 2 AS note, event_id, epoch_us(ts) AS t, event_type IN ('view', 'click') AS s FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, channel, note ORDER BY t, event_id) AS k FROM e),
  q AS (SELECT DISTINCT user_id, channel, note, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, t BIGINT)[]) AS held, CAST(NULL AS STRUCT(id BIGINT, t BIGINT)) AS first, CAST(NULL AS BIGINT) AS off_id, CAST(NULL AS BIGINT) AS t2 FROM e UNION ALL
    SELECT o.user_id, o.channel, o.note, o.k, CASE WHEN o.s THEN list_append(held, {'id': o.event_id, 't': o.t}) ELSE held[2:] END, CASE WHEN o.s THEN NULL ELSE held[1] END, o.event_id, o.t FROM q JOIN o ON o.user_id = q.user_id AND o.channel = q.channel AND o.note = q.note AND o.k = q.k + 1)
  SELECT user_id, channel, note, first.id AS on_id, off_id, round((t2 - first.t) / 1000000.0::DOUBLE, 3) AS seconds FROM q WHERE first IS NOT NULL AND t2 > first.t""",
)
def s6_on_off_pairing(spark, sf):
    """Each end with the oldest open start of its channel and note: ordinals, once ends with nothing open are gone."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = T.table(spark, sf, "events").select("user_id", (k % 4).alias("channel"), F.floor(k / 4 % 2).cast("int").alias("note"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").isin("view", "click").alias("on"))
    e = M.pair_starts_with_ends(e, ["user_id", "channel", "note"], ["t", "event_id"])
    pick = lambda c, on: F.max(F.when(F.col("on") == F.lit(on), F.col(c)))
    p = e.groupBy("user_id", "channel", "note", "k").agg(pick("event_id", True).alias("on_id"), pick("event_id", False).alias("off_id"), pick("t", True).alias("t1"), pick("t", False).alias("t2")).where("t2 > t1")
    return p.select("user_id", "channel", "note", "on_id", "off_id", F.round((F.col("t2") - F.col("t1")) / 1000000.0, 3).alias("seconds"))


@REGISTRY.query(
    "c66_rhythm_diagnosis",
    f"""WITH {NOTES}, m AS (SELECT sample_id, avg(confidence) AS tempo, avg(CASE WHEN note_seq % 4 = 0 THEN confidence END) AS down, avg(CASE WHEN note_seq % 3 = 0 THEN confidence END) AS bar, avg((abs(start_sec / 0.5 - round_even(start_sec / 0.5, 0)) * 0.5 > 0.15)::INT) AS off, least(1, min(start_sec) / 2) AS pickup, avg(voiced::INT) AS rubato FROM notes GROUP BY 1),
  i AS (SELECT *, list_filter([CASE WHEN tempo < 0.65 THEN 'possible_tempo_instability' END, CASE WHEN down < 0.35 THEN 'possible_downbeat_uncertainty' END, CASE WHEN bar < 0.45 THEN 'possible_bar_phase_error' END, CASE WHEN off > 0.35 THEN 'possible_off_grid_quantization' END, CASE WHEN pickup >= 0.7 THEN 'possible_pickup_or_leading_silence' END, CASE WHEN rubato >= 0.7 AND NOT coalesce(tempo < 0.65, FALSE) THEN 'possible_tempo_instability' END], lambda x: x IS NOT NULL) AS issues FROM m),
  d AS (SELECT *, CASE WHEN len(issues) > 1 THEN 'mixed_rhythm_issue' WHEN len(issues) = 1 THEN issues[1] ELSE 'stable_grid' END AS diagnosis FROM i)
  SELECT sample_id, diagnosis, array_to_string(list_sort(list_distinct(CASE WHEN diagnosis = 'stable_grid' THEN issues ELSE list_append(issues, diagnosis) END)), ',') AS flags FROM d""",
)
def c66_rhythm_diagnosis(spark, sf):
    """The diagnosis and flags of each sample from six measures of its rhythm."""
    n, conf = T.notes(spark, sf), F.col("confidence")
    off = F.abs(F.col("start_sec") - S.snap(F.col("start_sec"), 0.5)) > 0.15
    means = {"tempo": conf, "down": F.when(F.col("note_seq") % 4 == 0, conf), "bar": F.when(F.col("note_seq") % 3 == 0, conf)}
    m = A.means_in_order(n, KEY, ["note_seq"], means, F.avg(off.cast("int")).alias("off"), F.least(F.lit(1.0), F.min("start_sec") / 2).alias("pickup"), F.avg(F.col("voiced").cast("int")).alias("rubato"))
    diagnosis, flags = R.rhythm_issues(*map(F.col, ("tempo", "down", "bar", "off", "pickup", "rubato")))
    return m.select("sample_id", diagnosis.alias("diagnosis"), F.array_join(flags, ",").alias("flags"))


#: The edits that each reason suggests.
PATCHES = {
    "octave_outlier": ["shift_octave", "replace_pitch"],
    "large_quantize_error": ["move_note_to_grid", "adjust_duration"],
    "possible_fragmentation": ["merge_notes", "delete_note"],
    "possible_overmerge": ["split_note", "adjust_duration"],
    "low_confidence": ["mark_uncertain", "replace_pitch"],
}
_PATCH_ROWS = ", ".join(f"('{reason}', {k}, '{patch}')" for reason, patches in PATCHES.items() for k, patch in enumerate(patches))


@REGISTRY.query(
    "c68_uncertain_notes",
    f"""WITH {NOTES}, r AS (SELECT sample_id, note_seq, unnest(reasons) AS reason, unnest(range(len(reasons))) AS place, array_to_string(reasons, ',') AS reason_codes FROM (SELECT *, list_filter([CASE WHEN pitch > 76 THEN 'octave_outlier' END, CASE WHEN end_sec - start_sec < 0.09 THEN 'possible_fragmentation' END, CASE WHEN end_sec - start_sec > 0.39 THEN 'possible_overmerge' END, CASE WHEN confidence < 0.2 THEN 'low_confidence' END, CASE WHEN NOT voiced THEN 'unvoiced' END], lambda x: x IS NOT NULL) AS reasons FROM notes)),
  p(reason, k, patch) AS (VALUES {_PATCH_ROWS}), f AS (SELECT sample_id, note_seq, reason_codes, patch, min(place * 10 + k) AS place FROM r LEFT JOIN p USING (reason) GROUP BY 1, 2, 3, 4)
  SELECT sample_id, note_seq, reason_codes, coalesce(string_agg(patch, ',' ORDER BY place), 'mark_uncertain') AS patches FROM f GROUP BY 1, 2, 3""",
)
def c68_uncertain_notes(spark, sf):
    """Notes that have reasons, with the edits that these suggest."""
    reasons = [(F.col("pitch") > 76, "octave_outlier"), (dur() < 0.09, "possible_fragmentation"), (dur() > 0.39, "possible_overmerge"), (F.col("confidence") < 0.2, "low_confidence"), (~F.col("voiced"), "unvoiced")]
    n = R.with_reasons(T.notes(spark, sf), reasons).where(F.size("reasons") > 0)
    return n.select("sample_id", "note_seq", F.array_join("reasons", ",").alias("reason_codes"), F.array_join(R.looked_up(F.col("reasons"), PATCHES, "mark_uncertain"), ",").alias("patches"))


@REGISTRY.query(
    "c17_flag_union",
    f"""WITH {NOTES}, f AS (SELECT sample_id, note_seq, unnest([CASE WHEN confidence < 0.5 THEN event_type END, CASE WHEN pitch > 60 THEN 'high' END, CASE WHEN pitch > 60 AND NOT voiced THEN 'error' END, CASE WHEN velocity > 64 THEN 'loud' END, CASE WHEN end_sec - start_sec < 0.12 THEN 'short' END]) AS flag FROM notes)
  SELECT sample_id, note_seq, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), 'unavailable') AS flags FROM f GROUP BY 1, 2""",
)
def c17_flag_union(spark, sf):
    """Flags that come as a text, as a list and as a map."""
    lists = S.labels((F.col("pitch") > 60, "high"), ((F.col("pitch") > 60) & ~F.col("voiced"), "error"))
    maps = F.create_map(F.lit("loud"), F.col("velocity") > 64, F.lit("short"), dur() < 0.12)
    flags = R.all_flags([F.when(F.col("confidence") < 0.5, F.col("event_type"))], [lists], [maps])
    return T.notes(spark, sf).select("sample_id", "note_seq", F.coalesce(F.array_join(flags, ","), F.lit("unavailable")).alias("flags"))


@REGISTRY.query(
    "f9_voiced_frames",
    f"""WITH {NOTES}, f AS (SELECT sample_id, note_seq, CASE WHEN note_seq % 3 = 0 THEN voiced END AS flag, CASE WHEN note_seq % 4 <> 0 THEN upper(state) END AS state, CASE WHEN note_seq % 5 = 0 THEN pitch END AS pitch, CASE WHEN note_seq % 7 = 0 THEN velocity - 60 END AS hz FROM notes)
  SELECT sample_id, note_seq, CASE WHEN flag IS NOT NULL THEN flag WHEN state IN ('VOICED', 'ACTIVE', 'VOCAL', 'SINGING') THEN TRUE ELSE pitch IS NOT NULL OR coalesce(hz > 0, FALSE) END AS voiced FROM f""",
)
def f9_voiced_frames(spark, sf):
    """Frames that tell in different ways whether they are voiced."""
    some = lambda k, c: F.when(F.col("note_seq") % k == 0, c)
    state = F.when(F.col("note_seq") % 4 != 0, F.upper("state"))
    return T.notes(spark, sf).select("sample_id", "note_seq", R.is_voiced(some(3, F.col("voiced")), state, some(5, F.col("pitch")), some(7, F.col("velocity") - 60)).alias("voiced"))


@REGISTRY.query(
    "s7_tempo_integration",
    f"""WITH {NOTES}, m AS (SELECT sample_id, note_seq * 0 + row_number() OVER {BY} * 480 AS tick, 400000 + pitch * 1000 AS tempo FROM notes WHERE velocity % 5 = 0), z AS (SELECT * FROM m UNION ALL SELECT DISTINCT sample_id, 0, 500000 FROM notes),
  s AS (SELECT *, lag(tempo) OVER w AS before, tick - lag(tick) OVER w AS ticks FROM z WINDOW w AS (PARTITION BY sample_id ORDER BY tick)), c AS (SELECT sample_id, tick, tempo, coalesce(sum(ticks * before / 480000000.0::DOUBLE) OVER (PARTITION BY sample_id ORDER BY tick), 0) AS at FROM s),
  q AS (SELECT sample_id, note_seq, row_number() OVER {BY} * 100 AS tick FROM notes)
  SELECT q.sample_id, q.note_seq, round(c.at + (q.tick - c.tick) * c.tempo / 480000000.0::DOUBLE, 6) AS seconds FROM q ASOF JOIN c ON q.sample_id = c.sample_id AND q.tick >= c.tick""",
)
def s7_tempo_integration(spark, sf):
    """Ticks to seconds over a tempo map: prefix sums of its pieces, then an as-of join."""
    n = T.notes(spark, sf)
    w = X.ordered(KEY, ORDER)
    m = n.where("velocity % 5 = 0").select("sample_id", (F.row_number().over(w) * 480).cast("long").alias("at_tick"), (400000 + F.col("pitch") * 1000).alias("tempo"))
    m = m.unionByName(n.select("sample_id").distinct().withColumns({"at_tick": F.lit(0).cast("long"), "tempo": F.lit(500000)}))
    o = W.partitionBy("sample_id").orderBy("at_tick")
    piece = (F.col("at_tick") - F.lag("at_tick").over(o)) * F.lag("tempo").over(o) / F.lit(480000000.0)
    m = m.withColumn("piece", piece).withColumn("at", F.coalesce(F.sum("piece").over(o), F.lit(0.0)))
    q = n.select("sample_id", "note_seq", (F.row_number().over(w) * 100).cast("long").alias("tick"))
    j = I.asof_join(q, m, KEY, "tick", "at_tick", ["at_tick", "tempo", "at"])
    return j.select("sample_id", "note_seq", r6(F.col("at") + (F.col("tick") - F.col("at_tick")) * F.col("tempo") / F.lit(480000000.0)).alias("seconds"))


@REGISTRY.query("d6_shift_candidates", f"WITH {NOTES}, m AS (SELECT sample_id, min(start_sec) FILTER (note_seq % 3 <> 0) AS a, min(start_sec) FILTER (note_seq % 4 <> 0) AS b FROM notes GROUP BY 1), s AS (SELECT sample_id, unnest([0.0::DOUBLE, round(a - b, 3), round((a - b) / 2, 3), -0.05::DOUBLE, 0.05::DOUBLE]) AS shift FROM m) SELECT DISTINCT sample_id, shift + 0.0 AS shift FROM s")
def d6_shift_candidates(spark, sf):
    m = T.notes(spark, sf).groupBy("sample_id").agg(F.min(F.when(F.col("note_seq") % 3 != 0, F.col("start_sec"))).alias("a"), F.min(F.when(F.col("note_seq") % 4 != 0, F.col("start_sec"))).alias("b"))
    d = F.col("a") - F.col("b")
    return m.select("sample_id", F.explode(F.array_distinct(F.array(F.lit(0.0), F.round(d, 3) + 0.0, F.round(d / 2, 3) + 0.0, F.lit(-0.05), F.lit(0.05)))).alias("shift")).distinct()
