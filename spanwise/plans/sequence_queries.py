"""Queries with matching, folds and dynamic programming; those without SQL are tested against plain Python."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import folds as D
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import windows as X
from . import fixtures as T
from .fixtures import EXPECTED, NOTES, PREDICTED
from .registry import REGISTRY

KEY, ORDER = ["sample_id"], ["start_sec", "note_seq"]
r6 = lambda c: F.round(c, 6)
BY = "(PARTITION BY sample_id ORDER BY start_sec, note_seq)"


def _sides(spark, sf):
    """Every seventh predicted note is an octave up, every eleventh a semitone."""
    n = T.notes(spark, sf)
    up = F.when(F.col("note_seq") % 7 == 0, 12).when(F.col("note_seq") % 11 == 0, 1).otherwise(0)
    return T.expected(n), T.predicted(n).withColumn("pitch", F.col("pitch") + up)


def _matched(e, p, octave=12, any_octave=False):
    return M.greedy_match(M.match_edges(e, p, KEY, 0.12, octave, any_octave), KEY)


_OFF = "abs(p.pitch - e.pitch)"
_CLASS = f"least({_OFF} % 12, 12 - {_OFF} % 12)"
_IOU = "CASE WHEN greatest(e.end_sec, p.end_sec) - least(e.start_sec, p.start_sec) > 0 THEN greatest(0, least(e.end_sec, p.end_sec) - greatest(e.start_sec, p.start_sec)) / (greatest(e.end_sec, p.end_sec) - least(e.start_sec, p.start_sec)) ELSE 0 END"


def _greedy(name: str, tiers: str, predicted: str = "moved") -> str:
    """The greedy choice as a walk over all edges of a sample by cost."""
    return f"""{name}_edge AS (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY cost, e, p) AS k FROM (
      SELECT e.sample_id, e.note_seq AS e, p.note_seq AS p, {_OFF} AS off, {_CLASS} AS class, abs(p.start_sec - e.start_sec) AS apart, {_IOU} AS iou, round(abs(p.start_sec - e.start_sec) + CASE {tiers} END + (1 - {_IOU}) * 0.01::DOUBLE, 9) AS cost
      FROM expected e JOIN {predicted} p ON p.sample_id = e.sample_id AND abs(p.start_sec - e.start_sec) <= 0.12) WHERE cost IS NOT NULL),
  {name}_walk AS (
    SELECT sample_id, k, e, p, TRUE AS took, [e] AS es, [p] AS ps FROM {name}_edge WHERE k = 1
    UNION ALL SELECT sample_id, k, e, p, free, CASE WHEN free THEN list_append(es, e) ELSE es END, CASE WHEN free THEN list_append(ps, p) ELSE ps END
    FROM (SELECT x.sample_id, x.k, x.e, x.p, w.es, w.ps, NOT list_contains(w.es, x.e) AND NOT list_contains(w.ps, x.p) AS free FROM {name}_walk w JOIN {name}_edge x ON x.sample_id = w.sample_id AND x.k = w.k + 1)),
  {name} AS (SELECT x.* FROM {name}_edge x JOIN {name}_walk w ON w.sample_id = x.sample_id AND w.k = x.k AND took)"""


MOVED = f"{NOTES}, {EXPECTED}, {PREDICTED}, moved AS (SELECT * REPLACE (pitch + CASE WHEN note_seq % 7 = 0 THEN 12 WHEN note_seq % 11 = 0 THEN 1 ELSE 0 END AS pitch) FROM predicted)"
_TIERS = f"WHEN {_OFF} = 0 THEN 0::DOUBLE WHEN {_OFF} = 1 THEN 101::DOUBLE"


@REGISTRY.query(
    "j12_greedy_match",
    f"WITH RECURSIVE {MOVED}, {_greedy('m', _TIERS + f' WHEN {_OFF} = 12 THEN 112::DOUBLE')} SELECT sample_id, e AS expected_seq, p AS predicted_seq, round(cost, 6) AS cost FROM m",
)
def j12_greedy_match(spark, sf):
    """One to one, the cheapest pair first."""
    return _matched(*_sides(spark, sf)).select("sample_id", F.col("e").alias("expected_seq"), F.col("p").alias("predicted_seq"), r6("cost").alias("cost"))


_SCORES = ["pitch_accuracy", "semitone_error_rate", "octave_error_rate", "onset_mae", "mean_iou", "precision", "recall", "f1", "octave_pitch_accuracy", "octave_octave_error_rate", "octave_mean_pitch_delta", "octave_precision", "octave_recall", "octave_f1", "octave_recall_lift", "octave_f1_lift"]
_F1 = "CASE WHEN n_expected + n_predicted > 0 AND {0} > 0 THEN 2.0 * {0} / (n_expected + n_predicted) ELSE 0 END"


@REGISTRY.query(
    "a3_match_scores",
    f"""WITH RECURSIVE {MOVED}, {_greedy("m", _TIERS + f" WHEN {_OFF} = 12 THEN 112::DOUBLE")}, {_greedy("o", _TIERS + f" WHEN {_CLASS} = 0 THEN 100 + 0.01::DOUBLE * {_OFF} WHEN {_OFF} = 12 THEN 112::DOUBLE")},
  c AS (SELECT sample_id, (SELECT count(*) FROM expected e WHERE e.sample_id = s.sample_id) AS n_expected, (SELECT count(*) FROM moved p WHERE p.sample_id = s.sample_id) AS n_predicted FROM (SELECT DISTINCT sample_id FROM notes WHERE note_seq % 3 <> 0 OR note_seq % 4 <> 0) s),
  a AS (SELECT sample_id, count(*) AS n, avg((off = 0)::INT) AS pitch_accuracy, avg((off = 1)::INT) AS semitone_error_rate, avg((off = 12)::INT) AS octave_error_rate, avg(apart) AS onset_mae, avg(iou) AS mean_iou FROM m GROUP BY 1),
  b AS (SELECT sample_id, count(*) AS n, avg((class = 0)::INT) AS octave_pitch_accuracy, avg((class = 0 AND off > 0)::INT) AS octave_octave_error_rate, avg(off) AS octave_mean_pitch_delta FROM o GROUP BY 1),
  s AS (SELECT c.*, coalesce(a.n, 0) AS n_matched, coalesce(b.n, 0) AS octave_n_matched, coalesce(pitch_accuracy, 0) AS pitch_accuracy, coalesce(semitone_error_rate, 0) AS semitone_error_rate, coalesce(octave_error_rate, 0) AS octave_error_rate, onset_mae, mean_iou, coalesce(octave_pitch_accuracy, 0) AS octave_pitch_accuracy, coalesce(octave_octave_error_rate, 0) AS octave_octave_error_rate, octave_mean_pitch_delta
    FROM c LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id)),
  r AS (SELECT *, coalesce(n_matched / nullif(n_predicted, 0), 0) AS precision, coalesce(n_matched / nullif(n_expected, 0), 0) AS recall, {_F1.format("n_matched")} AS f1, coalesce(octave_n_matched / nullif(n_predicted, 0), 0) AS octave_precision, coalesce(octave_n_matched / nullif(n_expected, 0), 0) AS octave_recall, {_F1.format("octave_n_matched")} AS octave_f1 FROM s),
  l AS (SELECT *, octave_recall - recall AS octave_recall_lift, octave_f1 - f1 AS octave_f1_lift FROM r)
  SELECT sample_id, n_expected, n_predicted, n_matched, octave_n_matched, {", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in _SCORES)} FROM l""",
)
def a3_match_scores(spark, sf):
    """A3: scores of the match, and of one for which octaves count."""
    e, p = _sides(spark, sf)
    s = M.match_scores(e, p, _matched(e, p), KEY, _matched(e, p, any_octave=True))
    return s.select("sample_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_expected", "n_predicted", "n_matched", "octave_n_matched")), *(r6(c).alias(c) for c in _SCORES))


@REGISTRY.query(
    "c7_match_details",
    f"""WITH RECURSIVE {MOVED}, {_greedy("m", _TIERS + f" WHEN {_OFF} = 12 THEN 112::DOUBLE")}
  SELECT m.sample_id, 'matched' AS kind, m.e AS expected_seq, m.p AS predicted_seq, round(p.start_sec - e.start_sec, 6) AS onset_delta_sec, round(abs(p.start_sec - e.start_sec), 6) AS abs_onset_delta_sec, p.pitch - e.pitch AS pitch_delta, round(iou, 6) AS duration_iou
  FROM m JOIN expected e ON e.note_seq = m.e JOIN moved p ON p.note_seq = m.p
  UNION ALL SELECT sample_id, 'unmatched_expected', note_seq, NULL, NULL, NULL, NULL, NULL FROM expected WHERE note_seq NOT IN (SELECT e FROM m)
  UNION ALL SELECT sample_id, 'unmatched_predicted', NULL, note_seq, NULL, NULL, NULL, NULL FROM moved WHERE note_seq NOT IN (SELECT p FROM m)""",
)
def c7_match_details(spark, sf):
    """A row for each pair, with how far apart it is, and for each note that found none."""
    e, p = _sides(spark, sf)
    m = M.match_details(e, p, _matched(e, p), KEY)
    return m.select("sample_id", "kind", F.col("e").alias("expected_seq"), F.col("p").alias("predicted_seq"), r6("onset_delta_sec").alias("onset_delta_sec"), r6(F.abs("onset_delta_sec")).alias("abs_onset_delta_sec"), "pitch_delta", r6("duration_iou").alias("duration_iou"))


@REGISTRY.query(
    "c6_match_rates",
    f"""WITH RECURSIVE {MOVED}, mid AS (SELECT sample_id, round((SELECT median(start_sec) FROM expected e WHERE e.sample_id = s.sample_id) - (SELECT median(start_sec) FROM moved p WHERE p.sample_id = s.sample_id), 3) AS shift FROM (SELECT DISTINCT sample_id FROM notes) s),
  late AS (SELECT m.* REPLACE (start_sec + coalesce(shift, 0) AS start_sec, end_sec + coalesce(shift, 0) AS end_sec) FROM moved m JOIN mid USING (sample_id)),
  {_greedy("m", _TIERS + f" WHEN {_OFF} = 12 THEN 112::DOUBLE")}, {_greedy("x", _TIERS + f" WHEN {_OFF} = 12 THEN 112::DOUBLE", "late")},
  c AS (SELECT sample_id, shift, (SELECT count(*) FROM expected e WHERE e.sample_id = s.sample_id) AS n_expected, (SELECT count(*) FROM moved p WHERE p.sample_id = s.sample_id) AS n_predicted, (SELECT count(*) FROM m WHERE m.sample_id = s.sample_id) AS raw_matched, (SELECT count(*) FROM x WHERE x.sample_id = s.sample_id) AS shift_matched FROM mid s)
  SELECT sample_id, coalesce(shift, 0) AS shift_sec, n_expected, n_predicted, raw_matched, shift_matched, n_expected - raw_matched AS unmatched_expected, n_predicted - raw_matched AS unmatched_predicted,
    round(raw_matched / nullif(n_expected, 0), 6) AS raw_vs_expected, round(raw_matched / nullif(n_predicted, 0), 6) AS raw_vs_predicted, round(shift_matched / nullif(n_expected, 0), 6) AS shift_vs_expected, round(shift_matched / nullif(n_predicted, 0), 6) AS shift_vs_predicted FROM c""",
)
def c6_match_rates(spark, sf):
    """Shares of notes matched as they are, and with the predicted ones moved by the difference of the median starts."""
    e, p = _sides(spark, sf)
    middle = lambda df, c: df.groupBy("sample_id").agg(F.median("start_sec").alias(c))
    mid = middle(e, "a").join(middle(p, "b"), "sample_id", "full_outer").select("sample_id", F.coalesce(F.round(F.col("a") - F.col("b"), 3), F.lit(0.0)).alias("shift_sec"))
    late = p.join(mid, "sample_id").withColumns({c: F.col(c) + F.col("shift_sec") for c in ("start_sec", "end_sec")})
    count = lambda df, c: df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(c))
    out = mid
    for df, c in ((e, "n_expected"), (p, "n_predicted"), (_matched(e, p), "raw_matched"), (_matched(e, late), "shift_matched")):
        out = out.join(count(df, c), "sample_id", "left")
    out = out.fillna(0, ["n_expected", "n_predicted", "raw_matched", "shift_matched"])
    rate = lambda a, b: r6(F.try_divide(F.col(f"{a}_matched"), F.col(f"n_{b}"))).alias(f"{a}_vs_{b}")
    return out.select("*", *((F.col(f"n_{s}") - F.col("raw_matched")).alias(f"unmatched_{s}") for s in ("expected", "predicted")), *(rate(a, b) for a in ("raw", "shift") for b in ("expected", "predicted")))


@REGISTRY.query(
    "i5_range_bounded_segments",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER {BY} AS k FROM notes), r AS (
    SELECT sample_id, k, CASE WHEN confidence >= 0.3 THEN {{'first': note_seq, 'a': start_sec, 'b': end_sec, 't': start_sec, 'lo': pitch, 'hi': pitch, 'n': 1}} END AS s FROM o WHERE k = 1
    UNION ALL SELECT o.sample_id, o.k, CASE WHEN o.confidence < 0.3 THEN NULL
        WHEN s IS NULL OR o.start_sec - s.t > 0.5::DOUBLE OR greatest(s.hi, o.pitch) - least(s.lo, o.pitch) > 12 THEN {{'first': o.note_seq, 'a': o.start_sec, 'b': o.end_sec, 't': o.start_sec, 'lo': o.pitch, 'hi': o.pitch, 'n': 1}}
        ELSE {{'first': s.first, 'a': s.a, 'b': o.end_sec, 't': o.start_sec, 'lo': least(s.lo, o.pitch), 'hi': greatest(s.hi, o.pitch), 'n': s.n + 1}} END FROM r JOIN o ON o.sample_id = r.sample_id AND o.k = r.k + 1)
  SELECT sample_id, s.first AS first_seq, round(max(s.a), 6) AS start_sec, round(arg_max(s.b, k), 6) AS end_sec, min(s.lo)::DOUBLE AS low, max(s.hi)::DOUBLE AS high, CAST(max(s.n) AS INT) AS n_notes FROM r WHERE s IS NOT NULL GROUP BY sample_id, s.first""",
)
def i5_range_bounded_segments(spark, sf):
    s = D.range_bounded(T.notes(spark, sf), "sample_id", 12, 0.3, 0.5, width=30)
    return s.select("sample_id", "first_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "low", "high", "n_notes")


@REGISTRY.query(
    "i11_merge_same_pitch",
    f"""WITH {NOTES}, c AS (SELECT *, pitch % 3 AS p, coalesce(pitch % 3 <> lag(pitch % 3) OVER {BY}, FALSE)::INT AS new FROM notes), r AS (SELECT *, sum(new) OVER {BY} AS run FROM c),
  x AS (SELECT *, max(end_sec) OVER (PARTITION BY sample_id, run ORDER BY start_sec, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
  k AS (SELECT *, sum((reach IS NULL OR start_sec > reach + 0.1)::INT) OVER {BY} AS part FROM x)
  SELECT sample_id, min(note_seq) AS first_seq, p AS pitch, round(min(start_sec), 6) AS start_sec, round(max(end_sec), 6) AS end_sec, max(confidence) AS confidence, count(*) AS n_merged FROM k GROUP BY sample_id, part, p""",
)
def i11_merge_same_pitch(spark, sf):
    """Neighbours of one value, here pitch modulo 3, merge over short gaps; a running latest end within the run of one value is enough."""
    n = T.notes(spark, sf).withColumn("p", F.col("pitch") % 3)
    n = I.island_ids(n, KEY, ORDER, F.col("p") != F.lag("p").over(X.ordered(KEY, ORDER)), "run")
    n = n.withColumn("reach", I.reach(["sample_id", "run"], ORDER))
    k = I.island_ids(n, KEY, ORDER, F.col("reach").isNull() | (F.col("start_sec") > F.col("reach") + 0.1), "part")
    out = k.groupBy("sample_id", "part", F.col("p").alias("pitch")).agg(F.min("note_seq").alias("first_seq"), r6(F.min("start_sec")).alias("start_sec"), r6(F.max("end_sec")).alias("end_sec"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_merged"))
    return out.drop("part")


@REGISTRY.query(
    "i13_conflict_groups",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, round(end_sec - start_sec, 6) AS dur, row_number() OVER {BY} AS k FROM notes),
  a AS (SELECT sample_id, k, start_sec AS anchor FROM o WHERE k = 1 UNION ALL SELECT o.sample_id, o.k, CASE WHEN o.start_sec - a.anchor <= 0.15::DOUBLE THEN a.anchor ELSE o.start_sec END FROM a JOIN o ON o.sample_id = a.sample_id AND o.k = a.k + 1),
  m AS (SELECT o.*, dense_rank() OVER (PARTITION BY o.sample_id ORDER BY anchor) AS g FROM o JOIN a ON a.sample_id = o.sample_id AND a.k = o.k),
  w AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS g, CAST(NULL AS INT) AS last, CAST(NULL AS BIGINT) AS note_seq, CAST(0 AS BIGINT) AS n FROM notes UNION ALL
    SELECT sample_id, g, best.pitch, best.note_seq, n FROM (SELECT m.sample_id, m.g, arg_min({{'pitch': m.pitch, 'note_seq': m.note_seq}}, {{'a': -m.dur, 'b': -m.confidence, 'c': coalesce(abs(m.pitch - w.last), 0), 'd': m.start_sec, 'e': -m.note_seq}}) AS best, count(*) AS n FROM w JOIN m ON m.sample_id = w.sample_id AND m.g = w.g + 1 GROUP BY 1, 2))
  SELECT m.sample_id, m.note_seq, round(m.start_sec, 6) AS start_sec, round(m.end_sec, 6) AS end_sec, m.pitch, CAST(w.n AS INT) AS n_group FROM w JOIN m ON m.sample_id = w.sample_id AND m.note_seq = w.note_seq""",
)
def i13_conflict_groups(spark, sf):
    b = D.best_of_conflicts(T.notes(spark, sf), "sample_id", 0.15, width=30)
    return b.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch", "n_group")


@REGISTRY.query(
    "i14_trim_overlaps",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER {BY} AS k FROM notes), r AS (
    SELECT sample_id, k, {{'id': note_seq, 'a': start_sec, 'b': end_sec, 'p': pitch, 'c': confidence}} AS last, NULL::STRUCT(id BIGINT, a DOUBLE, b DOUBLE, p INT, c DOUBLE) AS done FROM o WHERE k = 1
    UNION ALL SELECT sample_id, k, CASE WHEN b > a THEN {{'id': note_seq, 'a': a, 'b': b, 'p': pitch, 'c': confidence}} ELSE cut END, CASE WHEN b > a THEN cut END FROM (
      SELECT o.*, o.end_sec AS b, CASE WHEN o.start_sec < last.b AND o.confidence <= last.c THEN least(o.end_sec, last.b + 0.005::DOUBLE) ELSE o.start_sec END AS a,
        CASE WHEN o.start_sec < last.b AND o.confidence > last.c THEN {{'id': last.id, 'a': last.a, 'b': greatest(last.a, o.start_sec - 0.005::DOUBLE), 'p': last.p, 'c': last.c}} ELSE last END AS cut
      FROM r JOIN o ON o.sample_id = r.sample_id AND o.k = r.k + 1)),
  every AS (SELECT sample_id, done AS x FROM r WHERE done IS NOT NULL UNION ALL SELECT sample_id, arg_max(last, k) FROM r GROUP BY sample_id)
  SELECT sample_id, x.id AS note_seq, round(x.a, 6) AS start_sec, round(x.b, 6) AS end_sec, x.p AS pitch FROM every""",
)
def i14_trim_overlaps(spark, sf):
    t = D.fold_runs(T.notes(spark, sf), "sample_id", 0.0, D.trim_weaker(0.005), "note_seq long, start_sec double, end_sec double, pitch int", width=30)
    return t.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch")


@REGISTRY.query(
    "i16_drop_leaps",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER {BY} AS k FROM notes), s AS (SELECT sample_id, k, note_seq, pitch AS last, TRUE AS kept FROM o WHERE k = 1 UNION ALL
    SELECT sample_id, k, note_seq, CASE WHEN x THEN last ELSE pitch END, NOT x FROM (SELECT o.*, s.last, abs(o.pitch - s.last) >= 12 AND (o.end_sec - o.start_sec < 0.25 OR o.confidence < 0.62) AS x FROM s JOIN o ON o.sample_id = s.sample_id AND o.k = s.k + 1))
  SELECT o.sample_id, o.note_seq, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, pitch FROM s JOIN o ON o.sample_id = s.sample_id AND o.k = s.k WHERE kept""",
)
def i16_drop_leaps(spark, sf):
    """The last note kept is remembered over any silence."""
    return D.drop_leaps(T.notes(spark, sf), "sample_id", width=30).select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch")


@REGISTRY.query(
    "j13_match_each_left",
    f"""WITH RECURSIVE {NOTES}, {EXPECTED}, {PREDICTED}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pitch ORDER BY start_sec, note_seq) AS k FROM expected),
  s AS (SELECT DISTINCT sample_id, pitch, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS p, CAST([] AS BIGINT[]) AS used FROM expected UNION ALL
    SELECT sample_id, pitch, k, e, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT s.sample_id, s.pitch, o.k, o.note_seq AS e, any_value(s.used) AS used, arg_min(q.note_seq, {{'d': abs(q.start_sec - o.start_sec), 't': q.start_sec, 'n': q.note_seq}}) AS p
      FROM s JOIN o ON o.sample_id = s.sample_id AND o.pitch = s.pitch AND o.k = s.k + 1 LEFT JOIN predicted q ON q.sample_id = s.sample_id AND q.pitch = s.pitch AND abs(q.start_sec - o.start_sec) <= 0.08 AND NOT list_contains(s.used, q.note_seq) GROUP BY 1, 2, 3, 4))
  SELECT sample_id, e AS expected_seq, p AS predicted_seq FROM s WHERE p IS NOT NULL""",
)
def j13_match_each_left(spark, sf):
    n = T.notes(spark, sf)
    m = D.match_each_left(T.expected(n), T.predicted(n), "sample_id", 0.08)
    return m.select("sample_id", F.col("left_seq").alias("expected_seq"), F.col("right_seq").alias("predicted_seq"))


@REGISTRY.query(
    "i22_polyphony_limit",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence DESC, start_sec - end_sec, start_sec, pitch, note_seq) AS k FROM notes),
  s AS (SELECT DISTINCT sample_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, id BIGINT)[]) AS kept FROM notes UNION ALL
    SELECT sample_id, k, CASE WHEN list_max(list_transform(list_append(list_transform(list_filter(kept, lambda x: x.a > a AND x.a < b), lambda x: x.a), a), lambda p: len(list_filter(kept, lambda x: x.a <= p AND p < x.b)))) < 1 THEN list_append(kept, {{'a': a, 'b': b, 'id': note_seq}}) ELSE kept END
    FROM (SELECT o.sample_id, o.k, s.kept, o.start_sec AS a, o.end_sec AS b, o.note_seq FROM s JOIN o ON o.sample_id = s.sample_id AND o.k = s.k + 1)),
  l AS (SELECT sample_id, unnest(kept) AS x FROM (SELECT sample_id, arg_max(kept, k) AS kept FROM s GROUP BY 1))
  SELECT sample_id, x.id AS note_seq, round(x.a, 6) AS start_sec, round(x.b, 6) AS end_sec FROM l""",
)
def i22_polyphony_limit(spark, sf):
    kept = D.fold_runs(T.notes(spark, sf), "sample_id", 0.0, D.limit_polyphony(1), "note_seq long, start_sec double, end_sec double")
    return kept.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"))


@REGISTRY.query("c45_clean_melody")
def c45_clean_melody(spark, sf):
    m = D.clean_melody(T.notes(spark, sf), "sample_id", width=30)
    return m.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch", "confidence")


@REGISTRY.query("d1_alignment")
def d1_alignment(spark, sf):
    """Alignment under five octave shifts, and the best of them."""
    e, p = _sides(spark, sf)
    out = L.align_best_shift(e, p, "sample_id")
    return out.select("sample_id", "n_expected", "n_predicted", "shift", r6("cost").alias("cost"), "pairs", *(r6(c).alias(c) for c in ("recall", "precision", "mean_pitch_delta")), "skipped_reason")


@REGISTRY.query(
    "d4_snap_to_grid",
    f"WITH {NOTES} SELECT sample_id, note_seq, round(round_even(start_sec / 0.125, 0) * 0.125, 6) AS start_sec, round(greatest(0.125, round_even((end_sec - start_sec) / 0.125, 0) * 0.125), 6) AS length_sec, round(abs(start_sec - round_even(start_sec / 0.125, 0) * 0.125), 6) AS shift_sec FROM notes",
)
def d4_snap_to_grid(spark, sf):
    snap = lambda c: F.bround(c / 0.125) * 0.125
    start, length = F.col("start_sec"), F.col("end_sec") - F.col("start_sec")
    return T.notes(spark, sf).select("sample_id", "note_seq", r6(snap(start)).alias("start_sec"), r6(F.greatest(F.lit(0.125), snap(length))).alias("length_sec"), r6(F.abs(start - snap(start))).alias("shift_sec"))


@REGISTRY.query(
    "d7_tempo_candidates",
    f"""WITH {NOTES}, d AS (SELECT sample_id, lead(start_sec) OVER {BY} - start_sec AS step FROM notes), m AS (SELECT sample_id, 60 / median(step) AS bpm FROM d GROUP BY 1),
  c AS (SELECT sample_id, bpm, bpm * f AS candidate, abs(ln(bpm * f / 110)) AS distance, f FROM m, (VALUES (0.25), (0.5), (1.0), (2.0), (4.0)) t(f)), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, f) AS k FROM c)
  SELECT sample_id, round(bpm, 6) AS raw_bpm, round(candidate, 6) AS bpm FROM r WHERE k = 1""",
)
def d7_tempo_candidates(spark, sf):
    """Among octaves of the tempo the one nearest to 110 on a log scale."""
    d = T.notes(spark, sf).select("sample_id", (F.lead("start_sec").over(X.ordered(KEY, ORDER)) - F.col("start_sec")).alias("step"))
    m = d.groupBy("sample_id").agg((60 / F.median("step")).alias("bpm"))
    tries = F.transform(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0, 4.0))), lambda f: F.struct(F.abs(F.log(F.col("bpm") * f / 110)).alias("d"), f.alias("f")))
    return m.select("sample_id", r6("bpm").alias("raw_bpm"), r6(F.col("bpm") * F.array_min(tries)["f"]).alias("bpm"))


@REGISTRY.query(
    "i15_replace_weaker",
    f"""WITH RECURSIVE {NOTES}, o AS (SELECT sample_id, {{'id': note_seq, 'a': start_sec, 'b': end_sec, 'p': pitch, 'c': confidence, 'd': round(end_sec - start_sec, 6)}} AS x, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, -confidence, -round(end_sec - start_sec, 6), note_seq) AS k FROM notes),
  r AS (SELECT sample_id, k, [x] AS kept FROM o WHERE k = 1 UNION ALL
    SELECT sample_id, k, CASE WHEN spot IS NULL OR spot = 0 THEN list_append(kept, x) ELSE list_transform(kept, lambda y, i: CASE WHEN i = spot AND (x.c, x.d, x.p) > (y.c, y.d, y.p) THEN x ELSE y END) END FROM (
      SELECT o.sample_id, o.k, kept, x, list_position(list_transform(kept, lambda y: x.a < y.b - 0.02::DOUBLE AND y.a < x.b - 0.02::DOUBLE), TRUE) AS spot FROM r JOIN o ON o.sample_id = r.sample_id AND o.k = r.k + 1))
  SELECT sample_id, y.id AS note_seq, round(y.a, 6) AS start_sec, round(y.b, 6) AS end_sec, y.p AS pitch FROM (SELECT sample_id, unnest(arg_max(kept, k)) AS y FROM r GROUP BY sample_id)""",
)
def i15_replace_weaker(spark, sf):
    t = D.fold_runs(T.notes(spark, sf), "sample_id", 0.0, D.replace_weaker(0.02), "note_seq long, start_sec double, end_sec double, pitch int", width=30)
    return t.select("sample_id", "note_seq", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch")


@REGISTRY.query(
    "i19_isolated_fragments",
    f"""WITH {NOTES}, x AS (SELECT *, max(end_sec) OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM notes), k AS (SELECT *, sum(coalesce((start_sec > reach + 0.3)::INT, 0)) OVER {BY} AS run FROM x),
  c AS (SELECT *, count(*) OVER (PARTITION BY sample_id, run) AS n FROM k) SELECT sample_id, note_seq, NOT (n = 1 AND end_sec - start_sec < 0.15) AS kept FROM c""",
)
def i19_isolated_fragments(spark, sf):
    """Short notes alone between silences go: a run of one note, so no fold is needed."""
    n = T.notes(spark, sf).withColumn("reach", I.reach(KEY, ORDER))
    k = I.island_ids(n, KEY, ORDER, F.col("start_sec") > F.col("reach") + 0.3, "run")
    alone = F.count(F.lit(1)).over(W.partitionBy("sample_id", "run")) == 1
    return k.select("sample_id", "note_seq", (~(alone & (F.col("end_sec") - F.col("start_sec") < 0.15))).alias("kept"))


@REGISTRY.query(
    "j20_gaps_in_runs",
    f"""WITH {NOTES}, v AS (SELECT *, max(end_sec) OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM notes WHERE state = 'vocal'), g AS (SELECT sample_id, reach AS a, start_sec AS b FROM v WHERE start_sec > reach)
  SELECT n.sample_id, note_seq, round(a, 6) AS gap_start, round(least(end_sec, b) - greatest(start_sec, a), 6) AS clipped_sec FROM notes n JOIN g ON n.sample_id = g.sample_id AND end_sec > a AND start_sec < b WHERE state = 'instrumental' AND least(end_sec, b) - greatest(start_sec, a) >= 0.12""",
)
def j20_gaps_in_runs(spark, sf):
    """Instrumental notes clipped to the gaps between vocal ones, 0.12 seconds at least."""
    n = T.notes(spark, sf)
    g = I.gaps(n.where("state = 'vocal'"), KEY, width=10.0).select("sample_id", F.col("gap_start").alias("a"), F.col("gap_end").alias("b"))
    both = F.least("end_sec", "b") - F.greatest("start_sec", "a")
    j = I.interval_join(n.where("state = 'instrumental'"), g, KEY, 1.0, "start_sec", "end_sec", "a", "b", both >= 0.12)
    return j.select("sample_id", "note_seq", r6("a").alias("gap_start"), r6(both).alias("clipped_sec"))


@REGISTRY.query(
    "j14_equivalent_segments",
    f"""WITH {NOTES}, a AS (SELECT * FROM notes WHERE note_seq % 2 = 0), b AS (SELECT sample_id, note_seq AS other, start_sec + 0.01 AS s2, end_sec + 0.02 AS e2, pitch AS p2 FROM notes WHERE note_seq % 3 = 0),
  r AS (SELECT a.sample_id, note_seq, other, s2, e2, row_number() OVER (PARTITION BY a.sample_id, note_seq ORDER BY round(least(end_sec, e2) - greatest(start_sec, s2), 9) DESC, other) AS k FROM a JOIN b ON a.sample_id = b.sample_id AND end_sec > s2 AND start_sec < e2 WHERE abs(pitch - p2) <= 1 AND least(end_sec, e2) - greatest(start_sec, s2) >= 0.8 * greatest(end_sec - start_sec, e2 - s2))
  SELECT a.sample_id, a.note_seq, other, round(coalesce(s2, start_sec), 6) AS start_sec, round(coalesce(e2, end_sec), 6) AS end_sec FROM a LEFT JOIN r ON a.sample_id = r.sample_id AND a.note_seq = r.note_seq AND k = 1""",
)
def j14_equivalent_segments(spark, sf):
    """Segments give way to the best that overlaps them by 80 percent both ways with nearly the same pitch."""
    n = T.notes(spark, sf)
    a = n.where("note_seq % 2 = 0").select("sample_id", "note_seq", "start_sec", "end_sec", "pitch")
    b = n.where("note_seq % 3 = 0").select("sample_id", F.col("note_seq").alias("other"), (F.col("start_sec") + 0.01).alias("s2"), (F.col("end_sec") + 0.02).alias("e2"), F.col("pitch").alias("p2"))
    both = F.least("end_sec", "e2") - F.greatest("start_sec", "s2")
    same = (F.abs(F.col("pitch") - F.col("p2")) <= 1) & (both >= 0.8 * F.greatest(F.col("end_sec") - F.col("start_sec"), F.col("e2") - F.col("s2")))
    j = I.interval_join(a, b, KEY, 0.5, "start_sec", "end_sec", "s2", "e2", same)
    best = j.groupBy("sample_id", "note_seq").agg(F.max_by(F.struct("other", "s2", "e2"), F.struct(F.round(both, 9), -F.col("other"))).alias("m"))
    out = a.join(best, ["sample_id", "note_seq"], "left")
    return out.select("sample_id", "note_seq", F.col("m.other").alias("other"), r6(F.coalesce("m.s2", "start_sec")).alias("start_sec"), r6(F.coalesce("m.e2", "end_sec")).alias("end_sec"))


@REGISTRY.query("d2_octave_path")
def d2_octave_path(spark, sf):
    """The cheapest path over what each note may be heard as."""
    return D.fold_runs(T.notes(spark, sf), "sample_id", 1.0, D.octave_path, "note_seq long, pitch int, heard int")


@REGISTRY.query("d3_lattice_snap")
def d3_lattice_snap(spark, sf):
    return D.fold_runs(T.notes(spark, sf), "sample_id", 0.5, D.lattice_snap(0.125), "note_seq long, start_sec double, snapped_sec double")


@REGISTRY.query(
    "d8_grid_candidates",
    f"""WITH {NOTES}, v AS (SELECT sample_id, step, phase, abs((start_sec - phase * step) / step - round_even((start_sec - phase * step) / step, 0)) AS d FROM notes, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) s(step), (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) p(phase)),
  c AS (SELECT sample_id, step, phase, round(1 - 2 * avg(d), 9) AS score FROM v GROUP BY 1, 2, 3) SELECT sample_id, step, phase, round(score, 6) AS score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, step, phase) AS rank FROM c""",
)
def d8_grid_candidates(spark, sf):
    """Twelve grids scored for each sample by how near the onsets are; one pass, all grids as aggregates."""
    start = F.col("start_sec")
    grids = [(s, p) for s in (0.25, 0.5, 1.0) for p in (0.0, 0.25, 0.5, 0.75)]
    off = lambda s, p: F.abs((start - p * s) / s - F.bround((start - p * s) / s))
    c = T.notes(spark, sf).groupBy("sample_id").agg(F.array(*(F.struct(F.lit(s).alias("step"), F.lit(p).alias("phase"), F.round(1 - 2 * F.avg(off(s, p)), 9).alias("score")) for s, p in grids)).alias("g"))
    c = c.select("sample_id", F.explode("g").alias("g")).select("sample_id", "g.*")
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("score"), "step", "phase"))
    return c.select("sample_id", "step", "phase", r6("score").alias("score"), rank.cast("long").alias("rank"))
