"""Queries on records of notes and small rules on notes, segments and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import note_rules as R
from ..operators import windows as X
from . import fixtures as T
from .fixtures import EXPECTED, NOTES, PREDICTED
from .registry import REGISTRY

r6 = lambda c: F.round(c, 6)
_D = "::DOUBLE"


@REGISTRY.query(
    "f7_normalized_notes",
    f"""WITH {NOTES}, n AS (SELECT *, round(start_sec, 6) AS s, round(end_sec, 6) AS e, note_seq AS q FROM notes),
  d AS (SELECT sample_id, note_seq, CASE WHEN q % 3 < 2 THEN s ELSE 0 END AS start_sec,
    CASE WHEN q % 5 = 0 THEN NULL WHEN q % 5 = 1 THEN s - 1 ELSE e END AS given, CASE WHEN q % 4 > 0 THEN 0.25{_D} END AS long,
    CASE q % 6 WHEN 0 THEN pitch::DOUBLE WHEN 1 THEN 60 WHEN 2 THEN 70 WHEN 3 THEN 81 END AS pitch, CASE WHEN q % 7 = 0 THEN 1 WHEN q % 7 = 1 THEN 0 WHEN q % 7 = 2 THEN 0 WHEN q % 7 = 3 THEN 0.4{_D} ELSE confidence END AS confidence,
    CASE WHEN q % 8 = 0 THEN 'c' || q WHEN q % 8 < 4 THEN 'n' || q END AS note_id, q % 9 = 0 AS ornament FROM n),
  f AS (SELECT *, greatest(start_sec, coalesce(given, start_sec + long, start_sec)) AS end_sec FROM d)
  SELECT sample_id, note_seq, note_id, start_sec, end_sec, round(end_sec - start_sec, 6) AS duration_sec, pitch, confidence, ornament FROM f""",
)
def f7_normalized_notes(spark, sf):
    """notes out of JSON objects in which a field has one of several names, is missing, or holds what is no number."""
    n, q = T.notes(spark, sf), F.col("note_seq")
    s, e = r6("start_sec"), r6("end_sec")
    fields = {
        "start_time_sec": F.when(q % 3 == 0, s), "start_time": F.when(q % 3 == 1, s), "onset_sec": F.when(q % 3 == 2, F.lit("soon")),
        "offset_sec": F.when(q % 5 == 1, s - 1).when(q % 5 > 1, e), "duration": F.when(q % 4 > 0, 0.25),
        "pitch_midi": F.when(q % 6 == 0, F.col("pitch")), "pitch": F.when(q % 6 == 1, "C4"), "pitch_name": F.when(q % 6 == 2, "A#4"), "f0_hz": F.when(q % 6 == 3, 880.0).when(q % 6 == 4, -1.0),
        "confidence": F.when(q % 7 == 0, "1.5").when(q % 7 == 1, "-2").when(q % 7 == 2, "NaN").when(q % 7 > 3, F.col("confidence").cast("string")), "mean_confidence": F.when(q % 7 == 3, 0.4),
        "id": F.when((q % 8 > 0) & (q % 8 < 4), F.concat(F.lit("n"), q.cast("string"))), "candidate_id": F.when(q % 8 == 0, F.concat(F.lit("c"), q.cast("string"))), "is_candidate_ornament": F.when(q % 9 == 0, True),
    }
    docs = n.select("sample_id", "note_seq", F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("note"))
    return R.normalized_notes(docs).select("sample_id", "note_seq", "note_id", "start_sec", "end_sec", r6("duration_sec").alias("duration_sec"), r6("pitch").alias("pitch"), "confidence", "ornament")


_CODES = ["High_Quantize_Error", " too_short ", "unheard_of", "large_quantize_error", "overmerge_risk", "uncertain"]
_ALIAS = "CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in R.CODE_ALIASES.items()) + " ELSE c END"


@REGISTRY.query(
    "c27_client_notes",
    f"""WITH {NOTES}, p(code, k) AS (VALUES {", ".join(f"('{c}', {k})" for k, c in enumerate(_CODES))}),
  x AS (SELECT sample_id, note_seq, k, lower(trim(code)) AS c FROM notes, p WHERE note_seq % (k + 2) = 0), y AS (SELECT sample_id, note_seq, k, {_ALIAS} AS c FROM x),
  z AS (SELECT sample_id, note_seq, c, min(k) AS k FROM y WHERE c IN ({", ".join(f"'{c}'" for c in R.CLIENT_CODES)}) GROUP BY 1, 2, 3),
  a AS (SELECT n.*, coalesce((SELECT list(c ORDER BY k) FROM z WHERE z.note_seq = n.note_seq AND z.sample_id = n.sample_id), []) AS r FROM notes n),
  b AS (SELECT *, CASE WHEN confidence < 0.55 AND NOT list_contains(r, 'low_confidence') THEN list_append(r, 'low_confidence') ELSE r END AS s FROM a),
  e AS (SELECT *, CASE WHEN (len(s) > 0 OR note_seq % 13 = 0) AND NOT list_contains(s, 'uncertain') THEN list_append(s, 'uncertain') ELSE s END AS t FROM b)
  SELECT sample_id, note_seq, array_to_string(t, ',') AS reasons, len(t) > 0 AS uncertain FROM e""",
)
def c27_client_notes(spark, sf):
    """Notes as a client sees them, with the reasons it knows."""
    q = F.col("note_seq")
    codes = F.array(*(F.when(q % (k + 2) == 0, code) for k, code in enumerate(_CODES)))
    n = T.notes(spark, sf).withColumn("reasons", R.client_reasons(codes, F.col("confidence"), q % 13 == 0))
    return n.select("sample_id", "note_seq", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("uncertain"))


@REGISTRY.query(
    "c31_candidate_counters",
    f"""WITH {NOTES} SELECT sample_id, count(*) AS n_candidates, count(*) FILTER (event_type = 'view') AS n_bridged, count(*) FILTER (voiced) AS n_selected FROM notes GROUP BY 1""",
)
def c31_candidate_counters(spark, sf):
    """Candidates of each sample, those bridged from contours, and those selected."""
    n = T.notes(spark, sf)
    origin = F.when(F.col("event_type") == "view", "contour_to_candidate_bridge").when(F.col("event_type") != "click", "raw")
    return R.candidate_counters(n.withColumn("candidate_origin", origin), n.where("voiced"), "sample_id")


@REGISTRY.query(
    "c32_restore_lineage",
    f"""WITH {NOTES}, note AS (SELECT *, 'c' || note_seq // 3 AS candidate_id FROM notes WHERE note_seq % 2 = 0), source AS (SELECT *, CASE WHEN note_seq % 3 > 0 THEN 'c' || note_seq // 3 WHEN note_seq % 5 = 0 THEN '' END AS candidate_id FROM notes WHERE note_seq % 4 > 0),
  best AS (SELECT n.sample_id, n.note_seq, arg_max(s.note_seq, {{'a': least(n.end_sec, s.end_sec) - greatest(n.start_sec, s.start_sec), 'b': -s.note_seq}}) AS o FROM note n JOIN source s ON s.sample_id = n.sample_id AND least(n.end_sec, s.end_sec) > greatest(n.start_sec, s.start_sec) WHERE s.note_seq <> n.note_seq GROUP BY 1, 2),
  named AS (SELECT sample_id, candidate_id, min(note_seq) AS i FROM source WHERE candidate_id <> '' GROUP BY 1, 2)
  SELECT n.sample_id, n.note_seq, coalesce(o, i) AS source_seq, CASE WHEN o IS NOT NULL THEN 'overlap' WHEN i IS NOT NULL THEN 'id' END AS found_by FROM note n LEFT JOIN best b ON b.sample_id = n.sample_id AND b.note_seq = n.note_seq LEFT JOIN named d ON d.sample_id = n.sample_id AND d.candidate_id = n.candidate_id WHERE n.note_seq % 4 = 0""",
)
def c32_restore_lineage(spark, sf):
    """The source of each note by longest overlap, else by id."""
    n, q = T.notes(spark, sf), F.col("note_seq")
    name = F.concat(F.lit("c"), F.floor(q / 3).cast("string"))
    sources = n.where("note_seq % 4 > 0").withColumn("candidate_id", F.when(q % 3 > 0, name).when(q % 5 == 0, ""))
    return R.restore_lineage(n.where("note_seq % 4 = 0").withColumn("candidate_id", name), sources, "sample_id", width=10.0).select("sample_id", "note_seq", "source_seq", "found_by")


@REGISTRY.query(
    "c51_octave_shift",
    f"""WITH {NOTES}, {EXPECTED}, {PREDICTED}, e AS (SELECT sample_id, median(pitch) AS expected_median FROM expected WHERE sample_id % 17 > 0 GROUP BY 1), p AS (SELECT sample_id, median(pitch + (sample_id % 7 - 3) * 6.25{_D}) AS predicted_median FROM predicted GROUP BY 1),
  d AS (SELECT sample_id, expected_median, predicted_median, predicted_median - expected_median AS median_delta, CAST(round_even((predicted_median - expected_median) / 12, 0) * 12 AS INT) AS o FROM e FULL JOIN p USING (sample_id))
  SELECT sample_id, expected_median, predicted_median, median_delta, coalesce(CASE WHEN o IN (-24, -12, 12, 24) AND abs(median_delta - o) <= 1 THEN -o END, 0) AS octave_shift FROM d""",
)
def c51_octave_shift(spark, sf):
    """Whether the predicted notes of a sample lie whole octaves off."""
    n = T.notes(spark, sf)
    moved = F.col("pitch") + (F.col("sample_id") % 7 - 3) * 6.25
    return R.octave_shift(T.expected(n).where("sample_id % 17 > 0"), T.predicted(n).withColumn("pitch", moved), "sample_id")


_STATE = "CASE event_type WHEN 'view' THEN ' Voiced' WHEN 'click' THEN 'CHORUS' WHEN 'error' THEN 'silence' WHEN 'purchase' THEN 'handoff' ELSE 'else' END"
_CASES = "CASE " + " ".join(f"WHEN lower(trim(raw)) IN ({', '.join(repr(x) for x in names)}) THEN '{name}'" for name, names in R.STATES.items()) + " ELSE 'vocal' END"


@REGISTRY.query(
    "c55_climax_segments",
    f"""WITH {NOTES}, seg AS (SELECT sample_id, start_sec, end_sec + (note_seq % 4 - 1) * 0.5{_D} AS end_sec, {_STATE} AS raw FROM notes WHERE sample_id % 5 > 0 AND note_seq % 10 = 0),
  lead AS (SELECT * FROM notes WHERE sample_id % 2 = 0 AND note_seq % 3 = 1), support AS (SELECT * FROM notes WHERE note_seq % 3 = 2),
  s AS (SELECT sample_id, start_sec, end_sec, {_CASES} AS state, FALSE AS inferred FROM seg WHERE end_sec >= start_sec
    UNION ALL SELECT sample_id, min(start_sec), max(end_sec), CASE WHEN bool_or(l) THEN 'vocal' ELSE 'instrumental' END, TRUE FROM (SELECT sample_id, start_sec, end_sec, TRUE AS l FROM lead UNION ALL SELECT sample_id, start_sec, end_sec, FALSE FROM support) WHERE sample_id NOT IN (SELECT sample_id FROM seg) GROUP BY 1),
  n AS (SELECT *, (SELECT count(*) FROM support p WHERE p.sample_id = s.sample_id AND s.end_sec > p.start_sec AND s.start_sec < p.end_sec) AS n_support FROM s)
  SELECT sample_id, start_sec, end_sec, state, inferred, n_support, state = 'climax' OR (state = 'vocal' AND n_support / greatest(1e-6, end_sec - start_sec) >= 1.2) AS climax FROM n""",
)
def c55_climax_segments(spark, sf):
    """Segments and their states, one over all notes where none are given, and which are a climax."""
    n, q, s = T.notes(spark, sf), F.col("note_seq"), F.col("sample_id")
    kind = F.col("event_type")
    state = F.when(kind == "view", " Voiced").when(kind == "click", "CHORUS").when(kind == "error", "silence").when(kind == "purchase", "handoff").otherwise("else")
    segments = n.where((s % 5 > 0) & (q % 10 == 0)).select("sample_id", "start_sec", (F.col("end_sec") + (q % 4 - 1) * 0.5).alias("end_sec"), state.alias("state"))
    support = n.where("note_seq % 3 = 2")
    known = R.segments_or_span(segments, n.where("sample_id % 2 = 0 AND note_seq % 3 = 1"), support, "sample_id")
    known = known.withColumn("segment_id", F.struct("start_sec", "end_sec", "state"))
    return R.climax_segments(known, support, "sample_id", "segment_id", width=10.0).drop("segment_id")


_TAGGED = f"""{NOTES}, w AS (SELECT *, lead(note_seq) OVER o AS right_id, lead(start_sec) OVER o - end_sec AS gap, lead(pitch) OVER o - pitch AS step FROM notes WINDOW o AS (PARTITION BY sample_id ORDER BY start_sec, note_seq)),
  tag AS (SELECT sample_id, unnest([note_seq, right_id]) AS note_seq, 'f' AS t FROM w WHERE gap BETWEEN 0 AND 0.05 AND abs(step) <= 6 UNION ALL SELECT sample_id, unnest([note_seq, right_id]), 'o' FROM w WHERE gap < -0.1 UNION ALL SELECT sample_id, note_seq, 'o' FROM notes WHERE end_sec - start_sec > 0.39),
  g AS (SELECT sample_id, note_seq, bool_or(t = 'f') AS f, bool_or(t = 'o') AS o FROM tag GROUP BY 1, 2),
  r AS (SELECT n.*, list_filter([CASE WHEN confidence < 0.3 THEN 'low_confidence' END, CASE WHEN n.note_seq % 31 = 0 THEN 'uncertain' END, CASE WHEN f THEN 'fragmentation_risk' END, CASE WHEN o THEN 'overmerge_risk' END], lambda x: x IS NOT NULL) AS a FROM notes n LEFT JOIN g ON g.sample_id = n.sample_id AND g.note_seq = n.note_seq)"""


def _tagged(spark, sf):
    n = T.notes(spark, sf)
    w = X.ordered(["sample_id"], ["start_sec", "note_seq"])
    pairs = n.select("sample_id", F.col("note_seq").alias("left_id"), F.lead("note_seq").over(w).alias("right_id"), (F.lead("start_sec").over(w) - F.col("end_sec")).alias("gap"), (F.lead("pitch").over(w) - F.col("pitch")).alias("step"))
    given = R.labels((F.col("confidence") < 0.3, "low_confidence"), (F.col("note_seq") % 31 == 0, "uncertain"))
    return R.tagged(n.withColumn("reasons", given), "sample_id", pairs.where("gap BETWEEN 0 AND 0.05 AND abs(step) <= 6"), pairs.where("gap < -0.1"), n.where(F.col("end_sec") - F.col("start_sec") > 0.39))


@REGISTRY.query("c61_tagged_notes", f"WITH {_TAGGED} SELECT sample_id, note_seq, array_to_string(CASE WHEN len(a) > 0 AND NOT list_contains(a, 'uncertain') THEN list_append(a, 'uncertain') ELSE a END, ',') AS reasons, len(a) > 0 AS uncertain FROM r")
def c61_tagged_notes(spark, sf):
    """Notes tagged from pairs that look like fragments or merges."""
    return _tagged(spark, sf).select("sample_id", "note_seq", F.array_join("reasons", ",").alias("reasons"), "uncertain")


@REGISTRY.query(
    "c61_quantize_errors",
    f"""WITH {_TAGGED}, e AS (SELECT sample_id, len(a) > 0 AS uncertain, round(abs(start_sec - round(start_sec * 8) / 8), 6) AS err FROM r)
  SELECT sample_id, count(*) AS n_notes, count(*) FILTER (uncertain) AS n_uncertain, round(avg(err), 9) AS mean_error, round(quantile_cont(err, 0.95), 9) AS p95_error, max(err) AS max_error FROM e GROUP BY 1""",
)
def c61_quantize_errors(spark, sf):
    """The errors of notes against a grid of an eighth second: mean, 95th percentile and largest."""
    err = F.round(F.abs(F.col("start_sec") - F.round(F.col("start_sec") * 8) / 8), 6)
    e = _tagged(spark, sf).withColumn("err", err)
    return e.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_notes"), F.count_if("uncertain").alias("n_uncertain"), F.round(F.avg("err"), 9).alias("mean_error"), F.round(F.percentile("err", 0.95), 9).alias("p95_error"), F.max("err").alias("max_error"))


@REGISTRY.query(
    "c65_first_filled",
    f"""WITH {NOTES}, g AS (SELECT sample_id, coalesce(list(note_seq ORDER BY note_seq) FILTER (note_seq % 50 = 0), []) AS a, list(note_seq ORDER BY note_seq) FILTER (note_seq % 40 = 1) AS b, coalesce(list(note_seq ORDER BY note_seq) FILTER (note_seq % 30 = 2), []) AS c FROM notes GROUP BY 1)
  SELECT sample_id, CASE WHEN len(a) > 0 THEN 'selected' WHEN len(b) > 0 THEN 'notes' WHEN len(c) > 0 THEN 'legacy' ELSE 'none' END AS source, CAST(coalesce(len(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c END), 0) AS INT) AS n_notes FROM g""",
)
def c65_first_filled(spark, sf):
    """The first list of notes that has any, and where it is from."""
    lists = [F.collect_list(F.when(F.col("note_seq") % m == k, F.col("note_seq"))) for m, k in ((50, 0), (40, 1), (30, 2))]
    g = T.notes(spark, sf).groupBy("sample_id").agg(*(x.alias(n) for x, n in zip(lists, "abc", strict=True)))
    array, source = R.first_filled((F.col("a"), "selected"), (F.when(F.size("b") > 0, F.col("b")), "notes"), (F.col("c"), "legacy"))
    return g.select("sample_id", source.alias("source"), F.size(array).alias("n_notes"))


@REGISTRY.query(
    "c69_frame_hop",
    f"""WITH {NOTES}, f AS (SELECT sample_id, round(start_sec, 6) AS t FROM notes WHERE sample_id % 9 > 0 OR note_seq IN (SELECT min(note_seq) FROM notes GROUP BY sample_id)), d AS (SELECT sample_id, round(t - lag(t) OVER (PARTITION BY sample_id ORDER BY t), 6) AS d FROM f)
  SELECT sample_id, coalesce(median(d) FILTER (d > 0), 0.01{_D}) AS hop_sec FROM d GROUP BY 1""",
)
def c69_frame_hop(spark, sf):
    """The step between frames, estimated by its median."""
    n = T.notes(spark, sf)
    first = n.groupBy("sample_id").agg(F.min("note_seq").alias("note_seq"))
    some = n.where("sample_id % 9 > 0").unionByName(n.where("sample_id % 9 = 0").join(first, ["sample_id", "note_seq"], "left_semi").select(*n.columns))
    return R.frame_hop(some.select("sample_id", F.col("start_sec").alias("time_sec")), "sample_id", 0.01, width=10.0)
