"""Queries on the repair of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases as P
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

RULES = P.PhraseRules()
r6 = lambda c: F.round(c, 6)


def _notes(spark, sf):
    """Pitches around 60, so that neighbours are near now and then; every eleventh note is to stay as it is."""
    n = T.notes(spark, sf)
    pitch = 60 + F.col("pitch") % 5 + F.when(F.col("note_seq") % 13 == 0, 12).otherwise(0)
    return n.select("sample_id", "note_seq", "start_sec", "end_sec", pitch.alias("pitch"), "confidence", (F.col("note_seq") % 11 == 0).alias("fixed"))


SUNG = f"""{NOTES}, sung AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s, e, note_seq) AS k, count(*) OVER (PARTITION BY sample_id) AS n_notes FROM (
    SELECT sample_id, note_seq, round(start_sec, 6) AS s, round(end_sec, 6) AS e, (60 + pitch % 5 + CASE WHEN note_seq % 13 = 0 THEN 12 ELSE 0 END)::DOUBLE AS p, round(confidence, 6) AS c, note_seq % 11 = 0 AS f FROM notes)
)"""
_WEIGHT = "greatest(0.001::DOUBLE, round({0}.e - {0}.s, 6)) * greatest(0.001::DOUBLE, {0}.c)"
_PITCH = f"round_even(({{0}}.p * ({_WEIGHT.format('{0}')}) + {{1}}.p * ({_WEIGHT.format('{1}')})) / ({_WEIGHT.format('{0}')} + {_WEIGHT.format('{1}')}), 0)"


def _out(df):
    return df.select("sample_id", "note_seq", *(r6(c).alias(c) for c in ("start_sec", "end_sec", "pitch", "confidence")), "n_merged")


@REGISTRY.query(
    "i12_bridge_merge",
    f"""WITH RECURSIVE {SUNG}, m AS (
    SELECT sample_id, k, note_seq, s, e, p, c, f, 1 AS n FROM sung WHERE k = 1
    UNION ALL SELECT sample_id, k, CASE WHEN j THEN m.note_seq ELSE o.note_seq END, CASE WHEN j THEN m.s ELSE o.s END, CASE WHEN j THEN greatest(m.e, o.e) ELSE o.e END, CASE WHEN j THEN {_PITCH.format("m", "o")} ELSE o.p END,
      CASE WHEN j THEN greatest(m.c, o.c) ELSE o.c END, CASE WHEN j THEN m.f ELSE o.f END, CASE WHEN j THEN m.n + 1 ELSE 1 END
    FROM (SELECT o.sample_id, o.k, m, o, o.s - m.e > 0 AND o.s - m.e <= 0.08 AND NOT m.f AND NOT o.f AND abs(m.p - o.p) <= 1 AS j FROM m JOIN sung o ON o.sample_id = m.sample_id AND o.k = m.k + 1)
  )
  SELECT sample_id, note_seq, round(arg_max(s, k), 6) AS start_sec, round(arg_max(e, k), 6) AS end_sec, round(arg_max(p, k), 6) AS pitch, round(arg_max(c, k), 6) AS confidence, CAST(max(n) AS INT) AS n_merged FROM m GROUP BY sample_id, note_seq""",
)
def i12_bridge_merge(spark, sf):
    """Gaps, not overlaps, of at most 0.08 seconds between notes that may change are bridged; the pitch is weighted by length and confidence."""
    return _out(P.by_phrase(_notes(spark, sf), "sample_id", RULES.short_gap, lambda notes: P.bridge(notes, RULES)))


_LONG = "round({0}.e - {0}.s, 6)"
_MIN = f"least({_LONG.format('a')}, {_LONG.format('b')})"


@REGISTRY.query(
    "i18_absorb_short",
    f"""WITH RECURSIVE {SUNG}, m AS (
    SELECT sample_id, n_notes, k + 1 AS k, {{'id': note_seq, 's': s, 'e': e, 'p': p, 'c': c, 'n': 1}} AS a FROM sung WHERE k = 1
    UNION ALL SELECT sample_id, n_notes, CASE WHEN j THEN k + 2 ELSE k + 1 END,
      CASE WHEN j THEN {{'id': a.id, 's': a.s, 'e': greatest(a.e, x.e, b.e), 'p': {_PITCH.format("a", "b")}, 'c': greatest(a.c, x.c, b.c), 'n': a.n + 2}} ELSE {{'id': x.note_seq, 's': x.s, 'e': x.e, 'p': x.p, 'c': x.c, 'n': 1}} END
    FROM (
      SELECT m.sample_id, m.n_notes, m.k, a, x, b, coalesce(x.s - a.e BETWEEN 0 AND 0.12 AND b.s - x.e BETWEEN 0 AND 0.12 AND abs(a.p - b.p) <= 1 AND {_LONG.format("x")} <= 0.18 AND {_MIN} >= 0.12 AND {_LONG.format("x")} <= 0.75::DOUBLE * {_MIN}
        AND x.c <= greatest(a.c, b.c) + 0.05::DOUBLE AND x.c <= least(0.7::DOUBLE, least(a.c, b.c) + 0.05::DOUBLE) AND (abs(x.p - round_even((a.p + b.p) / 2, 0)) >= 2 OR x.c <= least(a.c, b.c) + 0.05::DOUBLE), FALSE) AS j
      FROM m JOIN sung x ON x.sample_id = m.sample_id AND x.k = m.k LEFT JOIN sung b ON b.sample_id = m.sample_id AND b.k = m.k + 1)
  )
  SELECT sample_id, a.id AS note_seq, round(arg_max(a.s, k), 6) AS start_sec, round(arg_max(a.e, k), 6) AS end_sec, round(arg_max(a.p, k), 6) AS pitch, round(arg_max(a.c, k), 6) AS confidence, CAST(max(a.n) AS INT) AS n_merged FROM m GROUP BY sample_id, a.id""",
)
def i18_absorb_short(spark, sf):
    """A short weak note between two of nearly one pitch makes one note with them."""
    return _out(P.by_phrase(_notes(spark, sf), "sample_id", RULES.phrase_gap, lambda notes: P.absorb(notes, RULES)))


@REGISTRY.query(
    "i17_octave_fix",
    f"""WITH RECURSIVE {SUNG}, m AS (
    SELECT sample_id, k, note_seq, p AS before, p AS after, e FROM sung WHERE k = 1
    UNION ALL SELECT sample_id, k, note_seq, p, p + coalesce(CASE WHEN near AND j1 >= 10 AND w.t < j0 AND w.t + 2 <= j0 AND w.m < j1 THEN w.s END, 0), e FROM (
      SELECT o.*, abs(o.p - m.after) + abs(o.p - b.p) AS j0, greatest(abs(o.p - m.after), abs(o.p - b.p)) AS j1,
        coalesce(o.s - m.e BETWEEN 0 AND 0.08 AND b.s - o.e BETWEEN 0 AND 0.08 AND abs(m.after - b.p) <= 1 AND NOT (round(o.e - o.s, 6) > 0.25 AND o.c >= 0.58), FALSE) AS near,
        list_sort(list_transform(list_filter([-24, -12, 12, 24], lambda z: o.p + z BETWEEN 48 AND 84), lambda z: {{'t': abs(o.p + z - m.after) + abs(o.p + z - b.p), 'm': greatest(abs(o.p + z - m.after), abs(o.p + z - b.p)), 'a': abs(z), 's': z}}))[1] AS w
      FROM m JOIN sung o ON o.sample_id = m.sample_id AND o.k = m.k + 1 LEFT JOIN sung b ON b.sample_id = o.sample_id AND b.k = o.k + 1)
  ) SELECT sample_id, note_seq, round(before, 6) AS before, round(after, 6) AS after FROM m""",
)
def i17_octave_fix(spark, sf):
    """Single notes an octave or two off between neighbours of nearly one pitch."""
    n = _notes(spark, sf)
    now = P.by_phrase(n, "sample_id", RULES.outlier_gap, lambda notes: P.octave_outliers(notes, RULES))
    before = n.select("sample_id", "note_seq", r6(F.col("pitch").cast("double")).alias("before"))
    return now.join(before, ["sample_id", "note_seq"]).select("sample_id", "note_seq", "before", r6("pitch").alias("after"))


@REGISTRY.query("i21_phrase_repair")
def i21_phrase_repair(spark, sf):
    """All rules of phrases, at most two passes, each for the samples that the one before has changed; with I17 and W6 as its steps."""
    return _out(P.repair_phrases(_notes(spark, sf), "sample_id", RULES))


@REGISTRY.query(
    "c54_bridges_and_outliers",
    f"""WITH RECURSIVE {SUNG}, w AS (
    SELECT *, round(e - s, 6) < 0.12 AS short, s - lag(e) OVER o AS l, lead(s) OVER o - e AS r, lead(s) OVER o - lag(e) OVER o AS x FROM sung WINDOW o AS (PARTITION BY sample_id ORDER BY k)
  ), kept AS (
    SELECT sample_id, note_seq, s, e, p, c, short AS bridged, row_number() OVER (PARTITION BY sample_id ORDER BY k) AS k FROM w
    WHERE NOT short OR coalesce(c >= 0.45 AND l >= 0 AND r >= 0 AND x > 0 AND ((x > 0.5 AND (l <= 0.5 OR r <= 0.5)) OR (x > 0.05 AND (l <= 0.05 OR r <= 0.05))), FALSE)
  ), m AS (
    SELECT sample_id, k, note_seq, s, e, p, c, bridged FROM kept WHERE k = 1
    UNION ALL SELECT sample_id, k, note_seq, s, e, CASE WHEN j AND abs(p - anchor) BETWEEN 2 AND 4 THEN anchor ELSE p END, c, bridged FROM (
      SELECT n.*, CASE WHEN a.c > b.c OR (a.c = b.c AND round(a.e - a.s, 6) >= round(b.e - b.s, 6)) THEN a.p ELSE b.p END AS anchor,
        coalesce(n.s - a.e BETWEEN 0 AND 0.08 AND b.s - n.e BETWEEN 0 AND 0.08 AND abs(a.p - b.p) <= 1 AND NOT (round(n.e - n.s, 6) > 0.25 AND n.c >= 0.58)
          AND NOT (n.c >= greatest(a.c, b.c) AND round(n.e - n.s, 6) >= least(round(a.e - a.s, 6), round(b.e - b.s, 6))), FALSE) AS j
      FROM m a JOIN kept n ON n.sample_id = a.sample_id AND n.k = a.k + 1 LEFT JOIN kept b ON b.sample_id = n.sample_id AND b.k = n.k + 1)
  ) SELECT sample_id, note_seq, round(s, 6) AS start_sec, round(e, 6) AS end_sec, round(p, 6) AS pitch, bridged FROM m""",
)
def c54_bridges_and_outliers(spark, sf):
    """Short notes stay where they bridge a pause, then outliers take the pitch of a neighbour."""
    six = lambda c: r6(F.col(c)).alias(c)
    kept = P.keep_bridges(_notes(spark, sf).select("sample_id", "note_seq", six("start_sec"), six("end_sec"), "pitch", six("confidence")), "sample_id", width=30)
    now = P.by_phrase(kept, "sample_id", RULES.outlier_gap, lambda notes: P.smooth_outliers(notes, RULES))
    return now.join(kept.select("sample_id", "note_seq", "bridged"), ["sample_id", "note_seq"]).select("sample_id", "note_seq", six("start_sec"), six("end_sec"), six("pitch"), "bridged")
