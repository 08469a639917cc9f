"""Queries on documents of different shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import json_notes as J
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

r6 = lambda c: F.round(c, 6)
_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def _documents(spark, sf):
    """A document for each sample, in one of three shapes; in the last the notes lie five levels deep."""
    n = T.notes(spark, sf)
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), F.col("pitch") % 12 + 1), (F.floor(F.col("pitch") / 12) - 1).cast("string"))
    plain = F.struct(F.col("start_sec").alias("start_time"), F.col("end_sec").alias("end_time"), F.col("pitch").alias("pitch_midi"))
    named = F.struct(F.col("start_sec").cast("string").alias("onset_sec"), F.lit(0.25).alias("duration_sec"), name.alias("pitch"), F.struct(F.col("start_sec").alias("time_sec"), F.lit("7").alias("pitch")).alias("echo"))
    heard = F.struct(F.col("start_sec").alias("start"), F.lit(2).alias("duration_beats"), F.lit(120).alias("tempo_bpm"), (F.lit(440.0) * F.pow(F.lit(2.0), (F.col("pitch") - 69) / F.lit(12.0))).alias("f0_hz"))
    every = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("note_seq", x.alias("x")))), lambda y: y["x"])
    g = n.groupBy("sample_id").agg(every(plain).alias("plain"), every(named).alias("named"), every(heard).alias("heard"))
    shapes = [
        F.to_json(F.struct(F.struct(F.col("plain").alias("notes")).alias("melody_candidates"), F.struct(F.lit(1.0).alias("start"), F.lit(5).alias("pitch")).alias("extra"))),
        F.to_json(F.struct(F.col("named").alias("selected_notes"), F.lit("x").alias("notes"))),
        F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.col("heard")).alias("c"))).alias("b")).alias("a"), F.struct(F.lit(2.0).alias("start"), F.lit("none").alias("pitch")).alias("z"))),
    ]
    return g.select("sample_id", F.element_at(F.array(*shapes), (F.col("sample_id") % 3 + 1).cast("int")).alias("text"))


def _any(names):
    return "list_has_any(json_keys(v), [" + ", ".join(f"'{n}'" for n in names) + "])"


def _first(names):
    return "coalesce(" + ", ".join(f"v->>'$.{n}'" for n in names) + ")"


_NUMBER = lambda names: f"try_cast({_first(names)} AS DOUBLE)"


@REGISTRY.query(
    "c52_json_notes",
    f"""WITH {NOTES}, g AS (
    SELECT sample_id, list({{'start_time': start_sec, 'end_time': end_sec, 'pitch_midi': pitch}} ORDER BY note_seq) AS plain,
      list({{'onset_sec': start_sec::VARCHAR, 'duration_sec': 0.25::DOUBLE, 'pitch': {_NAMES}[pitch % 12 + 1] || (pitch // 12 - 1), 'echo': {{'time_sec': start_sec, 'pitch': '7'}}}} ORDER BY note_seq) AS named,
      list({{'start': start_sec, 'duration_beats': 2, 'tempo_bpm': 120, 'f0_hz': 440.0::DOUBLE * pow(2.0::DOUBLE, (pitch - 69) / 12.0::DOUBLE)}} ORDER BY note_seq) AS heard FROM notes GROUP BY sample_id),
  d AS (SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN to_json({{'melody_candidates': {{'notes': plain}}, 'extra': {{'start': 1.0, 'pitch': 5}}}}) WHEN 1 THEN to_json({{'selected_notes': named, 'notes': 'x'}}) ELSE to_json({{'a': {{'b': [{{'c': [heard]}}]}}, 'z': {{'start': 2.0, 'pitch': 'none'}}}}) END AS j FROM g),
  p AS (SELECT sample_id, coalesce({", ".join(f"CASE WHEN json_type(j, '{x}') = 'ARRAY' THEN json_extract(j, '{x}') END" for x in J.PREFERRED)}, j) AS j FROM d),
  items AS (SELECT sample_id, t.fullkey AS path, t.value AS v FROM p, json_tree(p.j) t WHERE t.type = 'OBJECT'),
  noted AS (SELECT *, {_first(J.NAMED)} AS named FROM items WHERE {_any(J.HAS_TIME)} AND {_any(J.HAS_PITCH)}),
  made AS (SELECT sample_id, path, {_NUMBER(J.START)} AS a, {_NUMBER(J.END)} AS b, coalesce({_NUMBER(J.LENGTH)}, CASE WHEN (v->>'$.tempo_bpm')::DOUBLE > 0 THEN (v->>'$.duration_beats')::DOUBLE * (60.0::DOUBLE / (v->>'$.tempo_bpm')::DOUBLE) END) AS len,
    coalesce({_NUMBER(J.PITCH)}, try_cast(named AS DOUBLE), list_position({_NAMES}, nullif(regexp_extract(named, '^([A-G]#?)(-?[0-9]+)$', 1), '')) - 1 + 12 * (try_cast(regexp_extract(named, '^([A-G]#?)(-?[0-9]+)$', 2) AS INT) + 1), 69 + 12 * log2({_NUMBER(J.HERTZ)} / 440)) AS pitch FROM noted)
  SELECT sample_id, path, round(a, 6) AS start_sec, round(coalesce(b, a + len, a), 6) AS end_sec, CAST(round_even(pitch, 0) AS INT) AS pitch FROM made WHERE a IS NOT NULL AND pitch IS NOT NULL""",
)
def c52_json_notes(spark, sf):
    """Note rows from documents of any shape, wherever they lie."""
    n = J.json_notes(_documents(spark, sf), "sample_id", "text")
    return n.select("sample_id", "path", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "pitch")
