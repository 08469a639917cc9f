"""Queries on MIDI: the samples written as files in memory and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.folds import fold_each
from ..sources import midi as M
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

BEAT = 480


def _files(spark, sf):
    """One file a sample: tempos in the first track, the notes of two channels in two more; 960 ticks a second at the tempo that is in force unless set."""
    n = T.notes(spark, sf)
    tick = lambda c: F.round(F.col(c) * 960).cast("long")
    n = n.select("sample_id", F.lit(0).alias("__run"), tick("start_sec").alias("a"), F.greatest(tick("end_sec"), tick("start_sec") + 1).alias("b"), "pitch", "velocity", (F.col("note_seq") % 2).cast("int").alias("side"), "note_seq")

    def fold(rows: list[tuple]) -> list[tuple]:
        tracks = [[(0, M.name_message("Conductor"))], [(0, M.name_message(" Lead "))], [(0, M.name_message("Drums"))]]
        tempos, events = [], [[], []]
        for a, b, pitch, velocity, side, seq in rows:
            channel = 9 if side else 2
            events[side] += [(a, 2, seq, bytes([144 | channel, pitch, velocity])), (b, 1, seq, bytes([144 | channel, pitch, 0]) if seq % 3 else bytes([128 | channel, pitch, 64]))]
            if velocity % 5 == 0:
                tempos.append((a, seq, M.tempo_message(400_000 + pitch * 1000)))
            if seq % 7 == 0:
                events[side].append((a, 0, seq, bytes([192 | channel, pitch])))
        tracks[0] += [(t, m) for t, _, m in sorted(tempos)]
        for k in (0, 1):
            tracks[k + 1] += [(t, m) for t, _, _, m in sorted(events[k])]
        return [(bytearray(M.encode(BEAT, tracks)),)]

    return fold_each(n, "sample_id", fold, "content binary", ["a", "b", "pitch", "velocity", "side", "note_seq"], ["a", "note_seq"])


MIDI = f"""{NOTES}, n AS (
  SELECT sample_id, round(start_sec * 960)::BIGINT AS a, greatest(round(end_sec * 960)::BIGINT, round(start_sec * 960)::BIGINT + 1) AS b, pitch, velocity, note_seq % 2 AS side, note_seq FROM notes
), tempo AS (
  SELECT sample_id, a AS t, arg_max(400000 + pitch * 1000, note_seq) AS tempo FROM n WHERE velocity % 5 = 0 GROUP BY 1, 2 UNION ALL SELECT DISTINCT sample_id, 0, 500000 FROM n WHERE sample_id NOT IN (SELECT sample_id FROM n WHERE velocity % 5 = 0 AND a = 0)
), timed AS (
  SELECT sample_id, t, tempo, coalesce(sum(piece) OVER (PARTITION BY sample_id ORDER BY t), 0)::BIGINT AS passed FROM (SELECT *, (t - lag(t) OVER w) * (lag(tempo) OVER w) AS piece FROM tempo WINDOW w AS (PARTITION BY sample_id ORDER BY t))
), ons AS (
  SELECT x.*, row_number() OVER (PARTITION BY x.sample_id, side, pitch ORDER BY a, note_seq) AS k, (SELECT arg_max(p.pitch, {{'a': p.a, 's': p.note_seq}}) FROM n p WHERE p.sample_id = x.sample_id AND p.side = x.side AND p.note_seq % 7 = 0 AND p.a <= x.a) AS program FROM n x
), offs AS (SELECT sample_id, side, pitch, b, row_number() OVER (PARTITION BY sample_id, side, pitch ORDER BY b, note_seq) AS k FROM n
), made AS (
  SELECT o.sample_id, (o.side + 1)::INT AS track, CASE WHEN o.side = 1 THEN 9 ELSE 2 END AS channel, o.program::INT AS program, o.pitch, o.velocity, o.a, f.b, (x.passed + (o.a - x.t) * x.tempo) / 480e6::DOUBLE AS start_sec
  FROM ons o JOIN offs f USING (sample_id, side, pitch, k) ASOF JOIN timed x ON x.sample_id = o.sample_id AND o.a >= x.t
), read AS (SELECT m.*, (y.passed + (m.b - y.t) * y.tempo) / 480e6::DOUBLE AS end_sec FROM made m ASOF JOIN timed y ON y.sample_id = m.sample_id AND m.b >= y.t)"""


@REGISTRY.query("s3_midi_notes", f"WITH {MIDI} SELECT sample_id, track, channel, program, pitch, velocity, start_sec, end_sec FROM read")
def s3_midi_notes(spark, sf):
    """Files to notes, with tempo changes of another track and the program in force.

    Times are not rounded: each is one division of whole numbers, the same everywhere.
    """
    n = M.midi_notes(M.midi_events(_files(spark, sf), "sample_id"))
    return n.select(F.col("path").alias("sample_id"), "track", "channel", "program", "pitch", "velocity", "start_sec", "end_sec")


@REGISTRY.query(
    "s4_midi_tracks",
    f"""WITH {MIDI}, t AS (SELECT DISTINCT sample_id, unnest([0, 1, 2])::INT AS track FROM n)
  SELECT t.sample_id, t.track, ['Conductor', ' Lead ', 'Drums'][t.track + 1] AS name, (SELECT arg_min(pitch, {{'a': a, 's': note_seq}}) FROM n WHERE n.sample_id = t.sample_id AND side + 1 = t.track AND note_seq % 7 = 0)::INT AS program,
    t.track = 2 AND count(pitch) > 0 AS is_drum, count(pitch) AS n_notes, coalesce(max(end_sec), 0)::DOUBLE AS duration_sec, min(pitch) AS min_pitch, max(pitch) AS max_pitch, t.track = 1 AS is_lead
  FROM t LEFT JOIN read r ON r.sample_id = t.sample_id AND r.track = t.track GROUP BY t.sample_id, t.track""",
)
def s4_midi_tracks(spark, sf):
    """S4, and S8: the track that is called lead."""
    t = M.midi_tracks(M.midi_events(_files(spark, sf), "sample_id"))
    lead = M.track_by_name(t, "LEAD").withColumn("is_lead", F.lit(True))
    t = t.join(lead, ["path", "track"], "left").fillna({"is_lead": False})
    return t.select(F.col("path").alias("sample_id"), "track", "name", "program", "is_drum", "n_notes", "duration_sec", "min_pitch", "max_pitch", "is_lead")
