"""Queries on the arrangement of two sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrangement as A
from ..operators import hook as H
from ..operators import monophonic as M
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

_STATES = ["vocal", "Handoff", "instrumental", "chorus", "voice"]


def _arranged(spark, sf):
    """Segments of two seconds; two thirds of the notes are of the source that leads."""
    n = T.notes(spark, sf)
    segments = n.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("segment_id"))
    at = F.col("segment_id")
    state = F.element_at(F.array(*map(F.lit, _STATES)), ((F.col("sample_id") + at) % 5 + 1).cast("int"))
    segments = segments.select("sample_id", "segment_id", (at * 2.0).alias("start_sec"), (at * 2.0 + 2).alias("end_sec"), state.alias("state"))
    return A.arrange(segments, n.where("note_seq % 3 > 0"), n.where("note_seq % 3 = 0"), "sample_id", width=2.0)


def _limited(name: str, of: str) -> str:
    """The limiter as a walk over the notes of a segment by rank; `of` has a limit for each."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, segment_id ORDER BY confidence DESC, start_sec - end_sec, start_sec, pitch, note_seq) AS k FROM {of}),
  {name}_w AS (SELECT DISTINCT sample_id, segment_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a DOUBLE, b DOUBLE, id BIGINT)[]) AS kept FROM {name}_r UNION ALL
    SELECT sample_id, segment_id, k, CASE WHEN list_max(list_transform(list_append(list_transform(list_filter(kept, lambda x: x.a > a AND x.a < b), lambda x: x.a), a), lambda p: len(list_filter(kept, lambda x: x.a <= p AND p < x.b)))) < most THEN list_append(kept, {{'a': a, 'b': b, 'id': note_seq}}) ELSE kept END
    FROM (SELECT r.sample_id, r.segment_id, r.k, w.kept, r.start_sec AS a, r.end_sec AS b, r.note_seq, r.most FROM {name}_w w JOIN {name}_r r ON r.sample_id = w.sample_id AND r.segment_id = w.segment_id AND r.k = w.k + 1)),
  {name} AS (SELECT sample_id, segment_id, unnest(kept).id AS note_seq FROM (SELECT sample_id, segment_id, arg_max(kept, k) AS kept FROM {name}_w GROUP BY 1, 2))"""


_ARRANGED = f"""{NOTES}, seg AS (SELECT sample_id, segment_id::INT AS segment_id, segment_id * 2.0::DOUBLE AS a, segment_id * 2.0::DOUBLE + 2 AS b, ['vocal', 'transition', 'instrumental', 'climax', 'vocal'][(sample_id + segment_id) % 5 + 1] AS kind FROM (SELECT DISTINCT sample_id FROM notes), range(15) t(segment_id)),
  ins AS (SELECT s.segment_id, s.kind, s.a, s.b, n.* FROM notes n JOIN seg s ON s.sample_id = n.sample_id AND n.end_sec > s.a AND n.start_sec < s.b),
  one AS (SELECT *, 1 AS most FROM ins WHERE note_seq % 3 > 0), sung AS (SELECT * FROM one WHERE kind <> 'instrumental'),
  {_limited("led", "sung")},
  two AS (SELECT *, CASE WHEN kind = 'instrumental' THEN 3 WHEN kind = 'climax' OR (kind = 'vocal' AND count(*) OVER (PARTITION BY sample_id, segment_id) / (b - a) >= 1.2) THEN 2 ELSE 1 END AS most FROM ins WHERE note_seq % 3 = 0),
  clash AS (SELECT DISTINCT t.sample_id, t.segment_id, t.note_seq FROM two t JOIN led l ON l.sample_id = t.sample_id AND l.segment_id = t.segment_id JOIN notes n ON n.note_seq = l.note_seq AND t.end_sec > n.start_sec AND n.end_sec > t.start_sec AND abs(t.pitch - n.pitch) <= 2),
  free AS (SELECT * FROM two WHERE (sample_id, segment_id, note_seq) NOT IN (SELECT (sample_id, segment_id, note_seq) FROM clash)),
  {_limited("held", "free")},
  judged AS (
    SELECT sample_id, segment_id, 'lead' AS source, note_seq, start_sec, end_sec, pitch, kind, CASE WHEN kind = 'instrumental' THEN 'lead_in_instrumental' WHEN (sample_id, segment_id, note_seq) NOT IN (SELECT (sample_id, segment_id, note_seq) FROM led) THEN 'lead_limit' END AS reason FROM one
    UNION ALL SELECT sample_id, segment_id, 'support', note_seq, start_sec, end_sec, pitch, kind, CASE WHEN (sample_id, segment_id, note_seq) IN (SELECT (sample_id, segment_id, note_seq) FROM clash) THEN 'conflicts_with_lead' WHEN (sample_id, segment_id, note_seq) NOT IN (SELECT (sample_id, segment_id, note_seq) FROM held) THEN 'support_limit' END FROM two)"""


@REGISTRY.query("i25_source_arbitration", f"WITH RECURSIVE {_ARRANGED} SELECT sample_id, segment_id, source, note_seq, kind, reason, reason IS NULL AS kept FROM judged")
def i25_source_arbitration(spark, sf):
    """Which notes of both sources stay in each stretch, and why the others go."""
    return _arranged(spark, sf).select("sample_id", "segment_id", "source", "note_seq", "kind", "reason", "kept")


@REGISTRY.query("i25_arranged_notes", f"WITH RECURSIVE {_ARRANGED} SELECT sample_id, source, min(note_seq) AS note_seq, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, pitch FROM judged WHERE reason IS NULL GROUP BY sample_id, source, judged.start_sec, judged.end_sec, pitch")
def i25_arranged_notes(spark, sf):
    """The notes that stay, each once."""
    n = A.owned_once(_arranged(spark, sf), "sample_id")
    return n.select("sample_id", "source", "note_seq", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "pitch")


@REGISTRY.query("c30_instrumental_hook")
def c30_instrumental_hook(spark, sf):
    """The top line of support notes in instrumental segments."""
    n, q = T.notes(spark, sf), F.col("note_seq")
    segments = n.where("note_seq % 4 = 0").select("sample_id", (F.col("start_sec") - 0.4).alias("start_sec"), (F.col("end_sec") + 0.4).alias("end_sec"), F.when(q % 8 == 0, " Instrumental").otherwise("vocal").alias("state"))
    out = H.instrumental_hook(n.where("note_seq % 4 > 0"), segments, "sample_id", width=10.0)
    return out.withColumns({"start_sec": F.round("start_sec", 6), "end_sec": F.round("end_sec", 6)})


@REGISTRY.query("c35_snapped_monophonic")
def c35_snapped_monophonic(spark, sf):
    """Notes on a grid of sixteenths, one at a time for each pitch."""
    n = T.notes(spark, sf).withColumn("pitch", 60 + F.col("pitch") % 4)
    out = M.snapped_monophonic(n, "sample_id", 100.0, transpose=1, offset=-0.05, sure=0.2, lowest=61, highest=63, least=0.1, width=10.0)
    return out.withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec", "confidence")})
