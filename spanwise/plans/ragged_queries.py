"""Queries on positional joins, lookups near intervals or points, and rescue by context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment_rules as A
from ..operators import ragged as R
from ..operators import windows as X
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

ORDER = ["start_sec", "end_sec", "note_seq"]
r6 = lambda c: F.round(c, 6)


@REGISTRY.query(
    "j21_group_zip",
    f"""WITH RECURSIVE {NOTES}, token AS (SELECT sample_id, note_seq AS token, ['zh', 'en', 'xx'][1 + note_seq % 3] AS lang, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec, note_seq) AS i FROM notes WHERE event_type = 'view'),
  note AS (SELECT sample_id, note_seq AS note, confidence, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, end_sec, note_seq) AS j FROM notes WHERE event_type <> 'view' AND (sample_id % 3 > 0 OR note_seq % 4 = 0)),
  size AS (SELECT sample_id, (SELECT count(*) FROM token t WHERE t.sample_id = s.sample_id) AS t, (SELECT count(*) FROM note n WHERE n.sample_id = s.sample_id) AS n FROM (SELECT DISTINCT sample_id FROM token) s),
  walk AS (
    SELECT sample_id, t, n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS g FROM size
    UNION ALL SELECT sample_id, t, n, i + 1, cursor + g, CASE WHEN n - cursor - g <= t - i THEN 1 WHEN n - cursor - g - (t - i) >= 4 THEN 3 WHEN n - cursor - g - (t - i) >= 2 THEN 2 ELSE 1 END FROM walk WHERE i < t AND cursor + g < n),
  paired AS (SELECT w.sample_id, k.token, k.lang, w.g, o.note, o.confidence FROM walk w JOIN token k ON k.sample_id = w.sample_id AND k.i = w.i JOIN note o ON o.sample_id = w.sample_id AND o.j > w.cursor AND o.j <= w.cursor + w.g WHERE w.i > 0)
  SELECT sample_id, token, CAST(count(*) AS BIGINT) AS n_notes, min(note) AS first_note, max(note) AS last_note, count(*) > 1 AS melisma,
    greatest(0.6, least(0.9, round((CASE WHEN count(*) > 1 THEN 0.74::DOUBLE ELSE 0.84::DOUBLE END + CASE lang WHEN 'zh' THEN 0.01::DOUBLE WHEN 'en' THEN 0::DOUBLE ELSE -0.02::DOUBLE END) * 0.7::DOUBLE + avg(confidence) * 0.3::DOUBLE, 4)))::DOUBLE AS confidence
  FROM paired GROUP BY sample_id, token, lang""",
)
def j21_group_zip(spark, sf):
    """Notes in groups of one to three to tokens by position; a third of the samples has fewer notes than tokens."""
    n = T.notes(spark, sf)
    tokens = n.where("event_type = 'view'").select("sample_id", F.col("note_seq").alias("token"), F.element_at(F.array(*map(F.lit, ("zh", "en", "xx"))), (1 + F.col("note_seq") % 3).cast("int")).alias("lang"), *(F.col(c).alias(f"t_{c}") for c in ORDER))
    notes = n.where("event_type <> 'view' AND (sample_id % 3 > 0 OR note_seq % 4 = 0)").select("sample_id", F.col("note_seq").alias("note"), F.col("confidence").alias("sure"), *ORDER)
    both = R.group_zip(tokens, notes, "sample_id", [f"t_{c}" for c in ORDER], ORDER, F.floor(F.col("t_start_sec") / 10), F.floor(F.col("start_sec") / 10))
    g = both.groupBy("sample_id", "token", "lang").agg(F.count(F.lit(1)).alias("n_notes"), F.min("note").alias("first_note"), F.max("note").alias("last_note"), F.avg("sure").alias("sure"))
    # How sure one note and several are, by language, and weights.
    base = F.when(F.col("n_notes") > 1, 0.74).otherwise(0.84) + F.when(F.col("lang") == "zh", 0.01).when(F.col("lang") == "en", 0.0).otherwise(-0.02)
    sure = F.greatest(F.lit(0.6), F.least(F.lit(0.9), F.round(base * 0.7 + F.col("sure") * 0.3, 4)))
    return g.select("sample_id", "token", "n_notes", "first_note", "last_note", (F.col("n_notes") > 1).alias("melisma"), sure.alias("confidence"))


@REGISTRY.query(
    "j22_frames_near",
    f"""WITH {NOTES}, span AS (SELECT sample_id, note_seq AS span_id, start_sec, end_sec, CASE WHEN note_seq % 3 = 0 THEN [start_sec - 0.5::DOUBLE, start_sec + 0.01::DOUBLE, end_sec + 0.3::DOUBLE, end_sec + 0.32::DOUBLE] END AS samples FROM notes WHERE note_seq % 5 = 0),
  frame AS (SELECT sample_id, note_seq, start_sec AS time_sec, voiced FROM notes),
  near AS (SELECT s.*, f.note_seq, f.time_sec, f.voiced FROM span s JOIN frame f ON f.sample_id = s.sample_id AND ((start_sec - 0.05::DOUBLE <= time_sec AND time_sec <= end_sec + 0.05::DOUBLE) OR len(list_filter(coalesce(samples, []), lambda t: abs(time_sec - t) <= 0.05::DOUBLE)) > 0))
  SELECT sample_id, span_id, arg_min(note_seq, {{'t': time_sec, 'n': note_seq}}) AS first_frame, arg_max(note_seq, {{'t': time_sec, 'n': note_seq}}) AS last_frame, CAST(count(*) AS BIGINT) AS n_frames, CAST(count(*) FILTER (voiced) AS BIGINT) AS n_voiced, bool_or(samples IS NOT NULL) AS by_samples FROM near GROUP BY sample_id, span_id""",
)
def j22_frames_near(spark, sf):
    """Frames within a tolerance of a span or of any of its sample times, and their range."""
    n = T.notes(spark, sf)
    samples = F.when(F.col("note_seq") % 3 == 0, F.array(F.col("start_sec") - 0.5, F.col("start_sec") + 0.01, F.col("end_sec") + 0.3, F.col("end_sec") + 0.32))
    spans = n.where("note_seq % 5 = 0").select("sample_id", F.col("note_seq").alias("span_id"), "start_sec", "end_sec", samples.alias("samples"))
    found = R.frames_near(spans, n.select("sample_id", "note_seq", F.col("start_sec").alias("time_sec"), "voiced"), "sample_id", "span_id", 0.05, 1.0)
    by = F.struct("time_sec", "note_seq")
    g = found.groupBy("sample_id", "span_id").agg(F.min_by("note_seq", by).alias("first_frame"), F.max_by("note_seq", by).alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), F.count_if("voiced").alias("n_voiced"))
    return g.withColumn("by_samples", F.col("span_id") % 3 == 0)


@REGISTRY.query("i20_octave_rescue")
def i20_octave_rescue(spark, sf):
    """Low notes an octave up where the context asks for it, in passes there and back."""
    n = T.notes(spark, sf)
    low = n.where("note_seq % 3 > 0").withColumn("pitch", 40 + F.col("pitch") % 8)
    context = n.where("note_seq % 3 = 0").withColumn("pitch", 52 + F.col("pitch") % 9)
    return R.rescue_low_octave(low, context, "sample_id", width=10.0)


_DRAFTS = f"""{NOTES}, token AS (SELECT sample_id, note_seq AS token_id, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq) - 1 AS i FROM notes WHERE event_type = 'view'),
  note AS (SELECT sample_id, note_seq AS note_id, note_seq % 29 = 0 AS ornament, row_number() OVER (PARTITION BY sample_id ORDER BY start_sec, note_seq) - 1 AS j FROM notes WHERE event_type <> 'view'),
  base AS (SELECT t.*, lag(token_id) OVER (PARTITION BY t.sample_id ORDER BY i) AS last, a.note_id AS a, b.note_id AS b FROM token t LEFT JOIN note a ON a.sample_id = t.sample_id AND a.j = i LEFT JOIN note b ON b.sample_id = t.sample_id AND b.j = i + 1),
  original AS (SELECT sample_id, i AS idx, token_id, FALSE AS melisma, list_filter([a], lambda x: x IS NOT NULL) AS note_ids FROM base WHERE i % 9 > 0),
  refined AS (SELECT sample_id, i AS idx, CASE WHEN sample_id % 2 = 1 AND token_id % 17 = 0 THEN -token_id WHEN sample_id % 4 = 2 AND token_id % 11 = 0 THEN coalesce(last, token_id) ELSE token_id END AS token_id, i % 4 = 0 AS melisma,
    list_filter(CASE WHEN sample_id % 3 = 0 AND i % 5 = 0 THEN [b, a] WHEN sample_id % 5 = 0 AND i % 7 = 3 THEN [-token_id] ELSE [a] END, lambda x: x IS NOT NULL) AS note_ids FROM base WHERE i % 8 > 0)"""


def _warned(name: str) -> str:
    return f"""{name}_e AS (SELECT e.*, t.i AS token_order, row_number() OVER (PARTITION BY e.sample_id, e.token_id ORDER BY idx) > 1 AS again, max(t.i) OVER (PARTITION BY e.sample_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {name} e LEFT JOIN token t ON t.sample_id = e.sample_id AND t.token_id = e.token_id),
  {name}_x AS (SELECT sample_id, idx, token_id, unnest(note_ids) AS note_id, generate_subscripts(note_ids, 1) AS pos FROM {name}),
  {name}_n AS (SELECT x.*, n.j AS note_order, n.ornament, row_number() OVER (PARTITION BY x.sample_id, x.note_id ORDER BY idx, pos) > 1 AS again FROM {name}_x x LEFT JOIN note n ON n.sample_id = x.sample_id AND n.note_id = x.note_id),
  {name}_o AS (SELECT *, max(o[-1]) OVER (PARTITION BY sample_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT sample_id, idx, token_id, list(note_order ORDER BY pos) AS o FROM {name}_n WHERE note_order IS NOT NULL GROUP BY 1, 2, 3)),
  {name}_w AS (
    SELECT sample_id, idx, unnest(list_filter([CASE WHEN again THEN 'duplicate_token' END, CASE WHEN token_order IS NULL THEN 'unknown_token' END, CASE WHEN token_order < before THEN 'token_rollback' END, CASE WHEN len(note_ids) = 0 THEN 'empty_notes' END, CASE WHEN melisma AND len(note_ids) < 2 THEN 'melisma_of_one' END, CASE WHEN NOT melisma AND len(note_ids) > 1 THEN 'several_without_melisma' END], lambda k: k IS NOT NULL)) AS kind, token_id AS about FROM {name}_e
    UNION ALL SELECT sample_id, idx, unnest(list_filter([CASE WHEN note_order IS NULL THEN 'unknown_note' END, CASE WHEN again THEN 'duplicate_note' END, CASE WHEN ornament THEN 'ornament_note' END], lambda k: k IS NOT NULL)), note_id FROM {name}_n
    UNION ALL SELECT sample_id, idx, unnest(list_filter([CASE WHEN list_sort(o) <> o THEN 'rollback_inside' END, CASE WHEN o[1] < before THEN 'note_rollback' END], lambda k: k IS NOT NULL)), token_id FROM {name}_o)"""


def _drafts(spark, sf):
    n = T.notes(spark, sf)
    w = F.row_number().over(X.ordered(["sample_id"], ["start_sec", "note_seq"])).cast("long") - 1
    tokens = n.where("event_type = 'view'").select("sample_id", F.col("note_seq").alias("token_id"), w.alias("token_order"), F.lag("note_seq").over(X.ordered(["sample_id"], ["start_sec", "note_seq"])).alias("last"))
    notes = n.where("event_type <> 'view'").select("sample_id", F.col("note_seq").alias("note_id"), w.alias("note_order"), (F.col("note_seq") % 29 == 0).alias("ornament"))
    base = tokens.withColumn("i", F.col("token_order"))
    for name, by in (("a", 0), ("b", 1)):
        base = base.join(notes.select("sample_id", (F.col("note_order") - by).alias("i"), F.col("note_id").alias(name)), ["sample_id", "i"], "left")
    there = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    i, s, t = F.col("i"), F.col("sample_id"), F.col("token_id")
    original = base.where(i % 9 > 0).select("sample_id", i.alias("idx"), "token_id", F.lit(False).alias("melisma"), there("a").alias("note_ids"))
    token = F.when((s % 2 == 1) & (t % 17 == 0), -t).when((s % 4 == 2) & (t % 11 == 0), F.coalesce("last", t)).otherwise(t)
    ids = F.when((s % 3 == 0) & (i % 5 == 0), there("b", "a")).when((s % 5 == 0) & (i % 7 == 3), F.array(-t)).otherwise(there("a"))
    refined = base.where(i % 8 > 0).select("sample_id", i.alias("idx"), token.alias("token_id"), (i % 4 == 0).alias("melisma"), ids.alias("note_ids"))
    return original, refined, tokens.drop("last"), notes


@REGISTRY.query("c40_alignment_warnings", f"WITH {_DRAFTS}, {_warned('refined')} SELECT sample_id, idx, kind, about FROM refined_w")
def c40_alignment_warnings(spark, sf):
    """Everything wrong with an alignment of tokens to notes."""
    _, refined, tokens, notes = _drafts(spark, sf)
    return A.alignment_warnings(refined, tokens, notes, "sample_id")


_KINDS = {k: f"kind = '{k}'" for k in A.FATAL} | {"token_order_regression": "kind = 'token_rollback'", "note_order_regression": "kind IN ('rollback_inside', 'note_rollback')"}


@REGISTRY.query(
    "c40_accept_refined",
    f"""WITH {_DRAFTS}, {_warned("original")}, {_warned("refined")},
  s AS (SELECT sample_id, count(*) AS n FROM token GROUP BY 1),
  u AS (SELECT s.*, n - (SELECT count(DISTINCT token_id) FROM original_e e WHERE e.sample_id = s.sample_id AND token_order IS NOT NULL) AS unassigned_before, n - (SELECT count(DISTINCT token_id) FROM refined_e e WHERE e.sample_id = s.sample_id AND token_order IS NOT NULL) AS unassigned_after,
    (SELECT count(*) FROM original_w w WHERE w.sample_id = s.sample_id AND NOT (kind = 'duplicate_note' AND about NOT IN (SELECT note_id FROM note))) AS warnings_before, (SELECT count(*) FROM refined_w w WHERE w.sample_id = s.sample_id AND NOT (kind = 'duplicate_note' AND about NOT IN (SELECT note_id FROM note))) AS warnings_after,
    (SELECT count(*) FROM refined r WHERE r.sample_id = s.sample_id) AS entries FROM s),
  r AS (SELECT *, list_filter([CASE WHEN entries = 0 THEN 'empty_alignments' END, {", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM refined_w w WHERE w.sample_id = u.sample_id AND {c}) THEN '{k}' END" for k, c in _KINDS.items())},
    CASE WHEN unassigned_after > unassigned_before + 2 THEN 'too_many_unassigned_tokens' END, CASE WHEN warnings_after > warnings_before + 3 THEN 'validator_warnings_increased' END], lambda k: k IS NOT NULL) AS reasons FROM u)
  SELECT sample_id, unassigned_before, unassigned_after, warnings_before, warnings_after, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM r""",
)
def c40_accept_refined(spark, sf):
    """Whether a refined alignment is taken, and why not."""
    out = A.accept_refined(*_drafts(spark, sf), "sample_id")
    return out.withColumn("reasons", F.array_join("reasons", ","))
