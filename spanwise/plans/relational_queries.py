"""Relational queries: joins by key, comparisons of runs, pairing, paging, latest versions, edits, text and path functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import versions as V
from . import fixtures as T
from .fixtures import NOTES
from .registry import REGISTRY

r6 = lambda c: F.round(c, 6)
money = lambda c: F.round(c, 2)


@REGISTRY.query("j1_owner_join", "SELECT o_orderkey, c_custkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 10")
def j1_owner_join(spark, sf):
    """Two inner joins with a check of the owner; nation is a fixed table of 25 rows, so it is broadcast."""
    o, c, n = (T.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    owned = c.join(F.broadcast(n.where("n_nationkey < 10")), c["c_nationkey"] == n["n_nationkey"])
    return o.join(owned, o["o_custkey"] == owned["c_custkey"]).select("o_orderkey", "c_custkey", "n_name", "o_totalprice")


@REGISTRY.query("j3_last_duplicate_lookup", "WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS k FROM lineitem) SELECT o_orderkey, l_partkey FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND k = 1")
def j3_last_duplicate_lookup(spark, sf):
    """Hash lookup in which the last duplicate of a key wins."""
    last = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))
    return T.table(spark, sf, "orders").select("o_orderkey").join(last, "o_orderkey", "left")


@REGISTRY.query("j15_left_anti", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j15_left_anti(spark, sf):
    """Also the referential check (F14): keys without a match."""
    o = T.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return T.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


RUNS_SQL = "a AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


@REGISTRY.query("j17_run_comparison", f"WITH {RUNS_SQL} SELECT id, a.v AS baseline, b.v AS candidate, round(b.v - a.v, 2) AS delta, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN b.v > a.v THEN 'better' WHEN b.v < a.v THEN 'worse' ELSE 'same' END AS signal FROM a FULL JOIN b USING (id)")
def j17_run_comparison(spark, sf):
    """Two runs by sample, full outer, with a direction-aware signal."""
    o = T.table(spark, sf, "orders")
    run = lambda k, name: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("id")).agg(money(F.sum("o_totalprice")).alias(name))
    return V.compare_runs(run(0, "baseline"), run(1, "candidate"), "id", "baseline", "candidate").withColumn("delta", money("delta"))


@REGISTRY.query(
    "j18_pairing",
    """WITH n AS (SELECT c_custkey AS id, regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g') AS key, 'left' AS side FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), 'right' FROM customer WHERE c_custkey % 4 <> 0)
  SELECT key, count(*) FILTER (side = 'left') AS n_left, count(*) FILTER (side = 'right') AS n_right, CASE WHEN count(*) FILTER (side = 'left') = 0 THEN 'right_only' WHEN count(*) FILTER (side = 'right') = 0 THEN 'left_only' WHEN count(*) > 2 THEN 'duplicate' ELSE 'paired' END AS status FROM n GROUP BY key""",
)
def j18_pairing(spark, sf):
    """Paired, unpaired and duplicate names by normalised key, in one aggregation instead of three joins."""
    c = T.table(spark, sf, "customer").select("c_custkey", S.slug(F.trim("c_name")).alias("key"))
    return V.pair_by_key(c.where("c_custkey % 3 <> 0").select("key"), c.where("c_custkey % 4 <> 0").select("key"), "key")


@REGISTRY.query("j23_default_chain", "WITH l AS (SELECT l_orderkey, max(l_discount) AS d FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT o_orderkey, round(coalesce(l.d, CASE WHEN o_totalprice > 100000 THEN 0.01 END, 0), 6) AS discount FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def j23_default_chain(spark, sf):
    d = T.table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_discount").alias("d"))
    value = F.coalesce("d", F.when(F.col("o_totalprice") > 100000, 0.01), F.lit(0.0))
    return T.table(spark, sf, "orders").join(d, "o_orderkey", "left").select("o_orderkey", r6(value).alias("discount"))


@REGISTRY.query("j24_variant_grid", f"WITH {NOTES} SELECT sample_id, shift, octave, round(avg(pitch + 12 * octave), 6) AS mean_pitch, round(min(start_sec + shift), 6) AS first_onset FROM notes CROSS JOIN (VALUES (-0.05), (0.0), (0.05)) s(shift) CROSS JOIN (VALUES (-1), (0), (1)) o(octave) GROUP BY 1, 2, 3")
def j24_variant_grid(spark, sf):
    """All variants of a parameter grid: aggregates per sample first, so the nine variants multiply samples, not notes."""
    n = T.notes(spark, sf).groupBy("sample_id").agg(F.avg("pitch").alias("p"), F.min("start_sec").alias("s"))
    grid = F.array(*(F.struct(F.expr(f"cast({x} as decimal(3,2))").alias("shift"), F.lit(o).alias("octave")) for x in ("-0.05", "0.0", "0.05") for o in (-1, 0, 1)))
    n = n.select("sample_id", "p", "s", F.explode(grid).alias("v"))
    return n.select("sample_id", "v.shift", "v.octave", r6(F.col("p") + 12 * F.col("v.octave")).alias("mean_pitch"), r6(F.col("s") + F.col("v.shift").cast("double")).alias("first_onset"))


@REGISTRY.query("a1_filtered_count", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS n_large, CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) AS next_key FROM orders GROUP BY 1")
def a1_filtered_count(spark, sf):
    """Counts under a filter, and the next number of a sequence."""
    return T.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"), (F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).cast("long").alias("next_key"))


@REGISTRY.query("t1_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def t1_paging(spark, sf):
    """The third page of twenty rows."""
    return T.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@REGISTRY.query("t2_latest_per_key", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1")
def t2_latest_per_key(spark, sf):
    """Latest row of each key by an aggregate, which combines on the map side, not by a window."""
    return V.latest(T.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@REGISTRY.query("t3_ascending_list", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def t3_ascending_list(spark, sf):
    """The versions of every key in ascending order: a sort by ranges, without a group."""
    return T.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@REGISTRY.query("t7_bounded_examples", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) AS examples FROM r WHERE k <= 3 GROUP BY 1")
def t7_bounded_examples(spark, sf):
    """Three examples for each key (T4)."""
    r = T.table(spark, sf, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("k <= 3")
    return r.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("examples"))


@REGISTRY.query("u1_union_sources", f"WITH {NOTES}, u AS (SELECT 'a' AS source, sample_id, note_seq, pitch, confidence FROM notes WHERE note_seq % 3 <> 0 UNION ALL SELECT 'b', sample_id, note_seq, pitch, NULL FROM notes WHERE note_seq % 4 <> 0) SELECT source, count(*) AS n, count(confidence) AS n_confidence, count(DISTINCT sample_id) AS n_samples FROM u GROUP BY 1")
def u1_union_sources(spark, sf):
    n = T.notes(spark, sf)
    a = T.expected(n).select(F.lit("a").alias("source"), "sample_id", "note_seq", "confidence")
    b = T.predicted(n).select(F.lit("b").alias("source"), "sample_id", "note_seq")
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confidence"), F.count_distinct("sample_id").alias("n_samples"))


@REGISTRY.query("u3_key_sets", "SELECT 'both' AS kind, o_custkey AS id FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'first', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def u3_key_sets(spark, sf):
    """Intersection and difference from one aggregation."""
    o = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderkey") % 2 == 0).alias("a"), F.bool_or(F.col("o_orderkey") % 2 == 1).alias("b"))
    return o.where("a").select(F.when(F.col("b"), "both").otherwise("first").alias("kind"), "id")


@REGISTRY.query("u4_before_after_diff", "WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 6 <> 0) SELECT CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'deleted' WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM b FULL JOIN a USING (o_orderkey) GROUP BY 1")
def u4_before_after_diff(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    d = V.diff(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 6 <> 0").withColumn("o_totalprice", changed), ["o_orderkey"], ["o_totalprice"])
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("u5_keep_first", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def u5_keep_first(spark, sf):
    return V.earliest(T.table(spark, sf, "documents"), ["source", "lang"], ["doc_id"], ["doc_id"])


@REGISTRY.query("u7_merged_arrays", f"WITH {NOTES}, d AS (SELECT DISTINCT sample_id, event_type, min(note_seq) OVER (PARTITION BY sample_id, event_type) AS f FROM notes) SELECT sample_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM d GROUP BY 1")
def u7_merged_arrays(spark, sf):
    """Distinct values in order of first appearance (U6): distinct before collecting, so arrays stay short."""
    d = T.notes(spark, sf).groupBy("sample_id", "event_type").agg(F.min("note_seq").alias("f"))
    return d.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@REGISTRY.query("m2_stale_update", "SELECT o_orderstatus AS before, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderdate < DATE '1997-01-01' THEN 'failed' ELSE o_orderstatus END AS after, count(*) AS n FROM orders GROUP BY 1, 2")
def m2_stale_update(spark, sf):
    """Update as a rewrite: what is open for too long fails (M3, M4)."""
    o = T.table(spark, sf, "orders")
    stale = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate").cast("date") < F.lit("1997-01-01").cast("date"))
    return o.groupBy(F.col("o_orderstatus").alias("before"), F.when(stale, "failed").otherwise(F.col("o_orderstatus")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("m6_get_or_create", "WITH want AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), have AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 1) SELECT id, FALSE AS created FROM have UNION ALL SELECT id, TRUE FROM want WHERE id NOT IN (SELECT id FROM have)")
def m6_get_or_create(spark, sf):
    o = T.table(spark, sf, "orders")
    ids = lambda k: o.where(F.col("o_orderkey") % 3 == k).select(F.col("o_custkey").alias("id")).distinct()
    return V.get_or_create(ids(1), ids(0), ["id"])


@REGISTRY.query("m7_cascading_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def m7_cascading_delete(spark, sf):
    gone = T.table(spark, sf, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


EDIT_SQL = "CASE note_seq % 10 WHEN 0 THEN 'delete' WHEN 1 THEN 'pitch' WHEN 2 THEN 'move' WHEN 3 THEN 'resize' END"


@REGISTRY.query("m8_note_edits", f"WITH {NOTES}, e AS (SELECT *, {EDIT_SQL} AS op FROM notes) SELECT sample_id, note_seq, coalesce(op, 'none') AS op, CASE WHEN op = 'pitch' THEN pitch + 1 ELSE pitch END AS pitch, round(CASE WHEN op = 'move' THEN start_sec + 0.1 ELSE start_sec END, 6) AS start_sec, round(CASE WHEN op = 'move' THEN end_sec + 0.1 WHEN op = 'resize' THEN start_sec + (end_sec - start_sec) * 2 ELSE end_sec END, 6) AS end_sec FROM e WHERE op IS DISTINCT FROM 'delete'")
def m8_note_edits(spark, sf):
    """A table of edits applied to a table of notes; here the edits follow from the notes' numbers."""
    n = T.notes(spark, sf)
    k = F.col("note_seq") % 10
    edits = n.select("sample_id", "note_seq", F.when(k == 0, "delete").when(k == 1, "pitch").when(k == 2, "move").when(k == 3, "resize").alias("op"), F.when(k == 1, 1.0).when(k == 2, 0.1).when(k == 3, 2.0).alias("amount")).where("op is not null")
    out = V.apply_note_edits(n, edits, ["sample_id", "note_seq"])
    return out.select("sample_id", "note_seq", "op", "pitch", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"))


@REGISTRY.query("m9_split_notes", f"WITH {NOTES}, p AS (SELECT *, CAST(unnest(CASE WHEN end_sec - start_sec > 0.3 THEN [0, 1] ELSE [0] END) AS INT) AS part FROM notes) SELECT sample_id, note_seq, part, round(start_sec + part * (end_sec - start_sec) / 2, 6) AS start_sec, round(CASE WHEN end_sec - start_sec > 0.3 AND part = 0 THEN (start_sec + end_sec) / 2 ELSE end_sec END, 6) AS end_sec FROM p")
def m9_split_notes(spark, sf):
    """Long notes in two."""
    n = T.notes(spark, sf)
    long = F.col("end_sec") - F.col("start_sec") > 0.3
    p = n.withColumn("part", F.explode(F.when(long, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return p.select("sample_id", "note_seq", "part", r6(F.col("start_sec") + F.col("part") * (F.col("end_sec") - F.col("start_sec")) / 2).alias("start_sec"), r6(F.when(long & (F.col("part") == 0), (F.col("start_sec") + F.col("end_sec")) / 2).otherwise(F.col("end_sec"))).alias("end_sec"))


@REGISTRY.query("s21_checksums", "SELECT doc_id, sha256(text) AS checksum, strlen(text) AS n_bytes FROM documents")
def s21_checksums(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.octet_length("text").cast("long").alias("n_bytes"))


@REGISTRY.query("s23_artifact_rows", "SELECT source, lang, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1, 2")
def s23_artifact_rows(spark, sf):
    return T.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@REGISTRY.query("sc_json_paths", "SELECT event_id, CAST(props->>'k' AS INT) AS k, props->>'missing' AS missing FROM events")
def sc_json_paths(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


NAMES_SQL = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"


@REGISTRY.query("sc_pitch_functions", f"WITH {NOTES} SELECT sample_id, note_seq, {NAMES_SQL}[1 + pitch % 12] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, pitch AS back, round(440.0 * pow(2.0, (pitch - 69) / 12.0), 6) AS hz, CAST(least(abs(pitch - 60) % 12, 12 - abs(pitch - 60) % 12) AS INT) AS from_c, round(round_even(start_sec / 0.25, 0) * 0.25, 6) AS snapped FROM notes")
def sc_pitch_functions(spark, sf):
    n = T.notes(spark, sf)
    name = S.midi_to_name(F.col("pitch"))
    return n.select("sample_id", "note_seq", name.alias("name"), S.name_to_midi(name).cast("int").alias("back"), r6(S.midi_to_hz(F.col("pitch"))).alias("hz"), S.circular_distance(F.col("pitch"), F.lit(60)).alias("from_c"), r6(S.snap(F.col("start_sec"), 0.25)).alias("snapped"))


@REGISTRY.query("sc_text_functions", "SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS collapsed, CAST(len(regexp_extract_all(lower(text), '[a-z]+')) AS INT) AS n_words, regexp_matches(lower(text), 'thank|please|sorry') AS polite FROM conversations")
def sc_text_functions(spark, sf):
    """White space, tokens and lexicon hits."""
    c = T.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))).alias("collapsed"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("n_words"), F.lower("text").rlike("thank|please|sorry").alias("polite"))


@REGISTRY.query("c38_track_statistics", "SELECT conv_id, role, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, median(length(text)::DOUBLE) AS median_chars, max(length(text)) - min(length(text)) AS char_range FROM conversations GROUP BY 1, 2")
def c38_track_statistics(spark, sf):
    n = F.length("text").cast("long")
    return T.table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(n)).alias("mean_chars"), F.median(n.cast("double")).alias("median_chars"), (F.max(n) - F.min(n)).alias("char_range"))


@REGISTRY.query("c64_lyrics_nesting", "WITH s AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) AS place FROM conversations) SELECT conv_id, turn, place, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS token_no, token FROM s")
def c64_lyrics_nesting(spark, sf):
    """Tokens of segments with their place, and a running number over the whole."""
    t = T.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "token"))
    return t.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("place"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "p")).cast("long").alias("token_no"), "token")
