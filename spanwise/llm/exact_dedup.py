"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary of the text digests (the frequent-items sketch behind
`approx_top_k`, kept per task and merged in two steps, `TRACKED` counters) names the digests that
may be frequent. An aggregation that combines on the map side verifies their groups,
and the verified winners of all of them, at most `TRACKED` rows, are broadcast, so rows of
frequent groups never travel. A digest that the summary leaves out occurs in at most
1 / (0.75 * TRACKED) of the rows; those groups take an ordinary shuffle on the digest.

Results for odd input. Null text counts as empty. Of equal texts the row with the
largest id stays; of rows repeated with the same id and text, exactly one. A row with
a null id cannot be referred to: it stays, alone in its group. An empty table gives
an empty result. Other columns are carried by `drop_exact_duplicates` and ignored by
`mark_exact_duplicates`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, frequent_values, materialize, table

#: Counters of the summary; as many digests at most are settled by broadcast.
TRACKED = 4096


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def frequent_digests(rows: DataFrame) -> DataFrame:
    """The values of `digest` in the summary, at most TRACKED."""
    found = frequent_values(rows.select(F.hex("digest").alias("digest")), "digest", TRACKED, TRACKED)
    return found.where("count > 1").select(F.unhex("item").alias("digest"))


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, digest, keep_id, group_size, kept."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    known, unknown = rows.where("id is not null"), rows.where("id is null")

    suspects = F.broadcast(frequent_digests(known))
    winners = F.broadcast(known.join(suspects, "digest", "left_semi").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    split = known.join(winners, "digest", "left")
    frequent = split.where("keep_id is not null")
    losers = frequent.where("id <> keep_id").withColumn("kept", F.lit(False))
    # only the winners' own rows: more than one each only where the input repeats a row
    first = F.row_number().over(W.partitionBy("digest", "id").orderBy("group_size")) == 1
    held = frequent.where("id = keep_id").withColumn("kept", first)

    group = W.partitionBy("digest")
    rest = (
        split.where("keep_id is null")
        .select("digest", "id")
        .withColumn("kept", F.row_number().over(group.orderBy(F.desc("id"))) == 1)
        .withColumn("keep_id", F.max("id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    alone = unknown.select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return losers.unionByName(held).unionByName(rest).unionByName(alone).select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", "kept")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with the columns of `docs`."""
    marks = mark_exact_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("id"), "digest", "keep_id")
    gone = materialize(marks, "duplicates")
    dropped = broadcast_if_small(gone.where("id <> keep_id").select("id").distinct())
    stays = docs.join(dropped, docs[id_col] == dropped["id"], "left_anti")
    again = gone.where("id = keep_id").select("id").distinct()
    if again.isEmpty():
        return stays
    # the same id and text more than once: one of those rows stays
    once = stays.join(again, stays[id_col] == again["id"], "left_semi").dropDuplicates([id_col, text_col])
    return stays.join(again, stays[id_col] == again["id"], "left_anti").unionByName(once)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = mark_exact_duplicates(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
