"""Checks of alignments of tokens to notes, and whether a refined alignment may take the place of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import prefix
from .lineage import cut

#: Entries of a key that one task takes where an order is followed along it.
BLOCK = 100_000


def alignment_warnings(entries: DataFrame, tokens: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """A row (key, idx, kind, about) for everything wrong with an entry, or with one of its notes.

    entries: key, idx, token_id, melisma, note_ids. tokens: key, token_id, token_order. notes: key, note_id, note_order, ornament.
    Orders are followed along known tokens and notes only, and a token or note that comes again is one each time it does.
    """
    block = F.floor(F.col("idx") / BLOCK)
    rows = entries.join(tokens, [key, "token_id"], "left")
    rows = rows.withColumn("__again", F.row_number().over(W.partitionBy(key, "token_id").orderBy("idx")) > 1)
    rows = prefix(rows, [key], ["idx"], F.col("token_order"), "__before", bucket=block)
    many = F.size(F.coalesce("note_ids", F.array().cast("array<long>")))
    first = [
        ("duplicate_token", F.col("__again")), ("unknown_token", F.col("token_order").isNull()), ("token_rollback", F.col("token_order") < F.col("__before")),
        ("empty_notes", many == 0), ("melisma_of_one", F.col("melisma") & (many < 2)), ("several_without_melisma", ~F.col("melisma") & (many > 1)),
    ]
    each = entries.select(key, "idx", "token_id", F.posexplode("note_ids").alias("pos", "note_id")).join(notes, [key, "note_id"], "left")
    each = each.withColumn("__again", F.row_number().over(W.partitionBy(key, "note_id").orderBy("idx", "pos")) > 1)
    known = F.col("note_order").isNotNull()
    second = [("unknown_note", ~known), ("duplicate_note", F.col("__again")), ("ornament_note", known & F.col("ornament"))]
    orders = each.where(known).groupBy(key, "idx", "token_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note_order"))), lambda x: x["note_order"]).alias("__o"))
    orders = prefix(orders, [key], ["idx"], F.element_at("__o", -1), "__before", bucket=block)
    third = [("rollback_inside", F.array_sort("__o") != F.col("__o")), ("note_rollback", F.col("__o")[0] < F.col("__before"))]

    def told(df: DataFrame, cases: list, about: str) -> DataFrame:
        found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in cases)), lambda k: k.isNotNull())
        return df.select(key, "idx", F.explode(found).alias("kind"), F.col(about).alias("about"))

    return told(rows, first, "token_id").unionByName(told(each, second, "note_id")).unionByName(told(orders, third, "token_id"))


#: Warnings that alone keep a refined alignment out.
FATAL = ["unknown_token", "unknown_note", "duplicate_token", "duplicate_note"]


def accept_refined(original: DataFrame, refined: DataFrame, tokens: DataFrame, notes: DataFrame, key: str, more_unassigned: int = 2, more_warnings: int = 3) -> DataFrame:
    """Per key of the tokens: how many tokens neither aligns, how many warnings each has, reasons against the refined one, and accepted.

    It may leave `more_unassigned` tokens more without notes, and have `more_warnings` warnings more; it must not be empty, name what is not there or
    anything twice, or go back in tokens or notes. Where a duplicate is unknown too, both are told; a duplicate that is unknown is no warning.
    """
    base = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n_tokens"))
    warned = {}
    for name, entries in (("before", original), ("after", refined)):
        w = cut(alignment_warnings(entries, tokens, notes, key))
        # a duplicate of an unknown note is not among the warnings
        unknown = w.where("kind = 'unknown_note'").select(key, "idx", "about").distinct().withColumn("__unknown", F.lit(True))
        w = w.join(unknown, [key, "idx", "about"], "left").withColumn("__counts", ~((F.col("kind") == "duplicate_note") & F.coalesce("__unknown", F.lit(False))))
        warned[name] = w
        done = entries.select(key, "token_id").distinct().join(tokens, [key, "token_id"]).groupBy(key).agg(F.count(F.lit(1)).alias(f"done_{name}"))
        size = entries.groupBy(key).agg(F.count(F.lit(1)).alias(f"entries_{name}"))
        base = base.join(done, key, "left").join(size, key, "left").join(w.groupBy(key).agg(F.count_if("__counts").alias(f"warnings_{name}")), key, "left")
    has = lambda k: F.bool_or(F.col("kind").isin(k)).alias(k[0])
    orders = [["token_rollback"], ["rollback_inside", "note_rollback"]]
    found = warned["after"].groupBy(key).agg(*(has([k]) for k in FATAL), *(has(k) for k in orders))
    out = base.fillna(0).join(found, key, "left").withColumns({f"unassigned_{n}": F.col("n_tokens") - F.col(f"done_{n}") for n in ("before", "after")})
    cases = [
        ("empty_alignments", F.col("entries_after") == 0), *((k, F.col(k)) for k in FATAL), ("token_order_regression", F.col("token_rollback")), ("note_order_regression", F.col("rollback_inside")),
        ("too_many_unassigned_tokens", F.col("unassigned_after") > F.col("unassigned_before") + more_unassigned), ("validator_warnings_increased", F.col("warnings_after") > F.col("warnings_before") + more_warnings),
    ]
    reasons = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in cases)), lambda k: k.isNotNull())
    return out.select(key, "unassigned_before", "unassigned_after", "warnings_before", "warnings_after", reasons.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)
