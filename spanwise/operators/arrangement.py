"""Which of two sources leads in each stretch of a song, and which of the notes of both stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_runs, limit_polyphony
from .intervals import interval_join
from .lineage import cut


@dataclass(frozen=True)
class ArrangementRules:
    # How many notes sound at once, by kind of stretch; notes a second that make a climax; semitones and seconds of a conflict.
    lead: int = 1
    support: int = 1
    climax: int = 2
    instrumental: int = 3
    climax_density: float = 1.2
    near: int = 2
    window: float = 0.12


#: States as they are called, by kind; any other counts as vocal.
KINDS = {"transition": ["transition", "handoff"], "climax": ["climax", "chorus"], "instrumental": ["inactive", "instrumental", "silence", "unvoiced", "no_vocal"]}
_NOTE = ["start_sec", "end_sec", "pitch", "confidence", "note_seq"]
_KEPT = "note_seq long, start_sec double, end_sec double"


def arrange(segments: DataFrame, lead: DataFrame, support: DataFrame, key: str, rules: ArrangementRules = ArrangementRules(), width: float = 10.0) -> DataFrame:
    """For each segment and each note in it: key, segment_id, source (lead, support), note_seq, kind of the segment, kept, and why not.

    segments: key, segment_id, start_sec, end_sec, state. In vocal stretches the lead source leads, limited to `lead` notes at once, and notes of the other
    stay where they do not conflict with a lead note that stays and are limited too, to more where they are dense; in instrumental ones only the other
    source stays. A note that reaches into several segments is judged in each; `owned_once` brings it together. Limits are kept
    within one segment and between its silences, so a task holds one such run.
    """
    state = F.lower(F.trim("state"))
    kind = F.lit("vocal")
    for name, states in KINDS.items():
        kind = F.when(state.isin(states), name).otherwise(kind)
    spans = segments.select(key, "segment_id", F.col("start_sec").alias("__from"), F.col("end_sec").alias("__to"), kind.alias("kind"))

    def inside(df: DataFrame) -> DataFrame:
        found = interval_join(df.select(key, *_NOTE), spans, [key], width, "start_sec", "end_sec", "__from", "__to")
        return cut(found.withColumn("__key", F.struct(key, "segment_id")))

    def limited(df: DataFrame, most: int, width: float = 60.0) -> DataFrame:
        return fold_runs(df, "__key", 0.0, limit_polyphony(most), _KEPT, width=width).select("__key", "note_seq", F.lit(True).alias("__kept"))

    first, second = inside(lead), inside(support)
    dense = second.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    climax = (F.col("kind") == "climax") | ((F.col("kind") == "vocal") & (F.coalesce("__n", F.lit(0)) / F.greatest(F.lit(1e-6), F.col("__to") - F.col("__from")) >= rules.climax_density))
    second = second.join(dense, "__key").withColumn("__limit", F.when(F.col("kind") == "instrumental", rules.instrumental).when(climax, rules.climax).otherwise(rules.support)).drop("__n")

    leads = limited(first.where("kind <> 'instrumental'"), rules.lead)
    first = cut(first.join(leads, ["__key", "note_seq"], "left").withColumn("reason", F.when(F.col("kind") == "instrumental", "lead_in_instrumental").when(F.col("__kept").isNull(), "lead_limit")))

    sung = first.where("reason is null").select("__key", F.col("start_sec").alias("l_start"), F.col("end_sec").alias("l_end"), F.col("pitch").alias("l_pitch"))
    pitched = (F.col("pitch") > 0) & (F.col("l_pitch") > 0)
    clash = F.when(pitched, F.abs(F.col("pitch") - F.col("l_pitch")) <= rules.near).otherwise(F.abs(F.col("start_sec") - F.col("l_start")) <= rules.window)
    clashing = interval_join(second.select("__key", "note_seq", "start_sec", "end_sec", "pitch"), sung, ["__key"], width, "start_sec", "end_sec", "l_start", "l_end", clash).select("__key", "note_seq").distinct().withColumn("__clash", F.lit(True))
    second = cut(second.join(clashing, ["__key", "note_seq"], "left"))
    free = second.where("__clash is null")
    kept = None
    for most in sorted({rules.support, rules.climax, rules.instrumental}):
        part = limited(free.where(F.col("__limit") == most), most)
        kept = part if kept is None else kept.unionByName(part)
    second = second.join(kept, ["__key", "note_seq"], "left").withColumn("reason", F.when(F.col("__clash"), "conflicts_with_lead").when(F.col("__kept").isNull(), "support_limit"))

    out = lambda df, source: df.select(key, "segment_id", F.lit(source).alias("source"), "note_seq", "start_sec", "end_sec", "pitch", "kind", "reason", F.col("reason").isNull().alias("kept"))
    return out(first, "lead").unionByName(out(second, "support"))


def owned_once(arranged: DataFrame, key: str) -> DataFrame:
    """The notes kept in any segment once: key, source, note_seq, start_sec, end_sec, pitch; of equal notes the one with the least note_seq."""
    rows = arranged.where("kept")
    return rows.groupBy(key, "source", "start_sec", "end_sec", "pitch").agg(F.min("note_seq").alias("note_seq")).select(key, "source", "note_seq", "start_sec", "end_sec", "pitch")
