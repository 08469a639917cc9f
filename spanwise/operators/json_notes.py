"""Note rows out of JSON documents of whatever shape, as variants that are opened level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hz_to_midi, name_to_midi
from .lineage import cut

# Names under which documents give times and pitches, the first that is not null counts.
START = ["quantized_start_time_sec", "start_time_sec", "start_time", "onset_sec", "start_sec", "start", "time_sec"]
END = ["quantized_end_time_sec", "end_time_sec", "end_time", "offset_sec", "end_sec", "end"]
LENGTH = ["quantized_duration_sec", "duration_sec", "duration"]
PITCH = ["midi_pitch", "pitch_midi", "pitch_midi_float", "pitch_center_midi", "midi_float"]
NAMED = ["pitch", "note"]
HERTZ = ["frequency_hz", "f0_hz", "frequency"]
# A note has one of each.
HAS_TIME = ["start_time", "start_time_sec", "onset_sec", "start_sec", "start", "time_sec"]
HAS_PITCH = ["pitch", "midi_pitch", "pitch_midi", "pitch_midi_float", "pitch_center_midi", "midi_float", "frequency_hz", "f0_hz"]
#: Where a document has one of these as a list, only that is looked at.
PREFERRED = ["$.melody_candidates.notes", "$.melody_candidates.selected_notes", "$.notes", "$.selected_notes"]


def _value(v: str, name: str, kind: str = "double") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _first(v: str, names: list[str], kind: str = "double") -> Column:
    return F.coalesce(*(_value(v, n, kind) for n in names))


def _is(v: str, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def note_items(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every object that looks like a note, at any depth: doc_id, path, item (a variant). Texts that are no JSON have none.

    Each pass opens the objects and lists that the one before has found, so there are as many passes as levels.
    """
    rows = docs.select(doc_id, F.try_parse_json(text).alias("v")).where("v is not null")
    lists = [F.when(F.schema_of_variant(x).startswith("ARRAY"), x) for x in (F.try_variant_get("v", p, "variant") for p in PREFERRED)]
    level = rows.select(doc_id, F.lit("$").alias("path"), F.coalesce(*lists, F.col("v")).alias("v"))
    found = None
    while True:
        level = cut(level.where(_is("v", "OBJECT") | _is("v", "ARRAY")))
        if level.isEmpty():
            break
        has = lambda names: F.coalesce(*(_value("v", n, "variant") for n in names)).isNotNull()
        here = level.where(_is("v", "OBJECT") & has(HAS_TIME) & has(HAS_PITCH)).select(doc_id, "path", F.col("v").alias("item"))
        found = here if found is None else found.unionByName(here)
        opened = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("inner")))
        level = opened.select(doc_id, F.when(F.col("key").isNull(), F.format_string("%s[%d]", "path", "pos")).otherwise(F.concat_ws(".", "path", "key")).alias("path"), F.col("inner").alias("v"))
    return level.select(doc_id, "path", F.col("v").alias("item")) if found is None else found


def json_notes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, path, start_sec, end_sec, pitch) of each item with a start and a pitch; a length in beats counts by its tempo."""
    items = note_items(docs, doc_id, text)
    beats, tempo = _value("item", "duration_beats"), _value("item", "tempo_bpm")
    start, end = _first("item", START), _first("item", END)
    length = F.coalesce(_first("item", LENGTH), F.when(tempo > 0, beats * (F.lit(60.0) / tempo)))
    named = _first("item", NAMED, "string")
    hertz = _first("item", HERTZ)
    pitch = F.coalesce(_first("item", PITCH), named.try_cast("double"), name_to_midi(F.trim(named)).cast("double"), F.when(hertz > 0, hz_to_midi(hertz)))
    out = items.select(doc_id, "path", start.alias("start_sec"), F.coalesce(end, start + length, start).alias("end_sec"), F.bround(pitch).cast("int").alias("pitch"))
    return out.where("start_sec is not null and pitch is not null")
