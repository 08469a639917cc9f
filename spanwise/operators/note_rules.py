"""Notes out of records with many names for one field, and small rules on notes, segments and their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, hz_to_midi, labels, name_to_midi
from .intervals import interval_join, previous

# The names that a field may have, the first there is being taken.
START = ("start_time_sec", "start_time", "onset_sec")
END = ("end_time_sec", "end_time", "offset_sec")
LENGTH = ("duration_sec", "duration")
PITCH = ("pitch_center_midi", "midi_float", "pitch_midi", "midi_pitch")
FREQUENCY = ("f0_hz", "frequency_hz", "frequency")

# Reason codes a client knows, and older names of some.
CLIENT_CODES = [
    "large_quantize_error", "octave_outlier", "possible_fragmentation", "possible_overmerge", "short_gap_bridged", "short_note_absorbed", "octave_jump_corrected",
    "phrase_median_smoothed", "low_confidence", "uncertain", "low_voiced_ratio", "too_short", "too_unstable", "outside_vocal_range", "likely_harmonic",
    "likely_accompaniment_bleed", "duplicate_fragment", "overlaps_stronger_candidate", "insufficient_onset_evidence", "silence_or_breath_region", "suspected_vibrato",
    "suspected_glide", "dp_fallback", "rhythm_grid_unavailable", "dp_no_candidate_path", "quantizer_backend_unsupported",
]
CODE_ALIASES = {"high_quantize_error": "large_quantize_error", "fragmentation_risk": "possible_fragmentation", "overmerge_risk": "possible_overmerge"}
CLIENT_UNSURE = 0.55

# What the states of a segment are called.
STATES = {"vocal": ("vocal", "voiced", "voice"), "transition": ("transition", "handoff"), "climax": ("climax", "chorus"), "instrumental": ("inactive", "instrumental", "silence", "unvoiced", "no_vocal")}
CLIMAX_DENSITY = 1.2


def first_text(document: str, names: tuple[str, ...]) -> Column:
    """The first of the fields of a JSON object that is there and not null."""
    return F.coalesce(*(F.get_json_object(document, f"$.{n}") for n in names))


def first_number(document: str, names: tuple[str, ...]) -> Column:
    """The same as a finite number; null where it is none, whatever later fields hold."""
    return finite(first_text(document, names).try_cast("double"))


def normalized_notes(df: DataFrame, document: str = "note") -> DataFrame:
    """adds note_id, start_sec, end_sec, duration_sec, pitch, confidence, voiced_ratio, stability and ornament, read from the JSON object `document`.

    An end that lacks is start and length, an end before the start the start. Confidence lies in 0 to 1 and is 0 where it lacks. A pitch is a number, else
    a note name, else from a frequency. What is no JSON object gives a note at 0 without pitch.
    """
    start, long = F.coalesce(first_number(document, START), F.lit(0.0)), first_number(document, LENGTH)
    end = F.greatest(start, F.coalesce(first_number(document, END), start + long, start))
    hz = first_number(document, FREQUENCY)
    pitch = F.coalesce(first_number(document, PITCH), name_to_midi(F.trim(first_text(document, ("pitch", "pitch_name")))).cast("double"), F.when(hz > 0, hz_to_midi(hz)))
    sure = F.coalesce(first_number(document, ("confidence",)), first_number(document, ("mean_confidence",)), F.lit(0.0))
    return df.withColumns({
        "note_id": first_text(document, ("id", "candidate_id")), "start_sec": start, "end_sec": end, "duration_sec": end - start, "pitch": pitch,
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), "voiced_ratio": first_number(document, ("voiced_ratio",)), "stability": first_number(document, ("stability",)),
        "ornament": F.coalesce(first_text(document, ("is_candidate_ornament",)) == "true", F.lit(False)),
    })


def client_reasons(codes: Column, confidence: Column, uncertain: Column) -> Column:
    """The codes a client knows, under their present names, once each and in order; then low_confidence and uncertain where they hold.

    Codes in any case and with blanks around them are meant; null codes are left out.
    """
    alias = F.create_map(*(F.lit(x) for kv in CODE_ALIASES.items() for x in kv))
    known = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c)))
    known = F.transform(known, lambda c: F.coalesce(alias[c], c))
    known = F.array_distinct(F.filter(known, lambda c: c.isin(*CLIENT_CODES)))
    plus = lambda a, name, when: F.when(F.coalesce(when, F.lit(False)) & ~F.array_contains(a, name), F.array_append(a, F.lit(name))).otherwise(a)
    known = plus(known, "low_confidence", confidence < CLIENT_UNSURE)
    return plus(known, "uncertain", F.coalesce(uncertain, F.lit(False)) | (F.size(known) > 0))


def candidate_counters(candidates: DataFrame, selected: DataFrame, key: str, origin: str = "contour_to_candidate_bridge") -> DataFrame:
    """Candidates, those of one origin, and selected notes of each key, in one aggregation."""
    both = candidates.select(key, F.lit(1).alias("__c"), (F.col("candidate_origin") == origin).alias("__o"), F.lit(0).alias("__s"))
    both = both.unionByName(selected.select(key, F.lit(0).alias("__c"), F.lit(False).alias("__o"), F.lit(1).alias("__s")))
    return both.groupBy(key).agg(F.sum("__c").alias("n_candidates"), F.count_if("__o").alias("n_bridged"), F.sum("__s").alias("n_selected"))


def restore_lineage(notes: DataFrame, sources: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Adds source_seq and found_by ('overlap', 'id' or null): the source that overlaps a note longest, else the first of the same candidate id.

    Both have key, note_seq, start_sec, end_sec, candidate_id. Of sources that overlap equally long the first by note_seq.
    """
    s = sources.select(key, F.col("note_seq").alias("__seq"), F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"))
    met = interval_join(notes.select(key, "note_seq", "start_sec", "end_sec"), s, [key], width, "start_sec", "end_sec", "__a", "__b")
    shared = F.least("end_sec", "__b") - F.greatest("start_sec", "__a")
    best = met.where(shared > 0).groupBy(key, "note_seq").agg(F.max_by("__seq", F.struct(shared, -F.col("__seq"))).alias("__best"))
    named = sources.where("candidate_id <> ''").groupBy(key, "candidate_id").agg(F.min("note_seq").alias("__named"))
    out = notes.join(best, [key, "note_seq"], "left").join(named, [key, "candidate_id"], "left")
    how = F.when(F.col("__best").isNotNull(), "overlap").when(F.col("__named").isNotNull(), "id")
    return out.withColumns({"source_seq": F.coalesce("__best", "__named"), "found_by": how}).drop("__best", "__named")


def octave_shift(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """octave_shift, what to add to the predicted pitches: whole octaves, one or two, where the medians are within 1 of them apart; else 0.

    A key that one side lacks has a null median and no shift.
    """
    both = expected.select(key, F.col("pitch").alias("__e"), F.lit(None).cast("double").alias("__p")).unionByName(predicted.select(key, F.lit(None).cast("double").alias("__e"), F.col("pitch").alias("__p")))
    g = both.groupBy(key).agg(F.median("__e").alias("expected_median"), F.median("__p").alias("predicted_median"))
    delta = F.col("predicted_median") - F.col("expected_median")
    octaves = (F.bround(delta / 12) * 12).cast("int")
    return g.withColumns({"median_delta": delta, "octave_shift": F.coalesce(F.when(octaves.isin(-24, -12, 12, 24) & (F.abs(delta - octaves) <= 1), -octaves), F.lit(0))})


def segment_state(state: Column) -> Column:
    """The state that a name stands for; vocal where it is none known."""
    said, found = F.lower(F.trim(state)), F.lit("vocal")
    for name, names in STATES.items():
        found = F.when(said.isin(*names), name).otherwise(found)
    return found


def segments_or_span(segments: DataFrame, lead: DataFrame, support: DataFrame, key: str) -> DataFrame:
    """The segments of a key with their states; for a key with notes but no segments one over all its notes, vocal if it has lead notes.

    Segments that end before they start are left out.
    """
    known = segments.where(F.col("end_sec") >= F.col("start_sec")).select(key, "start_sec", "end_sec", segment_state(F.col("state")).alias("state"))
    notes = lead.select(key, "start_sec", "end_sec", F.lit(1).alias("__lead")).unionByName(support.select(key, "start_sec", "end_sec", F.lit(0).alias("__lead")))
    bare = notes.join(segments.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("__lead").alias("__lead"))
    bare = bare.select(key, "start_sec", F.greatest("start_sec", "end_sec").alias("end_sec"), F.when(F.col("__lead") == 1, "vocal").otherwise("instrumental").alias("state"))
    return known.withColumn("inferred", F.lit(False)).unionByName(bare.withColumn("inferred", F.lit(True)))


def climax_segments(segments: DataFrame, support: DataFrame, key: str, segment_id: str, density: float = CLIMAX_DENSITY, width: float = 60.0) -> DataFrame:
    """Adds n_support and climax: a segment of that state, or a vocal one where support notes that overlap it are dense."""
    s = support.select(key, F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"))
    n = interval_join(segments.select(key, segment_id, "start_sec", "end_sec"), s, [key], width, "start_sec", "end_sec", "__a", "__b").groupBy(key, segment_id).agg(F.count(F.lit(1)).alias("n_support"))
    out = segments.join(n, [key, segment_id], "left").withColumn("n_support", F.coalesce("n_support", F.lit(0)))
    dense = F.col("n_support") / F.greatest(F.lit(1e-6), F.col("end_sec") - F.col("start_sec")) >= density
    return out.withColumn("climax", (F.col("state") == "climax") | ((F.col("state") == "vocal") & dense))


def tagged(notes: DataFrame, key: str, fragments: DataFrame, overlaps: DataFrame, extended: DataFrame) -> DataFrame:
    """Adds to the `reasons` of notes fragmentation_risk and overmerge_risk for those in pairs (left_id, right_id) or among the extended (note_seq), then uncertain where there is any."""
    ends = lambda p, tag: p.select(key, F.explode(F.array("left_id", "right_id")).alias("note_seq"), F.lit(tag).alias("__tag"))
    tags = ends(fragments, 1).unionByName(ends(overlaps, 2)).unionByName(extended.select(key, "note_seq", F.lit(2).alias("__tag")))
    tags = tags.groupBy(key, "note_seq").agg(F.max(F.col("__tag") == 1).alias("__fragment"), F.max(F.col("__tag") == 2).alias("__over"))
    out = notes.join(tags, [key, "note_seq"], "left")
    all_ = F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), labels((F.col("__fragment"), "fragmentation_risk"), (F.col("__over"), "overmerge_risk"))))
    all_ = F.when((F.size(all_) > 0) & ~F.array_contains(all_, "uncertain"), F.array_append(all_, F.lit("uncertain"))).otherwise(all_)
    return out.withColumn("reasons", all_).withColumn("uncertain", F.size("reasons") > 0).drop("__fragment", "__over")


def first_filled(*choices: tuple[Column, str]) -> tuple[Column, Column]:
    """The first array that has elements, and the name of where it is from; an empty array and `none` if there is none."""
    filled = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    array = F.coalesce(*(F.when(filled(a), a) for a, _ in choices), F.slice(choices[0][0], 1, 0))
    return array, F.coalesce(*(F.when(filled(a), F.lit(name)) for a, name in choices), F.lit("none"))


def frame_hop(frames: DataFrame, key: str, default: float, width: float = 60.0) -> DataFrame:
    """The median step between frame times that differ, of each key; `default`, at least 0.001, where there is none."""
    steps = previous(frames.select(key, F.round("time_sec", 6).alias("time_sec")), [key], ["time_sec"], "time_sec", "__last", F.floor(F.col("time_sec") / width))
    step = F.round(F.col("time_sec") - F.col("__last"), 6)
    return steps.groupBy(key).agg(F.coalesce(F.median(F.when(step > 0, step)), F.lit(max(0.001, default))).alias("hop_sec"))
