"""Note candidates: what frames and contours tell of raw ones, and new ones seeded by contours against all accepted so far."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from dataclasses import dataclass
from statistics import median, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import interval_join, island_ids, prefix
from .lineage import cut
from .ragged import frames_near


@dataclass(frozen=True)
class SeedRules:
    # Confidence, shares, seconds, semitones.
    sure: float = 0.58
    voiced: float = 0.72
    least: float = 0.04
    stability: float = 0.60
    pitch_range: float = 2.5
    share: float = 0.55
    lowest: float = 48.0
    highest: float = 84.0
    tolerance: float = 0.02
    cut_from: float = 0.20
    part_least: float = 0.12
    part_longest: float = 1.25
    part_range: float = 1.0
    part_spread: float = 0.60
    frame_gap: float = 0.04
    extension: float = 0.35


_OUT = "contour_id long, part int, start_sec double, end_sec double, stable_start_sec double, stable_end_sec double, pitch double, confidence double, stability double, state string, reasons array<string>"


def enrich_candidates(raw: DataFrame, frames: DataFrame, contours: DataFrame, key: str, rules: SeedRules = SeedRules(), width: float = 60.0, frames_a_bucket: int = 4096) -> DataFrame:
    """Raw candidates with what they lack taken from the frames and contours around them.

    raw: key, candidate_id (unique in a key), start_sec, end_sec, pitch, and, null where not known, confidence, voiced_ratio, stability and
    contour_ids. frames: key, frame_index, time_sec, pitch, confidence, voiced. contours: key, contour_id (string), start_sec, end_sec, stability.

    The frame range goes from the first to the last frame within the tolerance, and counts all frames numbered between. A candidate without contour ids
    gets those of the contours it overlaps; one that has none after that is dropped, as is one without times or pitch.
    Each join is by buckets of time, of frame numbers or by contour id, so no task needs a whole key.
    """
    r, by = rules, [key, "candidate_id"]
    own = cut(raw.where("start_sec IS NOT NULL AND end_sec IS NOT NULL AND pitch IS NOT NULL").select(*by, "start_sec", "end_sec", "pitch", "confidence", "voiced_ratio", "stability", F.array_distinct(F.filter("contour_ids", lambda x: F.trim(x) != "")).alias("contour_ids")))
    own_ids = F.coalesce(F.size("contour_ids"), F.lit(0)) > 0
    f = frames.select(key, "frame_index", "time_sec", F.col("pitch").alias("f_pitch"), F.col("confidence").alias("f_sure"), "voiced")

    spans = own.select(*by, "start_sec", "end_sec", F.lit(None).cast("array<double>").alias("samples"))
    order = F.struct("time_sec", "frame_index")
    ranges = frames_near(spans, f.select(key, "frame_index", "time_sec"), key, "candidate_id", r.tolerance, width)
    ranges = ranges.groupBy(*by).agg(F.min_by("frame_index", order).alias("first_frame"), F.max_by("frame_index", order).alias("last_frame"))
    numbered = f.withColumn("__n", F.col("frame_index") + 0.5)
    within = interval_join(ranges.withColumn("__last", F.col("last_frame") + 1), numbered.drop("time_sec"), [key], float(frames_a_bucket), "first_frame", "__last", "__n", "__n")
    sung = F.col("f_pitch").isNotNull()
    seen = within.groupBy(*by).agg(F.count(F.lit(1)).alias("frame_count"), F.count_if(F.coalesce("voiced", sung) & sung).alias("voiced_count"), (F.max("f_pitch") - F.min("f_pitch")).alias("__range"), F.avg("f_sure").alias("__sure"))

    c = contours.select(key, F.col("contour_id").alias("__id"), F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"), F.coalesce("stability", F.lit(0.0)).alias("__stable"))
    bare = own.where(~own_ids).select(*by, "start_sec", "end_sec")
    met = interval_join(bare, c, [key], width, "start_sec", "end_sec", "__a", "__b").where(F.least("end_sec", "__b") > F.greatest("start_sec", "__a"))
    met = met.select(*by, F.col("__id").alias("contour_id"))
    named = own.where(own_ids).select(*by, F.explode("contour_ids").alias("contour_id"))
    stable = named.unionByName(met).join(c.groupBy(key, F.col("__id").alias("contour_id")).agg(F.max("__stable").alias("__stable")), [key, "contour_id"], "left")
    stable = stable.groupBy(*by).agg(F.array_sort(F.collect_set("contour_id")).alias("__ids"), F.max("__stable").alias("__stable"))

    whole = own.join(ranges, by, "left").join(seen, by, "left").join(stable, by)
    ratio = F.coalesce("voiced_ratio", F.col("voiced_count") / F.col("frame_count"), F.lit(1.0))
    steady = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.coalesce("__range", F.lit(0.0)) / r.pitch_range))
    sure = F.coalesce("confidence", "__sure", F.lit(0.0))
    return whole.select(
        *by, *(F.round(x, 6).alias(x) for x in ("start_sec", "end_sec", "pitch")), F.round(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")), 6).alias("duration_sec"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 6).alias("confidence"), F.round(ratio, 6).alias("voiced_ratio"), (ratio >= r.voiced).alias("voiced"),
        F.round(F.coalesce("stability", "__stable", steady), 6).alias("stability"), F.when(own_ids, F.col("contour_ids")).otherwise(F.col("__ids")).alias("contour_ids"),
        "first_frame", "last_frame", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("frame_count", "voiced_count")),
    )


class _Accepted:
    """Spans by length within a factor of two, each class in order of start; so a look meets only spans long enough to matter."""

    def __init__(self):
        self.classes: dict[int, list[tuple[float, float]]] = {}

    def add(self, start: float, end: float) -> None:
        if end > start:
            insort(self.classes.setdefault(math.frexp(end - start)[1], []), (start, end))

    def covers(self, start: float, end: float, share: float) -> bool:
        """Whether one span covers more than `share` of this one."""
        long = end - start
        for k, spans in self.classes.items():
            most = math.ldexp(1.0, k)  # no span of this class is longer
            if long <= 0 or most <= share * long:
                continue
            for a, b in spans[bisect_right(spans, (start - most,)) : bisect_right(spans, (end, math.inf))]:
                if (min(end, b) - max(start, a)) / long > share:
                    return True
        return False


def _reasons(c: dict, accepted: _Accepted, r: SeedRules) -> list[str]:
    found = []
    if (c["confidence"] or 0.0) < r.sure:
        found.append("low_confidence")
    if (c["voiced_ratio"] or 0.0) < r.voiced:
        found.append("low_voiced_ratio")
    if round(max(0.0, c["end"] - c["start"]), 6) < r.least:
        found.append("too_short")
    if (c["stability"] or 0.0) < r.stability or (c["pitch_range"] or 0.0) > r.pitch_range:
        found.append("too_unstable")
    if not r.lowest <= c["pitch"] <= r.highest:
        found.append("outside_vocal_range")
    if accepted.covers(c["start"], c["end"], r.share):
        found.append("overlaps_accepted")
    return found


def steady_stretches(frames: list[tuple], r: SeedRules) -> list[list[tuple]]:
    """Frames (time, pitch, confidence) cut at unsure ones, at silences and where the range of pitch would grow too wide."""
    out, now, low, high = [], [], 0.0, 0.0
    for f in frames:
        if now and (f[2] < r.sure or f[0] - now[-1][0] > r.frame_gap or max(high, f[1]) - min(low, f[1]) > r.part_range):
            out.append(now)
            now = []
        if f[2] >= r.sure:
            low, high = (min(low, f[1]), max(high, f[1])) if now else (f[1], f[1])
            now.append(f)
    return [*out, now] if now else out


def _stable_span(frames: list[tuple]) -> tuple[float, float]:
    steps = [b[0] - a[0] for a, b in zip(frames, frames[1:]) if b[0] > a[0]]
    return frames[0][0], frames[-1][0] + (median(steps) if steps else 0.01)


def _part(frames: list[tuple], r: SeedRules) -> dict | None:
    start, end = _stable_span(frames)
    pitches = [f[1] for f in frames]
    if not r.part_least <= end - start <= r.part_longest or pstdev(pitches) > r.part_spread:
        return None
    spread = max(pitches) - min(pitches)
    return {"start": round(start, 6), "end": round(end, 6), "pitch": round(median(pitches), 6), "confidence": round(min(1.0, max(0.0, sum(f[2] for f in frames) / len(frames))), 6), "voiced_ratio": 1.0, "stability": round(min(1.0, max(0.0, 1 - spread / 3)), 6), "pitch_range": spread, "stable": (start, end)}


def seed_run(contours: list[dict], accepted: _Accepted, r: SeedRules) -> list[tuple]:
    """Contours in order, each against all accepted before it; an unsteady one is tried again in steady parts, which then grow towards each other."""
    out = []

    def told(c: dict, number: int, part: int, state: str, reasons: list[str]) -> None:
        stable = c.get("stable") or (None, None)
        out.append((number, part, c["start"], c["end"], *stable, c["pitch"], c["confidence"], c["stability"], state, reasons))

    for c in contours:
        if c["pitch"] is None:
            continue
        lacks = _reasons(c, accepted, r)
        if not lacks:
            accepted.add(c["start"], c["end"])
            told(c, c["id"], 0, "whole", [])
            continue
        taken: list[tuple[int, dict]] = []
        if "too_unstable" in lacks and c["duration"] >= r.cut_from:
            held = _Accepted()
            for k, frames in enumerate(steady_stretches(c["frames"], r), start=1):
                part = _part(frames, r)
                if part is None:
                    a, b = _stable_span(frames)
                    told({"start": a, "end": b, "pitch": None, "confidence": None, "stability": None}, c["id"], k, "part_rejected", ["too_short"])
                    continue
                against = _reasons(part, accepted, r)
                if "overlaps_accepted" not in against and held.covers(part["start"], part["end"], r.share):
                    against.append("overlaps_accepted")
                if against:
                    told(part, c["id"], k, "part_rejected", against)
                    continue
                held.add(part["start"], part["end"])
                taken.append((k, part))
        for at, (k, part) in enumerate(taken):
            start, end = part["stable"]
            left, right = c["start"], c["end"]
            if at:
                left = max(left, (taken[at - 1][1]["stable"][1] + start) / 2)
            if at + 1 < len(taken):
                right = min(right, (end + taken[at + 1][1]["stable"][0]) / 2)
            a, b = max(left, start - r.extension), min(right, end + r.extension)
            grown = part | {"start": round(a, 6), "end": round(b, 6)} if b > a else part
            accepted.add(grown["start"], grown["end"])
            told(grown, c["id"], k, "part", [])
        told(c, c["id"], 0, "in_parts" if taken else "rejected", lacks)
    return out


def seed_candidates(contours: DataFrame, raw: DataFrame, key: str, rules: SeedRules = SeedRules(), width: float = 60.0) -> DataFrame:
    """Candidates seeded by contours. A row for each contour (part 0) and each steady part tried of it, with its state and what it lacks.

    contours: key, contour_id (their order), start_sec, end_sec, pitch, confidence, voiced_ratio, stability, pitch_range and frames (array of time_sec,
    pitch_midi, confidence, or null). raw: key, start_sec, end_sec; accepted beforehand. States: whole, rejected, in_parts (parts
    stand for it), part, part_rejected. A contour is rejected also where one accepted span, raw or seeded before, covers more than `share` of it.
    A contour without times or pitch is skipped.

    Contours meet only through spans that overlap, and no span leaves the extent of its contour and frames. So a key is cut where no extent reaches
    over, raw candidates go to each run they overlap, and each run is a fold of its own. Contours that overlap in a chain are one run.
    """
    r6 = lambda c: F.round(F.col(c).cast("double"), 6)
    rows = contours.where("start_sec IS NOT NULL AND end_sec IS NOT NULL").select(key, "contour_id", *(r6(c).alias(c) for c in ("start_sec", "end_sec")), "frames", F.struct(*(r6(c).alias(c) for c in ("pitch", "confidence", "voiced_ratio", "stability", "pitch_range"))).alias("own"))
    times = F.transform("frames", lambda f: F.round(f["time_sec"], 6))
    last = F.greatest("start_sec", "end_sec", F.array_max(times) + max(rules.frame_gap, 0.01))
    rows = rows.withColumns({"__from": F.least("start_sec", "end_sec", F.array_min(times)), "__to": last})
    order, bucket = ["__from", "__to", "contour_id"], F.floor(F.col("__from") / width)
    extents = prefix(rows.select(key, *order), [key], order, F.col("__to"), "__reach", bucket=bucket)
    extents = cut(island_ids(extents, [key], order, F.col("__from") > F.col("__reach"), "__run", bucket).drop("__reach"))
    runs = extents.groupBy(key, "__run").agg(F.min("__from").alias("__a"), F.max("__to").alias("__b"))
    near = interval_join(runs, raw.select(key, F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end")), [key], width, "__a", "__b", "r_start", "r_end")
    seeds = rows.drop("__from", "__to").join(extents.select(key, "contour_id", "__run"), [key, "contour_id"])
    both = near.select(key, "__run", F.lit(0).alias("kind"), F.col("r_start").alias("start_sec"), F.col("r_end").alias("end_sec")).unionByName(seeds.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def fold(run: list[tuple]) -> list[tuple]:
        accepted, own = _Accepted(), []
        for kind, number, start, end, told, frames in run:
            if kind == 0:
                accepted.add(start, end)
                continue
            # a frame without time or pitch counts for nothing, one without confidence as unsure
            samples = sorted(((round(f["time_sec"], 6), round(f["pitch_midi"], 6), round(f["confidence"] or 0.0, 6)) for f in frames or [] if f["time_sec"] is not None and f["pitch_midi"] is not None), key=lambda f: f[0])
            sure = None if told["confidence"] is None else min(1.0, max(0.0, told["confidence"]))
            own.append(told | {"id": number, "start": start, "end": end, "duration": round(max(0.0, end - start), 6), "confidence": sure, "frames": samples})
        return seed_run(own, accepted, rules)

    return fold_each(both, key, fold, _OUT, ["kind", "contour_id", "start_sec", "end_sec", "own", "frames"], ["kind", "contour_id"])
