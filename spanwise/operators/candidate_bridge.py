"""Contours that fill pauses between notes, where each accepted one becomes context for the next."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import asof_join, interval_join, island_ids, prefix
from .lineage import cut


@dataclass(frozen=True)
class BridgeRules:
    # Confidence, seconds, semitones.
    sure: float = 0.72
    voiced: float = 0.9
    least: float = 0.18
    longest: float = 2.5
    stability: float = 0.35
    lowest: float = 48.0
    highest: float = 84.0
    vocal: float = 0.6
    least_gap: float = 0.18
    reach: float = 4.0
    big_gap: float = 0.5
    tolerance: int = 4
    cut_from: float = 2.5
    part_least: float = 0.18
    part_longest: float = 0.75
    part_range: float = 1.25
    frame_gap: float = 0.04


#: What a candidate may lack, in the order in which it is told.
REASONS = ["low_confidence", "low_voiced_ratio", "too_short", "too_unstable", "outside_vocal_range", "overlaps_note", "no_gap", "no_local_context", "splits_big_gap", "no_vocal_activity"]
_OUT = "contour_id long, part int, start_sec double, end_sec double, pitch double, confidence double, accepted boolean, reasons array<string>"


class _Context:
    """Notes near a run of contours, with those accepted."""

    def __init__(self, notes: list[tuple], rules: BridgeRules):
        self.rules = rules
        self.notes: list[tuple] = []  # start, end, pitch, confidence
        self.longest = 0.0
        for n in notes:
            self.add(n)

    def add(self, note: tuple) -> None:
        insort(self.notes, note)
        self.longest = max(self.longest, note[1] - note[0])

    def near(self, start: float, end: float) -> list[tuple]:
        a = bisect_right(self.notes, (start - self.longest - self.rules.reach,))
        b = bisect_right(self.notes, (end + self.rules.reach, float("inf")))
        return self.notes[a:b]

    def overlaps(self, start: float, end: float) -> bool:
        return any(min(n[1], end) - max(n[0], start) > 0 for n in self.near(start, end))

    def gap(self, start: float, end: float) -> tuple[float, float] | None:
        """The pause between two notes in order that holds the middle."""
        middle = (start + end) / 2
        k = bisect_left(self.notes, (middle,))
        if 0 < k < len(self.notes) and self.notes[k - 1][1] < self.notes[k][0] and self.notes[k - 1][1] <= middle:
            return round(self.notes[k - 1][1], 6), round(self.notes[k][0], 6)
        return None

    def sides(self, start: float, end: float) -> tuple[tuple[float, float] | None, tuple[float, float] | None]:
        """Distance and pitch of the nearest good notes before and after, within reach; of equally near ones the first."""
        r, left, right = self.rules, None, None
        for a, b, pitch, sure in self.near(start, end):
            if not r.lowest <= pitch <= r.highest or b - a < r.least or sure < r.sure:
                continue
            if b <= start:
                if start - b <= r.reach and (left is None or start - b < left[0]):
                    left = (start - b, pitch)
            elif a >= end and a - end <= r.reach and (right is None or a - end < right[0]):
                right = (a - end, pitch)
        return left, right


def _lacks(c: dict, context: _Context, vocal: list[tuple] | None, r: BridgeRules) -> list[str]:
    """What speaks against a candidate; its pitch is moved an octave up where the context asks for it."""
    start, end = c["start"], c["end"]
    long = round(max(0.0, end - start), 6)
    gap = context.gap(start, end)
    left, right = context.sides(start, end)
    if c["pitch"] is not None and c["pitch"] < r.lowest and (left or right):
        near = [s[1] for s in (left, right) if s]
        now, then = (min(abs(c["pitch"] + s - p) for p in near) for s in (0, 12))
        if r.lowest <= c["pitch"] + 12 <= r.highest and now >= 8 and then <= r.tolerance and then + max(2.0, r.tolerance / 2) < now:
            c["pitch"] = round(c["pitch"] + 12, 6)
    # a pause is split in two big ones, or a side is missing or touches
    splits = gap is not None and round(gap[1] - gap[0], 6) > r.big_gap and (not left or not right or round(left[0], 6) == 0 or round(right[0], 6) == 0 or (left[0] > r.big_gap and right[0] > r.big_gap))
    inside = 0.0 if gap is None else round(min(end, gap[1]) - max(start, gap[0]), 6)
    held = None if vocal is None else (sum(max(0.0, min(end, b) - max(start, a)) for a, b in vocal) / long if long else 0.0)
    too_long = long > r.longest
    unstable = c["stability"] is None or c["stability"] < r.stability
    tests = [
        c["confidence"] < r.sure, c["voiced_ratio"] is None or c["voiced_ratio"] < r.voiced, long < r.least, too_long or unstable,
        c["pitch"] is None or not r.lowest <= c["pitch"] <= r.highest, context.overlaps(start, end), gap is None or round(gap[1] - gap[0], 6) < r.least_gap or inside < r.least,
        not left or not right, splits, held is not None and round(held, 6) < r.vocal,
    ]
    found = [name for name, failed in zip(REASONS, tests, strict=True) if failed]
    return [] if found == ["too_unstable"] and not too_long and c["moves"] else found


def _parts(c: dict, r: BridgeRules) -> list[dict]:
    """Steady stretches of a long contour as candidates."""
    if c["end"] - c["start"] < r.cut_from:
        return []
    stretches, now = [], []
    for t, p, s in c["frames"] or []:
        if s < r.sure or (now and (t - now[-1][0] > r.frame_gap or max(x[1] for x in [*now, (t, p)]) - min(x[1] for x in [*now, (t, p)]) > r.part_range)):
            stretches.append(now)
            now = []
        if s >= r.sure:
            now.append((t, p, s))
    out = []
    for k, f in enumerate((x for x in [*stretches, now] if x), start=1):
        steps = [b[0] - a[0] for a, b in zip(f, f[1:]) if b[0] > a[0]]
        start, end = f[0][0], f[-1][0] + (median(steps) if steps else 0.01)
        pitches = [x[1] for x in f]
        spread = max(pitches) - min(pitches)
        if r.part_least <= end - start <= r.part_longest:
            out.append({"id": c["id"], "part": k, "start": round(start, 6), "end": round(end, 6), "pitch": round(median(pitches), 6), "confidence": round(sum(x[2] for x in f) / len(f), 6), "voiced_ratio": 1.0, "stability": round(max(0.0, min(1.0, 1 - spread / (r.part_range * 2))), 6), "moves": c["vibrato"] and spread <= r.part_range})
    return out


def bridge_run(contours: list[dict], notes: list[tuple], vocal: list[tuple] | None, r: BridgeRules) -> list[tuple]:
    """Contours in order; each that is rejected is tried again in parts."""
    context, out = _Context(notes, r), []

    def tried(c: dict) -> bool:
        lacks = _lacks(c, context, vocal, r)
        out.append((c["id"], c["part"], c["start"], c["end"], c["pitch"], c["confidence"], not lacks, lacks))
        if not lacks:
            context.add((c["start"], c["end"], c["pitch"], c["confidence"]))
        return not lacks

    for c in contours:
        if not tried(c):
            for part in _parts(c, r):
                tried(part)
    return out


def bridge_candidates(contours: DataFrame, notes: DataFrame, key: str, vocal: DataFrame | None = None, rules: BridgeRules = BridgeRules(), width: float = 60.0) -> DataFrame:
    """For each contour, and each part tried of it: whether it is accepted as a note, and what it lacks.

    contours: key, contour_id (their order), start_sec, end_sec, pitch, confidence, voiced_ratio, stability, glides, vibrato and
    frames (array of time_sec, pitch_midi, confidence, or null). notes: start_sec, end_sec, pitch, confidence. vocal: start_sec, end_sec;
    a key without vocal stretches is judged without them. A contour that lies in no pause between two notes lacks one.

    No contour looks further than `reach` but for the pause it lies in, so a key is cut where contours are further apart. Notes are sent to each run
    within reach of it, and so are the last to begin before a contour and the first after it, which bound the pause.
    """
    spans = contours.select(key, "contour_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("start_sec", "end_sec")))
    order, bucket = ["start_sec", "end_sec", "contour_id"], F.floor(F.col("start_sec") / width)
    runs = prefix(spans, [key], order, F.col("end_sec"), "__reach", bucket=bucket)
    runs = cut(island_ids(runs, [key], order, F.col("start_sec") - F.col("__reach") > rules.reach, "__run", bucket).drop("__reach"))
    extent = runs.groupBy(key, "__run").agg((F.min("start_sec") - rules.reach - 1e-6).alias("__from"), (F.max("end_sec") + rules.reach + 1e-6).alias("__to"))
    n = cut(notes.select(key, F.col("start_sec").alias("n_start"), F.col("end_sec").alias("n_end"), F.col("pitch").cast("double").alias("n_pitch"), F.col("confidence").alias("n_sure")))
    packed = F.struct("n_start", "n_end", "n_pitch", "n_sure").alias("note")
    near = interval_join(extent, n, [key], width, "__from", "__to", "n_start", "n_end").select(key, "__run", packed)
    last = n.groupBy(key, F.col("n_start").alias("__at")).agg(F.max(F.struct("n_start", "n_end", "n_pitch", "n_sure")).alias("note"))
    ends = runs.select(key, "__run", "start_sec", "end_sec", "contour_id")
    next_ = n.groupBy(key, F.col("n_start").alias("__at")).agg(F.min(F.struct("n_start", "n_end", "n_pitch", "n_sure")).alias("note"))
    first = asof_join(ends, last, [key], "start_sec", "__at", ["note"], width=width).unionByName(asof_join(ends, next_, [key], "end_sec", "__at", ["note"], forward=True, width=width))
    first = first.where("note is not null").select(key, "__run", "note")
    # a note that both ways find counts once, equal notes as often as there are
    rows = near.withColumn("n", F.lit(1)).groupBy(key, "__run", "note").agg(F.sum("n").alias("n")).unionByName(first.distinct().withColumn("n", F.lit(0))).groupBy(key, "__run", "note").agg(F.greatest(F.lit(1), F.sum("n")).alias("n"))
    kinds = rows.select(key, "__run", F.lit(0).alias("kind"), "note", "n")
    whole = contours.select(key, "contour_id", F.struct(F.round(F.col("start_sec").cast("double"), 6).alias("start"), F.round(F.col("end_sec").cast("double"), 6).alias("end"), F.round(F.col("pitch").cast("double"), 6).alias("pitch"), F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.round("voiced_ratio", 6).alias("voiced_ratio"), F.round("stability", 6).alias("stability"), (F.coalesce("glides", F.lit(False)) | F.coalesce("vibrato", F.lit(False))).alias("moves"), F.coalesce("vibrato", F.lit(False)).alias("vibrato"), "frames").alias("contour"))
    kinds = kinds.unionByName(runs.select(key, "__run", "contour_id").join(whole, [key, "contour_id"]).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    if vocal is not None:
        heard = vocal.select(key, F.col("start_sec").alias("v_start"), F.col("end_sec").alias("v_end"))
        stretches = interval_join(extent, heard, [key], width, "__from", "__to", "v_start", "v_end").select(key, "__run", F.struct("v_start", "v_end").alias("stretch"))
        known = extent.select(key, "__run").join(heard.select(key).distinct(), key).withColumn("stretch", F.lit(None).cast("struct<v_start: double, v_end: double>"))
        kinds = kinds.unionByName(stretches.unionByName(known).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    else:
        kinds = kinds.withColumn("stretch", F.lit(None).cast("struct<v_start: double, v_end: double>"))

    def fold(rows: list[tuple]) -> list[tuple]:
        own, around, stretches = [], [], None
        for kind, number, note, n, contour, stretch in rows:
            if kind == 0:
                around += [tuple(note[c] for c in ("n_start", "n_end", "n_pitch", "n_sure"))] * n
            elif kind == 1:
                stretches = (stretches or []) + ([(stretch["v_start"], stretch["v_end"])] if stretch else [])
            else:
                own.append(contour | {"id": number, "part": 0, "frames": sorted((f["time_sec"], f["pitch_midi"], f["confidence"]) for f in contour["frames"] or [])})
        return bridge_run(own, around, stretches, rules)

    return fold_each(kinds, key, fold, _OUT, ["kind", "contour_id", "note", "n", "contour", "stretch"], ["kind", "contour_id"])
