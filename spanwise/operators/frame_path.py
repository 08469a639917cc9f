"""From pitch frames to notes: a path of pitch or silence through all frames, its segments, and the notes of those."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import interval_join, island_ids, prefix
from .lattice import UNIT, cheapest_paths
from .lineage import cut


@dataclass(frozen=True)
class FrameRules:
    # Limits of what is heard as voiced, as a jump, as steady (median deviation) and as narrow (range).
    voiced: float = 0.3
    jump: float = 1.2
    radius: int = 2
    lowest: int = 21
    highest: int = 108
    smoothing: int = 7
    mad_good: float = 0.25
    mad_bad: float = 1.6
    span_soft: float = 1.2
    span_hard: float = 6.0
    hop: float = 0.01
    least_sec: float = 0.08
    least_frames: int = 3
    gap_frames: int = 3
    sure: float = 0.35
    # Frames of a block, the unit in which keys are dealt out.
    block: int = 4096


def with_neighbours(df: DataFrame, index: str, reach: int, block: int) -> DataFrame:
    """Rows dealt to blocks of `block` indexes, with those up to `reach` beyond the edges of each; `__own`: whether the block is a row's own.

    For windows that look at most `reach` rows far, where the index has no holes: partition them by key and `__block`.
    """
    at = F.floor(F.col(index) / block)
    blocks = F.array_distinct(F.array(at, F.floor((F.col(index) - reach) / block), F.floor((F.col(index) + reach) / block)))
    return df.withColumns({"__at": at, "__block": F.explode(blocks)}).withColumn("__own", F.col("__at") == F.col("__block")).drop("__at")


def _middle(sorted_values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(sorted_values)
    at = lambda k: F.element_at(sorted_values, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def _ramp(x: Column, good: float, bad: float) -> Column:
    return F.when(x <= good, 1.0).when(x >= bad, 0.0).otherwise((bad - x) / (bad - good))


def local_stability(frames: DataFrame, key: str, rules: FrameRules) -> DataFrame:
    """Adds `stability`, 1 to 0 by the median deviation of the observed pitches around a frame."""
    half = (rules.smoothing | 1) // 2
    w = W.partitionBy(key, "__block").orderBy("frame_index").rowsBetween(-half, half)
    rows = with_neighbours(frames, "frame_index", half, rules.block).withColumn("__near", F.array_sort(F.collect_list("observed").over(w))).where("__own")
    rows = rows.withColumn("__middle", _middle(F.col("__near")))
    off = F.array_sort(F.transform("__near", lambda v: F.abs(v - F.col("__middle"))))
    return rows.withColumn("stability", F.when(F.size("__near") <= 1, 1.0).otherwise(_ramp(_middle(off), rules.mad_good, rules.mad_bad))).drop("__near", "__middle", "__block", "__own")


def frame_states(frames: DataFrame, key: str, rules: FrameRules) -> DataFrame:
    """Adds `pitches`, null for silence first, and `cost` of each in whole parts of a unit: what a frame speaks against it."""
    heard = F.col("voiced") & F.col("observed").isNotNull()
    rows = local_stability(frames, key, rules)
    centre = F.bround("observed").cast("int")
    near = F.filter(F.sequence(centre - rules.radius, centre + rules.radius), lambda p: p.between(rules.lowest, rules.highest))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("confidence") - rules.voiced) / max(1e-6, 1.0 - rules.voiced)))
    silent = F.when(heard, F.lit(-0.25) - F.lit(0.85) * F.greatest(F.lit(0.0), F.col("confidence") - rules.voiced)).otherwise(0.30)
    # Weights of confidence, stability and distance, and what any pitch costs.
    score = lambda p: F.lit(1.05) * sure + F.lit(0.35) * F.col("stability") - F.lit(0.20) * F.abs(F.col("observed") - p) - 0.10
    whole = lambda c: F.round(-c * UNIT).cast("long")
    pitches = F.when(heard, F.concat(F.array(F.lit(None).cast("int")), near)).otherwise(F.array(F.lit(None).cast("int")))
    return rows.withColumn("pitches", pitches).withColumn("cost", F.transform("pitches", lambda p: whole(F.when(p.isNull(), silent).otherwise(score(p)))))


def pitch_step(jump: float):
    """Costs of going from pitch to pitch, where NaN is silence."""

    def step(before: np.ndarray, here: np.ndarray) -> np.ndarray:
        a, b = before[:, :1], here[:, 0][None, :]
        apart = np.abs(a - b)
        # Costs of staying, stepping and leaping, of silence going on, and of notes that begin and end.
        cost = np.where(apart == 0, -0.55, 1.05 + 0.25 * apart + np.where(apart >= jump, 0.65 + 0.12 * np.minimum(12.0, apart - jump), 0.0))
        cost = np.where(np.isnan(a), np.where(np.isnan(b), -0.15, 0.45), np.where(np.isnan(b), 0.35, cost))
        return np.rint(cost * UNIT).astype(np.int64)

    return step


def frame_path(frames: DataFrame, key: str, rules: FrameRules = FrameRules()) -> tuple[DataFrame, DataFrame]:
    """The best path: (key, frame_index, state: pitch or null for silence), and (key, score).

    frames: frame_index from 0 without holes, observed (null where nothing was), confidence, voiced.
    """
    states = frame_states(frames, key, rules)
    states = cut(states.select(key, "frame_index", "pitches", "cost", F.col("pitches").cast("array<double>").alias("feature")))
    block = F.floor(F.col("frame_index") / rules.block)
    paths, totals = cheapest_paths(states, key, ["frame_index"], block, pitch_step(rules.jump))
    # which pitch a choice is follows from the observed one
    chosen = paths.join(states.select(key, "frame_index", "pitches"), [key, "frame_index"]).select(key, "frame_index", F.col("pitches")[F.col("choice")].alias("state"))
    return chosen, totals.select(key, (-F.col("total") / UNIT).alias("score"))


def path_segments(path: DataFrame, key: str, block: int) -> DataFrame:
    """Runs of one pitch: key, start_idx, end_idx, pitch."""
    before = path.select(key, (F.col("frame_index") + 1).alias("frame_index"), F.col("state").alias("__before"))
    rows = path.where("state is not null").join(before, [key, "frame_index"], "left")
    at = F.floor(F.col("frame_index") / block)
    runs = island_ids(rows, [key], ["frame_index"], ~F.col("state").eqNullSafe(F.col("__before")), "__run", at)
    return runs.groupBy(key, "__run").agg(F.min("frame_index").alias("start_idx"), F.max("frame_index").alias("end_idx"), F.first("state").alias("pitch")).drop("__run")


def path_statistics(path: DataFrame, frames: DataFrame, key: str, rules: FrameRules) -> DataFrame:
    """Per key: state_changes, transition_penalty (sum of what transitions cost) and suppressed_spikes.

    A spike is a run of at most one frame more than the gap, silent or surely a leap away from the path's pitch, between pitches at most a semitone
    apart, in which some sure frame leaps away from the pitch before it. Neighbours are found by their index, so no task needs a whole key.
    """
    rows = cut(path.join(frames.select(key, "frame_index", "observed", "confidence"), [key, "frame_index"]))
    before = rows.select(key, (F.col("frame_index") + 1).alias("frame_index"), F.col("state").alias("before"))
    pairs = rows.join(before, [key, "frame_index"])
    a, b = F.col("before"), F.col("state")
    apart = F.abs(b - a).cast("double")
    # the costs of `pitch_step`
    cost = F.when(a.isNull() & b.isNull(), -0.15).when(a.isNull(), 0.45).when(b.isNull(), 0.35).when(apart == 0, -0.55).otherwise(1.05 + F.lit(0.25) * apart + F.when(apart >= rules.jump, 0.65 + F.lit(0.12) * F.least(F.lit(12.0), apart - rules.jump)).otherwise(0.0))
    moves = pairs.groupBy(key).agg(F.count_if(~a.eqNullSafe(b)).alias("state_changes"), (F.sum(F.greatest(F.lit(0), F.round(cost * UNIT).cast("long"))) / UNIT).alias("transition_penalty"))

    sure = F.col("observed").isNotNull() & (F.col("confidence") >= rules.voiced)
    odd = rows.withColumn("__sure", sure).where(F.col("state").isNull() | (F.col("__sure") & (F.abs(F.col("observed") - F.col("state")) >= rules.jump)))
    ahead = odd.select(key, (F.col("frame_index") + 1).alias("frame_index"), F.lit(True).alias("__goes_on"))
    odd = island_ids(odd.join(ahead, [key, "frame_index"], "left"), [key], ["frame_index"], F.col("__goes_on").isNull(), "__run", F.floor(F.col("frame_index") / rules.block))
    heard = F.when(F.col("__sure"), F.col("observed"))
    runs = odd.groupBy(key, "__run").agg(F.min("frame_index").alias("__start"), F.max("frame_index").alias("__end"), F.min(heard).alias("__low"), F.max(heard).alias("__high"))
    runs = runs.where(F.col("__end") - F.col("__start") + 1 <= max(1, rules.gap_frames + 1))
    for name, at in (("left", F.col("__start") - 1), ("right", F.col("__end") + 1)):
        runs = runs.withColumn("frame_index", at).join(rows.select(key, "frame_index", F.col("state").alias(f"__{name}")), [key, "frame_index"]).drop("frame_index")
    left = F.col("__left")
    spike = (F.abs(left - F.col("__right")) <= 1) & (F.greatest(F.abs(F.col("__low") - left), F.abs(F.col("__high") - left)) >= rules.jump)
    spikes = runs.groupBy(key).agg(F.count_if(spike).alias("suppressed_spikes"))
    found = rows.select(key).distinct().join(moves, key, "left").join(spikes, key, "left")
    return found.fillna(0, ["state_changes", "suppressed_spikes"]).fillna(0.0, ["transition_penalty"])


def merge_segments(segments: DataFrame, key: str, rules: FrameRules) -> DataFrame:
    """Segments that join the last one over a short gap: of one pitch, or near and short; the pitch of the longer stays.

    A segment further away than the gap never joins, so runs are cut there.
    """
    most_gap = max(1, rules.gap_frames + 1)
    short = max(rules.least_frames, round(max(rules.least_sec, rules.hop) / max(rules.hop, 1e-4)))

    def fold(rows: list[tuple]) -> list[tuple]:
        out = [[*rows[0], 1]]
        for start, end, pitch in rows[1:]:
            last = out[-1]
            gap, apart = start - last[1] - 1, abs(pitch - last[2])
            own, other = end - start + 1, last[1] - last[0] + 1
            least = min(own, other)
            near = apart <= 1 and least <= max(short, rules.least_frames * 2)
            expressive = apart <= 2 and least <= max(short * 3, rules.least_frames * 5)
            if gap <= most_gap and (apart == 0 or near or expressive):
                last[1], last[2], last[3] = end, last[2] if other >= own else pitch, last[3] + 1
            else:
                out.append([start, end, pitch, 1])
        return [tuple(x) for x in out]

    at = F.floor(F.col("start_idx") / rules.block)
    rows = prefix(segments, [key], ["start_idx"], F.col("end_idx"), "__reach", bucket=at)
    runs = island_ids(rows, [key], ["start_idx"], F.col("start_idx") - F.col("__reach") - 1 > most_gap, "__run", at).drop("__reach")
    return fold_each(runs, key, fold, "start_idx long, end_idx long, pitch int, n_merged int", ["start_idx", "end_idx", "pitch"], ["start_idx"])


def segment_notes(merged: DataFrame, frames: DataFrame, key: str, rules: FrameRules) -> DataFrame:
    """A note for each segment from its voiced frames, with the reason why it is rejected, if it is."""
    heard = frames.where("voiced and observed is not null").select(key, F.col("frame_index").alias("__f"), (F.col("frame_index") + 1).alias("__g"), "observed", "confidence")
    spans = merged.withColumn("__stop", F.col("end_idx") + 1)
    both = interval_join(spans, heard, [key], float(rules.block), "start_idx", "__stop", "__f", "__g")
    found = both.groupBy(key, "start_idx", "end_idx", "n_merged").agg(F.count(F.lit(1)).alias("n_frames"), F.avg("confidence").alias("mean"), F.array_sort(F.collect_list("observed")).alias("__seen"), (F.percentile("observed", 0.9) - F.percentile("observed", 0.1)).alias("span"))
    found = found.withColumn("median", _middle(F.col("__seen")))
    found = found.withColumn("mad", _middle(F.array_sort(F.transform("__seen", lambda v: F.abs(v - F.col("median")))))).drop("__seen")
    quality = F.lit(0.55) * _ramp(F.col("mad"), rules.mad_good, rules.mad_bad) + F.lit(0.45) * _ramp(F.col("span"), rules.span_soft, rules.span_hard)
    out = found.select(
        key, "start_idx", "end_idx", "n_merged", "n_frames", F.bround("median").cast("int").alias("pitch"), F.greatest(F.lit(0.0), F.col("start_idx") * rules.hop - rules.hop * 0.5).alias("start_sec"), (F.col("end_idx") * rules.hop + rules.hop * 0.5).alias("end_sec"),
        (F.col("mean") * (F.lit(0.65) + F.lit(0.35) * quality)).alias("confidence"),
    )
    length = F.round(F.col("end_sec") - F.col("start_sec"), 9)
    weak = (F.round("confidence", 9) < rules.sure) & (length < max(0.20, rules.least_sec * 2.5))
    return out.withColumn("rejected", F.when((length < rules.least_sec) | (F.col("n_frames") < rules.least_frames), "short_fragment").when(weak, "low_confidence_island"))
