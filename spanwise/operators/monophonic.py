"""Notes on a grid, merged and kept apart pitch by pitch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import island_ids, prefix


def merged_by_pitch(notes: list[tuple], gap: float, near: float) -> list[tuple]:
    """Notes (start, end, confidence, pitch) of one pitch in order: joined over short gaps where confidence is near, then kept from overlapping.

    Of two that overlap the first is cut where the second begins, if that one is surer and ends later; else it takes the second in.
    """
    joined: list[tuple] = []
    for n in notes:
        last = joined[-1] if joined else None
        if last and n[0] <= last[1] + gap and abs(n[2] - last[2]) <= near:
            joined[-1] = (last[0], max(last[1], n[1]), max(last[2], n[2]), n[3])
        else:
            joined.append(n)
    out: list[tuple] = []
    for n in joined:
        last = out[-1] if out else None
        if not last or n[0] >= last[1]:
            out.append(n)
        elif n[2] > last[2] and n[1] > last[1]:
            out[-1:] = [(last[0], n[0], last[2], n[3]), n]
        else:
            out[-1] = (last[0], max(last[1], n[1]), max(last[2], n[2]), n[3])
    return out


def snapped_monophonic(notes: DataFrame, key: str, tempo: float, transpose: int = 0, offset: float = 0.0, sure: float = 0.0, lowest: int = 0, highest: int = 127, least: float = 0.0, width: float = 60.0) -> DataFrame:
    """Notes moved and transposed, on a grid of sixteenths, with those of one pitch merged and not overlapping: key, start_sec, end_sec, confidence, pitch.

    Notes out of range or less sure than `sure` go, and at the end those shorter than `least`. A null confidence or pitch goes too.
    A pitch of a key is cut where no gap is bridged; each run is a fold of its own.
    """
    grid, near = 60.0 / tempo / 4.0, 0.35
    gap = grid * 0.55
    n = notes.withColumn("pitch", (F.col("pitch") + transpose).cast("int")).where(F.col("pitch").between(lowest, highest) & (F.col("confidence") >= sure))
    start = F.greatest(F.lit(0.0), F.col("start_sec") + offset)
    long = F.greatest(start + least, F.col("end_sec") + offset) - start
    on = F.bround(start / grid) * grid
    n = n.select(key, "pitch", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), on.alias("start_sec"), (on + F.greatest(F.lit(grid), F.bround(long / grid) * grid)).alias("end_sec"))
    keys, order, bucket = [key, "pitch"], ["start_sec", "end_sec", "confidence"], F.floor(F.col("start_sec") / width)
    rows = prefix(n, keys, order, F.col("end_sec"), "__reach", bucket=bucket)
    rows = island_ids(rows, keys, order, F.col("start_sec") > F.col("__reach") + gap, "__run", bucket).drop("__reach")
    rows = rows.withColumn("__run", F.col("__run") * (highest - lowest + 1) + F.col("pitch") - lowest)
    out = fold_each(rows, key, lambda run: merged_by_pitch(run, gap, near), "start_sec double, end_sec double, confidence double, pitch int", ["start_sec", "end_sec", "confidence", "pitch"], order)
    return out.where(F.col("end_sec") - F.col("start_sec") >= least)
