"""The top line of supporting notes where no one sings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import interval_join, island_ids, prefix

# Weights of length (up to so many seconds) and confidence in a note's score, and seconds in which onsets compete.
LENGTH_WEIGHT, LENGTH_MOST, SURE_WEIGHT = 0.6, 1.5, 0.4
WINDOW = 0.08


def top_line(notes: list[tuple], window: float) -> list[tuple]:
    """Notes (start, end, pitch, confidence, seq) of one run, reduced to a line.

    In order of start, score and pitch a note that competes with kept ones takes the place of the last of them if it has priority over all;
    then of kept notes that still overlap the one of higher priority stays.
    """
    scored = []
    for a, b, pitch, sure, seq in notes:
        score = min(b - a, LENGTH_MOST) * LENGTH_WEIGHT + max(0.0, min(1.0, sure)) * SURE_WEIGHT
        scored.append((a, b, int(round(pitch)), seq, score))
    scored.sort(key=lambda n: (n[0], -n[4], -n[2], n[3]))

    def priority(n: tuple) -> tuple:
        return round(n[4], 6), n[2], -n[0], n[1] - n[0]

    kept: list[tuple] = []
    live: list[int] = []  # places in `kept` that a later note may compete with
    for n in scored:
        live = [i for i in live if kept[i][1] > n[0] or n[0] - kept[i][0] <= window]
        rivals = [i for i in live if abs(kept[i][0] - n[0]) <= window or n[1] > kept[i][0]]
        if not rivals:
            live.append(len(kept))
            kept.append(n)
        elif all(priority(n) > priority(kept[i]) for i in rivals):
            kept[rivals[-1]] = n
    line: list[tuple] = []
    for n in sorted(kept, key=lambda n: (n[0], n[2], n[1])):
        if line and n[0] < line[-1][1]:
            if priority(n) > priority(line[-1]):
                line[-1] = n
        else:
            line.append(n)
    return [(n[3], n[0], n[1], n[2], round(n[4], 6)) for n in line]


def instrumental_hook(support: DataFrame, segments: DataFrame, key: str, window: float = WINDOW, width: float = 60.0) -> DataFrame:
    """The top line of the support notes that overlap an instrumental segment: key, note_seq, start_sec, end_sec, pitch, score.

    support: key, note_seq, start_sec, end_sec, pitch, confidence; notes without length or pitch are left out. segments: key, start_sec, end_sec, state.
    A key is cut where no note sounds and onsets are more than `window` apart; each run is a fold of its own.
    """
    quiet = segments.where(F.lower(F.trim("state")) == "instrumental").select(key, F.col("start_sec").alias("__a"), F.col("end_sec").alias("__b"))
    n = support.where("end_sec > start_sec AND pitch IS NOT NULL").select(key, "note_seq", "start_sec", "end_sec", F.col("pitch").cast("double").alias("pitch"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    met = interval_join(n.select(key, "note_seq", "start_sec", "end_sec"), quiet, [key], width, "start_sec", "end_sec", "__a", "__b").select(key, "note_seq").distinct()
    rows, order, bucket = n.join(met, [key, "note_seq"], "left_semi"), ["start_sec", "note_seq"], F.floor(F.col("start_sec") / width)
    rows = prefix(rows, [key], order, F.greatest("end_sec", F.col("start_sec") + window + 1e-9), "__reach", bucket=bucket)
    rows = island_ids(rows, [key], order, F.col("start_sec") > F.col("__reach"), "__run", bucket).drop("__reach")
    return fold_each(rows, key, lambda run: top_line(run, window), "note_seq long, start_sec double, end_sec double, pitch int, score double")
