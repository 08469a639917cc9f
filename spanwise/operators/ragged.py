"""Joins by position in ragged groups, lookups near intervals or points, and rescue by the nearest context."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import fold_each
from .intervals import asof_join, interval_join, island_ids, prefix
from .lineage import cut


def positions(df: DataFrame, key: str, order: list[str], name: str, bucket: Column) -> DataFrame:
    """Numbers the rows of a key from 0. bucket: a whole number that never falls along the order; a task takes the rows of one."""
    return prefix(df, [key], order, F.lit(1).cast("long"), name, F.sum, bucket=bucket).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def group_zip(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], left_bucket: Column, right_bucket: Column) -> DataFrame:
    """Right rows in groups of one to three zipped to left rows by position: all columns of both, left_at and right_at.

    With e more right rows left than left ones a left row takes three while e >= 4, two while e >= 2, and else
    one. As a group of three lowers e by two and one of two by one, the numbers of groups of
    each size follow from the counts alone, so each row's partner is computed and nothing is walked
    through. Rows without a partner are left out. Apart from the key, columns must differ.
    """
    a = positions(left, key, left_order, "left_at", left_bucket)
    b = positions(right, key, right_order, "right_at", right_bucket)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__left")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("__right")), key)
    more = F.col("__right") - F.col("__left")
    threes = F.when(more >= 4, F.floor((more - 2) / 2)).otherwise(0)
    counts = counts.withColumn("__threes", threes).withColumn("__twos", F.greatest(F.lit(0), more - 2 * F.col("__threes") - 1))
    at, threes, twos = F.col("right_at"), F.col("__threes"), F.col("__twos")
    partner = F.when(at < 3 * threes, F.floor(at / 3)).when(at < 3 * threes + 2 * twos, threes + F.floor((at - 3 * threes) / 2)).otherwise(at - 2 * threes - twos)
    b = b.join(counts, key).withColumn("left_at", partner).drop("__left", "__right", "__threes", "__twos")
    return a.join(b, [key, "left_at"])


def frames_near(spans: DataFrame, frames: DataFrame, key: str, span_id: str, tolerance: float, width: float) -> DataFrame:
    """The frames (key, time_sec and others) within `tolerance` of a span or of any of its sample times: frame columns and span_id, each pair once.

    spans: key, span_id, start_sec, end_sec, samples (array of times, null or empty if there are none). What a span looks at is
    brought together to windows that do not touch, with the times they are made of; so one join by buckets of `width` seconds finds all.
    """
    point = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    looks = F.concat(F.array(point(F.col("start_sec"), F.col("end_sec"))), F.coalesce(F.transform("samples", lambda t: point(t, t)), F.array()))
    rows = spans.select(key, span_id, F.explode(looks).alias("x")).select(key, span_id, "x.a", "x.b")
    # a little wider, as a time less the tolerance is rounded
    loose = tolerance * (1 + 1e-9) + 1e-9
    rows = rows.withColumns({"__from": F.col("a") - loose, "__to": F.col("b") + loose})
    keys, order = [key, span_id], ["__from", "__to"]
    rows = island_ids(prefix(rows, keys, order, F.col("__to"), "__reach"), keys, order, F.col("__from") > F.col("__reach"), "__run")
    windows = rows.groupBy(*keys, "__run").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"), F.collect_list(point(F.col("a"), F.col("b"))).alias("__looks")).drop("__run")
    time = F.col("time_sec")
    seen = F.exists("__looks", lambda x: F.when(x["a"] < x["b"], (x["a"] - tolerance <= time) & (time <= x["b"] + tolerance)).otherwise(F.abs(time - x["a"]) <= tolerance))
    found = interval_join(windows, frames.withColumn("__time", time), [key], width, "__from", "__to", "time_sec", "__time", seen)
    return found.select(*frames.columns, span_id)


def rescue_low_octave(pending: DataFrame, context: DataFrame, key: str, width: float = 600.0, lowest: int = 48, highest: int = 84, sure: float = 0.45, least: float = 0.12, reach: float = 4.0, tolerance: int = 4, big_gap: float = 0.5, jump: int = 9, passes: int = 4) -> DataFrame:
    """Notes under `lowest` that an octave up fit what is around them: key, note_seq, pitch (as rescued), pass.

    Passes go left to right and back in turn, `passes` at most. What is rescued is context for what is looked at later. Context
    are notes from `lowest` to `highest` with confidence `sure` and length `least`, the nearest before and after within `reach` seconds;
    of equally near ones those of `context` first. A note needs both, must not split a pause over `big_gap` into two such, must
    be `jump` from both and, moved, within `tolerance` of one, and nearer by more than half of that.

    A rescued note is never the nearest across a note of `context` that lies between, so the pending notes are
    cut there into runs, and each run is a fold of its own.
    """
    fit = F.col("pitch").between(lowest, highest) & (F.col("confidence") >= sure) & (F.round(F.col("end_sec") - F.col("start_sec"), 6) >= least)
    known = cut(context.where(fit).select(key, "start_sec", "end_sec", "pitch", "note_seq"))
    first = lambda t: known.groupBy(key, F.col(t).alias("__t")).agg(F.min_by(F.struct("start_sec", "end_sec", "pitch"), F.struct("start_sec", "end_sec", "pitch", "note_seq")).alias("__n"))
    rows = pending.select(key, "start_sec", "end_sec", "pitch", "confidence", "note_seq")
    rows = asof_join(rows, first("end_sec").withColumnRenamed("__n", "__left"), [key], "start_sec", "__t", ["__left"], width=width)
    rows = asof_join(rows, first("start_sec").withColumnRenamed("__n", "__right"), [key], "end_sec", "__t", ["__right"], forward=True, width=width)

    # the latest start among context notes that ended by the start of a pending note, and the latest end of pending notes before it
    bucket = F.floor(F.col("__t") / width)
    ended = known.select(key, F.col("end_sec").alias("__t"), F.lit(0).alias("__side"), F.col("start_sec").alias("__value"), F.lit(None).cast("long").alias("note_seq"))
    asked = rows.select(key, F.col("start_sec").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__value"), "note_seq")
    between = prefix(ended.unionByName(asked), [key], ["__t", "__side", "note_seq"], F.col("__value"), "__between", bucket=bucket).where("__side = 1").select(key, "note_seq", "__between")
    order = ["start_sec", "end_sec", "pitch", "note_seq"]
    at = F.floor(F.col("start_sec") / width)
    rows = prefix(rows.join(between, [key, "note_seq"]), [key], order, F.col("end_sec"), "__reach", bucket=at)
    # where two are apart by a context note, or by more than any looks
    apart = (F.col("__between") >= F.col("__reach")) | (F.col("start_sec") - F.col("__reach") > reach)
    rows = island_ids(rows, [key], order, apart, "__run", at)
    rows = rows.select(key, "__run", *order, "confidence", F.col("__left.end_sec").alias("l_end"), F.col("__left.pitch").alias("l_pitch"), F.col("__right.start_sec").alias("r_start"), F.col("__right.pitch").alias("r_pitch"))

    def fold(run: list[tuple]) -> list[tuple]:
        ends: list[tuple] = []  # of rescued notes: end, -turn, start, pitch
        starts: list[tuple] = []  # start, turn, end, pitch
        out, left = [], list(run)
        for n in range(passes):
            rest = []
            for note in left if n % 2 == 0 else left[::-1]:
                moved = rescued(note, ends, starts)
                if moved is None:
                    rest.append(note)
                    continue
                a, b, _, seq, c = note[:5]
                out.append((seq, int(moved), n + 1))
                if moved <= highest and c >= sure and round(b - a, 6) >= least:
                    insort(ends, (b, -len(out), a, moved))
                    insort(starts, (a, len(out), b, moved))
            if len(rest) == len(left):
                break
            left = sorted(rest, key=lambda x: (x[0], x[1], x[2], x[3]))
        return out

    def rescued(note: tuple, ends: list[tuple], starts: list[tuple]) -> float | None:
        a, b, pitch, _, _, l_end, l_pitch, r_start, r_pitch = note
        before = (l_end, l_pitch) if l_end is not None and a - l_end <= reach else None
        k = bisect_left(ends, (a, 1)) - 1
        if k >= 0 and a - ends[k][0] <= reach and (before is None or ends[k][0] > before[0]):
            before = (ends[k][0], ends[k][3])
        after = (r_start, r_pitch) if r_start is not None and r_start - b <= reach else None
        k = bisect_left(starts, (b, 0))
        if k < len(starts) and starts[k][0] - b <= reach and (after is None or starts[k][0] < after[0]):
            after = (starts[k][0], starts[k][3])
        if before is None or after is None:
            return None
        if after[0] - before[0] > big_gap and ((a - before[0] > big_gap) + (after[0] - b > big_gap) > 1 or a < before[0] or after[0] < b):
            return None
        now, then = (min(abs(pitch + s - p) for p in (before[1], after[1])) for s in (0, 12))
        fits = lowest <= pitch + 12 <= highest and pitch < lowest
        return pitch + 12 if fits and now >= max(8, jump) and then <= tolerance and then + max(2, tolerance // 2) < now else None

    return fold_each(rows, key, fold, "note_seq long, pitch int, pass int", ["start_sec", "end_sec", "pitch", "note_seq", "confidence", "l_end", "l_pitch", "r_start", "r_pitch"], order)
