"""Operators whose next step depends on what was kept before, as folds over short runs.

A fold never looks across a silence longer than what its rule bridges, so each key is first
cut there into runs (a window), and the fold runs per run: groups stay short however long a
key is. The folds themselves are small functions on (start, end, pitch, confidence, seq).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .intervals import island_ids, prefix, previous, reach
from .lineage import ship

Note = tuple[float, float, float, float, int]
FIELDS = ["start_sec", "end_sec", "pitch", "confidence", "note_seq"]
ORDER = ["start_sec", "note_seq"]


def fold_runs(notes: DataFrame, key: str, bridge: float, fold: Callable[[list[Note]], list[tuple]], columns: str, width: float | None = None) -> DataFrame:
    """Applies `fold` to each run of notes with no silence over `bridge`; its rows get the key before them. width: seconds of a key that one task takes when runs are numbered.

    Runs are dealt out whole and come sorted, so a task walks through its runs one after the
    other and holds one at a time; a run may go on in the next batch.
    """
    bucket = None if width is None else F.floor(F.col("start_sec") / width)
    rows = prefix(notes.select(key, *FIELDS), [key], ORDER, F.col("end_sec"), "__reach", bucket=bucket)
    rows = island_ids(rows, [key], ORDER, F.col("start_sec") > F.col("__reach") + bridge, "__run", bucket).drop("__reach")
    return fold_each(rows, key, fold, columns)


def fold_each(rows: DataFrame, key: str, fold: Callable[[list[tuple]], list[tuple]], columns: str, fields: list[str] = FIELDS, order: list[str] = ORDER) -> DataFrame:
    """Applies `fold` to the `fields` of the rows of each key and `__run`; its rows get the key before them."""
    kind = dict(rows.dtypes)[key]
    schema = _parse_datatype_string(f"{key} {kind}, {columns}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != name:
                    out += [(name[0], *x) for x in fold(held)] if held else []
                    name, held = row[:2], []
                held.append(row[2:])
            yield made(out)
        yield made([(name[0], *x) for x in fold(held)] if held else [])

    dealt = ship(rows).select(key, "__run", *fields).repartition(key, "__run").sortWithinPartitions(key, "__run", *order)
    return dealt.mapInArrow(run, schema)


def range_bounded(notes: DataFrame, key: str, limit: float, sure: float, gap: float, width: float = 600.0) -> DataFrame:
    """Segments of rows of confidence `sure` or more, without a step in time over `gap`, whose pitches stay within `limit`.

    The row that would leave the range starts the next segment. Rows that are not sure belong to none and end
    the one before them, so runs are cut at them and at steps over `gap`. width: seconds of a key that one task takes when runs are numbered.
    """

    def fold(run: list[Note]) -> list[tuple]:
        out: list[list] = []
        for start, end, pitch, confidence, seq in run:
            if confidence < sure:
                continue
            now = out[-1] if out else None
            if now is None or max(now[4], pitch) - min(now[3], pitch) > limit:
                out.append([seq, start, end, pitch, pitch, 1])
            else:
                now[2:] = end, min(now[3], pitch), max(now[4], pitch), now[5] + 1
        return [tuple(x) for x in out]

    bucket = F.floor(F.col("start_sec") / width)
    rows = previous(ship(notes).select(key, *FIELDS), [key], ORDER, "start_sec", "__before", bucket)
    apart = (F.col("confidence") < sure) | (F.col("start_sec") - F.col("__before") > gap)
    rows = island_ids(rows, [key], ORDER, apart, "__run", bucket)
    return fold_each(rows, key, fold, "first_seq long, start_sec double, end_sec double, low double, high double, n_notes int")


def trim_weaker(gap: float) -> Callable[[list[Note]], list[tuple]]:
    """Of a note and the last one kept, if they overlap, the more confident stays whole, the earlier of equals.

    The other ends `gap` before it, though not before its own start, or begins `gap` after it; a note
    whose start reaches its end goes.
    """

    def fold(notes: list[Note]) -> list[tuple]:
        kept = [list(notes[0])]
        for note in map(list, notes[1:]):
            last = kept[-1]
            if note[0] < last[1]:
                if note[3] > last[3]:
                    last[1] = max(last[0], note[0] - gap)
                else:
                    note[0] = min(note[1], last[1] + gap)
            if note[1] > note[0]:
                kept.append(note)
        return [(n[4], n[0], n[1], int(n[2])) for n in kept]

    return fold


def best_of_conflicts(notes: DataFrame, key: str, window: float, width: float | None = None) -> DataFrame:
    """Of the notes that start within `window` of a group's first one the best stays: key, note_seq, start_sec, end_sec, pitch, confidence, n_group.

    The best is the longest, then the most confident, then the nearest in pitch to the winner before, the earliest, and
    the one with the largest note_seq. Only among notes as long and as confident does the winner before matter: first,
    each group is brought down to those, and a group with one of them begins a run that needs no memory. width: seconds of
    a key that one task takes when runs are numbered.
    """

    def length(note: Note) -> float:
        return round(note[1] - note[0], 6)

    def groups(run: list[Note]) -> list[tuple]:
        out, group = [], []
        for note in [*run, None]:
            if group and (note is None or note[0] - group[0][0] > window):
                most = max((length(n), n[3]) for n in group)
                best = [n for n in group if (length(n), n[3]) == most]
                out += [(group[0][0], len(best), len(group), n[4], n[0], n[1], int(n[2]), n[3]) for n in best]
                group = []
            if note is not None:
                group.append(note)
        return out

    def winners(run: list[tuple]) -> list[tuple]:
        out, last = [], None
        for _, group in groupby(run, key=lambda n: n[0]):
            best = min(group, key=lambda n: (abs(n[5] - last) if last is not None else 0, n[3], -n[2]))
            out.append((*best[2:], best[1]))
            last = best[5]
        return out

    # twice the window, as no group reaches over a silence longer than it
    tied = fold_runs(notes, key, 2 * window, groups, "anchor double, n_best int, n_group int, note_seq long, start_sec double, end_sec double, pitch int, confidence double")
    bucket = None if width is None else F.floor(F.col("anchor") / width)
    runs = island_ids(tied, [key], ["anchor", "note_seq"], F.col("n_best") == 1, "__run", bucket)
    fields = ["anchor", "n_group", "note_seq", "start_sec", "end_sec", "pitch", "confidence"]
    return fold_each(runs, key, winners, "note_seq long, start_sec double, end_sec double, pitch int, confidence double, n_group int", fields, ["anchor", "note_seq"])


def limit_polyphony(most: int) -> Callable[[list[Note]], list[tuple]]:
    """Notes in order of confidence, length, start and pitch stay where at most `most` then sound at once. Runs are cut at silences, over which nothing sounds."""

    def fold(notes: list[Note]) -> list[tuple]:
        kept: list[tuple[float, float, int]] = []  # by start
        longest = max((n[1] - n[0] for n in notes), default=0.0)
        for note in sorted(notes, key=lambda n: (-n[3], n[0] - n[1], n[0], n[2], n[4])):
            near = kept[bisect_left(kept, (note[0] - 2 * longest,)) : bisect_left(kept, (note[1],))]
            near = [k for k in near if k[1] > note[0]]
            points = [note[0], *(k[0] for k in near if k[0] > note[0])]
            if note[1] <= note[0] or most > max(sum(k[0] <= p < k[1] for k in near) for p in points):
                insort(kept, (note[0], note[1], note[4]))
        return [(k[2], k[0], k[1]) for k in kept] if most > 0 else []

    return fold


def drop_leaps(notes: DataFrame, key: str, leap: float = 12, short: float = 0.25, unsure: float = 0.62, width: float | None = None) -> DataFrame:
    """Short or unsure notes at least `leap` semitones from the last one kept go, however long ago that was.

    Notes that are neither are kept whatever came before, so each begins a run that needs no memory of what lies
    before it. width: seconds of a key that one task takes when runs are numbered.
    """

    def fold(run: list[Note]) -> list[tuple]:
        kept = run[:1]
        for note in run[1:]:
            if abs(note[2] - kept[-1][2]) < leap:
                kept.append(note)
        return [(n[4], n[0], n[1], int(n[2]), n[3]) for n in kept]

    firm = (F.col("end_sec") - F.col("start_sec") >= short) & (F.col("confidence") >= unsure)
    bucket = None if width is None else F.floor(F.col("start_sec") / width)
    rows = island_ids(ship(notes).select(key, *FIELDS), [key], ORDER, firm, "__run", bucket)
    return fold_each(rows, key, fold, "note_seq long, start_sec double, end_sec double, pitch int, confidence double")


def match_each_left(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Each left note in order of its start takes the nearest free right note of its pitch (the earlier of equals): key, left_seq, right_seq.

    Notes of a key and pitch that start over `tolerance` apart never meet, so runs are cut there.
    """

    def fold(run: list[Note]) -> list[tuple]:
        free, out = [n for n in run if n[2]], []
        starts = [n[0] for n in free]
        taken = [False] * len(free)
        for note in run:
            if note[2]:
                continue
            near = range(bisect_left(starts, note[0] - 2 * tolerance), bisect_right(starts, note[0] + 2 * tolerance))
            open_ = [(abs(starts[j] - note[0]), j) for j in near if not taken[j] and abs(starts[j] - note[0]) <= tolerance]
            if open_:
                j = min(open_)[1]
                taken[j] = True
                out.append((note[4], free[j][4]))
        return out

    side = lambda df, k: df.select(F.struct(key, F.col("pitch").alias("of_pitch")).alias("__key"), "start_sec", F.col("start_sec").alias("end_sec"), F.lit(k).alias("pitch"), F.lit(0.0).alias("confidence"), "note_seq")
    # twice the tolerance, as the sum of start and tolerance is rounded
    found = fold_runs(side(left, 0).unionByName(side(right, 1)), "__key", 2 * tolerance, fold, "left_seq long, right_seq long")
    return found.select(f"__key.{key}", "left_seq", "right_seq")


def replace_weaker(window: float) -> Callable[[list[Note]], list[tuple]]:
    """A note that overlaps one kept by more than `window` takes the place of the first such, if it has the higher confidence, length, pitch, or goes.

    Notes come by start, confidence and length; the place it takes is that in the order in which places were taken.
    """

    def fold(notes: list[Note]) -> list[tuple]:
        rank = lambda n: (n[3], round(n[1] - n[0], 6), n[2])
        active: list[Note] = []
        out: list[Note] = []
        for note in sorted(notes, key=lambda n: (n[0], -n[3], -round(n[1] - n[0], 6), n[4])):
            # what ends before this one begins meets none of the later ones either
            out += [k for k in active if k[1] <= note[0]]
            active = [k for k in active if k[1] > note[0]]
            at = next((k for k, x in enumerate(active) if note[0] < x[1] - window and x[0] < note[1] - window), None)
            if at is None:
                active.append(note)
            elif rank(note) > rank(active[at]):
                active[at] = note
        return [(n[4], n[0], n[1], int(n[2])) for n in out + active]

    return fold


def cheapest_path(costs: list[list[float]], step: Callable[[int, int, int], float]) -> list[int]:
    """States of the least total of own costs and step(k, from, to) costs; the smaller state of equals."""
    total, back = list(costs[0]), []
    for k in range(1, len(costs)):
        ways = [min((total[i] + step(k, i, j), i) for i in range(len(total))) for j in range(len(costs[k]))]
        back.append([i for _, i in ways])
        total = [w + c for (w, _), c in zip(ways, costs[k], strict=True)]
    path = [min(range(len(total)), key=lambda j: (total[j], j))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


#: What a note's pitch may be heard as, in semitones, and the cost of hearing it so; None: not at all.
HEARD = [(0, 0.0), (-12, 0.6), (12, 0.6), (None, 1.2)]


def octave_path(notes: list[Note]) -> list[tuple]:
    """The cheapest way to hear each note, as it is, an octave off or not at all; jumps cost by octaves, doubt makes silence cheaper."""
    costs = [[c * (0.5 + n[3]) if s is not None else 0.2 + c * n[3] for s, c in HEARD] for n in notes]

    def step(k: int, i: int, j: int) -> float:
        a, b = HEARD[i][0], HEARD[j][0]
        return 0.3 if a is None or b is None else abs(notes[k][2] + b - notes[k - 1][2] - a) / 12

    path = cheapest_path(costs, step)
    return [(n[4], int(n[2]), None if HEARD[s][0] is None else int(n[2]) + HEARD[s][0]) for n, s in zip(notes, path, strict=True)]


def lattice_snap(grid: float) -> Callable[[list[Note]], list[tuple]]:
    """Onsets on the grid, each at one of the three nearest points, so that shifts, collisions and reversed order cost least in all."""

    def fold(notes: list[Note]) -> list[tuple]:
        points = [[round(n[0] / grid) + d for d in (-1, 0, 1)] for n in notes]
        costs = [[abs(p * grid - n[0]) / grid for p in ps] for n, ps in zip(notes, points, strict=True)]
        step = lambda k, i, j: 0.0 if points[k][j] > points[k - 1][i] else 1.0 if points[k][j] == points[k - 1][i] else 4.0
        path = cheapest_path(costs, step)
        return [(n[4], n[0], points[k][s] * grid) for k, (n, s) in enumerate(zip(notes, path, strict=True))]

    return fold


def merge_same_pitch(notes: DataFrame, key: str, gap: float, width: float | None = None) -> DataFrame:
    """Neighbours of one pitch at most `gap` apart become one note, with the first one's note_seq and start, the latest end and the best confidence."""
    bucket = None if width is None else F.floor(F.col("start_sec") / width)
    w = W.partitionBy(key).orderBy(*ORDER)
    rows = notes.select(key, *FIELDS)
    # the row before may lie in another bucket, so it is looked up over the key
    rows = island_ids(rows.withColumn("__other", F.col("pitch") != F.lag("pitch").over(w)), [key], ORDER, F.col("__other"), "__same", bucket)
    rows = rows.withColumn("__reach", reach([key, "__same"], ORDER))
    rows = island_ids(rows, [key], ORDER, F.col("__other") | (F.col("start_sec") - F.col("__reach") > gap), "__note", bucket)
    found = rows.groupBy(key, "__note").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first("pitch").alias("pitch"), F.max("confidence").alias("confidence"), F.min_by("note_seq", F.struct(*ORDER)).alias("note_seq"))
    return found.drop("__note")


def clean_melody(notes: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """A single line of notes: by range, length and confidence, merged, one of each conflict, without leaps, merged again. Equal starts go by note_seq."""
    length, sure = F.round(F.col("end_sec") - F.col("start_sec"), 6), F.col("confidence")
    kept = notes.where(F.col("pitch").between(52, 76) & (length >= 0.12) & (sure >= 0.52) & ~((length < 0.16) & (sure < 0.6)))
    one = best_of_conflicts(merge_same_pitch(kept, key, 0.08, width), key, 0.1, width)
    return merge_same_pitch(drop_leaps(one, key, width=width), key, 0.08, width)
