"""Repair of sung phrases: gaps bridged, octaves corrected, outliers smoothed, short notes absorbed, notes held on; until nothing changes.

A phrase ends at a gap over `phrase_gap`. No rule moves its ends, so a key is cut there into runs that
stay the same in every pass, and a run is one row with its notes. Only the octave rule looks past
an end: at the pitch of the note before, which the same rule may have just moved by one of five
shifts. So each run becomes a map from the shift before it to the shift of its own last note, the maps are
followed along the key (one small row a run), and then all runs are done side by side. Passes
end for a key as soon as none of its runs changed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .folds import fold_each
from .intervals import island_ids, previous
from .lineage import cut, ship


@dataclass(frozen=True)
class PhraseRules:
    # Fixed values of the rules: seconds, semitones, confidences.
    phrase_gap: float = 0.12
    short_gap: float = 0.08
    same_pitch: int = 1
    short: float = 0.18
    neighbour: float = 0.12
    octave_jump: int = 9
    octave_neighbour: int = 2
    window: int = 5
    deviation: int = 2
    adjust: int = 4
    smooth_longest: float = 0.24
    drop_fragments: bool = False
    fragment_longest: float = 0.16
    fragment_confidence: float = 0.54
    fragment_jump: int = 7
    sustain_gap: float = 0.18
    sustain_step: int = 2
    lowest: int = 48
    highest: int = 84
    passes: int = 2
    outlier_gap: float = 0.08
    outlier_jump: int = 10
    outlier_longest: float = 0.25
    outlier_sure: float = 0.58


#: Ways in which the octave rule may move a note, in the order in which they are tried, and the one that leaves it.
SHIFTS = [0, -24, -12, 12, 24]
NOTE = "start_sec double, end_sec double, pitch double, confidence double, note_seq long, fixed boolean, n_merged int"
START, END, PITCH, SURE, SEQ, FIXED, MERGED = range(7)
Note = list


def _length(n: Note) -> float:
    return round(max(0.0, n[END] - n[START]), 6)


def _gap(a: Note, b: Note) -> float:
    return b[START] - a[END]


def _near(notes: list[Note], most: float) -> bool:
    return all(0 <= _gap(a, b) <= most for a, b in zip(notes, notes[1:]))


def _weighted(notes: list[Note]) -> float:
    weights = [max(0.001, _length(n)) * max(0.001, n[SURE]) for n in notes]
    return float(round(sum(n[PITCH] * w for n, w in zip(notes, weights, strict=True)) / sum(weights)))


def _joined(notes: list[Note]) -> Note:
    """One note in place of several: the first one's number and whether it is fixed, the weighted pitch of the outer ones."""
    outer = [notes[0], notes[-1]]
    return [round(min(n[START] for n in notes), 6), round(max(n[END] for n in notes), 6), _weighted(outer), round(max(n[SURE] for n in notes), 6), notes[0][SEQ], notes[0][FIXED], sum(n[MERGED] for n in notes)]


def bridge(notes: list[Note], r: PhraseRules) -> list[Note]:
    """Neighbours of nearly one pitch with a short gap between them become one note."""
    out = notes[:1]
    for n in notes[1:]:
        last = out[-1]
        if 0 < _gap(last, n) <= r.short_gap and not last[FIXED] and not n[FIXED] and abs(last[PITCH] - n[PITCH]) <= r.same_pitch:
            out[-1] = _joined([last, n])
        else:
            out.append(n)
    return out


def drop_fragments(notes: list[Note], r: PhraseRules) -> list[Note]:
    """Short, unsure notes far from both neighbours, which are near each other, go."""
    if not r.drop_fragments:
        return notes
    out = notes[:1]
    for n, after in zip(notes[1:], notes[2:]):
        last = out[-1]
        alone = min(abs(n[PITCH] - last[PITCH]), abs(n[PITCH] - after[PITCH])) >= r.fragment_jump and abs(last[PITCH] - after[PITCH]) <= max(3, r.same_pitch + 2)
        if not (_near([last, n, after], r.phrase_gap) and alone and _length(n) <= r.fragment_longest and n[SURE] <= r.fragment_confidence and not n[FIXED]):
            out.append(n)
    return out + notes[-1:] if len(notes) > 1 else out


def octaves(notes: list[Note], r: PhraseRules, before: float | None, after: float | None) -> list[Note]:
    """Notes that leap from the pitches around them move by octaves, if that brings them much nearer.

    before: pitch of the note ahead of these, as moved; after: of the one that follows. None at the ends of a key, whose first and last notes stay.
    """
    out = [list(n) for n in notes]
    for k, n in enumerate(out):
        left = out[k - 1][PITCH] if k else before
        right = out[k + 1][PITCH] if k + 1 < len(out) else after
        if left is None or right is None or n[FIXED]:
            continue
        anchors = _anchors(out, k, r.phrase_gap)
        if len(anchors) < 2 or max(abs(n[PITCH] - left), abs(n[PITCH] - right)) < max(7, r.octave_jump):
            continue
        surest = max(a[SURE] for a, _ in anchors)
        if n[SURE] >= min(0.70, surest - 0.05) or (_length(n) > max(r.short, r.smooth_longest, 0.35) and n[SURE] >= surest + 0.05):
            continue
        pitches = [a[PITCH] for a, _ in anchors]
        if abs(left - right) > max(r.octave_neighbour, 3) and max(pitches) - min(pitches) > 7:
            continue

        def cost(shift: int, n: Note = n, anchors: list = anchors, pitches: list = pitches) -> tuple[float, float, int]:
            p = n[PITCH] + shift
            total = abs(shift) * 0.12
            for a, gap in anchors:
                total += abs(p - a[PITCH]) * max(0.03, _length(a)) * max(0.05, a[SURE]) * math.exp(-max(0.0, gap) / max(1e-6, r.phrase_gap))
            return total, max(abs(p - a) for a in pitches), abs(shift)

        own = cost(0)
        best, shift = min([(own, 0), *((cost(s), s) for s in SHIFTS[1:] if r.lowest <= n[PITCH] + s <= r.highest)], key=lambda x: x[0])
        if shift and (best[0] <= own[0] * 0.55 or best[1] <= own[1] - 5):
            out[k][PITCH] = round(n[PITCH] + shift, 6)
    return out


def _anchors(notes: list[Note], k: int, most: float) -> list[tuple[Note, float]]:
    """Up to two notes on either side, without a gap over `most` or an overlap on the way, and the gaps."""
    found, at = [], notes[k][START]
    for n in reversed(notes[max(0, k - 2) : k]):
        if not 0 <= at - n[END] <= most:
            break
        found.append((n, at - n[END]))
        at = n[START]
    at = notes[k][END]
    for n in notes[k + 1 : k + 3]:
        if not 0 <= n[START] - at <= most:
            break
        found.append((n, n[START] - at))
        at = n[END]
    return found


def islands(notes: list[Note], r: PhraseRules) -> list[Note]:
    """One or two unsure notes that leap away and back move by octaves together."""
    out, k = [list(n) for n in notes], 1
    limit, longest = max(7, r.octave_jump), max(0.35, r.smooth_longest * 2)
    while k < len(out) - 1:
        best = None
        for size in (1, 2):
            if k + size >= len(out):
                continue
            a, b, own = out[k - 1], out[k + size], out[k : k + size]
            if not _near([a, *own, b], r.phrase_gap) or any(n[FIXED] for n in own) or own[-1][END] - own[0][START] > longest:
                continue
            p, q = own[0][PITCH], own[-1][PITCH]
            edge, cost = max(abs(p - a[PITCH]), abs(q - b[PITCH])), abs(p - a[PITCH]) + abs(q - b[PITCH])
            if max(n[SURE] for n in own) >= min(0.70, max(a[SURE], b[SURE]) - 0.05) or edge < limit or abs(p - q) > 3:
                continue
            for s in SHIFTS[1:]:
                if any(not r.lowest <= n[PITCH] + s <= r.highest for n in own):
                    continue
                x, y = abs(p + s - a[PITCH]), abs(q + s - b[PITCH])
                rank = (x + y + abs(s) * 0.1, max(x, y), abs(s))
                if (rank[1] < edge - 5 or rank[0] <= cost * 0.55) and (best is None or rank < best[0]):
                    best = (rank, size, s)
        if best is None:
            k += 1
            continue
        for n in out[k : k + best[1]]:
            n[PITCH] = round(n[PITCH] + best[2], 6)
        k += best[1]
    return out


def smooth(notes: list[Note], r: PhraseRules, first: bool, last: bool) -> list[Note]:
    """Short notes a little off the median of their phrase window take it. first, last: whether the key has no notes before or after these."""
    half, out = (max(3, r.window) | 1) // 2, [list(n) for n in notes]
    for k, n in enumerate(notes):
        if n[FIXED] or _length(n) > r.smooth_longest or (k < half and not first) or (k + half >= len(notes) and not last):
            continue
        around = notes[max(0, k - half) : k + half + 1]
        if len(around) >= 3 and _near(around, r.phrase_gap):
            middle = float(round(median(x[PITCH] for x in around)))
            if max(1, r.deviation) <= abs(n[PITCH] - middle) <= max(r.deviation, r.adjust):
                out[k][PITCH] = middle
    return out


def absorb(notes: list[Note], r: PhraseRules) -> list[Note]:
    """A short, weak note between two of nearly one pitch makes one note with them."""
    if len(notes) < 3:
        return notes
    out, k = notes[:1], 1
    while k < len(notes) - 1:
        a, n, b = out[-1], notes[k], notes[k + 1]
        outer = min(_length(a), _length(b))
        surest, least = max(a[SURE], b[SURE]), min(a[SURE], b[SURE])
        off = abs(n[PITCH] - round(median([a[PITCH], b[PITCH]]))) >= max(1, r.same_pitch + 1)
        weak = n[SURE] <= min(0.70, least + 0.05) and (off or n[SURE] <= least + 0.05)
        if _near([a, n, b], r.phrase_gap) and abs(a[PITCH] - b[PITCH]) <= r.same_pitch and _length(n) <= r.short and outer >= r.neighbour and _length(n) <= 0.75 * outer and n[SURE] <= surest + 0.05 and weak:
            out[-1] = _joined([a, n, b])
            k += 2
        else:
            out.append(n)
            k += 1
    return out + notes[-1:] if k == len(notes) - 1 else out


def sustain(notes: list[Note], r: PhraseRules) -> list[Note]:
    """Notes last until the next one over a short gap to a near pitch."""
    out = [list(n) for n in notes]
    for n, after in zip(out, notes[1:]):
        if 0 < _gap(n, after) <= min(r.sustain_gap, r.phrase_gap) and abs(n[PITCH] - after[PITCH]) <= r.sustain_step and not n[FIXED]:
            n[END] = round(max(n[START], after[START]), 6)
    return out


def octave_outliers(notes: list[Note], r: PhraseRules) -> list[Note]:
    """Between two notes of nearly one pitch, one far from both moves by octaves if that brings it much nearer; long sure notes stay."""
    out = [list(n) for n in notes]
    for a, n, b in zip(out, out[1:], out[2:]):
        own = (abs(n[PITCH] - a[PITCH]) + abs(n[PITCH] - b[PITCH]), max(abs(n[PITCH] - a[PITCH]), abs(n[PITCH] - b[PITCH])))
        if not _near([a, n, b], r.outlier_gap) or abs(a[PITCH] - b[PITCH]) > r.same_pitch or own[1] < r.outlier_jump or (_length(n) > r.outlier_longest and n[SURE] >= r.outlier_sure):
            continue
        ways = [(abs(n[PITCH] + s - a[PITCH]) + abs(n[PITCH] + s - b[PITCH]), max(abs(n[PITCH] + s - a[PITCH]), abs(n[PITCH] + s - b[PITCH])), abs(s), s) for s in SHIFTS[1:] if r.lowest <= n[PITCH] + s <= r.highest]
        best = min(ways, key=lambda w: w[:3], default=None)
        if best and best[:2] < own and best[0] + max(2, r.same_pitch) <= own[0] and best[1] < own[1]:
            n[PITCH] += best[3]
    return out


def smooth_outliers(notes: list[Note], r: PhraseRules) -> list[Note]:
    """Left to right, a note two to four semitones off its neighbours, which are near each other, takes the pitch of the surer one.

    The note before is as this step left it, the one after as it was. Long sure notes stay, and those surer than both and no shorter.
    """
    out = [list(n) for n in notes]
    for a, n, b in zip(out, out[1:], out[2:]):
        anchor = a if (a[SURE], _length(a)) >= (b[SURE], _length(b)) else b
        if not _near([a, n, b], r.outlier_gap) or abs(a[PITCH] - b[PITCH]) > max(1, r.same_pitch) or (_length(n) > r.outlier_longest and n[SURE] >= r.outlier_sure):
            continue
        firm = n[SURE] >= max(a[SURE], b[SURE]) and _length(n) >= min(_length(a), _length(b))
        if 2 <= abs(n[PITCH] - anchor[PITCH]) <= 4 and not firm:
            n[PITCH] = anchor[PITCH]
    return out


def keep_bridges(notes: DataFrame, key: str, least: float = 0.12, sure: float = 0.45, big: float = 0.5, small: float = 0.05, width: float = 600.0) -> DataFrame:
    """The notes without the short ones, but for those without which a pause over `big`, or over `small`, would open; `bridged` tells which those are."""
    order = ["start_sec", "end_sec", "note_seq"]
    bucket = F.floor(F.col("start_sec") / width)
    rows = previous(notes, [key], order, "end_sec", "__before", bucket)
    back = [f"__{c}" for c in order]
    rows = rows.withColumns({b: -F.col(c) for b, c in zip(back, order, strict=True)})
    rows = previous(rows, [key], back, "start_sec", "__after", -bucket).drop(*back)
    left, right, whole = F.col("start_sec") - F.col("__before"), F.col("__after") - F.col("end_sec"), F.col("__after") - F.col("__before")
    opens = lambda most: (whole > most) & ((left <= most) | (right <= most))
    short = F.round(F.col("end_sec") - F.col("start_sec"), 6) < least
    bridge = F.coalesce((F.col("confidence") >= sure) & (left >= 0) & (right >= 0) & (whole > 0) & (opens(big) | opens(small)), F.lit(False))
    return rows.where(~short | bridge).withColumn("bridged", short).drop("__before", "__after")


def begun(notes: list[Note], r: PhraseRules) -> list[Note]:
    return drop_fragments(bridge(notes, r), r)


def finished(notes: list[Note], r: PhraseRules, before: float | None, after: float | None) -> list[Note]:
    notes = islands(octaves(notes, r, before, after), r)
    return sustain(bridge(absorb(smooth(notes, r, before is None, after is None), r), r), r)


def _mapped(df: DataFrame, make: Callable[[dict], dict], schema: str) -> DataFrame:
    """A row for each row, as dictionaries."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([make(row) for row in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, kind)


_FIELDS = [x.split()[0] for x in NOTE.split(", ")]
_LIST = f"array<struct<{', '.join(x.replace(' ', ': ') for x in NOTE.split(', '))}>>"


def _lists(notes: list[dict]) -> list[Note]:
    return [[n[f] for f in _FIELDS] for n in notes]


def _dicts(notes: list[Note]) -> list[dict]:
    return [dict(zip(_FIELDS, n, strict=True)) for n in notes]


def phrase_runs(notes: DataFrame, key: str, gap: float, width: float) -> DataFrame:
    """(key, __run from 0, notes): the notes of each phrase as one row. width: seconds of a key that one task takes."""
    order = ["start_sec", "end_sec", "note_seq"]
    bucket = F.floor(F.col("start_sec") / width)
    rows = previous(notes, [key], order, "end_sec", "__before", bucket)
    rows = island_ids(rows, [key], order, F.col("start_sec") - F.col("__before") > gap, "__run", bucket)
    return rows.groupBy(key, "__run").agg(F.array_sort(F.collect_list(F.struct(*order, "pitch", "confidence", "fixed", "n_merged"))).alias("notes"))


def repair_phrases(notes: DataFrame, key: str, rules: PhraseRules = PhraseRules(), width: float = 600.0) -> DataFrame:
    """The notes (start_sec, end_sec, pitch, confidence, note_seq and, if there, fixed: left as it is) after at most `passes` passes; n_merged: out of how many."""
    kind = dict(notes.dtypes)[key]
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in notes.columns else F.lit(False)
    six = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    rows = ship(notes).select(key, six("start_sec"), F.greatest(six("start_sec"), six("end_sec")).alias("end_sec"), six("pitch"), six("confidence"), "note_seq", fixed.alias("fixed"), F.lit(1).alias("n_merged"))
    runs = cut(phrase_runs(rows, key, rules.phrase_gap, width))
    plain = f"{key} {kind}, __run long, notes {_LIST}"
    done = None
    for _ in range(rules.passes):
        started = cut(_mapped(runs, lambda row: row | {"notes": _dicts(begun(_lists(row["notes"]), rules))}, plain))
        ends = started.select(key, "__run", F.col("notes")[0]["pitch"].alias("head"), F.element_at("notes", -1)["pitch"].alias("tail"))
        linked = started.join(ends.select(key, (F.col("__run") + 1).alias("__run"), F.col("tail").alias("before")), [key, "__run"], "left")
        linked = linked.join(ends.select(key, (F.col("__run") - 1).alias("__run"), F.col("head").alias("after")), [key, "__run"], "left")

        def moved(row: dict) -> dict:
            """Which shift the last note gets for each shift of the note before."""
            own, out = _lists(row["notes"]), []
            for s in SHIFTS:
                now = octaves(own, rules, None if row["before"] is None else row["before"] + s, row["after"])
                out.append(SHIFTS.index(round(now[-1][PITCH] - own[-1][PITCH])))
            return {key: row[key], "__run": 0, "run": row["__run"], "moves": out}

        moves = _mapped(linked, moved, f"{key} {kind}, __run long, run long, moves array<int>")
        known = fold_each(moves, key, _along, "run long, shift int", ["run", "moves"], ["run"]).withColumnRenamed("run", "__run")

        def all_done(row: dict) -> dict:
            own = _lists(row["notes"])
            before = None if row["before"] is None else row["before"] + SHIFTS[row["shift"]]
            return {key: row[key], "__run": row["__run"], "notes": _dicts(finished(own, rules, before, row["after"]))}

        now = _mapped(linked.join(known, [key, "__run"]), all_done, plain)
        signature = lambda c: F.xxhash64(F.transform(c, lambda n: F.struct(n["start_sec"], n["end_sec"], n["pitch"])))
        before = runs.select(key, "__run", signature(F.col("notes")).alias("__was"))
        now = cut(now.join(before, [key, "__run"]).withColumn("__changed", signature(F.col("notes")) != F.col("__was")).drop("__was"))
        changed = now.where("__changed").select(key).distinct()
        rest, runs = now.join(changed, key, "left_anti").select(key, "__run", "notes"), now.join(changed, key, "left_semi").select(key, "__run", "notes")
        done = rest if done is None else done.unionByName(rest)
    out = done.unionByName(runs) if done is not None else runs
    return out.select(key, F.explode("notes").alias("n")).select(key, *(F.col(f"n.{f}") for f in _FIELDS))


def _along(rows: list[tuple]) -> list[tuple]:
    """The shift of the note before each run of a key, in order."""
    out, shift = [], 0
    for run, moves in rows:
        out.append((run, shift))
        shift = moves[shift]
    return out


def by_phrase(notes: DataFrame, key: str, gap: float, step: Callable[[list[Note]], list[Note]], width: float = 600.0) -> DataFrame:
    """The notes after one step that looks at no note across a gap over `gap`."""
    kind = dict(notes.dtypes)[key]
    six = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in notes.columns else F.lit(False)
    rows = ship(notes).select(key, six("start_sec"), six("end_sec"), six("pitch"), six("confidence"), "note_seq", fixed.alias("fixed"), F.lit(1).alias("n_merged"))
    runs = phrase_runs(rows, key, gap, width)
    now = _mapped(runs, lambda row: {key: row[key], "notes": _dicts(step(_lists(row["notes"])))}, f"{key} {kind}, notes {_LIST}")
    return now.select(key, F.explode("notes").alias("n")).select(key, *(F.col(f"n.{f}") for f in _FIELDS))
