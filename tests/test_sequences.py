"""Matching, folds and alignment against plain Python, and edge cases of interval operators."""

import itertools
import random

import numpy as np
import pytest

from spanwise.functions import scalar as S
from spanwise.operators import alignment, folds, intervals, matching, rules
from spanwise.plans import catalog, fixtures
from pyspark.sql import functions as F

SCHEMA = "sample_id long, note_seq long, start_sec double, end_sec double, pitch int, confidence double"


def notes(spark, n=200, seed=1, samples=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = round(r.random() * 20, 3)
        rows.append((r.randrange(samples), k, start, start + round(r.random(), 3), r.randrange(40, 80), r.randrange(100) / 100))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_greedy_match_is_the_greedy_choice(spark):
    df, rows = notes(spark)
    e, p = df.where("note_seq % 3 <> 0"), df.where("note_seq % 4 <> 0").withColumn("start_sec", F.col("start_sec") + 0.03)
    edges = matching.match_edges(e, p, ["sample_id"], 0.2)
    found = {(r.sample_id, r.e, r.p) for r in matching.greedy_match(edges, ["sample_id"]).collect()}
    want, used = set(), set()
    for r in sorted(edges.collect(), key=lambda r: (r.cost, r.e, r.p)):
        if ("e", r.sample_id, r.e) not in used and ("p", r.sample_id, r.p) not in used:
            used |= {("e", r.sample_id, r.e), ("p", r.sample_id, r.p)}
            want.add((r.sample_id, r.e, r.p))
    assert found == want and want


def test_no_edges(spark):
    df, _ = notes(spark, 5)
    assert matching.greedy_match(matching.match_edges(df, df.limit(0), ["sample_id"], 0.1), ["sample_id"]).count() == 0


def test_folds_by_run_equal_folds_of_whole_samples(spark):
    """Runs are cut only where the rule does not reach, so the result is that of the whole sample."""
    fold, columns = folds.trim_weaker(0.03), "note_seq long, start_sec double, end_sec double, pitch int"
    df, rows = notes(spark, 150, 3)
    got = sorted(tuple(r)[:2] for r in folds.fold_runs(df, "sample_id", 0.2, fold, columns).collect())
    want = []
    for s in {r[0] for r in rows}:
        own = sorted(((r[2], r[3], float(r[4]), r[5], r[1]) for r in rows if r[0] == s), key=lambda x: (x[0], x[4]))
        want += [(s, x[0]) for x in fold(own)]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [None, 0.5])
def test_best_of_conflicts_by_length_confidence_and_last_winner(spark, width):
    """Few lengths and confidences, so that ties are common and hang on winners long before."""
    r = random.Random(14)
    rows = [(r.randrange(2), k, t := round(r.random() * 15, 2), t + 0.1 * r.randint(1, 2), r.randrange(40, 80), r.randint(0, 1) / 2) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for s in {x[0] for x in rows}:
        group, last = [], None
        for x in [*sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])), None]:
            if group and (x is None or x[2] - group[0][2] > 0.1):
                best = max(group, key=lambda n: (round(n[3] - n[2], 6), n[5], -abs(n[4] - last) if last is not None else 0, -n[2], n[1]))
                want.add((s, best[1], len(group)))
                last, group = best[4], []
            if x is not None:
                group.append(x)
    got = {(x.sample_id, x.note_seq, x.n_group) for x in folds.best_of_conflicts(df, "sample_id", 0.1, width).collect()}
    assert got == want and any(n > 2 for _, _, n in want)


def test_cheapest_path_is_the_cheapest():
    r = random.Random(6)
    for _ in range(40):
        costs = [[r.randrange(9) for _ in range(3)] for _ in range(r.randint(1, 6))]
        move = [[r.randrange(5) for _ in range(3)] for _ in range(3)]
        price = lambda p: sum(costs[k][s] for k, s in enumerate(p)) + sum(move[a][b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        path = folds.cheapest_path(costs, lambda k, i, j: move[i][j])  # noqa: B023
        assert price(path) == min(map(price, itertools.product(range(3), repeat=len(costs))))


def test_small_folds():
    n = [(0.0, 0.5, 60.0, 0.5, 1), (0.55, 0.6, 72.0, 0.4, 2), (0.62, 1.0, 60.0, 0.6, 3), (0.9, 1.2, 65.0, 0.9, 4)]
    assert folds.replace_weaker(0.0)(n) == [(1, 0.0, 0.5, 60), (2, 0.55, 0.6, 72), (4, 0.9, 1.2, 65)]
    assert folds.trim_weaker(0.005)(n)[2:] == [(3, 0.62, 0.895, 60), (4, 0.9, 1.2, 65)]
    assert [x[2] for x in folds.octave_path([(0, 1, 60.0, 0.9, 1), (1, 2, 72.0, 0.9, 2), (2, 3, 60.0, 0.9, 3)])][0] == 60
    assert [x[2] for x in folds.lattice_snap(0.5)([(0.1, 1, 60.0, 1, 1), (0.2, 1, 60.0, 1, 2)])] == [0.0, 0.5]


def naive_align(a, b, basis, shift):
    """Cell by cell: cost, pairs, pairs of one pitch, pitches apart; the first of a pair, a note of a and one of b left out, of equals."""
    d = [[None] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            tries = []
            if i and j:
                (s, e, p), (t, f, q) = a[i - 1], b[j - 1]
                far, whole = abs(p - q - shift), max(e, f) - min(s, t)
                shared = max(0.0, min(e, f) - max(s, t)) / whole if whole > 1e-9 else 0.0
                cost = far + min(4.0, abs(s / basis - t / basis) * 4.0) + (1.0 - shared) * 0.1
                c, n, m, x = d[i - 1][j - 1]
                tries.append((c + cost, n + 1, m + (far == 0), x + far))
            for di, dj in ((1, 0), (0, 1)):
                if i >= di and j >= dj:
                    c, *rest = d[i - di][j - dj]
                    tries.append((c + alignment.GAP, *rest))
            d[i][j] = min(tries, key=lambda t: (t[0], -t[1], t[3])) if tries else (0.0, 0, 0, 0.0)
    return d[-1][-1]


def test_alignment(spark, monkeypatch):
    r = np.random.default_rng(2)
    sides, rows = {}, []
    for key in range(12):
        for side in (0, 1):
            n = int(r.integers(0, 12)) if key < 11 else 60
            start = np.round(r.random(n) * 20, 1)
            own = np.stack([start, start + np.round(r.random(n), 1), r.integers(50, 53, n) + (12 * (key % 3) * side)], 1)
            sides[key, side] = sorted(map(tuple, own.tolist()), key=lambda x: (x[0], x[2], x[1]))
            rows += [(key, side, k, *x[:2], int(x[2])) for k, x in enumerate(own.tolist())]
    df = spark.createDataFrame(rows, "key long, side int, note_seq long, start_sec double, end_sec double, pitch int")
    monkeypatch.setattr(alignment, "MOST_CELLS", 3000)
    got = {x.key: x for x in alignment.align_best_shift(df.where("side = 0"), df.where("side = 1"), "key").collect()}
    for key in got:
        a, b = sides[key, 0], sides[key, 1]
        if not a or not b or key == 11:
            assert got[key].skipped_reason == ("too_many_note_pairs" if key == 11 else "empty_note_sequence") and got[key].cost is None and got[key].pairs == 0
            continue
        basis = max(*(max(x[1] for x in s) - min(x[0] for x in s) for s in (a, b)), 1.0)
        ways = {s: naive_align(a, b, basis, s) for s in alignment.SHIFTS}
        shift = min(ways, key=lambda s: (ways[s][0], abs(s)))
        cost, pairs, matches, apart = ways[shift]
        assert (got[key].shift, got[key].pairs) == (shift, pairs)
        assert got[key].cost == pytest.approx(cost / (len(a) + len(b))) and got[key].recall == pytest.approx(matches / len(a)) and got[key].mean_pitch_delta == pytest.approx(apart / pairs if pairs else 0)
    assert len({x.shift for x in got.values()}) > 2


def test_interval_join_equals_the_predicate(spark):
    df, rows = notes(spark, 120, 5)
    b = df.select("sample_id", F.col("note_seq").alias("other"), F.col("start_sec").alias("a"), F.col("end_sec").alias("b"))
    got = sorted((r.note_seq, r.other) for r in intervals.interval_join(df, b, ["sample_id"], 0.7, "start_sec", "end_sec", "a", "b").collect())
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
    assert got == want


def test_empty_and_touching(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 3.0, 3.0), (2, 5.0, 6.0)], "sample_id long, start_sec double, end_sec double")
    merged = sorted(map(tuple, intervals.merge_spans(df, ["sample_id"]).collect()))
    assert merged == [(1, 0.0, 2.0, 2), (1, 3.0, 3.0, 1), (2, 5.0, 6.0, 1)]
    assert intervals.merge_spans(df.limit(0), ["sample_id"]).count() == 0
    c = {r.sample_id: r for r in intervals.coverage(df, ["sample_id"]).collect()}
    assert c[1].covered_sec == 2.0 and c[1].longest_silence_sec == 1.0 and c[2].coverage == 1.0


def test_split_keys_give_the_same(spark):
    """Operators that deal a key out over buckets of time against those that keep it whole."""
    df, _ = notes(spark, 300, 8)
    for f in (intervals.merge_spans, intervals.coverage, intervals.gaps):
        split, whole = (sorted(tuple(round(v, 9) for v in r) for r in f(df, ["sample_id"], width=w).collect()) for w in (3.0, None))
        assert split == whole
    right = df.where("note_seq % 5 = 0").select("sample_id", F.col("start_sec").alias("t"), F.col("note_seq").alias("other"))
    for forward in (False, True):
        whole, split = (sorted(map(tuple, intervals.asof_join(df.select("sample_id", "note_seq", "start_sec"), right, ["sample_id"], "start_sec", "t", ["other", "t"], forward, w).collect()), key=repr) for w in (None, 2.0))
        assert whole == split


def test_scalars(spark):
    row = spark.range(1).select(
        S.hz_to_midi(F.lit(440.0)).alias("a"), S.hz_to_midi(F.lit(0.0)).alias("zero"), S.name_to_midi(F.lit("Bb3")).alias("b"), S.name_to_midi(F.lit("x")).alias("none"),
        S.nearest_of(F.lit(0.4), [0.25, 0.5, 1.0]).alias("n"), S.circular_distance(F.lit(1), F.lit(11)).alias("c"), S.finite(F.lit(float("nan"))).alias("nan"), S.slug(F.lit(" A b!")).alias("s"),
    ).first()
    assert tuple(row) == (69.0, None, 58, None, 0.5, 2, None, "a-b")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_registry_rejects_a_second_query_of_a_name():
    from spanwise.plans.registry import Registry

    r = Registry()
    r.add(" A ", lambda s, d: None)
    with pytest.raises(ValueError):
        r.add("a", lambda s, d: None)
    with pytest.raises(KeyError):
        r.run("b", None, "")


def test_fixture_columns(spark, small):
    assert fixtures.notes(spark, small).where("end_sec <= start_sec").count() == 0


def test_ends_close_the_oldest_open_start(spark):
    """Against a queue for each key, with orphan ends, unclosed starts and ends at the time of their start."""
    r = random.Random(11)
    rows = [(r.randrange(4), k, r.randrange(60), r.random() < 0.5) for k in range(240)] + [(9, 900, 1, False), (9, 901, 2, True), (9, 902, 3, False), (8, 903, 1, True)]
    df = spark.createDataFrame(rows, "key long, id long, t long, on boolean")
    got = {}
    for x in matching.pair_starts_with_ends(df, ["key"], ["t", "id"]).collect():
        got.setdefault((x.key, x.k), {})[x.on] = x.id
    want, held = set(), {}
    for key, i, _, on in sorted(rows, key=lambda x: (x[2], x[1])):
        if on:
            held.setdefault(key, []).append(i)
        elif held.get(key):
            want.add((held[key].pop(0), i))
    assert {(x[True], x[False]) for x in got.values() if len(x) == 2} == want and (901, 902) in want


@pytest.mark.parametrize("width", [None, 1.0])
def test_leaps_from_the_last_note_kept(spark, width):
    df, rows = notes(spark, 400, 12)
    want = set()
    for s in {x[0] for x in rows}:
        last = None
        for _, seq, a, b, pitch, sure in sorted((x for x in rows if x[0] == s), key=lambda x: (x[2], x[1])):
            if last is None or not (abs(pitch - last) >= 12 and (b - a < 0.25 or sure < 0.62)):
                last = pitch
                want.add((s, seq))
    assert {tuple(x)[:2] for x in folds.drop_leaps(df, "sample_id", width=width).collect()} == want and len(want) < 400


def test_each_left_note_takes_the_nearest_free_one(spark):
    r = random.Random(13)
    rows = [(r.randrange(2), k, round(r.random() * 3, 2), 0.0, r.randrange(50, 53), 0.5) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in folds.match_each_left(df.where("note_seq % 2 = 0"), df.where("note_seq % 2 = 1"), "sample_id", 0.08).collect()}
    order = sorted(rows, key=lambda x: (x[2], x[1]))
    want, taken = set(), set()
    for e in (x for x in order if x[1] % 2 == 0):
        best = None
        for p in (x for x in order if x[1] % 2 == 1 and x[0] == e[0] and x[4] == e[4] and x[1] not in taken):
            if abs(p[2] - e[2]) <= 0.08 and (best is None or abs(p[2] - e[2]) < abs(best[2] - e[2])):
                best = p
        if best:
            taken.add(best[1])
            want.add((e[0], e[1], best[1]))
    assert got == want and want


def test_voiced_by_what_a_frame_has(spark):
    rows = [(False, "vocal", 60, 440.0), (None, "Singing", None, None), (None, "rest", 60, None), (None, None, None, 0.0), (None, None, None, 1.0), (None, "rest", None, None)]
    df = spark.createDataFrame(rows, "v boolean, s string, p int, f double")
    assert [x[0] for x in df.select(rules.is_voiced(*map(F.col, "vspf"))).collect()] == [False, True, True, False, True, False]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_polyphony_limit(spark, most):
    df, rows = notes(spark, 250, 15)
    want = set()
    for s in {x[0] for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[5], x[2] - x[3], x[2], x[4], x[1])):
            tried = [*kept, x]
            if max(sum(y[2] <= p[2] < y[3] for y in tried) for p in tried) <= most:
                kept = tried
        want |= {(s, x[1]) for x in kept if most}
    got = {tuple(x)[:2] for x in folds.fold_runs(df, "sample_id", 0.0, folds.limit_polyphony(most), "note_seq long, start_sec double, end_sec double").collect()}
    assert got == want


def test_clean_melody(spark):
    r = random.Random(16)
    rows = [(r.randrange(3), k, t := round(r.random() * 40, 3), round(t + 0.1 + r.random() * 0.4, 3), r.randrange(50, 79, r.choice((1, 13))), r.randint(40, 100) / 100) for k in range(500)]

    def merged(notes):
        out = []
        for seq, a, b, pitch, sure in notes:
            if out and out[-1][3] == pitch and a - out[-1][2] <= 0.08:
                out[-1] = (*out[-1][:2], max(b, out[-1][2]), pitch, max(sure, out[-1][4]))
            else:
                out.append((seq, a, b, pitch, sure))
        return out

    want = set()
    for s in range(3):
        own = sorted((x[1:] for x in rows if x[0] == s), key=lambda x: (x[1], x[0]))
        own = [x for x in own if 52 <= x[3] <= 76 and (d := round(x[2] - x[1], 6)) >= 0.12 and x[4] >= 0.52 and not (d < 0.16 and x[4] < 0.6)]
        won, group = [], []
        for x in [*merged(own), None]:
            if group and (x is None or x[1] - group[0][1] > 0.1):
                last = won[-1][3] if won else None
                won.append(max(group, key=lambda n: (round(n[2] - n[1], 6), n[4], -abs(n[3] - last) if last is not None else 0, -n[1], n[0])))
                group = []
            if x is not None:
                group.append(x)
        line = won[:1]
        for x in won[1:]:
            if not (abs(x[3] - line[-1][3]) >= 12 and (x[2] - x[1] < 0.25 or x[4] < 0.62)):
                line.append(x)
        want |= {(s, *x) for x in merged(line)}
    for width in (None, 2.0):
        got = {(x.sample_id, x.note_seq, x.start_sec, x.end_sec, x.pitch, x.confidence) for x in folds.clean_melody(spark.createDataFrame(rows, SCHEMA), "sample_id", width).collect()}
        assert got == want and 20 < len(want) < 250
