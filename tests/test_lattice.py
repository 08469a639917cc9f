"""Paths through lattices against a plain pass and exhaustive search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import frame_path as P
from spanwise.operators import grid_lattice as G
from spanwise.operators.lattice import cheapest_paths


def make_step():
    return lambda before, here: np.abs(before[:, :1] - here[:, 0][None, :]).astype(np.int64) % 3


step = make_step()  # sent to tasks by value


def plain(rows):
    """rows: (costs, features) in order; of equal ways the one from the first state."""
    total, back = list(rows[0][0]), []
    for (_, f), (cost, g) in zip(rows, rows[1:]):
        s = step(np.array(f).reshape(-1, 1), np.array(g).reshape(-1, 1))
        ways = [min((total[i] + int(s[i, j]), i) for i in range(len(f))) for j in range(len(g))]
        back.append([i for _, i in ways])
        total = [w + c for (w, _), c in zip(ways, cost, strict=True)]
    path = [min(range(len(total)), key=lambda j: (total[j], j))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], min(total)


@pytest.fixture(scope="module")
def lattice():
    """One key of 60 blocks and many ties, some of one block or one row."""
    r = random.Random(4)
    out = {}
    for key, n in (("hot", 600), ("a", 7), ("b", 1), ("c", 10), ("d", 11)):
        rows = []
        for _ in range(n):
            states = r.randrange(1, 6)
            rows.append(([r.randrange(0, 3) for _ in range(states)], [float(r.randrange(0, 9)) for _ in range(states)]))
        out[key] = rows
    return out


def test_same_as_a_plain_pass(spark, lattice):
    rows = [(key, k * 2, c, f) for key, found in lattice.items() for k, (c, f) in enumerate(found)]
    df = spark.createDataFrame(rows, "key string, at long, cost array<long>, feature array<double>").repartition(6)
    paths, totals = cheapest_paths(df, "key", ["at"], F.floor(F.col("at") / 20), step)
    got = {}
    for r in paths.collect():
        got.setdefault(r.key, {})[r.at] = r.choice
    sums = {r.key: r.total for r in totals.collect()}
    for key, found in lattice.items():
        path, total = plain(found)
        assert [got[key][2 * k] for k in range(len(found))] == path and sums[key] == total
    assert paths.where("key = 'none'").count() == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "key string, at long, cost array<long>, feature array<double>")
    paths, totals = cheapest_paths(empty, "key", ["at"], F.col("at"), step)
    assert paths.count() == 0 and totals.count() == 0


def test_grid_against_all_ways(spark):
    rules = G.GridRules(lengths=(0.25, 0.5), radius=1)
    r = random.Random(9)
    notes = []
    for key in range(6):
        at = 0.0
        for seq in range(4):
            at += r.choice([0.0, 0.05, 0.13, 0.3])
            notes.append((key, seq, round(at, 3), r.choice([0.1, 0.25, 0.4, 0.9])))
    df = spark.createDataFrame(notes, "key long, seq long, beat double, beats double")
    _, totals = G.place_on_grid(df, "key", "beat", "beats", ["beat", "seq"], rules, width=0.3)
    got = {x.key: x.total for x in totals.collect()}
    places = {(x.key, x.seq): x.p for x in df.select("key", "seq", G.candidates(F.col("beat"), F.col("beats"), rules).alias("p")).collect()}
    move = G.overlap_step(rules)
    for key in range(6):
        own = [places[key, s] for _, s, *_ in sorted((b, s) for k, s, b, _ in notes if k == key)]
        best = min(sum(x.cost for x in way) + sum(int(move(np.array([[a.start, a.start + a.length]]), np.array([[b.start, b.start + b.length]]))[0, 0]) for a, b in itertools.pairwise(way)) for way in itertools.product(*own))
        assert round(got[key] * 1e9) == best


def test_one_long_key_by_blocks(spark):
    """The path does not depend on how the frames are cut, and segments and notes neither."""
    r = random.Random(2)
    rows = [("s", k, None if r.random() < 0.1 else 60 + r.choice([0, 0, 0, 1, 3, 12]) + r.uniform(-0.4, 0.4), r.random(), r.random() < 0.9) for k in range(900)]
    frames = spark.createDataFrame(rows, "key string, frame_index long, observed double, confidence double, voiced boolean")

    def notes(block):
        rules = P.FrameRules(block=block)
        path, totals = P.frame_path(frames, "key", rules)
        found = P.segment_notes(P.merge_segments(P.path_segments(path, "key", block), "key", rules), frames, "key", rules)
        return sorted(map(tuple, path.collect()), key=repr), totals.collect(), sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in found.collect())

    assert notes(17) == notes(4096)
