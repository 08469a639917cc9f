"""The top line against a walk over whole lists; records of notes, client reasons and reports on odd rows."""

import json
import math
import random

from pyspark.sql import functions as F

from spanwise.operators import hook as H
from spanwise.operators import note_rules as R
from spanwise.operators import run_reports as U

NOTE = "key long, note_seq long, start_sec double, end_sec double, pitch double, confidence double"


def walk(notes):
    """Every note is compared with all kept ones of its key."""
    rank = lambda n: (round(min(n[1] - n[0], 1.5) * 0.6 + n[3] * 0.4, 6), n[2], -n[0], n[1] - n[0])
    kept = []
    for n in sorted(notes, key=lambda n: (n[0], -(min(n[1] - n[0], 1.5) * 0.6 + n[3] * 0.4), -n[2], n[4])):
        rivals = [i for i, k in enumerate(kept) if abs(k[0] - n[0]) <= 0.08 or (k[1] > n[0] and n[1] > k[0])]
        if not rivals:
            kept.append(n)
        elif rank(n) > max(rank(kept[i]) for i in rivals):
            kept[rivals[-1]] = n
    line = []
    for n in sorted(kept, key=lambda n: (n[0], n[2], n[1])):
        if not line or n[0] >= line[-1][1]:
            line.append(n)
        elif rank(n) > rank(line[-1]):
            line[-1] = n
    return sorted(n[4] for n in line)


def test_hook_by_runs(spark):
    r = random.Random(3)
    rows, segments, want = [], [], {}
    for key in range(5):
        long = 400 if key == 0 else 60
        notes = [(round(a := r.random() * long, 2), round(a + r.choice([0.03, 0.2, 0.5, 2.0]), 2), float(r.randrange(50, 80)), r.choice([0.2, 0.5, 0.9]), k) for k in range(long * 2)]
        own = [(k * 10.0, k * 10.0 + r.choice([3.0, 7.0]), r.choice(["instrumental", " INSTRUMENTAL", "vocal"])) for k in range(long // 10)]
        rows += [(key, n[4], *n[:4]) for n in notes]
        segments += [(key, *s) for s in own]
        want[key] = walk([n for n in notes if any(n[1] > s[0] and n[0] < s[1] for s in own if s[2] != "vocal")])
    rows += [(0, -1, 5.0, 5.0, 60.0, 0.9), (0, -2, 5.0, 6.0, None, 0.9)]
    s = spark.createDataFrame(segments, "key long, start_sec double, end_sec double, state string")
    for width in (3.0, 1000.0):
        got = {key: [] for key in want}
        for x in H.instrumental_hook(spark.createDataFrame(rows, NOTE).repartition(4), s, "key", width=width).collect():
            got[x.key].append(x.note_seq)
        assert {k: sorted(v) for k, v in got.items()} == want
    assert H.instrumental_hook(spark.createDataFrame([], NOTE), s, "key").count() == 0


def test_records(spark):
    docs = [
        {"start_time": 2, "end_time": 1, "pitch": "C4", "confidence": 7}, {"onset_sec": "1.5", "duration": 0.5, "f0_hz": 880, "mean_confidence": 0.3}, {"start_time_sec": "x", "start_time": 4, "end_time": "Infinity", "duration_sec": 1, "pitch_midi": "NaN"},
        {"start_time_sec": None, "start_time": 3, "f0_hz": -5, "id": 7, "is_candidate_ornament": True},
    ]
    texts = [json.dumps(d) for d in docs] + ["", "no json", "[1]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, note string")
    got = [tuple(x)[1:] for x in R.normalized_notes(df).orderBy("k").select("k", "start_sec", "end_sec", "pitch", "confidence", "note_id", "ornament").collect()]
    assert got[0] == (2.0, 2.0, 60.0, 1.0, None, False)
    assert got[1][:2] == (1.5, 2.0) and math.isclose(got[1][2], 81.0) and got[1][3] == 0.3
    # the first name that is there counts, also where it holds no number
    assert got[2] == (0.0, 1.0, None, 0.0, None, False)
    assert got[3] == (3.0, 3.0, None, 0.0, "7", True)
    assert got[4:] == [(0.0, 0.0, None, 0.0, None, False)] * 4


def test_client_reasons(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, ["TOO_short", None, "other", "too_short"], 0.9, False), (3, [], 0.5, None), (4, ["uncertain", "fragmentation_risk"], None, True), (5, ["x"], 0.9, True)], "k int, codes array<string>, c double, u boolean")
    got = [x[0] for x in df.orderBy("k").select(R.client_reasons(F.col("codes"), F.col("c"), F.col("u"))).collect()]
    assert got == [[], ["too_short", "uncertain"], ["low_confidence", "uncertain"], ["uncertain", "possible_fragmentation"], ["uncertain"]]


def test_lineage_and_hop(spark):
    n = "key long, note_seq long, start_sec double, end_sec double, candidate_id string"
    notes = spark.createDataFrame([(1, 1, 0.0, 2.0, "a"), (1, 2, 5.0, 6.0, "b"), (1, 3, 7.0, 8.0, None), (2, 4, 0.0, 1.0, "")], n)
    sources = spark.createDataFrame([(1, 11, 0.0, 1.0, "x"), (1, 10, 1.0, 2.0, "x"), (1, 12, 2.0, 9.0, "z"), (1, 14, 20.0, 21.0, "b"), (1, 13, 30.0, 31.0, "b"), (2, 15, 1.0, 2.0, "")], n)
    got = {x.note_seq: (x.source_seq, x.found_by) for x in R.restore_lineage(notes, sources.where("note_seq <> 12"), "key", width=1.5).collect()}
    assert got == {1: (10, "overlap"), 2: (13, "id"), 3: (None, None), 4: (None, None)}
    frames = spark.createDataFrame([(1, 0.0), (1, 0.0), (1, 0.01), (1, 0.03), (1, 5.0), (2, 1.0)], "key long, time_sec double")
    assert {x.key: x.hop_sec for x in R.frame_hop(frames, "key", 0.0, width=0.02).collect()} == {1: 0.02, 2: 0.001}


def test_reports_without_candidates(spark):
    results = spark.createDataFrame([(1,), (2,)], "key long")
    grids = spark.createDataFrame([(1, True, "half_tempo_grid", None, None)], "key long, available boolean, best_id string, current_rank int, score_delta double")
    none = spark.createDataFrame([], "key long, candidate_id string, " + ", ".join(f"{m} double" for m in U.MEASURES))
    summary = U.rhythm_summary(results, grids, none, "key")
    assert {x.key: x.next_action for x in summary.collect()} == {1: "regenerate_debug_package", 2: "regenerate_debug_package"}
    assert [x.n_samples for x in U.group_counts(summary).orderBy("place").collect()] == [0, 0, 0, 2, 0]
