"""Gap reports on ties, nulls and empty tables."""

from spanwise.operators import gap_reports as G

NOTE = "key long, note_seq long, start_sec double, end_sec double, pitch double, confidence double"


def test_nearest_center_ties_and_limits(spark):
    left = spark.createDataFrame([(1, 1, 10.0, 11.0, None, None), (1, 2, 100.0, 101.0, None, None), (2, 3, 0.0, 0.0, None, None)], NOTE)
    right = spark.createDataFrame([(1, 9, 9.5, 10.5, None, None), (1, 8, 10.5, 11.5, None, None), (1, 7, 10.5, 11.5, None, None), (1, 6, 99.0, 100.5, None, None), (1, 5, 101.0, 102.0, None, None)], NOTE)
    for width in (0.3, 5.0, 1000.0):
        got = {x.note_seq: (x.near_id, x.near_sec) for x in G.nearest_center(left, right, "key", "note_seq", width=width).collect()}
        # equally near on both sides: the smallest id; a distance of just the limit counts
        assert got == {1: (7, 0.5), 2: (6, 0.75), 3: (None, None)}


def test_deleted_candidates(spark):
    raw = spark.createDataFrame([(1, 1, 0.0, 0.1, 60.0, 0.2), (1, 2, 1.0, 2.0, 67.0, None), (1, 3, 3.0, 4.0, None, 0.9), (1, 4, 5.0, 6.0, 60.0, 0.9), (2, 5, 0.0, 1.0, 60.0, 0.9)], NOTE)
    selected = spark.createDataFrame([(1, 1, 1.0, 1.5, 70.0, None), (1, 2, 3.96, 5.0, 40.0, None), (1, 3, 5.5, 6.0, 61.0, None)], NOTE)
    got = {x.note_seq: x for x in G.deleted_candidates(raw, selected, selected, "key", width=0.7).collect()}
    name = lambda *r: ["deleted_candidate_" + x for x in ("selector_removed", *r)]
    assert set(got) == {1, 2, 3, 5}
    assert got[1].reasons == name("low_confidence", "short_duration", "large_pitch_jump") and got[1].impact == 0.02
    # without confidence it counts half; the neighbour without pitch is no jump
    assert got[2].reasons == name("large_pitch_jump", "overlap") and (got[2].impact, got[2].overlap_with, got[2].pitch_jump) == (0.5, 1, 7.0)
    # no pitch to compare, yet it overlaps for too short a time to be matched
    assert got[3].reasons == name("overlap") and got[3].place == 1
    assert got[5].reasons == name() and got[5].near_id is None
    none = spark.createDataFrame([], NOTE)
    assert G.deleted_candidates(none, selected, none, "key").count() == 0
    assert G.deleted_candidates(raw, none, none, "key", top=None).count() == 5


def test_clusters(spark):
    gaps = spark.createDataFrame([(1, 1.0, 3.0), (1, 10.0, 10.3)], "key long, gap_start double, gap_end double")
    raw = spark.createDataFrame([(1, 1, 1.1, 1.9, 46.0, 0.8), (1, 2, 1.9, 2.9, 46.0, None), (1, 3, 2.98, 5.0, 90.0, 0.9), (1, 4, 10.1, 10.2, None, 0.1)], NOTE)
    selected = spark.createDataFrame([(1, 1, 0.0, 1.0, 59.0, None), (1, 2, 3.0, 3.5, 70.0, None)], NOTE)
    got = {x.gap_start: x for x in G.fragment_clusters(gaps, raw, selected, "key", width=2.0).collect()}
    name = lambda *r: ["candidate_formation_" + x for x in r]
    a, b = got[1.0], got[10.0]
    assert a.reasons == name("low_octave_cluster", "safe") and (a.n_candidates, round(a.pitch, 9), round(a.shifted_pitch, 9), round(a.confidence, 9)) == (2, 46.0, 58.0, 0.8)
    # without pitch it has none in range, but what is near is told
    assert b.reasons == name("short_fragment_cluster", "too_short", "low_confidence", "pitch_out_of_range") and b.left_pitch == 70.0
    assert G.fragment_clusters(gaps.limit(0), raw, selected, "key").count() == 0
