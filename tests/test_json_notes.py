"""Notes out of JSON of odd shapes."""

from spanwise.operators import json_notes as J


def test_shapes(spark):
    deep = '{"start": 3, "pitch": 1}'
    for _ in range(12):
        deep = '{"x": [' + deep + "]}"
    rows = [
        (1, '{"melody_candidates": {"notes": [{"start_time": 1.5, "end_time": 2, "pitch_midi": 60.6, "more": {"start": 9, "pitch": "A4"}}]}, "x": {"start": 1, "pitch": 5}}'),
        (2, '{"a": {"b": [{"c": [[{"onset_sec": "2.5", "duration": 1, "f0_hz": 440}]]}]}}'), (3, "nope"), (4, None), (5, "[]"), (7, "5"), (8, deep),
        (6, '{"notes": [{"start": 0, "pitch": "C#4"}, {"start": null, "pitch": "c4"}, {"start": 1, "duration_beats": 2, "tempo_bpm": 60, "note": "61", "pitch": null}, 5, "x", {"start": 2, "pitch": "noise"}]}'),
    ]
    df = spark.createDataFrame(rows, "id int, t string")
    got = sorted((r.id, r.path, r.start_sec, r.end_sec, r.pitch) for r in J.json_notes(df, "id", "t").collect())
    assert got == [(1, "$[0]", 1.5, 2.0, 61), (1, "$[0].more", 9.0, 9.0, 69), (2, "$.a.b[0].c[0][0]", 2.5, 3.5, 69), (6, "$[0]", 0.0, 0.0, 61), (6, "$[2]", 1.0, 3.0, 61), (8, "$" + ".x[0]" * 12, 3.0, 3.0, 1)]
    assert J.json_notes(df.limit(0), "id", "t").count() == 0 and J.json_notes(df.where("id = 7"), "id", "t").count() == 0
