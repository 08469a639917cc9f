"""The clean by runs against a walk over all notes of a key."""

import random

from spanwise.operators import monophonic as M

NOTE = "key long, start_sec double, end_sec double, pitch double, confidence double"


def walk(notes, tempo, transpose, offset, sure, lowest, highest, least):
    grid, rows = 60.0 / tempo / 4.0, []
    for a, b, pitch, c in notes:
        pitch = int(pitch + transpose)
        if lowest <= pitch <= highest and c >= sure:
            a = max(0.0, a + offset)
            s = round(a / grid) * grid
            rows.append([pitch, s, s + max(grid, round((max(a + least, b + offset) - a) / grid) * grid), min(1.0, c)])
    merged = []
    for n in sorted(rows):
        m = merged[-1] if merged else None
        if m and m[0] == n[0] and n[1] <= m[2] + grid * 0.55 and abs(n[3] - m[3]) <= 0.35:
            m[2], m[3] = max(m[2], n[2]), max(m[3], n[3])
        else:
            merged.append(list(n))
    clean = []
    for n in merged:
        m = clean[-1] if clean else None
        if m and m[0] == n[0] and n[1] < m[2]:
            if n[3] > m[3] and n[2] > m[2]:
                m[2] = n[1]
                clean.append(n)
            else:
                m[2], m[3] = max(m[2], n[2]), max(m[3], n[3])
        else:
            clean.append(n)
    return sorted((n[0], round(n[1], 6), round(n[2], 6), n[3]) for n in clean if n[2] - n[1] >= least)


def test_by_runs(spark):
    r = random.Random(8)
    notes = {key: [(a := r.random() * long, a + r.choice([0.05, 0.3, 0.9]), float(r.randrange(58, 63)), r.choice([0.1, 0.3, 0.5, 0.8, 1.2])) for _ in range(long * 3)] for key, long in enumerate([200, 30, 30])}
    df = spark.createDataFrame([(k, *n) for k, rows in notes.items() for n in rows] + [(9, 0.0, 1.0, None, 0.9), (9, 0.0, 1.0, 60.0, None)], NOTE).repartition(4)
    rules = dict(tempo=96.0, transpose=1, offset=-0.04, sure=0.2, lowest=60, highest=62, least=0.1)
    for width in (2.0, 1000.0):
        got = {}
        for x in M.snapped_monophonic(df, "key", width=width, **rules).collect():
            got.setdefault(x.key, []).append((x.pitch, round(x.start_sec, 6), round(x.end_sec, 6), x.confidence))
        assert {k: sorted(v) for k, v in got.items()} == {k: walk(v, **rules) for k, v in notes.items()}
    assert M.snapped_monophonic(df.limit(0), "key", 120.0).count() == 0
