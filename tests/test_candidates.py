"""Seeding by runs against a plain walk over all contours and spans of a key, and enrichment of odd rows."""

import random
from statistics import median, pstdev

from spanwise.operators import candidates as C

FRAMES = "array<struct<time_sec: double, pitch_midi: double, confidence: double>>"
CONTOURS = f"key long, contour_id long, start_sec double, end_sec double, pitch double, confidence double, voiced_ratio double, stability double, pitch_range double, frames {FRAMES}"


def end_of(frames):
    deltas = [y[0] - x[0] for x, y in zip(frames, frames[1:]) if y[0] > x[0]]
    return frames[-1][0] + (median(deltas) if deltas else 0.01)


def walk(contours, spans):
    """Contours by number, each compared with every span accepted so far."""
    accepted, out = list(spans), []

    def share(a, b, among):
        return max((max(0.0, min(b, d) - max(a, c)) / (b - a) for c, d in among), default=0.0) if b > a else 0.0

    for _, number, a, b, pitch, sure, voiced, stability, spread, frames in sorted(contours, key=lambda c: c[1]):
        lacks = ["low_confidence"] * (sure < 0.58) + ["low_voiced_ratio"] * (voiced < 0.72) + ["too_short"] * (round(b - a, 6) < 0.04)
        lacks += ["too_unstable"] * (stability < 0.6 or spread > 2.5) + ["outside_vocal_range"] * (not 48 <= pitch <= 84) + ["overlaps_accepted"] * (share(a, b, accepted) > 0.55)
        if not lacks:
            accepted.append((a, b))
            out.append((number, 0, "whole", (), a, b))
            continue
        good, pieces = [], []
        if "too_unstable" in lacks and round(b - a, 6) >= 0.2:
            piece = []
            for f in frames or []:
                if f[2] < 0.58:
                    pieces, piece = pieces + [piece], []
                    continue
                if piece and (f[0] - piece[-1][0] > 0.04 or max(x[1] for x in piece + [f]) - min(x[1] for x in piece + [f]) > 1):
                    pieces, piece = pieces + [piece], []
                piece = piece + [f]
            pieces = [p for p in pieces + [piece] if p]
        for k, p in enumerate(pieces, start=1):
            s, e, heights = p[0][0], end_of(p), [f[1] for f in p]
            if e - s < 0.12 or e - s > 1.25 or pstdev(heights) > 0.6:
                out.append((number, k, "part_rejected", ("too_short",), s, e))
                continue
            against = ("outside_vocal_range",) * (not 48 <= median(heights) <= 84) + ("overlaps_accepted",) * (share(round(s, 6), round(e, 6), accepted + [(round(x, 6), round(y, 6)) for _, x, y in good]) > 0.55)
            if against:
                out.append((number, k, "part_rejected", against, s, e))
            else:
                good.append((k, s, e))
        for i, (k, s, e) in enumerate(good):
            left = max([a] + [(x[2] + s) / 2 for x in good[:i][-1:]])
            right = min([b] + [(e + x[1]) / 2 for x in good[i + 1 :][:1]])
            x, y = max(left, s - 0.35), min(right, e + 0.35)
            x, y = (x, y) if y > x else (s, e)
            accepted.append((round(x, 6), round(y, 6)))
            out.append((number, k, "part", (), x, y))
        out.append((number, 0, "in_parts" if good else "rejected", tuple(lacks), a, b))
    return out


def test_runs_against_whole_keys(spark):
    r = random.Random(5)
    contours, raw, want = [], [], {}
    for key in range(6):
        long = 300 if key == 0 else 60
        own = [(key, round(t := r.random() * long, 2), round(t + r.choice([0.05, 0.2, 0.5, 9.0 if r.random() < 0.1 else 0.3]), 2)) for _ in range(long // 2)]
        mine = []
        for k in range(long * 2):
            a = round(r.random() * long, 2)
            b = round(a + r.choice([0.02, 0.15, 0.3, 0.8, 1.5]), 2)
            frames = [(round(a + j * 0.02, 2), 60.0 + r.choice([0, 0, 0.4, 2]) * (j // 12 % 3), r.choice([0.9] * 14 + [0.1])) for j in range(round((b - a) / 0.02) + 1)] if r.random() < 0.8 else None
            mine.append((key, k, a, b, r.choice([46.0, 55.0, 60.0, 90.0]) if k % 5 == 0 else 62.0, r.choice([0.5, 0.7, 0.9]), r.choice([0.7, 0.8, 1.0]), r.choice([0.3, 0.7, 0.9]), r.choice([0.0, 1.0, 3.0]), frames))
        contours, raw = contours + mine, raw + own
        want[key] = walk(mine, [(round(x[1], 6), round(x[2], 6)) for x in own])
    c = spark.createDataFrame(contours, CONTOURS).repartition(5)
    w = spark.createDataFrame(raw, "key long, start_sec double, end_sec double").repartition(3)
    got = {}
    for x in C.seed_candidates(c, w, "key", width=7.0).collect():
        got.setdefault(x.key, []).append((x.contour_id, x.part, x.state, tuple(x.reasons), round(x.start_sec, 5), round(x.end_sec, 5)))
    for key, rows in want.items():
        assert sorted(got[key]) == sorted((*x[:4], round(x[4], 5), round(x[5], 5)) for x in rows)
    states = {x[2] for rows in want.values() for x in rows}
    assert states == {"whole", "rejected", "in_parts", "part", "part_rejected"}


def test_odd_contours(spark):
    nothing = (None,) * 6
    odd = [(1, 1, None, 1.0, 60.0, *nothing[:5]), (1, 2, 0.0, 1.0, *nothing), (1, 3, 2.0, 2.0, 60.0, 0.9, 0.9, 0.9, 0.0, []), (1, 4, 3.0, 4.0, 60.0, *nothing[:4], [(None, 1.0, 1.0), (3.0, None, 1.0)])]
    none = spark.createDataFrame([], "key long, start_sec double, end_sec double")
    got = {x.contour_id: x.reasons for x in C.seed_candidates(spark.createDataFrame(odd, CONTOURS), none, "key").collect()}
    assert got == {3: ["too_short"], 4: ["low_confidence", "low_voiced_ratio", "too_unstable"]}
    assert C.seed_candidates(spark.createDataFrame([], CONTOURS), none, "key").count() == 0
