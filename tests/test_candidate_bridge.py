"""The bridge by runs against a plain walk over all contours and notes of a key."""

import random

from spanwise.operators import candidate_bridge as B

R = B.BridgeRules()


def overlap(a, b, c, d):
    return max(0.0, min(b, d) - max(a, c))


def plain(contours, notes, vocal):
    """Contours in order: accepted (id, part) and, for each tried, what it lacks; every list is gone through whole."""
    work, out = [tuple(n) for n in notes], []

    def lacks(c):
        a, b = c["start"], c["end"]
        gaps = [(x[1], y[0]) for x, y in zip(sorted(work), sorted(work)[1:]) if y[0] > x[1]]
        gap = next(((g, h) for g, h in gaps if g <= (a + b) / 2 <= h), None)
        good = [n for n in work if 48 <= n[2] <= 84 and n[1] - n[0] >= 0.18 and n[3] >= 0.72]
        left = min(((a - n[1], n[2]) for n in sorted(good) if n[1] <= a and a - n[1] <= 4), key=lambda x: x[0], default=None)
        right = min(((n[0] - b, n[2]) for n in sorted(good) if n[1] > a and n[0] >= b and n[0] - b <= 4), key=lambda x: x[0], default=None)
        sides = [x[1] for x in (left, right) if x]
        if c["pitch"] < 48 and sides:
            now, then = (min(abs(c["pitch"] + s - p) for p in sides) for s in (0, 12))
            if 48 <= c["pitch"] + 12 <= 84 and now >= 8 and then <= 4 and then + 2 < now:
                c["pitch"] += 12
        long, found = round(b - a, 6), []
        found += ["low_confidence"] * (c["confidence"] < 0.72) + ["low_voiced_ratio"] * (c["voiced_ratio"] < 0.9) + ["too_short"] * (long < 0.18)
        found += ["too_unstable"] * (long > 2.5 or c["stability"] < 0.35) + ["outside_vocal_range"] * (not 48 <= c["pitch"] <= 84) + ["overlaps_note"] * any(overlap(a, b, n[0], n[1]) > 0 for n in work)
        found += ["no_gap"] * (gap is None or round(gap[1] - gap[0], 6) < 0.18 or round(overlap(a, b, *gap), 6) < 0.18) + ["no_local_context"] * (not left or not right)
        if gap and round(gap[1] - gap[0], 6) > 0.5 and (not left or not right or not round(left[0], 6) or not round(right[0], 6) or min(left[0], right[0]) > 0.5):
            found.append("splits_big_gap")
        if vocal and (not long or round(sum(overlap(a, b, *v) for v in vocal) / long, 6) < 0.6):
            found.append("no_vocal_activity")
        return [] if found == ["too_unstable"] and long <= 2.5 and c["moves"] else found

    def tried(c):
        found = lacks(c)
        out.append((c["id"], c["part"], c["pitch"], tuple(found)))
        if not found:
            work.append((c["start"], c["end"], c["pitch"], c["confidence"]))
        return not found

    for c in contours:
        if not tried(c):
            for part in B._parts(c, R):
                tried(part)
    return out


def test_runs_against_whole_keys(spark):
    r = random.Random(12)
    contours, notes, vocal, want = [], [], [], {}
    for key in range(6):
        end = 200 if key else 600
        own_notes = [(round(t := r.random() * end, 2), round(t + r.choice([0.1, 0.3, 0.5, 6.0 if r.random() < 0.05 else 0.4]), 2), float(r.randrange(44, 80)), r.choice([0.6, 0.8, 0.9])) for _ in range(end // 2)]
        own_vocal = [] if key == 2 else [(k * 10.0, k * 10.0 + 8) for k in range(end // 10)]
        own = []
        for k in range(end // 2):
            a = round(r.random() * end, 2)
            b = round(a + r.choice([0.1, 0.2, 0.3, 0.5, 2.6, 3.0]), 2)
            frames = [(round(a + j * 0.02, 2), 60.0 + r.choice([0, 0, 0.2, 3]) * (j // 12 % 3), r.choice([0.9] * 12 + [0.1])) for j in range(int((b - a) / 0.02))] if b - a > 2 else None
            own.append({"id": k, "part": 0, "start": a, "end": b, "pitch": float(r.choice([40, 46, 55, 60, 66])), "confidence": r.choice([0.6, 0.8, 0.95]), "voiced_ratio": r.choice([0.5, 0.95, 1.0]), "stability": r.choice([0.2, 0.5]), "moves": (v := r.random() < 0.3), "vibrato": v, "frames": frames})
            contours.append((key, k, a, b, own[-1]["pitch"], own[-1]["confidence"], own[-1]["voiced_ratio"], own[-1]["stability"], False, v, frames))
        notes += [(key, *n) for n in own_notes]
        vocal += [(key, *v) for v in own_vocal]
        # as runs are cut in time, contours of one run come by number; so give them to the walk in that order too
        want[key] = plain(own, own_notes, own_vocal)
    frame = "array<struct<time_sec: double, pitch_midi: double, confidence: double>>"
    c = spark.createDataFrame(contours, f"key long, contour_id long, start_sec double, end_sec double, pitch double, confidence double, voiced_ratio double, stability double, glides boolean, vibrato boolean, frames {frame}").repartition(5)
    n = spark.createDataFrame(notes, "key long, start_sec double, end_sec double, pitch double, confidence double").repartition(3)
    v = spark.createDataFrame(vocal, "key long, start_sec double, end_sec double")
    got = {}
    for x in B.bridge_candidates(c, n, "key", v, width=7.0).collect():
        got.setdefault(x.key, []).append((x.contour_id, x.part, x.pitch, tuple(x.reasons)))
        assert x.accepted == (not x.reasons)
    for key in want:
        assert sorted(got[key]) == sorted(want[key])
    assert sum(not x[3] for x in want[0]) > 5 and any(x[1] and not x[3] for k in want for x in want[k])
    assert B.bridge_candidates(c.limit(0), n, "key", v).count() == 0
