"""Ragged joins and rescue against plain Python."""

import random

import pytest

from spanwise.operators import ragged as R

NOTE = "key long, start_sec double, end_sec double, pitch int, confidence double, note_seq long"


def plain_rescue(pending, context, reach=4.0, passes=4):
    """Notes as (start, end, pitch, confidence, seq), in the way that the rule says it: pass by pass over all that is left."""
    known, out = sorted(context, key=lambda n: (n[0], n[1], n[2], n[4])), {}
    left = sorted(pending, key=lambda n: (n[0], n[1], n[2], n[4]))
    for turn in range(passes):
        rest = []
        for n in sorted(left, key=lambda n: (n[0], n[1], n[2], n[4]), reverse=bool(turn % 2)):
            fit = [c for c in known if 48 <= c[2] <= 84 and c[3] >= 0.45 and round(c[1] - c[0], 6) >= 0.12]
            before = max((c for c in fit if c[1] <= n[0] and n[0] - c[1] <= reach), key=lambda c: c[1], default=None)
            after = min((c for c in fit if c[0] >= n[1] and c[0] - n[1] <= reach), key=lambda c: c[0], default=None)
            ok = before is not None and after is not None and 48 <= n[2] + 12 <= 84 and n[2] < 48
            if ok and after[0] - before[1] > 0.5:
                ok = (n[0] - before[1] > 0.5) + (after[0] - n[1] > 0.5) <= 1
            if ok:
                now, then = (min(abs(n[2] + s - c[2]) for c in (before, after)) for s in (0, 12))
                ok = now >= 9 and then <= 4 and then + 2 < now
            if ok:
                out[n[4]] = (n[2] + 12, turn + 1)
                known.append((n[0], n[1], n[2] + 12, n[3], n[4]))
            else:
                rest.append(n)
        if len(rest) == len(left):
            break
        left = rest
    return out


@pytest.mark.parametrize("width", [2.0, 1000.0])
def test_rescue(spark, width):
    r = random.Random(8)
    pending, context = [], []
    for key in range(5):
        for k in range(250):
            at, long = round(r.random() * (30 if key else 120), 2), r.choice([0.05, 0.1, 0.2, 0.4])
            side = pending if r.random() < 0.7 else context
            side.append((key, at, round(at + long, 2), r.choice([38, 41, 44, 47] if side is pending else [40, 50, 53, 56, 58, 90]), r.choice([0.3, 0.5, 0.7]), key * 1000 + k))
    got = {x.note_seq: (x.pitch, x["pass"]) for x in R.rescue_low_octave(spark.createDataFrame(pending, NOTE), spark.createDataFrame(context, NOTE), "key", width).collect()}
    want = {}
    for key in range(5):
        want |= plain_rescue([n[1:] for n in pending if n[0] == key], [n[1:] for n in context if n[0] == key])
    assert got == want and any(t > 1 for _, t in want.values())


@pytest.mark.parametrize("tokens, notes", [(0, 3), (3, 0), (5, 5), (5, 6), (5, 7), (5, 8), (5, 9), (5, 12), (5, 40), (40, 5), (1, 1), (1, 9), (30, 77)])
def test_group_zip_sizes(tokens, notes):
    """The closed form of the partner equals the walk; the query is compared with the walk in SQL."""
    walk, cursor = {}, 0
    for i in range(tokens):
        if cursor >= notes:
            break
        more = notes - cursor - (tokens - i)
        size = 3 if more >= 4 else 2 if more >= 2 else 1
        walk |= {j: i for j in range(cursor, min(notes, cursor + size))}
        cursor += size
    more = notes - tokens
    threes = (more - 2) // 2 if more >= 4 else 0
    twos = max(0, more - 2 * threes - 1)
    partner = lambda j: j // 3 if j < 3 * threes else threes + (j - 3 * threes) // 2 if j < 3 * threes + 2 * twos else j - 2 * threes - twos
    assert {j: partner(j) for j in range(notes) if partner(j) < tokens} == walk
