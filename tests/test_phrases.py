"""Repair of phrases: cut into runs and followed along a key, against the rules applied to whole keys."""

import random

import pytest

from spanwise.operators import phrases as P


def whole(notes, rules):
    """notes: lists in order; the passes over one key without cuts."""
    for _ in range(rules.passes):
        now = P.finished(P.begun(notes, rules), rules, None, None)
        same = [n[:3] for n in now] == [n[:3] for n in notes]
        notes = now
        if same:
            break
    return notes


def songs():
    r = random.Random(11)
    out = {}
    for key, n in enumerate((500, 1, 2, 3, 60, 61, 62)):
        at, pitch, notes = 0.0, 60, []
        for seq in range(n):
            at += r.choice([0.0, 0.02, 0.05, 0.1, 0.1, 0.12, 0.13, 0.5, -0.02])
            pitch = max(50, min(80, pitch + r.choice([-2, -1, 0, 0, 1, 2])))
            length = r.choice([0.05, 0.1, 0.15, 0.2, 0.3, 0.6])
            heard = pitch + r.choice([0] * 6 + [12, -12, 24, -24, 3, -4])
            notes.append([round(at, 6), round(at + length, 6), float(heard), r.choice([0.3, 0.5, 0.6, 0.8, 0.95]), seq, r.random() < 0.05, 1])
            at = round(at + length, 6)
        out[key] = sorted(notes, key=lambda n: (n[0], n[1], n[4]))
    return out


@pytest.mark.parametrize("rules", [P.PhraseRules(), P.PhraseRules(passes=4, drop_fragments=True, octave_jump=7, sustain_gap=0.3)])
def test_runs_against_whole_keys(spark, rules):
    found = songs()
    df = spark.createDataFrame([(k, *n[:6]) for k, notes in found.items() for n in notes], "song long, start_sec double, end_sec double, pitch double, confidence double, note_seq long, fixed boolean").repartition(5)
    got = {}
    for r in P.repair_phrases(df, "song", rules, width=3.0).collect():
        got.setdefault(r.song, []).append([r.start_sec, r.end_sec, r.pitch, r.confidence, r.note_seq, r.fixed, r.n_merged])
    for key, notes in found.items():
        assert sorted(got[key]) == sorted(whole(notes, rules))
    assert any(n[2] != dict((x[4], x[2]) for x in found[0])[n[4]] for n in got[0])


def test_steps():
    r = P.PhraseRules()
    note = lambda a, b, p, c=0.5, fixed=False: [a, b, float(p), c, int(a * 100), fixed, 1]
    assert [n[:3] for n in P.bridge([note(0, 0.2, 60), note(0.25, 0.5, 61), note(0.5, 0.7, 61)], r)] == [[0, 0.5, 61], [0.5, 0.7, 61]]  # touching notes stay
    assert len(P.bridge([note(0, 0.2, 60, fixed=True), note(0.25, 0.5, 60)], r)) == 2
    assert [n[:3] for n in P.absorb([note(0, 0.3, 60), note(0.3, 0.4, 64), note(0.4, 0.8, 60)], r)] == [[0, 0.8, 60]]
    assert len(P.absorb([note(0, 0.3, 60), note(0.3, 0.4, 64, 0.9), note(0.4, 0.8, 60)], r)) == 3  # surer than its neighbours
    up = [note(0, 0.2, 60, 0.8), note(0.2, 0.4, 72, 0.3), note(0.4, 0.6, 61, 0.8)]
    assert [n[2] for n in P.octaves(up, r, None, None)] == [60, 60, 61] and [n[2] for n in P.islands(up, r)] == [60, 60, 61]
    assert [n[1] for n in P.sustain([note(0, 0.2, 60), note(0.3, 0.4, 62), note(0.5, 0.6, 70)], r)] == [0.3, 0.4, 0.6]
    assert [n[2] for n in P.smooth([note(0, 0.2, 60), note(0.2, 0.4, 63), note(0.4, 0.6, 60)], r, True, True)] == [60, 60, 60]
    assert [n[2] for n in P.smooth([note(0, 0.2, 60), note(0.2, 0.4, 63), note(0.4, 0.6, 60)], r, False, True)] == [60, 63, 60]
