"""MIDI files written by the test and read back."""

from pyspark.sql import functions as F

from spanwise.sources import midi as M


def test_files(spark, tmp_path):
    on = lambda t, note, v=80, c=0: (t, bytes([144 | c, note, v]))
    off = lambda t, note, c=0: (t, bytes([128 | c, note, 0]))
    conductor = [(0, M.name_message("x")), (480, M.tempo_message(1_000_000)), (480, M.tempo_message(250_000))]
    # an end without a start, running status, two open notes of one pitch, one never closed, one of no length, a system message
    lead = [(0, M.name_message(" Lead")), off(0, 60), (0, bytes([192, 5])), on(0, 60), (240, bytes([60, 90])), off(480, 60), (500, b"\xf0\x02\x01\xf7"), off(960, 60), on(960, 61), off(960, 61), on(970, 62), (980, bytes([0xE0, 1, 2]))]
    drums = [on(0, 36, 100, 9), (200_000, bytes([144 | 9, 36, 0]))]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "song.mid").write_bytes(M.encode(480, [conductor, lead, drums]))
    (tmp_path / "bad.mid").write_bytes(b"MThd\x00\x00")
    (tmp_path / "short.mid").write_bytes(M.encode(480, [lead])[:-20])
    (tmp_path / "none.txt").write_bytes(b"")
    events = M.read_midi(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert {r.path for r in events.where("kind = 'error'").collect()} - {"short.mid"} == {"bad.mid"}
    song = events.where("path = 'song.mid'")
    notes = sorted((r.track, r.channel, r.program, r.pitch, r.velocity, round(r.start_sec, 9), round(r.end_sec, 9)) for r in M.midi_notes(song).collect())
    assert notes == sorted([(1, 0, 5, 60, 80, 0.0, 0.5), (1, 0, 5, 60, 90, 0.25, 0.75), (2, 9, None, 36, 100, 0.0, round(0.5 + (200_000 - 480) * 0.25 / 480, 9))], key=lambda n: n[:2])
    assert M.midi_notes(song, channel=9).count() == 1 and M.midi_notes(song, program=5).count() == 2 and M.midi_notes(song, track=0).count() == 0
    tracks = {r.track: r for r in M.midi_tracks(song).collect()}
    assert (tracks[1].name, tracks[1].program, tracks[1].is_drum, tracks[1].n_notes, tracks[1].min_pitch) == (" Lead", 5, False, 2, 60)
    assert tracks[0].n_notes == 0 and tracks[0].duration_sec == 0 and tracks[2].is_drum
    assert [tuple(r) for r in M.track_by_name(M.midi_tracks(song), "lead ").collect()] == [("song.mid", 1)]


def test_numbers():
    for n in (0, 1, 127, 128, 16_383, 16_384, 2_097_151, 268_435_455):
        assert M._number(M._coded(n), 0) == (n, len(M._coded(n)))
