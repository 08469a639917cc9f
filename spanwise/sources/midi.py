"""MIDI files as tables: Spark reads the files from any of its stores, tasks decode events, and Spark pairs and times them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.intervals import asof_join
from ..operators.lineage import ship
from ..operators.matching import pair_starts_with_ends

#: Microseconds of a beat where no tempo is set.
TEMPO = 500_000
EVENT = "track int, seq long, tick long, kind string, channel int, note int, velocity int, program int, tempo int, text string"


class BadMidi(ValueError):
    pass


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where it ends."""
    value = 0
    for k in range(4):
        byte = data[at + k]
        value = value << 7 | byte & 127
        if byte < 128:
            return value, at + k + 1
    raise BadMidi("a number has more than four bytes")


def _track(data: bytes) -> Iterator[tuple]:
    """Tick, kind and values of the events of a track that matter to notes; programs are those in force at a note."""
    at = tick = status = 0
    programs: dict[int, int] = {}
    while at < len(data):
        step, at = _number(data, at)
        tick += step
        if data[at] >= 128:
            status, at = data[at], at + 1
        elif not 128 <= status < 240:
            raise BadMidi("data without a status before it")
        if status == 255:
            kind, (size, at) = data[at], _number(data, at + 1)
            value, at = data[at : at + size], at + size
            if kind == 81 and size == 3:
                yield tick, "tempo", None, None, None, None, int.from_bytes(value, "big"), None
            elif kind == 3:
                yield tick, "name", None, None, None, None, None, value.decode("latin-1")
            elif kind == 47:
                return
        elif status in (240, 247):
            size, at = _number(data, at)
            at += size
        elif status > 240:
            at += {241: 1, 242: 2, 243: 1}.get(status, 0)
        else:
            kind, channel = status & 240, status & 15
            size = 1 if kind in (192, 208) else 2
            a, b = data[at], data[at + size - 1]
            at += size
            if kind == 192:
                programs[channel] = a
                yield tick, "program", channel, None, None, a, None, None
            elif kind in (128, 144):
                on = kind == 144 and b > 0
                yield tick, "on" if on else "off", channel, a, b if on else 0, programs.get(channel) if on else None, None, None
            else:
                yield tick, "other", channel, None, None, None, None, None


def decode(content: bytes) -> tuple[int, list[tuple]]:
    """Ticks of a beat, and the events of all tracks with their track and place."""
    if content[:4] != b"MThd" or len(content) < 14:
        raise BadMidi("no MIDI header")
    beat = int.from_bytes(content[12:14], "big")
    if beat >= 1 << 15:
        raise BadMidi("time in frames is not supported")
    at, track, out = 8 + int.from_bytes(content[4:8], "big"), 0, []
    while at + 8 <= len(content):
        size = int.from_bytes(content[at + 4 : at + 8], "big")
        if content[at : at + 4] == b"MTrk":
            out += [(track, k, *e) for k, e in enumerate(_track(content[at + 8 : at + 8 + size]))]
            track += 1
        at += 8 + size
    return max(1, beat), out


def midi_events(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each event of the files in `content`: path, beat (ticks of one) and the columns of EVENT.

    A file that cannot be read gives one row of kind `error`, with what is wrong as its text.
    """
    kind = dict(files.dtypes)[path]
    schema = _parse_datatype_string(f"path {kind}, beat int, {EVENT}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    beat, events = decode(data or b"")
                except (BadMidi, IndexError) as problem:
                    beat, events = 1, [(None, 0, None, "error", *[None] * 5, str(problem) or "the file ends early")]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(events), arrow[0].type), pa.array([beat] * len(events), pa.int32()), *(pa.array([e[k] for e in events], arrow[k + 2].type) for k in range(10))], schema=arrow)

    return ship(files).select(F.col(path).alias("path"), content).mapInArrow(run, schema)


def tempo_map(events: DataFrame) -> DataFrame:
    """path, at_tick, tempo, passed: the tempo from each tick on and the time there, in whole microseconds times the ticks of a beat. Of several tempos of one tick the last counts, by track and place; before the first it is TEMPO."""
    tempos = events.where("kind = 'tempo'").groupBy("path", "beat", F.col("tick").alias("at_tick")).agg(F.max_by("tempo", F.struct("track", "seq")).alias("tempo"))
    starts = events.select("path", "beat").distinct().join(tempos.where("at_tick = 0").select("path").distinct(), "path", "left_anti").select("path", "beat", F.lit(0).cast("long").alias("at_tick"), F.lit(TEMPO).alias("tempo"))
    w = W.partitionBy("path").orderBy("at_tick")  # changes of tempo of one file
    piece = (F.col("at_tick") - F.lag("at_tick").over(w)) * F.lag("tempo").over(w)
    every = tempos.unionByName(starts).withColumn("__piece", piece)
    return every.withColumn("passed", F.coalesce(F.sum("__piece").over(w), F.lit(0).cast("long"))).select("path", "at_tick", "tempo", "passed")


def midi_notes(events: DataFrame, track: int | None = None, channel: int | None = None, program: int | None = None) -> DataFrame:
    """The notes (path, track, channel, program, note_seq, pitch, velocity, start_sec, end_sec), by track, channel or program if given.

    An end closes the oldest open note of its track, channel and pitch; notes without an end, or as long as no tick, are left out.
    """
    rows = events.where("kind IN ('on', 'off')")
    for name, value in (("track", track), ("channel", channel)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    paired = pair_starts_with_ends(rows.withColumn("__on", F.col("kind") == "on"), ["path", "track", "channel", "note"], ["seq"], "__on")
    value = lambda side, c: F.max(F.when(F.col("__on") == side, F.col(c)))
    whole = paired.groupBy("path", "beat", "track", "channel", "note", "k").agg(*(value(True, c).alias(c) for c in ("seq", "velocity", "program")), value(True, "tick").alias("on_tick"), value(False, "tick").alias("off_tick")).where("off_tick > on_tick")
    whole = whole if program is None else whole.where(F.col("program") == program)
    tempos = tempo_map(events)
    for side in ("on", "off"):
        mapped = tempos.select("path", F.col("at_tick").alias(f"{side}_at"), F.col("tempo").alias(f"{side}_tempo"), F.col("passed").alias(f"{side}_passed"))
        whole = asof_join(whole, mapped, ["path"], f"{side}_tick", f"{side}_at", [f"{side}_at", f"{side}_tempo", f"{side}_passed"], width=1e6)
    second = lambda side: (F.col(f"{side}_passed") + (F.col(f"{side}_tick") - F.col(f"{side}_at")) * F.col(f"{side}_tempo")) / (F.lit(1e6) * F.col("beat"))
    return whole.select("path", "track", "channel", "program", F.col("seq").alias("note_seq"), F.col("note").alias("pitch"), "velocity", second("on").alias("start_sec"), second("off").alias("end_sec"))


def midi_tracks(events: DataFrame) -> DataFrame:
    """Per file and track: first name and program, whether it plays drums (channel 9), number of notes, last end and range of pitches."""
    first = lambda kind, c: F.min_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("seq")))
    about = events.where("track is not null").groupBy("path", "track").agg(F.coalesce(first("name", "text"), F.lit("")).alias("name"), first("program", "program").alias("program"), F.coalesce(F.bool_or(F.col("channel") == 9), F.lit(False)).alias("is_drum"))
    notes = midi_notes(events).groupBy("path", "track").agg(F.count(F.lit(1)).alias("n_notes"), F.max("end_sec").alias("duration_sec"), F.min("pitch").alias("min_pitch"), F.max("pitch").alias("max_pitch"))
    return about.join(notes, ["path", "track"], "left").fillna({"n_notes": 0, "duration_sec": 0.0})


def track_by_name(tracks: DataFrame, name: str) -> DataFrame:
    """Of each file the first track of that name, whatever its case and the spaces around it: path, track."""
    return tracks.where(F.lower(F.trim("name")) == name.strip().lower()).groupBy("path").agg(F.min("track").alias("track"))


def read_midi(spark: SparkSession, folder: str, pattern: str = "*.mid*") -> DataFrame:
    """The events of all files under `folder` whose names fit."""
    return midi_events(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder))


def _coded(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def encode(beat: int, tracks: list[list[tuple[int, bytes]]]) -> bytes:
    """A file from (tick, message) lists in order of their ticks."""
    out = b"MThd" + (6).to_bytes(4, "big") + (1).to_bytes(2, "big") + len(tracks).to_bytes(2, "big") + beat.to_bytes(2, "big")
    for track in tracks:
        body, before = b"", 0
        for tick, message in track:
            body += _coded(tick - before) + message
            before = tick
        body += b"\x00\xff\x2f\x00"
        out += b"MTrk" + len(body).to_bytes(4, "big") + body
    return out


def tempo_message(tempo: int) -> bytes:
    return b"\xff\x51\x03" + tempo.to_bytes(3, "big")


def name_message(name: str) -> bytes:
    data = name.encode("latin-1")
    return b"\xff\x03" + _coded(len(data)) + data
