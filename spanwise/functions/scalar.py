"""Scalar expressions on pitches, times and intervals, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARP_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
#: Semitones above C of the natural notes.
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def hz_to_midi(hz: Column) -> Column:
    """Null for frequencies that are not positive."""
    return F.when(hz > 0, 69.0 + 12.0 * F.log2(hz / 440.0))


def midi_to_hz(pitch: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (pitch - 69.0) / 12.0)


def pitch_class(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12))


def midi_to_name(pitch: Column) -> Column:
    """C4 is 60."""
    name = F.element_at(F.array(*map(F.lit, SHARP_NAMES)), (pitch_class(pitch) + 1).cast("int"))
    return F.concat(name, (F.floor(pitch / 12) - 1).cast("string"))


def name_to_midi(name: Column) -> Column:
    """Null for what is not a note name."""
    pattern = r"^([A-Ga-g])([#b]*)(-?\d+)$"
    letter = F.upper(F.regexp_extract(name, pattern, 1))
    marks = F.regexp_extract(name, pattern, 2)
    natural = F.lit(None).cast("int")
    for k, v in NATURALS.items():
        natural = F.when(letter == k, v).otherwise(natural)
    shift = F.length(F.replace(marks, F.lit("b"), F.lit(""))) - F.length(F.replace(marks, F.lit("#"), F.lit("")))
    octave = F.regexp_extract(name, pattern, 3)
    return natural + shift + 12 * (F.when(octave != "", octave).cast("int") + 1)


def circular_distance(a: Column, b: Column, period: int = 12) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, period - d)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ramp(x: Column, zero_at: float, one_at: float) -> Column:
    """0 up to zero_at and 1 from one_at on, linear between; zero_at may be the larger."""
    return clamp((x - zero_at) / (one_at - zero_at))


def decay(x: Column, scale: float) -> Column:
    return F.exp(-F.abs(x) / scale)


def snap(x: Column, grid: float) -> Column:
    """Nearest multiple of grid, halves to the even one."""
    return F.bround(x / grid) * grid


def nearest_of(x: Column, values: list[float]) -> Column:
    """The value nearest to x; the smaller of two equally near ones."""
    return F.array_min(F.transform(F.array(*map(F.lit, sorted(values))), lambda v: F.struct(F.abs(x - v).alias("d"), v.alias("v"))))["v"]


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end > b_start) & (a_start < b_end)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def labels(*cases: tuple[Column, str]) -> Column:
    """The codes of all the cases that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in cases)))


def first_label(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first case that holds."""
    out = F.lit(otherwise)
    for c, label in reversed(cases):
        out = F.when(c, F.lit(label)).otherwise(out)
    return out


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes; a hash where nothing is left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(words != "", words).otherwise(F.substr(F.sha1(text), F.lit(1), F.lit(12)))


def round_scaled(x: Column, digits: int = 6) -> Column:
    """Scaled before it is rounded, as DuckDB does: a value a digit below a half may become one by that."""
    return F.round(x * 10.0**digits) / 10.0**digits
