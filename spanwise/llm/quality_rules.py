"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats.

The words of a text, `[^\\x20\\x09-\\x0D]+` with case kept, are hashed; a rolling hash over them gives
each n-gram a number for every length of LENGTHS, and n-grams that occur twice or more in the
text cover their words, the first occurrence included and overlaps once. What counts is the
code points of the words covered. Of the short lengths of TOP it is those that occurrences of
the one n-gram that covers most take up, as its count times its length. Lines are the parts
between \\n; one that holds a word and equals an earlier one of its text is a repeat.

Everything is counted in whole numbers and compared as such, so a share is never rounded. A
text fails where the base rules do (under MOST_FEW words, or over 30 % of words in repeated
windows of eight) or where a measure exceeds its percentage of the characters of words.

One pass in Arrow batches without a shuffle; a text is hashed in blocks, and needs some 70 bytes
for each of its words. Hashes of n-grams have 64 bits and are compared within one text only.

Results for odd input. Null or empty text has no words: all counts are 0 and the base rules fail.
A text without a line break is one line. Null ids are kept as they are, and repeated rows are
judged each by itself. Ties do not arise, as no row depends on another. An empty table gives an
empty result. Other columns are kept by `keep_good`, and ignored by `measure`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .scratch import ship, table

# Words of a base window, its percentage, and the fewest words.
WINDOW, REPEATED, MOST_FEW = 8, 30, 20
# The published limits for repetition, percent of characters by length of n-gram, and for lines.
LENGTHS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
TOP = {2: 20, 3: 18, 4: 16}
LINES = 20

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that begin no code point of a word.
_SILENT = _SPACES + bytes(range(0x80, 0xC0))


def word_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and code points of each word of one text, made block by block; case counts."""
    buf, hashes, chars, at = np.frombuffer(data, np.uint8), [], [], 0
    letters = _letters()
    gap = wordhash._tables()[1]
    while at < len(buf):
        to = min(at + wordhash.BLOCK, len(buf))
        while to < len(buf):  # on to the end of the word
            ahead = np.flatnonzero(gap[buf[to : to + wordhash.BLOCK]])
            if len(ahead):
                to += int(ahead[0])
                break
            to = min(to + wordhash.BLOCK, len(buf))
        part = buf[at:to]
        start, end = wordhash.spans(part)
        up, down = wordhash._powers(wordhash._room(len(part) + 1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * up[: len(part)], out=total[1:])
        points = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=points[1:])
        hashes.append(wordhash.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        chars.append(points[end] - points[start])
        at = to
    return (np.concatenate(hashes), np.concatenate(chars)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _letters() -> np.ndarray:
    return wordhash.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(wordhash._ODD))


def line_repeats(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the code points of their words."""
    seen, lines, chars = set(), 0, 0
    for line in data.split(b"\n"):
        if line in seen:
            lines += 1
            chars += len(line.translate(None, _SILENT))
        elif line.strip():
            seen.add(line)
    return lines, chars


class Repeats:
    """The n-grams of several texts, whose words lie one after the other; no n-gram reaches over an end."""

    def __init__(self, words: np.ndarray, chars: np.ndarray, begins: np.ndarray):
        self.begins, self.chars = begins, chars
        self.text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        self.end = np.repeat(begins[1:], np.diff(begins))
        self.up, self.down = wordhash._powers(wordhash._room(len(words) + 1))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])
        self.upto = np.concatenate([[0], np.cumsum(chars)])

    def by_text(self, values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return upto[self.begins[1:]] - upto[self.begins[:-1]]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the n-grams, ordered by text and n-gram; where each distinct one begins, and how often it occurs."""
        place = np.arange(max(0, len(self.chars) - n + 1))
        place = place[place + n <= self.end[: len(place)]]
        key = wordhash.mix((self.total[place + n] - self.total[place]) * self.down[place] + self.text[place].astype(np.uint64) * np.uint64(wordhash._ODD))
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return place, first, np.diff(np.append(first, len(key)))

    def covered(self, n: int) -> np.ndarray:
        """Whether each word lies in an n-gram that its text holds twice or more."""
        place, _, count = self.runs(n)
        again = place[np.repeat(count > 1, count)]
        edge = np.bincount(again, minlength=len(self.chars) + 1) - np.bincount(again + n, minlength=len(self.chars) + 1)
        return np.cumsum(edge)[: len(self.chars)] > 0

    def top(self, n: int) -> np.ndarray:
        """By text: the largest product of count and code points of an n-gram that occurs twice or more."""
        place, first, count = self.runs(n)
        first, count = first[count > 1], count[count > 1]
        at = place[first]
        out = np.zeros(len(self.begins) - 1, np.int64)
        np.maximum.at(out, self.text[at], (self.upto[at + n] - self.upto[at]) * count)
        return out


def _measures(group: list[bytes]) -> dict[str, np.ndarray]:
    tables = [word_table(data) for data in group]
    begins = np.cumsum([0] + [len(w) for w, _ in tables])
    words, chars = (np.concatenate(x) for x in zip(*tables, strict=True))
    lines = np.array([line_repeats(data) for data in group], np.int64)
    repeats = Repeats(words, chars, begins)
    return {
        "n_words": np.diff(begins),
        "word_chars": repeats.by_text(chars),
        "n_symbols": np.array([len(data) - len(data.translate(None, SYMBOLS)) for data in group], np.int64),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeats.by_text(repeats.covered(WINDOW)),
        "dup_line_chars": lines[:, 1],
        **{f"dup_{n}gram_chars": repeats.by_text(chars * repeats.covered(n)) for n in LENGTHS},
        **{f"top_{n}gram_chars": repeats.top(n) for n in TOP},
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Each measure of characters with the percentage of word_chars that it may have.
LIMITS = {"dup_line_chars": LINES} | {f"dup_{n}gram_chars": p for n, p in LENGTHS.items()} | {f"top_{n}gram_chars": p for n, p in TOP.items()}
MEASURES = [*BASE, *LIMITS]


def _base_failed() -> Column:
    return (F.col("n_words") < MOST_FEW) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def _failed_rules() -> Column:
    return F.filter(F.array(*(F.when(100 * F.col(c) > p * F.col("word_chars"), c) for c, p in LIMITS.items())), lambda c: c.isNotNull())


def measure(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row: the columns `carry`, all measures, base_failed, failed_rules (names of limits exceeded) and kept."""
    rows = ship(docs).select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in wordhash.batches(batch.column(1).to_pylist()):
                got = _measures(group)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(group)), *(pa.array(got[m], pa.int64()) for m in MEASURES)], names=["row", *MEASURES])

    out = rows.select("row", *(F.lit(0).cast("long").alias(m) for m in MEASURES)).schema
    found = rows.mapInArrow(run, out).select("row.*", *MEASURES)
    found = found.withColumns({"base_failed": _base_failed(), "failed_rules": _failed_rules()})
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns, that pass all rules."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("whole"), F.col(text_col).alias("text"))
    return measure(packed, carry=("whole",)).where("kept").select("whole.*")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and both verdicts."""
    return measure(table(spark, sf_dir, "documents")).drop("failed_rules")


def _sql() -> str:
    leads = ", ".join([*(f"lead(id, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS g{k}" for k in range(max(*LENGTHS, WINDOW))), *(f"lead(size, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS s{k}" for k in range(max(TOP)))])

    def gram(n: int) -> str:
        return ", ".join(f"g{k}" for k in range(n))

    def covered(n: int, name: str, value: str) -> str:
        return f"""{name} AS (
  SELECT doc_id, sum({value}) AS {name}_v FROM numbered JOIN (
    SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, {gram(n)}) AS c FROM grams WHERE g{n - 1} IS NOT NULL) WHERE c > 1
  ) USING (doc_id, i) GROUP BY doc_id
)"""

    def top(n: int) -> str:
        return f"""top{n} AS (
  SELECT doc_id, max(c * size) AS top{n}_v FROM (SELECT doc_id, {gram(n)}, {" + ".join(f"any_value(s{k})" for k in range(n))} AS size, count(*) AS c FROM grams WHERE g{n - 1} IS NOT NULL GROUP BY doc_id, {gram(n)} HAVING count(*) > 1) GROUP BY doc_id
)"""

    parts = [covered(WINDOW, "windows", "1"), *(covered(n, f"dup{n}", "size") for n in LENGTHS), *(top(n) for n in TOP)]
    names = ["windows", *(f"dup{n}" for n in LENGTHS), *(f"top{n}" for n in TOP), "lines"]
    columns = ["coalesce(windows_v, 0) AS n_repeat_words", "coalesce(lines_v, 0) AS dup_line_chars", *(f"coalesce(dup{n}_v, 0) AS dup_{n}gram_chars" for n in LENGTHS), *(f"coalesce(top{n}_v, 0) AS top_{n}gram_chars" for n in TOP)]
    fails = " OR ".join(f"100 * {c} > {p} * word_chars" for c, p in LIMITS.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
ids AS (SELECT word, CAST(row_number() OVER () AS INT) AS id, CAST(len(word) AS INT) AS size FROM (SELECT DISTINCT word FROM words)),
numbered AS (SELECT doc_id, i, id, size FROM words JOIN ids USING (word)),
grams AS (SELECT doc_id, i, {leads} FROM numbered),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT doc_id, sum(c - 1) AS lines_n, sum((c - 1) * len(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS lines_v
  FROM (SELECT doc_id, line, count(*) AS c FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id
),
{", ".join(parts)},
measured AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines_n, 0) AS n_dup_lines, {", ".join(columns)}
  FROM docs {" ".join(f"LEFT JOIN {n} USING (doc_id)" for n in names)}
),
based AS (SELECT *, n_words < {MOST_FEW} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM measured)
SELECT * REPLACE ({", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in MEASURES)}), NOT base_failed AND NOT ({fails}) AS kept FROM based
"""


OP12_SQL = _sql()
