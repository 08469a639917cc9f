"""Substring deduplication over sliding sentence spans.

Every run of RUN consecutive sentences is hashed, however short. A passage that holds few whole
sentences is found by the clauses of sentences: from every clause on, and back from every clause,
the shortest run of at least two clauses with at least WORDS words is hashed too. Spans
meet in one global aggregation, which keeps for each its first place (least id, then position) and
combines on the map side, so a span that fills a third of the corpus is no burden. Every
clause that a repeated span covers anywhere but at its first place is removed.

Only what may be concerned travels: bitmaps, sized by a count, tell tasks which spans may be
repeated and which documents may have some, so other spans are not shuffled again and other
texts not at all. A bitmap only ever lets too much through. Beyond `most` values there is none:
the spans, or the texts, are then all joined by an ordinary shuffle.

A clause ends after one of .!?,;: with white space, or after a line break; a sentence does so after
one of .!? with white space, or after a line break. Both end with the text. Spans are compared by
their words: runs of letters and digits, with A-Z lower-cased; punctuation does not count. A
passage inside one clause has no span and stays.

Results for odd input. Null text stays null and has no clause. Rows with a null id stay
as they are and take no part. Rows repeated with the same id count as one document: their
spans are no repeats of each other. Ties do not arise, as a place is unique. Texts may
become empty. An empty table gives an empty result. Other columns are kept, but n_parts (clauses)
and n_removed give way to the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import wordhash
from .scratch import MOST, Bitmap, materialize, ship, table

#: Sentences of a run, and words of a run of clauses, of which it has two at least.
RUN, WORDS = 3, 20
#: Ends of clauses; those that start with a comma, semicolon or colon end no sentence.
_END = r"[.!?][ \t\r\n]+|\n[ \t\r\n]*|[,;:][ \t\r]+"
_ENDS = re.compile(_END)
_SPACE, _STRONG, _WEAK = (np.isin(np.arange(256), [ord(c) for c in x]) for x in (" \t\r\n", ".!?", ",;:"))


def clause_ends(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the clauses of a text end, as the pattern _END has it, and whether a sentence does too."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(_SPACE[buf].astype(np.int8), prepend=0, append=0))
    begin, end = edge[0::2], edge[1::2]
    before = np.where(begin > 0, buf[begin - 1], 0)
    lines = np.flatnonzero(buf == 10)
    at = np.searchsorted(lines, begin)
    line = np.append(lines, len(buf))[at]
    broken, weak = line < end, _WEAK[before]
    whole = _STRONG[before] | broken
    # after a comma, spaces before a line break end a clause of their own
    first = weak & (line > begin)
    ends = np.concatenate([end[whole], np.minimum(line, end)[first]])
    kinds = np.concatenate([np.ones(whole.sum(), bool), np.zeros(first.sum(), bool)])
    order = np.argsort(ends, kind="stable")
    ends, kinds = ends[order], kinds[order]
    if not len(ends) or ends[-1] < len(buf):
        ends, kinds = np.append(ends, len(buf)), np.append(kinds, True)
    kinds[-1] = True
    return ends, kinds


def span_hashes(data: bytes, run: int = RUN, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First clause, number of clauses and hash of each span."""
    buf = np.frombuffer(data, np.uint8)
    ends, whole = clause_ends(buf)
    n, closes = len(ends), np.flatnonzero(whole) + 1
    begin = np.append(0, ends)[:n]
    start, _ = wordhash.spans(buf, letters_only=True)
    hashes = wordhash.words(data, letters_only=True)
    first = np.append(np.searchsorted(start, begin), len(hashes))
    up, down = wordhash._powers(wordhash._room(len(hashes) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

    opens = np.append(0, closes[:-1])[: max(0, len(closes) - run + 1)]
    place = np.arange(n)
    on = np.maximum(np.searchsorted(first, first[:n] + words), place + 2)
    back = np.minimum(np.searchsorted(first[:n], first[1:] - words, side="right") - 1, place - 1)
    spans = np.unique(np.concatenate([
        opens * (n + 1) + closes[run - 1 : run - 1 + len(opens)],
        (place * (n + 1) + on)[on <= n],
        (back * (n + 1) + place + 1)[back >= 0],
    ]).astype(np.int64))
    place, stop = np.divmod(spans, n + 1)
    a, b = first[place], first[stop]
    place, stop, a, b = (x[a < b] for x in (place, stop, a, b))
    return place, stop - place, wordhash.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


_SPAN = "span long, id long, place int, many int"


def _spans(run: int, words: int, repeated=None):
    """A function for mapInArrow: (id, text) to (span, id, place, many), of all spans or those that may be repeated."""

    def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids = batch.column(0).to_pylist()
            for first, group in wordhash.batches(batch.column(1).to_pylist()):
                parts = [(h.view(np.int64), np.full(len(h), ids[first + k], np.int64), place.astype(np.int32), many.astype(np.int32)) for k, data in enumerate(group) for place, many, h in [span_hashes(data, run, words)]]
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                if repeated is not None:
                    keep = repeated.value.may_hold(columns[0])
                    columns = [x[keep] for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["span", "id", "place", "many"])

    return make


def cut_repeats(text: str | None, places: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the clauses of the spans (place, many); clauses there were, and removed."""
    if not text:
        return text, 0, 0
    ends = [m.end() for m in _ENDS.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    if not places:
        return text, len(ends), 0
    gone = {k for p in places for k in range(p["place"], p["place"] + p["many"])}
    return "".join(text[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in gone), len(ends), len(gone)


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS, most: int = MOST) -> DataFrame:
    """Id, and the array of spans (place, many) that are repeats, of every document that has some."""
    rows = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    place = F.struct("id", "place")
    spans = rows.mapInArrow(_spans(run, words), _SPAN)
    repeated = spans.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("span", "first")
    repeated = materialize(repeated, "repeated")
    known = Bitmap.of(repeated, "span", most)
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)
    again = rows.mapInArrow(_spans(run, words, sent), _SPAN).join(repeated, "span").where(place != F.col("first"))
    return again.groupBy("id").agg(F.collect_set(F.struct("place", "many")).alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS, most: int = MOST) -> DataFrame:
    """The rows of `docs` with repeated clauses cut from the text, and n_parts and n_removed."""
    at = materialize(repeated_places(docs, id_col, text_col, run, words, most), "repeats").withColumnRenamed("id", "repeats_id")
    known = Bitmap.of(at, "repeats_id", most)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    docs = docs.drop("n_parts", "n_removed")
    names = docs.columns
    out = StructType([*docs.schema.fields, StructField("n_parts", LongType()), StructField("n_removed", LongType())])

    def concerned(want: bool):
        def make(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
                may = np.zeros(len(ids), bool)
                known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
                may[known] = sent.value.may_hold(ids.drop_null().to_numpy(zero_copy_only=False))
                batch = batch.filter(pa.array(may == want))
                yield batch if want else _with_counts(batch, [None] * len(batch), text_col)

        return make

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            row, places = batch.column(0), batch.column(1).to_pylist()
            yield _with_counts(pa.RecordBatch.from_arrays([row.field(c) for c in names], names=names), places, text_col)

    some = docs if known is None else docs.mapInArrow(concerned(True), docs.schema)
    some = some.select(F.struct(*(F.col(c) for c in names)).alias("row"))
    some = some.join(at, F.col("row")[id_col].cast("long") == F.col("repeats_id"), "left").select("row", "places")
    some = some.mapInArrow(cut, out)
    return some if known is None else docs.mapInArrow(concerned(False), out).unionByName(some)


def _with_counts(batch: pa.RecordBatch, places: list, text_col: str) -> pa.RecordBatch:
    text = batch.schema.get_field_index(text_col)
    got = [cut_repeats(t, p) for t, p in zip(batch.column(text).to_pylist(), places, strict=True)]
    columns = [pa.array([g[0] for g in got], pa.string()) if k == text else c for k, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2))], names=[*batch.schema.names, "n_parts", "n_removed"])


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP7_SQL = f"""
WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([.!?][ \\t\\r\\n]+|\\n[ \\t\\r\\n]*)', '\\1' || chr(30) || chr(31), 'g'), '([,;:][ \\t\\r]+)', '\\1' || chr(31), 'g') AS t FROM documents
),
cut AS (SELECT doc_id, list_filter(string_split(t, chr(31)), lambda x: x <> '') AS parts FROM marked),
flat AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS i FROM cut),
clean AS (
  SELECT doc_id, i, replace(p, chr(30), '') AS s, contains(p, chr(30)) AS closes,
    nullif(trim(regexp_replace(translate(replace(p, chr(30), ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g')), '') AS w FROM flat
),
sized AS (SELECT *, CASE WHEN w IS NULL THEN 0 ELSE len(string_split(w, ' ')) END AS n FROM clean),
counted AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY doc_id) AS last_i,
    coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
  FROM sized
),
sentences AS (SELECT doc_id, sentence, min(i) AS lo, max(i) AS hi FROM counted GROUP BY 1, 2),
reach AS (
  SELECT a.doc_id, a.lo AS i, b.hi AS j FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.sentence = a.sentence + {RUN - 1}
  UNION
  SELECT doc_id, i, j FROM (
    SELECT a.doc_id, a.i, a.last_i, greatest(b.i, a.i + 1) AS j
    FROM (SELECT *, (upto - n + {WORDS}) * 1000000 AS target FROM counted) a ASOF JOIN (SELECT doc_id, i, upto * 1000000 + i AS key FROM counted) b ON a.doc_id = b.doc_id AND a.target <= b.key
  ) WHERE j <= last_i
  UNION
  SELECT doc_id, i, j FROM (
    SELECT a.doc_id, least(b.i, a.i - 1) AS i, a.i AS j
    FROM (SELECT *, (upto - {WORDS}) * 1000000 + 999999 AS target FROM counted) a ASOF JOIN (SELECT doc_id, i, (upto - n) * 1000000 + i AS key FROM counted) b ON a.doc_id = b.doc_id AND a.target >= b.key
  ) WHERE i >= 0
),
spans AS (
  SELECT r.doc_id, r.i, r.j, string_agg(c.w, ' ' ORDER BY c.i) AS span
  FROM reach r JOIN counted c ON c.doc_id = r.doc_id AND c.i BETWEEN r.i AND r.j GROUP BY 1, 2, 3
),
again AS (
  SELECT doc_id, i, j FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY span) AS earliest FROM spans WHERE span IS NOT NULL) WHERE (doc_id, i) <> earliest
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM again),
kept AS (
  SELECT c.doc_id, count(*) AS n_parts, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN c.s END, '' ORDER BY c.i) AS text
  FROM clean c LEFT JOIN gone g USING (doc_id, i) GROUP BY c.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_parts, 0) AS n_parts, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
