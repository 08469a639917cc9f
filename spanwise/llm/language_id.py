"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword of bits. For each bit a binary n-gram classifier tells the
languages with a 1 from those with a 0: the log-odds of every n-gram bucket, from counts
over all training documents that Spark sums per language. The bits' margins are decoded by
their logistic losses: the codeword with the least loss wins, and where the runner-up is
closer than `AMBIGUOUS`, the document is flagged. The model has languages * BUCKETS
counters at any corpus size, and prediction is one pass without a shuffle.

Results for odd input. Null text, or text without a letter, gives `und`, score 0 and no
flag. Rows without a language are not learned from. With no training row everything is
`und`; with one language all texts with a letter get it, with score 1. Repeated rows count
as often as they occur; an empty table gives an empty result. Rows with a null id are
predicted, and learned from. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ship, table

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Gap of mean loss between the best two codewords under which a text counts as ambiguous.
AMBIGUOUS = 0.02
#: Languages beyond which the counters are not gathered.
MOST_LANGUAGES = 1000
BLOCK = 1 << 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[128:] = np.arange(128, 256)
_KEEP[97:123] = np.arange(97, 123)


def bucket_counts(text: str) -> np.ndarray:
    """How many n-grams of each bucket the whole text has."""
    buf = _KEEP[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    keep = buf != 32
    keep[1:] |= buf[:-1] != 32
    buf = buf[keep].astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(buf), BLOCK):
        for n in ORDERS:
            part = buf[at : at + BLOCK + n - 1]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint32)
                for j in range(n):
                    h = (h ^ part[j : len(part) - n + 1 + j]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def _count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in found:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is not None and _LETTER.search(text):
                counts = bucket_counts(text)
                total[lang] = total[lang] + counts if lang in total else counts
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all ways to split up to 5 languages in two, else the best spread of some random codes."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 5:
        splits = [c for r in range(1, k) for c in combinations(range(k), r) if 0 in c]
        return np.array([[1.0 if lang in s else -1.0 for s in splits] for lang in range(k)])
    made, bits = np.random.default_rng(7), 10 * int(np.ceil(np.log2(k)))
    best, spread = None, -1
    for _ in range(50):
        code = np.where(made.random((k, bits)) < 0.5, -1.0, 1.0)
        if np.all(np.abs(code.sum(0)) < k):
            near = (bits - code @ code.T) / 2 + np.eye(k) * bits
            if near.min() > spread:
                best, spread = code, near.min()
    return best


class Model:
    """Codewords of the languages, and the log-odds of each bit for each bucket."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        if self.code.shape[1]:
            share = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * BUCKETS) for x in self.langs])
            self.odds = np.array([np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)) for bit in self.code.T]).T

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        x = bucket_counts(text)
        at = np.flatnonzero(x)
        margin = (x[at] @ self.odds[at]) / max(1, x.sum())
        loss = np.log1p(np.exp(-4 * margin * self.code)).mean(1)
        order = np.argsort(loss, kind="stable")
        score = np.exp(-self.code.shape[1] * (loss - loss.min()))
        return self.langs[order[0]], float(score[order[0]] / score.sum()), bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = ship(labelled).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count, "lang string, bucket int, n long")
    sums = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).limit(MOST_LANGUAGES + 1).collect()  # BUCKETS entries a language at most
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for lang, entries in found:
        at, n = zip(*entries, strict=True)
        counts[lang][list(at)] = n
    return Model(dict(counts))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score, ambiguous."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = [model.predict(text) for text in batch.column(1).to_pylist()]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score", "ambiguous"])

    rows = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 4):
    """True for the ids that are not learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text has an unambiguous language, with the columns of `docs`."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            got = [model.predict(text) for text in texts]
            yield batch.filter(pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in got], pa.bool_()))

    return ship(docs).mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
