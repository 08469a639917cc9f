"""Scoring by a trigram model of all n-grams of the training documents.

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p2(w | v) = max(c(v w) - D, 0) / c(v) + b(v) p1(w)
    p3(w | u v) = max(c(u v w) - D, 0) / c(u v) + b(u v) p2(w | v)

with D = DISCOUNT, and b what the n-grams leave of 1. Contexts that were not seen take the next
shorter one with weight 1. No n-gram is left out, however rare, and no word.

A model of at most VOCABULARY words and NGRAMS n-grams of each order is one Elias-Fano trie,
which the tasks get as bytes and query memory-mapped. It holds the same fractions and weights, to the
last bit, as are made of counts for any larger model, so the scores do not depend on the way. A larger
model stays distributed: blocks of texts send their
distinct trigrams, with counts from training, to buckets by the first word. A bucket has every
trigram of its words, so it knows c and the number of successors of words, pairs and trigrams,
and answers each block in the order of its question. Words that fill more than two buckets (HEAVY)
are dealt out by pair; their numbers of successors are counted beforehand. As a trigram's
second pair is the first of the next trigram, the answers hold all that p1, p2 and p3 need.

Results for odd input. Null or empty text has one token, the end. Rows with a null id are
learned from and scored. Repeated rows count as often as they occur. Without training rows
N and V are 0 and every token has probability 1. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .elias_fano import Trie
from .scratch import materialize, ship, table

VOCABULARY = 1 << 14
NGRAMS = 1 << 20
FREQUENT = 1 << 19
DISCOUNT = 0.75
#: Characters of text for each bucket, tokens of a block, and a heavy word's occurrences in shares of a bucket.
BUCKET_CHARS, BLOCK_TOKENS, HEAVY = 1 << 22, 1 << 20, 2
#: Counters that a task holds before it passes them on.
HELD = 1 << 21
END = np.uint64(0x5E17D0C0FFEE1234)
_SHIFT = VOCABULARY.bit_length() - 1


def tokens_of(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts, each text's end included, and where each text begins."""
    found, begins = wordhash.words_of(group)
    out = np.insert(found, begins[1:], END)
    return out, begins + np.arange(len(begins))


class Counter:
    """Counts of 64-bit keys, merged now and then, and passed on when there are too many."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, which = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.counts = [keys], [np.bincount(which, np.concatenate(self.counts), len(keys)).astype(np.int64)]
            self.held = len(keys)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.held > least:
            self.merge()
            if self.held > least:
                for a in range(0, self.held, 1 << 17):
                    part = slice(a, a + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(self.keys[0][part].view(np.int64)), pa.array(self.counts[0][part], pa.int64())], names=["key", "c"])
                self.__init__()


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """Sums, over all rows of text, of how often each key occurs. keys_of: from the texts' bytes to keys."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counter = keys_of(), Counter()
        for batch in found:
            for _, group in wordhash.batches(batch.column(0).to_pylist()):
                counter.add(keys(group))
                yield from counter.flush(HELD)
        yield from counter.flush()

    return rows.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _step() -> Column:
    """The power of two, in quarters, that a count reaches."""
    return F.floor(4 * F.log2("c"))


def _at_most(counts: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The rows of the largest counts, by whole steps, so that there are `most` at most."""
    steps = counts.where(F.col("c") >= least).groupBy(_step().alias("step")).count().collect()  # 4 * 64 at most
    total, lowest = 0, None
    for step, n in sorted(steps, reverse=True):
        if total + n > most:
            break
        total, lowest = total + n, step
    return counts.where((F.col("c") >= least) & (_step() >= lowest)) if lowest is not None else counts.where("false")


class Vocabulary:
    """The frequent words: hashes, counts, and numbers of those that n-grams are made of."""

    def __init__(self, key: np.ndarray, c: np.ndarray):
        order = np.argsort(key.view(np.uint64))
        self.key, self.c = key.view(np.uint64)[order], c[order]
        self.number = np.full(len(self.key), -1, np.int32)
        best = np.lexsort((self.key, -self.c))[: VOCABULARY]
        self.number[best] = np.arange(len(best))
        self.count_of = self.c[best]
        self.rank = np.empty(len(self.key), np.int64)
        self.rank[np.lexsort((self.key, -self.c))] = np.arange(len(self.key))

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens among the frequent words, or -1."""
        if not len(self.key):
            return np.full(len(tokens), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, tokens), len(self.key) - 1)
        return np.where(self.key[at] == tokens, at, -1)

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Ranks of the frequent words; the hashes of others, with the highest bit set."""
        place = self.place(tokens)
        rare = tokens | np.uint64(1 << 63)
        return np.where(place >= 0, self.rank[place].astype(np.uint64), rare) if len(self.rank) else rare

    def numbers(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.number[place] if len(self.number) else -1, -1).astype(np.int64)


def _runs(number: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Last places of the runs of `order` numbered tokens within one text, and the runs' keys."""
    n = len(number)
    ok, key = np.zeros(n, bool), np.zeros(n, np.int64)
    if n >= order:
        ok[order - 1 :] = True
        for j in range(order):
            part = number[order - 1 - j : n - j]
            ok[order - 1 :] &= part >= 0
            key[order - 1 :] |= part << (_SHIFT * j)
        for j in range(order - 1):
            at = begins[:-1] + j
            ok[at[at < n]] = False
    at = np.flatnonzero(ok)
    return at, key[at]


def _pair_keys(vocabulary, order: int):
    def make():
        words = vocabulary.value

        def keys(group: list[bytes]) -> np.ndarray:
            tokens, begins = tokens_of(group)
            return _runs(words.numbers(words.place(tokens)), begins, order)[1]

        return keys

    return make


def _word_keys():
    return lambda group: tokens_of(group)[0]


class LanguageModel:
    """The rows learned from, counts of their words, frequent words, and the trie as bytes if it holds the whole model."""

    def __init__(self, rows: DataFrame, n: int, v: int, ends: int, words: Vocabulary, trie: bytes | None):
        self.rows, self.n, self.v, self.ends, self.words, self.trie = rows, n, v, ends, words, trie


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table of bounded size, sorted by key."""
    got = df.select("key", "c").toArrow()
    key, c = got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], c[order]


def _whole(counts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """All counts, if there are NGRAMS at most."""
    counts = materialize(counts, "ngrams")
    return _arrays(counts) if counts.count() <= NGRAMS else None


def train(docs: DataFrame, text_col: str = "text") -> LanguageModel:
    """Learns from every row of `docs`."""
    sc = docs.sparkSession.sparkContext
    rows = ship(docs).select(F.col(text_col).alias("text"))
    counts = materialize(_counted(rows, _word_keys), "words")
    is_end = F.col("key") == F.lit(int(END.view(np.int64)))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0))).first()
    words = Vocabulary(*_arrays(_at_most(counts, FREQUENT)))
    trie = None
    if v == len(words.key) <= VOCABULARY:
        sent = sc.broadcast(words)
        pairs = _whole(_counted(rows, _pair_keys(sent, 2)))
        triples = _whole(_counted(rows, _pair_keys(sent, 3))) if pairs else None
        if triples:
            trie = make_trie(words.count_of, *pairs, *triples).to_bytes()
    return LanguageModel(rows, n, v, ends, words, trie)


def make_trie(count_of: np.ndarray, pair: np.ndarray, pair_c: np.ndarray, triple: np.ndarray, triple_c: np.ndarray) -> Trie:
    """The trie from sorted keys and counts; a number's or pair's own count is that of its occurrences as a context."""
    count_of = count_of if len(count_of) else np.ones(1, np.int64)
    context, word, parent = pair >> _SHIFT, pair & (VOCABULARY - 1), np.searchsorted(pair, triple >> _SHIFT)
    back1 = DISCOUNT * np.bincount(context, minlength=len(count_of)) / count_of
    back2 = DISCOUNT * np.bincount(parent, minlength=len(pair)) / pair_c
    share, share3 = np.maximum(pair_c - DISCOUNT, 0) / count_of[context], np.maximum(triple_c - DISCOUNT, 0) / pair_c[parent]
    return Trie.of(len(count_of), back1, (context, word, share, back2), (parent, triple & (VOCABULARY - 1), share3))


def token_scores(words: Vocabulary, trie: Trie, n: int, v: int, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: place among the frequent words, its p1 (1 for rare words), and the parts a and b of a + b * p1."""
    place = words.place(tokens)
    p1 = np.where(place >= 0, ((words.c[place] if len(words.c) else 0) + 1) / (n + v + 1), 1.0)
    number = words.numbers(place)
    count = len(tokens)
    a, b = np.zeros(count), np.ones(count)
    first = np.zeros(count, bool)
    first[begins[:-1]] = True
    before = np.append(-1, number[:-1])
    before[first] = -1
    has = np.flatnonzero(before >= 0)
    b[has] = trie.value("back1", before[has], 1.0)
    at, key = _runs(number, begins, 2)
    distinct, which = np.unique(key, return_inverse=True)
    found = trie.find("2", distinct >> _SHIFT, distinct & (VOCABULARY - 1))
    a[at] = trie.value("p2", found, 0.0)[which]
    # the pair that ends one token before
    pair_at = np.full(count, -1, np.int64)
    pair_at[at] = found[which]
    context = np.append(-1, pair_at[:-1])
    context[first] = -1
    has = np.flatnonzero(context >= 0)
    back = trie.value("back2", context[has], 1.0)
    a[has] *= back
    b[has] *= back
    ends = has[number[has] >= 0]
    keys, which = np.unique(context[ends] << _SHIFT | number[ends], return_inverse=True)
    found = trie.find("3", keys >> _SHIFT, keys & (VOCABULARY - 1))
    a[ends] += trie.value("p3", found, 0.0)[which]
    return place, p1, a, b


def _sums(begins: np.ndarray, known: np.ndarray, p1: np.ndarray, p: np.ndarray) -> list[pa.Array]:
    """By text: n_tokens, n_known, base_score and score."""
    sums = [np.add.reduceat(x, begins[:-1]) for x in (known.astype(np.int64), np.log10(p1), np.log10(p))]
    return [pa.array(np.diff(begins), pa.int64()), *map(pa.array, sums)]


_SCORED = ["id", "n_tokens", "n_known", "base_score", "score"]
_SCORED_TYPES = "id long, n_tokens long, n_known long, base_score double, score double"


def _score(words, trie, n: int, v: int):
    """For mapInArrow: scores of (id, text) by a trie that holds the whole model."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = words.value, Trie.mapped(trie.value)
        for batch in found:
            ids = batch.column(0)
            for first, group in wordhash.batches(batch.column(1).to_pylist()):
                tokens, begins = tokens_of(group)
                place, p1, a, b = token_scores(held, tree, n, v, tokens, begins)
                known = place >= 0
                p1 = np.where(known, p1, 1 / (n + v + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(group)), *_sums(begins, known, p1, a + b * p1)], names=_SCORED)

    return run


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; bytes of one place in their numbers are put together."""
    sizes = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], np.int64)
    raw = sizes.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    count = int.from_bytes(raw[:8], "little")
    at, out = 8 + 24 * count, []
    for kind, width, n in np.frombuffer(raw, np.int64, 3 * count, 8).reshape(-1, 3).tolist():
        part = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(f"{chr(kind)}{width}"))
        at += width * n
    return out


_NONE = np.uint64(1 << 62)
_MESSAGE = "block long, bucket long, data binary"


def _message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "bucket", "data"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _questions(words, heavy: int, buckets: int):
    """For mapInArrow: (id, text, learn, query) to distinct trigrams by bucket, and what puts the answers together.

    A block that is scored has a row of its own, under a bucket below 0.
    """

    def block_of(block: int, codes: list, lengths: list, ids: list, learn: list, query: list) -> Iterator[tuple[int, int, bytes]]:
        code, length = np.concatenate(codes), np.concatenate(lengths)
        learn, query = np.array(learn, bool), np.array(query, bool)
        ends = np.cumsum(length)
        text = np.repeat(np.arange(len(length)), length)
        first = np.ones(len(code), bool)
        first[ends - 1] = False  # an end has no successor
        at = np.flatnonzero(first)
        u, v = code[at], code[np.minimum(at + 1, len(code) - 1)]
        last = ~first[np.minimum(at + 1, len(code) - 1)]
        w = np.where(last, _NONE, code[np.minimum(at + 2, len(code) - 1)])
        where = wordhash.mix(u + np.uint64(1))
        where = np.where(u < np.uint64(heavy), wordhash.mix(where + v), where)
        bucket = (where % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((w, v, u, bucket))
        u, v, w, bucket = u[order], v[order], w[order], bucket[order]
        new = _starts(bucket, u, v, w)
        number = np.cumsum(new) - 1
        count = np.bincount(number, learn[text[at[order]]]).astype(np.int64)
        u, v, w, bucket = u[new], v[new], w[new], bucket[new]
        asks = bool(query.any())
        edges = np.append(np.flatnonzero(_starts(bucket)), len(bucket))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield block, int(bucket[a]), pack(np.array([asks]), u[a:b], v[a:b], w[a:b], count[a:b])
        if asks:
            which = np.empty(len(at), np.uint32)
            which[order] = number
            known = np.array([i is not None for i in ids])
            yield block, -1 - block % buckets, pack(length, query, known, np.array([i or 0 for i in ids], np.int64), which)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, many = TaskContext.get().partitionId() << 32, [[] for _ in range(5)], 0

        def emit():
            rows, size = [], 0
            for row in block_of(block, *held):
                rows.append(row)
                size += len(row[2])
                if size > 1 << 20:
                    yield _message(rows)
                    rows, size = [], 0
            if rows:
                yield _message(rows)

        vocabulary = words.value
        for batch in found:
            ids, texts, learn, query = (batch.column(k).to_pylist() for k in range(4))
            for first, group in wordhash.batches(texts):
                tokens, begins = tokens_of(group)
                part = slice(first, first + len(group))
                for x, new in zip(held[:2], (vocabulary.codes(tokens), np.diff(begins)), strict=True):
                    x.append(new)
                for x, new in zip(held[2:], (ids[part], learn[part], query[part]), strict=True):
                    x.extend(new)
                many += len(tokens)
                if many >= BLOCK_TOKENS:
                    yield from emit()
                    block, held, many = block + 1, [[] for _ in range(5)], 0
        if many:
            yield from emit()

    return run


def _grouped(found: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows of equal key, which follow each other."""
    rows = (r for batch in found for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    for _, group in itertools.groupby(rows, lambda r: r[key]):
        yield list(group)


def count_trigrams(u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """For each row: counts of its trigram, pair and word, and how many successors pair and word have."""
    order = np.lexsort((w, v, u))
    a, b, c = u[order], v[order], w[order]
    new1, new2, new3 = _starts(a), _starts(a, b), _starts(a, b, c)
    at1, at2, at3 = (np.cumsum(x) - 1 for x in (new1, new2, new3))
    held = count[order]
    c1, c2, c3 = (np.bincount(x, held).astype(np.int64) for x in (at1, at2, at3))
    t2, t1 = np.bincount(at2[new3], c3 > 0).astype(np.int64), np.bincount(at1[new2], c2 > 0).astype(np.int64)
    out = []
    for values, at in ((c3, at3), (c2, at2), (t2, at2), (c1, at1), (t1, at1)):
        x = np.empty(len(u), np.int64)
        x[order] = values[at]
        out.append(x)
    return out


def _answers(heavy: int):
    """For mapInArrow: questions, bucket by bucket, to answers; a heavy word's count is -1 - its rank. Blocks' own rows pass."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(found, 1):
            if group[0][1] < 0:
                for row in group:
                    yield _message([row])
                continue
            parts = [unpack(r[2]) for r in group]
            u, v, w, count = (np.concatenate(x) for x in list(zip(*parts, strict=True))[1:])
            told = count_trigrams(u, v, w, count)
            is_heavy = u < np.uint64(heavy)
            told[3] = np.where(is_heavy, -1 - np.where(is_heavy, u, np.uint64(0)).astype(np.int64), told[3])
            edges = np.cumsum([0, *(len(p[1]) for p in parts)])
            rows = [(r[0], r[1], pack(*(x[a:b] for x in told))) for r, p, a, b in zip(group, parts, edges[:-1], edges[1:], strict=True) if p[0][0]]
            for k in range(0, len(rows), 64):
                yield _message(rows[k : k + 64])

    return run


def _assembled(heavy_counts, n: int, v: int, ends: int):
    """For mapInArrow: a block's own row and answers, by bucket, to the scores of its texts."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_heavy, t_heavy = heavy_counts.value
        for group in _grouped(found, 0):
            length, query, known_id, ids, which = unpack(group[0][2])
            parts = [unpack(r[2]) for r in group[1:]]
            c3, c2, t2, c1, t1 = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 5
            at = np.flatnonzero(c1 < 0)
            c1[at], t1[at] = c_heavy[rank := -1 - c1[at]], t_heavy[rank]
            total = int(length.sum())
            begins = np.concatenate([[0], np.cumsum(length)])
            inner = np.ones(total, bool)
            inner[begins[1:] - 1] = False
            places = np.flatnonzero(inner)

            def spread(x: np.ndarray, rest: int = 0, which=which, places=places, total=total) -> np.ndarray:
                out = np.full(total, rest, np.int64)
                out[places] = x[which]
                return out

            c3, c2, t2, c, t1 = spread(c3), spread(c2), spread(t2), spread(c1, ends), spread(t1)
            p1 = (c + 1) / (n + v + 1)
            a, b = np.zeros(total), np.ones(total)  # of a + b * p1, in the steps of `token_scores`
            text = np.repeat(np.arange(len(length)), length)
            at = np.flatnonzero(text[1:] == text[:-1]) + 1
            at = at[c[at - 1] > 0]
            a[at], b[at] = np.maximum(c2[at - 1] - DISCOUNT, 0) / c[at - 1], DISCOUNT * t1[at - 1] / c[at - 1]
            at = np.flatnonzero(text[2:] == text[:-2]) + 2
            at = at[c2[at - 2] > 0]
            back = DISCOUNT * t2[at - 2] / c2[at - 2]
            a[at], b[at] = a[at] * back + np.maximum(c3[at - 2] - DISCOUNT, 0) / c2[at - 2], b[at] * back
            columns = [pa.array(ids, mask=~known_id), *_sums(begins, c > 0, p1, a + b * p1)]
            yield pa.RecordBatch.from_arrays(columns, names=_SCORED).filter(pa.array(query))

    return run


def _successors(rows: DataFrame, words, heavy: int) -> np.ndarray:
    """How many different words follow each heavy one."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words.value
        for batch in found:
            for _, group in wordhash.batches(batch.column(0).to_pylist()):
                tokens, begins = tokens_of(group)
                code = vocabulary.codes(tokens)
                first = code < np.uint64(heavy)
                first[begins[1:] - 1] = False
                at = np.flatnonzero(first)
                order = np.lexsort((code[at + 1], code[at]))
                u, v = code[at][order], code[at + 1][order]
                new = _starts(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(u[new].astype(np.int64)), pa.array(v[new].view(np.int64))], names=["u", "v"])

    out = np.zeros(heavy, np.int64)
    if heavy:
        for u, many in rows.mapInArrow(run, "u long, v long").distinct().groupBy("u").count().collect():
            out[u] = many
    return out


def _exchange(rows: DataFrame, learned: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of the rows (id, text, learn, query) that ask, by the n-grams of those that are learned from."""
    sc = rows.sparkSession.sparkContext
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET_CHARS))
    c = np.sort(model.words.c)[::-1]
    heavy = int((c * buckets > HEAVY * model.n).sum())
    words = sc.broadcast(model.words)
    counts = sc.broadcast((c[:heavy], _successors(learned, words, heavy)))
    asked = rows.mapInArrow(_questions(words, heavy, buckets), _MESSAGE).repartition("bucket").sortWithinPartitions("bucket")
    told = asked.mapInArrow(_answers(heavy), _MESSAGE).repartition("block").sortWithinPartitions("block", "bucket")
    return told.mapInArrow(_assembled(counts, model.n, model.v, model.ends), _SCORED_TYPES)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", learned: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score.

    learned: the rows of `docs` that the model was trained on, if it was trained on rows of `docs`
    only; they then travel once.
    """
    sc = docs.sparkSession.sparkContext
    rows = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.lit(False) if learned is None else learned).alias("learn"), F.lit(True).alias("query"))
    if model.trie is not None:
        scored = rows.select("id", "text").mapInArrow(_score(sc.broadcast(model.words), sc.broadcast(model.trie), model.n, model.v), _SCORED_TYPES)
    else:
        if learned is None:
            rows = rows.unionByName(model.rows.select(F.lit(None).cast("long").alias("id"), "text", F.lit(True).alias("learn"), F.lit(False).alias("query")))
        scored = _exchange(rows, model.rows, model)
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id", folds: int = 7) -> Column:
    """True for the ids that are not learned from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == 2, F.lit(False))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs.where(~held_out())), learned=~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
