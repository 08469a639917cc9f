"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item of n words, documents are looked at through windows of n words,
starting at every word; a shorter document is one window, whole. A window's fingerprint is the 64-bit SimHash of its five-word
shingles, weighted by how often they occur. Items are indexed, by number of words, under
BLOCKS blocks of bits of their fingerprints, each with all values that differ in at most
RADIUS // BLOCKS bits: of two fingerprints within RADIUS bits at least one block differs
in so few, so the index returns every item within RADIUS. Returned pairs are verified by
the exact weighted Jaccard similarity of their shingles.

A window that shares no shingle with an item has similarity 0, so only windows that reach
over a shared shingle get a fingerprint. The rest of a text costs one hash a word.

Items are taken in blocks of ITEMS_AT_ONCE, with one pass over the documents for each
block; what travels to the tasks is bounded by the block. Documents are never shuffled.

A document shorter than an item is compared with every item that shares enough shingles
with it, without fingerprints. An item of fewer than five words is one shingle of all its
words, and is held by every document with these words in a row.

Results for odd input. Words are runs of letters and digits, lower-cased. Null texts on
either side, items without a word and empty tables give nothing. Repeated items give results of their own; repeated documents too. Ties
between windows go to the first. Other columns are ignored, and kept by `drop_leaks`.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .scratch import broadcast_if_small, materialize, ship, table

SHINGLE = 5
SIMILAR = 0.8
#: Bits in which fingerprints of similar texts may differ; at similarity 0.8 the mean is under 10, with a deviation of 3.
RADIUS, BLOCKS = 19, 10
ITEMS_AT_ONCE = 5000
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)


def simhash(shingles: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` shingles; a shingle that occurs twice weighs twice."""
    bits = (shingles[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.int32) * 2 - 1
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
    ones = (total[width:] - total[:-width]) > 0
    return (ones.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)).astype(np.int64) for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True)]


@functools.cache
def _flips(width: int) -> np.ndarray:
    return np.array([sum(1 << k for k in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)], np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    keys, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(which[: len(a)], minlength=len(keys)), np.bincount(which[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items by number of words: their shingles, fingerprints and blocks."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items: list[tuple[int, np.ndarray]] = []
        by_words = defaultdict(list)
        for item_id, text in items:
            found = wordhash.words((text or "").lower().encode("utf-8", "surrogatepass"), letters_only=True)
            if len(found):
                by_words[len(found)].append(len(self.items))
                self.items.append((item_id, wordhash.shingles(found, SHINGLE)))
        self.short = {n: by_words.pop(n) for n in range(1, SHINGLE) if n in by_words}
        long = [(n, k) for n, members in by_words.items() for k in members]
        #: Different shingles of the other items, sorted, and the items.
        posted = np.concatenate([np.zeros(0, np.uint64), *(np.unique(self.items[k][1]) for _, k in long)])
        poster = np.repeat(np.array([k for _, k in long], np.int64), [len(np.unique(self.items[k][1])) for _, k in long])
        order = np.argsort(posted, kind="stable")
        self.posted, self.poster = posted[order], poster[order]
        self.sizes = {}
        owner = defaultdict(set)
        for n, members in by_words.items():
            prints = np.array([simhash(self.items[k][1], n - SHINGLE + 1)[0] for k in members], np.uint64)
            tables = []
            for k, values in enumerate(blocks_of(prints)):
                near = (values[:, None] ^ _flips(int(_EDGES[k + 1] - _EDGES[k]))).ravel()
                who = np.repeat(np.arange(len(members)), len(near) // len(members))
                order = np.argsort(near, kind="stable")
                tables.append((near[order], who[order]))
            self.sizes[n] = (np.array(members), prints, tables)
            for k in members:
                for s in set(self.items[k][1].tolist()):
                    owner[s].add(n)
        self.shared = np.array(sorted(owner), np.uint64)
        self.widths = [np.array(sorted(owner[s])) for s in self.shared.tolist()]

    def pairs(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and items of n words whose fingerprints differ in at most RADIUS bits: positions, and how many bits."""
        members, own, tables = self.sizes[n]
        met = []
        for values, (near, who) in zip(blocks_of(prints), tables, strict=True):
            lo, hi = np.searchsorted(near, values, "left"), np.searchsorted(near, values, "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            met.append(np.repeat(np.arange(len(prints)), many) * len(members) + who[at])
        w, k = np.divmod(np.unique(np.concatenate(met)), len(members))
        apart = np.bitwise_count(prints[w] ^ own[k]).astype(np.int64)
        close = apart <= RADIUS
        return w[close], members[k[close]], apart[close]

    def over_whole(self, own: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """Items of more words than a document with these shingles, similarity and differing bits."""
        lo, hi = np.searchsorted(self.posted, own, "left"), np.searchsorted(self.posted, own, "right")
        items, shared = np.unique(np.concatenate([self.poster[a:b] for a, b in zip(lo, hi, strict=True)]), return_counts=True)
        for k in items[shared >= SIMILAR * len(own) - 1e-9].tolist():
            item = self.items[k][1]
            if len(item) > len(own) and (score := similarity(own, item)) >= SIMILAR:
                yield k, score, int(np.bitwise_count(simhash(own, len(own))[0] ^ simhash(item, len(item))[0]))

    def search(self, found: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """Item, best similarity, first word, number of words and differing bits, for the word hashes of a document."""
        own = wordhash.shingles(found, SHINGLE) if len(found) >= SHINGLE else np.zeros(0, np.uint64)
        at = np.searchsorted(self.shared, own)
        hits = np.flatnonzero(self.shared[np.minimum(at, len(self.shared) - 1)] == own) if len(self.shared) else []
        starts = defaultdict(list)
        for p in hits:
            for n in self.widths[at[p]].tolist():
                starts[n].append(p)
        best: dict[int, tuple[float, int, int, int]] = {}
        for n, members in self.short.items():
            held = wordhash.shingles(found, n) if len(found) >= n else np.zeros(0, np.uint64)
            for k in members:
                if len(same := np.flatnonzero(held == self.items[k][1][0])):
                    best[k] = (1.0, int(same[0]), n, 0)
        if any(len(own) < n - SHINGLE + 1 for n in starts):
            best.update((k, (score, 0, len(found), apart)) for k, score, apart in self.over_whole(own))
        for n, places in starts.items():
            width = n - SHINGLE + 1
            begin = np.unique(np.concatenate([np.arange(max(0, p - width + 1), min(p, len(own) - width) + 1) for p in places]))
            if not len(begin):
                continue
            for run in np.split(begin, np.flatnonzero(np.diff(begin) > 1) + 1):
                for a in range(int(run[0]), int(run[-1]) + 1, 4096):
                    b = min(a + 4096, int(run[-1]) + 1)
                    for w, k, apart in zip(*self.pairs(n, simhash(own[a : b + width - 1], width)), strict=True):
                        score = similarity(own[a + w : a + w + width], self.items[k][1])
                        if score >= SIMILAR and score > best.get(k, (0.0,))[0]:
                            best[int(k)] = (score, int(a + w), n, int(apart))
        return [(self.items[k][0], *x) for k, x in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: ids, similarity, first_word, n_words, differing_bits."""
    spark = docs.sparkSession
    rows = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, similarity double, first_word int, n_words int, differing_bits int"
    out = None
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    n_blocks = -(-items.count() // ITEMS_AT_ONCE) or 1
    for block in range(n_blocks):  # each holds about ITEMS_AT_ONCE items, chosen by hash
        held = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in held), key=lambda r: (r[0] is None, r[0], r[1])))

        def run(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in found:
                got, ids = [], batch.column(0).to_pylist()
                for first, group in wordhash.batches(batch.column(1).to_pylist(), lower=True):
                    hashes, begins = wordhash.words_of(group, letters_only=True)
                    for k, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                        got += [(ids[first + k], *x) for x in index.search(hashes[a:b])]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(types)], names=["id", "item", "similarity", "first_word", "n_words", "differing_bits"])

        part = rows.where("text is not null").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item. A row with a null id cannot be referred to and stays."""
    leaking = broadcast_if_small(materialize(find_leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("leaking_id")).distinct(), "leaking"))
    return docs.join(leaking, docs[id_col] == leaking["leaking_id"], "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
