"""Phrase collocations read from truncated suffix trees that are built group by group.

The suffixes of a corpus are those of each word occurrence, cut at DEPTH words or the end of its
piece. As in the ERA construction of suffix trees, they are partitioned vertically: a prefix is one
word, and a prefix with more than `budget` suffixes is replaced by its extensions by one word,
until none is too large. Prefixes, in the order of a hash, are packed into groups of about `budget`
suffixes. Each group's subtree is built by itself from its sorted suffixes and holds 2 * `budget`
of them at most; the count of a node is the total of the leaves below it. Prefixes that were
replaced have their counts from the partitioning.

A phrase can only occur `least` times if all of its words do, so suffixes end before a word that
a bitmap of the frequent words shows to be rarer. The bitmap is sized by a count and only ever lets too much through; over 2^26 frequent words there is none.
Tasks send the distinct suffixes of blocks of texts, with counts, to the groups as compressed
arrays. Words are 64-bit hashes of the language and the word; suffixes are compared word by word.
Broadcast are the replaced prefixes and the limits of the groups: 8 bytes for each `budget`
words of the corpus at most, for each level.

Results for odd input. Null or empty text has no words. A null language counts as `und`. Null ids
and repeated rows count as rows. A phrase never goes over the end of a piece or of a text, which
may be as long as it likes: blocks end within texts. Ties of score and count are ordered by the
phrase. An empty table, and a corpus without frequent phrases, gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordhash
from .language_model import pack, unpack
from .scratch import Bitmap, broadcast_if_small, materialize, ship, table

# Words of a phrase, its fewest occurrences, the share of a longer phrase (percent), rows per language.
DEPTH, LEAST, INSIDE, FIRST = 4, 30, 80, 2000
#: Suffixes of a group, and words that a task gathers before it sends them.
BUDGET, HELD = 1 << 21, 1 << 20
#: Slices of the hash by which running sums are carried.
SLICES = 1 << 12
#: Words with their text that are broadcast, by count; beyond that they are joined by a shuffle.
MOST_TEXTS = 200_000
_KEYS = [f"w{k}" for k in range(DEPTH)]


def _kinds() -> np.ndarray:
    """0: byte of a word, 1: between words, 2: between pieces."""
    kinds = np.zeros(256, np.int8)
    kinds[[9, 32]] = 1
    kinds[[10, 11, 12, 13, *b".,;:!?"]] = 2
    return kinds


class Words:
    """The words of texts one after the other: hashes, text of each, whether each begins a piece, and where it lies in `buf`."""

    def __init__(self, buf: np.ndarray, first: int, begins: np.ndarray, salts: np.ndarray, broken: bool = True, more: bool = False):
        """begins: where each text begins in `buf`; broken: a piece ended before it; more: the text goes on in the next block."""
        kinds = _kinds()[buf]
        edge = np.flatnonzero(np.diff((kinds != 0).astype(np.int8), prepend=1, append=1))
        self.buf, self.start, self.end, self.more = buf, edge[0::2], edge[1::2], more
        up, down = wordhash._powers(wordhash._room(len(buf) + 1))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(wordhash._tables()[0][buf] * up[: len(buf)], out=total[1:])
        plain = wordhash.mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        text = np.searchsorted(begins, self.start, side="right") - 1
        self.text = text + first
        self.key = np.maximum(wordhash.mix(plain + salts[self.text]), np.uint64(1))  # 0 stands for no word
        ends = np.concatenate([[0], np.cumsum(kinds == 2)])
        self.opens = ends[self.start] != ends[np.append(0, self.end)[:-1]]
        self.opens[:1] |= broken
        #: whether a piece ends after the last word, or did before there was one
        self.broken = bool(ends[-1] != ends[self.end[-1]]) if len(self.end) else broken or bool(ends[-1])

    def spell(self, at: int) -> str:
        return self.buf[self.start[at] : self.end[at]].tobytes().decode("utf-8", "replace").translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(texts: list[str | None], salts: np.ndarray, size: int = wordhash.BLOCK) -> Iterator[Words]:
    """Blocks of about `size` bytes: several texts, or a part of a long one."""
    gap = _kinds() != 0
    for first, group in wordhash.batches(texts, size=size):
        if len(group) > 1 or len(group[0]) <= size:
            yield Words(np.frombuffer(b"\n".join(group), np.uint8), first, np.cumsum([0] + [len(x) + 1 for x in group[:-1]]), salts)
            continue
        buf, at, broken = np.frombuffer(group[0], np.uint8), 0, True
        while at < len(buf):
            to = min(at + size, len(buf))
            while to < len(buf):  # on to the end of the word
                ahead = np.flatnonzero(gap[buf[to : to + size]])
                if len(ahead):
                    to += int(ahead[0])
                    break
                to = min(to + size, len(buf))
            block = Words(buf[at:to], first, np.zeros(1, np.int64), salts, broken, to < len(buf))
            yield block
            at, broken = to, block.broken


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col), F.lit("und"))
    return ship(docs).select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.col(text_col).alias("text"))


def _blocks(batch: pa.RecordBatch) -> Iterator[Words]:
    salts = wordhash.mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(wordhash._ODD))
    return words_of(batch.column(2).to_pylist(), salts)


def count_words(rows: DataFrame) -> DataFrame:
    """Language, key, word and count c of every word of every language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, known = [], [], {}

        def flush():
            every, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(every)).astype(np.int64)
            for a in range(0, len(every), 1 << 16):
                part = every[a : a + (1 << 16)]
                lang, word = zip(*map(known.__getitem__, part.tolist()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(part.view(np.int64)), pa.array(word), pa.array(total[a : a + (1 << 16)])], names=["lang", "key", "word", "c"])
            keys.clear(), counts.clear(), known.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for block in _blocks(batch):
                every, at, count = np.unique(block.key, return_index=True, return_counts=True)
                known.update((key, (langs[block.text[k]], block.spell(k))) for key, k in zip(every.tolist(), at.tolist(), strict=True) if key not in known)
                keys.append(every)
                counts.append(count)
                if len(known) > HELD >> 3 or sum(map(len, keys)) > HELD:
                    yield from flush()
        if keys and known:
            yield from flush()

    return rows.mapInArrow(run, "lang string, key long, word string, c long").groupBy("lang", "key").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def suffixes(blocks: Iterator[Words], frequent: Bitmap | None, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct suffixes of two words or more of about `held` words: a column of hashes for each word, 0 behind the end, and counts."""
    keys, follows, counted, size = [], [], [], 0
    tail_key, tail_follows = np.zeros(0, np.uint64), np.zeros(0, bool)

    def distinct():
        key, follow, count = np.concatenate(keys), np.concatenate(follows), np.concatenate(counted)
        keys.clear(), follows.clear(), counted.clear()
        every, code = np.unique(key, return_inverse=True)
        n = len(key)
        code = np.concatenate([code.astype(np.uint32) + np.uint32(1), np.zeros(DEPTH, np.uint32)])
        follow = np.concatenate([follow, np.zeros(DEPTH, bool)])
        some = np.flatnonzero(count & follow[1 : n + 1])
        high, on = code[some].astype(np.uint64) << np.uint64(32) | code[some + 1], follow[some + 2]
        low = np.where(on, code[some + 2], np.uint32(0)).astype(np.uint64) << np.uint64(32)
        low |= np.where(on & follow[some + 3], code[some + 3], np.uint32(0))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))[: len(high)]
        words = np.append(np.uint64(0), every)
        parts = [half[first] >> np.uint64(32) if upper else half[first] & np.uint64(0xFFFFFFFF) for half in (high, low) for upper in (True, False)]
        return [words[x] for x in parts], np.diff(np.append(first, len(high)))

    for block in blocks:
        ok = frequent.may_hold(block.key.view(np.int64)) if frequent is not None else np.ones(len(block.key), bool)
        key = np.concatenate([tail_key, block.key])
        # whether a word goes on from the one before, both being frequent
        follow = np.concatenate([tail_follows, ~block.opens & ok & np.concatenate([_last(tail_key, frequent), ok])[: len(ok)]])
        whole = len(key) - (DEPTH - 1) * block.more
        keys.append(key)
        follows.append(follow)
        counted.append(np.arange(len(key)) < whole)
        tail_key, tail_follows = (key[max(0, whole) :], follow[max(0, whole) :]) if block.more else (key[:0], follow[:0])
        # the words carried on are preceded by others, which the next block does not hold
        tail_follows = np.concatenate([np.zeros(min(1, len(tail_follows)), bool), tail_follows[1:]])
        size += len(key)
        if size > held:
            yield distinct()
            size = 0
    if keys:
        yield distinct()


def _last(tail: np.ndarray, frequent: Bitmap | None) -> np.ndarray:
    """Whether the word before a block's first may be followed."""
    if not len(tail):
        return np.zeros(1, bool)
    return frequent.may_hold(tail[-1:].view(np.int64)) if frequent is not None else np.ones(1, bool)


class Partition:
    """Prefixes with too many suffixes, by number of words, and the limits of the groups of all others."""

    def __init__(self, replaced: list[np.ndarray], limits: np.ndarray | None = None):
        self.replaced, self.limits = replaced, limits

    def place(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For suffixes: the hash of the shortest prefix that is not replaced, and how many words it has."""
        prefix, size = words[0].copy(), np.ones(len(words[0]), np.int64)
        for k, replaced in enumerate(self.replaced):
            at = np.flatnonzero(size == k + 1)
            at = at[np.isin(prefix[at], replaced)]
            prefix[at] = longer(prefix[at], words[k + 1][at])
            size[at] += 1
        return prefix, size

    def groups(self, prefix: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, prefix.view(np.int64), side="right")


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix with one more word."""
    return wordhash.mix(prefix * np.uint64(wordhash._ODD) ^ word)


_NODE = ", ".join(f"{k} long" for k in _KEYS) + ", c long"


def _nodes(words: list[np.ndarray], c: np.ndarray, more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    columns = [pa.array(x.view(np.int64)) for x in words] + [pa.array(c, pa.int64())] + [pa.array(x.view(np.int64)) for x in (more or {}).values()]
    return pa.RecordBatch.from_arrays(columns, names=[*_KEYS, "c", *(more or {})])


def extensions(rows: DataFrame, frequent, replaced: list[np.ndarray], held: int = HELD) -> DataFrame:
    """Counts of the prefixes that replace the longest ones in `replaced`, with their hashes."""
    size = len(replaced) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partition(replaced)
        for words, c in suffixes((b for batch in batches for b in _blocks(batch)), frequent.value, held):
            prefix, n = part.place(words)
            some = np.flatnonzero((n == size) & (words[size - 1] > 0))
            words = [x[some] if k < size else np.zeros(len(some), np.uint64) for k, x in enumerate(words)]
            prefix, c = prefix[some], c[some]
            # equal prefixes are neighbours
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))[: len(prefix)]
            c = np.add.reduceat(c, first) if len(first) else c
            for a in range(0, len(first), 1 << 17):
                at = first[a : a + (1 << 17)]
                yield _nodes([x[at] for x in words], c[a : a + (1 << 17)], {"prefix": prefix[at]})

    return rows.mapInArrow(run, _NODE + ", prefix long").groupBy(*_KEYS, "prefix").agg(F.sum("c").alias("c"))


def _limits(prefixes: DataFrame, budget: int) -> np.ndarray:
    """First hashes of the groups after the first, for prefixes (prefix, c) in the order of their hash, at `budget` suffixes each.

    Running sums are made slice by slice of the hash; there is a row for each `budget` suffixes at most.
    """
    sliced = prefixes.select("prefix", "c", F.shiftright("prefix", 64 - SLICES.bit_length() + 1).alias("slice"))
    totals = sorted(sliced.groupBy("slice").agg(F.sum("c")).collect())  # SLICES rows at most
    upto = np.cumsum([0] + [c for _, c in totals])[:-1].tolist()
    if not totals:
        return np.zeros(0, np.int64)
    offsets = F.broadcast(prefixes.sparkSession.createDataFrame([(s, u) for (s, _), u in zip(totals, upto, strict=True)], "slice int, upto long").withColumn("slice", F.col("slice").cast("long")))
    before = F.col("upto") + F.sum("c").over(W.partitionBy("slice").orderBy("prefix")) - F.col("c")
    group = sliced.join(offsets, "slice").select("prefix", F.floor(before / F.lit(budget)).cast("long").alias("g"))
    return np.sort(np.array([r[0] for r in group.where("g > 0").groupBy("g").agg(F.min("prefix")).select("min(prefix)").collect()], np.int64))


def _send(frequent, part, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parted = part.value
        for words, c in suffixes((b for batch in batches for b in _blocks(batch)), frequent.value, held):
            prefix, n = parted.place(words)
            has = np.choose(n - 1, words) > 0
            some = np.flatnonzero(has & (n < DEPTH))
            if not len(some):
                continue
            group = parted.groups(prefix[some])
            some = some[np.argsort(group, kind="stable")]
            group = np.sort(group, kind="stable")
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(group)]
            out, size = [], 0
            for a, b in zip(first.tolist(), np.append(first[1:], len(group)).tolist(), strict=True):
                at = some[a:b]
                every, codes = np.unique(np.concatenate([x[at] for x in words]), return_inverse=True)
                out.append((int(group[a]), pack(every, *codes.astype(np.uint32).reshape(DEPTH, -1), c[at].astype(np.uint32))))
                size += len(out[-1][1])
                if size > 1 << 21:
                    yield _messages(out)
                    out, size = [], 0
            if out:
                yield _messages(out)

    return run


def _messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["group", "data"])


def subtree(messages: list[bytes], replaced: list[np.ndarray], least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes of two words or more with `least` occurrences or more of the suffix tree of one group.

    Sorted suffixes are the leaves from left to right. The node of the first d words begins where
    one of them changes; its count is the total of its leaves.
    """
    every = np.unique(np.concatenate([unpack(m)[0] for m in messages]))
    parts = []
    for m in messages:
        known, *codes, c = unpack(m)
        place = np.searchsorted(every, known).astype(np.uint64)
        parts.append((*(place[codes[k]] << np.uint64(32) | place[codes[k + 1]] for k in (0, 2)), c))
    high, low, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((low, high))
    high, low, c = high[order], low[order], c[order]
    columns = [x.astype(np.uint32) for half in (high, low) for x in (half >> np.uint64(32), half & np.uint64(0xFFFFFFFF))]
    del high, low, order
    starts = np.append(True, columns[0][1:] != columns[0][:-1])
    prefix = every[columns[0]]
    words, counts = [], []
    for d in range(1, DEPTH):
        starts = starts | np.append(True, columns[d][1:] != columns[d][:-1])
        first = np.flatnonzero(starts)
        total = np.add.reduceat(c, first, dtype=np.int64)
        keep = (total >= least) & (every[columns[d][first]] > 0)
        first, total = first[keep], total[keep]
        prefix = longer(prefix, every[columns[d]])
        if d < len(replaced):  # of those the partitioning has the counts
            keep = ~np.isin(prefix[first], replaced[d])
            first, total = first[keep], total[keep]
        words.append([every[columns[k][first]] if k <= d else np.zeros(len(first), np.uint64) for k in range(DEPTH)])
        counts.append(total)
    return [np.concatenate(x) for x in zip(*words, strict=True)], np.concatenate(counts)


def _trees(part, least: int):
    """For mapInArrow: messages ordered by group to nodes, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done():
            words, c = subtree(held, part.value.replaced, least)
            for a in range(0, len(c), 1 << 17):
                yield _nodes([x[a : a + (1 << 17)] for x in words], c[a : a + (1 << 17)])

        for batch in batches:
            for group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and group != now:
                    yield from done()
                    held.clear()
                now = group
                held.append(data)
        if held:
            yield from done()

    return run


def frequent_phrases(rows: DataFrame, words: DataFrame, least: int, budget: int, held: int) -> DataFrame:
    """Keys w0 to w3 (0: none) and count c of every phrase of two words or more that occurs `least` times."""
    sc = rows.sparkSession.sparkContext
    often = words.where(F.col("c") >= least)
    frequent = sc.broadcast(Bitmap.of(often, "key"))
    level = often.select(F.col("key").alias("prefix"), "c")
    replaced, light, found = [], [], []
    for size in range(1, DEPTH + 1):
        heavy = level.where(F.col("c") > budget)
        if size > 1:
            found.append((level.where(F.col("c") >= least) if size == DEPTH else heavy).select(*_KEYS, "c"))
        if size == DEPTH:
            break
        light.append(level.where(F.col("c") <= budget).select("prefix", "c"))
        over = np.array([r[0] for r in heavy.select("prefix").collect()], np.int64).view(np.uint64)  # one for each `budget` words at most
        if not len(over):
            break
        replaced.append(np.sort(over))
        level = materialize(extensions(rows, frequent, replaced, held), "prefixes")
    prefixes = light[0]
    for x in light[1:]:
        prefixes = prefixes.unionByName(x)
    part = sc.broadcast(Partition(replaced, _limits(prefixes, budget)))
    messages = rows.mapInArrow(_send(frequent, part, held), "group long, data binary")
    nodes = messages.repartition("group").sortWithinPartitions("group").mapInArrow(_trees(part, least), _NODE)
    for x in found:
        nodes = nodes.unionByName(x)
    return nodes


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, inside: int = INSIDE, first: int = FIRST, budget: int = BUDGET, held: int = HELD) -> DataFrame:
    """The `first` best phrases of each language: lang, rank, phrase, a, l, r, n and score."""
    rows = _rows(docs, text_col, lang_col)
    words = materialize(count_words(rows), "words")
    phrase = F.filter(F.array(*_KEYS), lambda w: w != 0)
    nodes = materialize(frequent_phrases(rows, words, least, budget, held).select(phrase.alias("phrase"), F.col("c").alias("a")), "phrases")
    single = words.where(F.col("c") >= least)
    counts = nodes.select("phrase", F.col("a").alias("c")).unionByName(single.select(F.array("key").alias("phrase"), "c"))

    size = F.size("phrase")
    cuts = nodes.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, size).alias("rest"))
    cuts = cuts.join(counts.select(F.col("phrase").alias("head"), F.col("c").alias("l")), "head").join(counts.select(F.col("phrase").alias("rest"), F.col("c").alias("r")), "rest")
    wide = "decimal(20, 0)"
    score = F.expr(f"(cast(2000000 as {wide}) * cast(a as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    scored = cuts.groupBy("phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("phrase", "a", "cut.score", "cut.l", "cut.r")

    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("phrase", at, n))))
    within = nodes.where(size > 2).select(F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("phrase").agg(F.max("longer").alias("longer"))
    wide_a = F.col("a").cast("decimal(25, 0)")
    kept = scored.join(within, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(25, 0)") * 100 < wide_a * inside)).drop("longer")

    spelled = broadcast_if_small(single.select("key", "word", "lang"), MOST_TEXTS)
    kept = kept.join(spelled.select(F.col("key").alias("opens_with"), "lang"), F.col("phrase")[0] == F.col("opens_with")).drop("opens_with")
    # all that may be among the first, whatever their spelling
    best = kept.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= first).drop("rank")
    best = best.select("*", F.posexplode("phrase").alias("at", "key")).join(spelled.drop("lang"), "key")
    best = best.groupBy("lang", "phrase", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("text"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))).where(F.col("rank") <= first)
    totals = broadcast_if_small(words.groupBy("lang").agg(F.sum("c").alias("n")), MOST_TEXTS)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""
WITH pieces AS (
  SELECT doc_id, row_number() OVER () AS d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS pn
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
occurrences AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, m, count(*) AS f FROM occurrences, range(1, 5) t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, count(*) AS n FROM occurrences GROUP BY lang),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, m, f AS a FROM grams WHERE m > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longest
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN parts p ON p.lang = s.lang AND p.phrase = s.phrase WHERE longest IS NULL OR 100 * longest < {INSIDE} * a
) JOIN total USING (lang) WHERE rank <= {FIRST}
"""
