"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths decide how pieces share a sequence, and there are at most `SIZE` lengths.
So the plan is made from the histogram of lengths, which Spark aggregates: `SIZE`
counters, whatever the corpus holds. Every step of the plan uses up one length or one
kind of open sequence, so the plan has a few thousand entries at any corpus size.
Pieces find their places in parallel: the r-th piece of a length takes the r-th place
that the plan has for that length. Ranks come from counts by (bucket, length), with
pieces dealt to buckets by hash, so no task ever holds all pieces of a length.

Results for odd input. A null or empty text is one piece that holds only the end id.
A document longer than `SIZE` tokens is cut every `SIZE` tokens; no other is cut.
Repeated rows are packed as often as they occur. Null ids are packed like any other.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordhash
from .scratch import materialize, ship, table

SIZE = 2048
BUCKETS = 256
#: Parts of words whose ids a task remembers.
REMEMBERED = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: a random number, the lower-case byte, the kind (0 space, 1 letter, 2 digit, 3 other), and what makes a word odd."""
    lower, kind, odd = np.arange(256, dtype=np.uint8), np.full(256, 3), np.zeros(256, bool)
    lower[65:91] += 32
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    odd[: 32] = kind[:32] > 0
    odd[[0x27, 0x7F, 0xC2, *range(0xC4, 0x100)]] = True
    return wordhash.mix(np.arange(1, 257, dtype=np.uint64)), lower, kind.astype(np.uint8), odd


class WordTokenizer:
    """Ids of a BPE tokenizer that works word by word and drops white space.

    Equal to `Tokenizer.encode(text, add_special_tokens=False).ids`, but each distinct part
    of a word (its letters, a digit, or other characters) goes through the merges once. Words
    with characters beyond ASCII and the Latin-1 letters, with an apostrophe, or with what
    may be a special token, go through the tokenizer itself, whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        # the usual printable stand-ins of byte-level BPE
        self.stand_in = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        #: Number of each unit met, the ids of all one after the other, and where each unit's begin.
        self.number: dict[bytes, int] = {}
        self.ids, self.begin = array("i"), array("q", [0])

    def units(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each unit, whether it is an odd word, and the bytes as units spell them."""
        table, lower, kinds, odd = _classes()
        kind, low, strange = kinds[buf], lower[buf], odd[buf]
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        strange[after] |= (buf[after] == 0x97) | (buf[after] == 0xB7)
        capital = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
        low[capital] += 0x20
        strange[:-1] |= (buf[:-1] == 0x3C) & (buf[1:] == 0x7C)
        word = kind > 0
        split = word & ((kind != np.append(0, kind[:-1])) | (kind == 2))
        at_odd = np.zeros(len(buf), bool)
        if strange.any():
            start, end = wordhash.spans(buf)
            seen = np.append(0, np.cumsum(strange))
            which = seen[end] > seen[start]
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[start[which]] += 1
            edge[end[which]] -= 1
            at_odd = np.cumsum(edge[:-1], dtype=np.int8) > 0
            split &= ~at_odd
            split[start[which]] = True
            low = np.where(at_odd, buf, low)
        last = word & np.append(split[1:] | ~word[1:], True)
        start, end = np.flatnonzero(split), np.flatnonzero(last) + 1
        up, down = wordhash._powers(wordhash._room(len(buf) + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[low] * up[: len(buf)], dtype=np.uint64)])
        return start, end, wordhash.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), at_odd[start], low

    def learn(self, units: list[bytes], odd: list[bool]) -> np.ndarray:
        """Numbers of the units; makes the ids of those not met before."""
        if len(self.number) > REMEMBERED:
            self._forget()
        number, ids, begin, model = self.number, self.ids, self.begin, self.whole.model
        out = []
        for unit, is_odd in zip(units, odd, strict=True):
            key = b"\0" + unit if is_odd else unit
            n = number.get(key)
            if n is None:
                if is_odd:
                    ids.extend(self.whole.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids)
                else:
                    ids.extend([t.id for t in model.tokenize(unit.decode() if unit.isascii() else unit.decode("latin-1").translate(self.stand_in))])
                n = number[key] = len(number)
                begin.append(len(ids))
            out.append(n)
        return np.array(out, np.int64)

    def encode(self, group: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        start, end, keys, odd, low = self.units(np.frombuffer(b" ".join(group), np.uint8))
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        spelled = low.tobytes()
        number = self.learn([spelled[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)], odd[first].tolist())
        flat, begin = np.array(self.ids, np.int32), np.array(self.begin, np.int64)
        count = (begin[number + 1] - begin[number])[which]
        begin = begin[number][which]
        to = np.cumsum(count)
        ids = flat[np.repeat(begin - (to - count), count) + np.arange(to[-1] if len(to) else 0)]
        bounds = np.append(0, to)[np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in group]))]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield ids[a:b]


def pieces_of(tokenizer: str, size: int = SIZE):
    """A function for mapInArrow: (id, text) to (id, piece, start, length, ids_crc32)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(tokenizer)
        for batch in found:
            ids = batch.column(0).to_pylist()
            for first, group in wordhash.batches(batch.column(1).to_pylist(), size=wordhash.BLOCK // 2):
                out = defaultdict(list)
                for k, tokens in enumerate(tok.encode(group)):
                    tokens = np.append(tokens, 0).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), size)):
                        part = tokens[start : start + size]
                        for name, v in (("id", ids[first + k]), ("piece", piece), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[x], pa.int64()) for x in ("start", "length", "ids_crc32"))], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """How to fill sequences: (how many alike, [(length, how often), ...]) from counts by length.

    First exact complements: for the longest length left, the gap that it leaves is looked
    up among single lengths, then sums of two, then of three, the longest parts first, and as
    many sequences are filled as the counts allow. What fits no gap exactly goes by best fit
    in decreasing order into the open sequence with the least room.
    """
    left = counts.astype(np.int64).copy()
    made: list[tuple[int, list[tuple[int, int]]]] = []

    def take(*parts: int) -> bool:
        need = defaultdict(int)
        for p in parts:
            need[p] += 1
        n = min(left[p] // k for p, k in need.items())
        if n > 0:
            for p, k in need.items():
                left[p] -= n * k
            made.append((int(n), sorted(need.items(), reverse=True)))
        return n > 0

    def pairs(gap: int, most: int) -> np.ndarray:
        """The longer parts of the sums of two that give `gap`, longest first."""
        a = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        return a[(left[a] > 0) & (left[gap - a] > 0)] if len(a) else a

    if left[size]:
        take(size)
    for longest in range(size - 1, 0, -1):
        gap = size - longest
        if left[longest] and left[gap]:
            take(longest, gap)
        if left[longest]:
            for a in pairs(gap, longest):
                take(longest, int(a), int(gap - a))
                if not left[longest]:
                    break
        if left[longest]:
            for a in range(min(gap - 2, longest), (gap - 1) // 3, -1):
                if left[a]:
                    for b in pairs(gap - a, a):
                        take(longest, a, int(b), int(gap - a - b))
                        if not left[longest] or not left[a]:
                            break
                if not left[longest]:
                    break
    open_by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    rooms = np.zeros(size + 1, bool)
    for length in range(size - 1, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                many, held = open_by_room[room].pop()
                rooms[room] = bool(open_by_room[room])
            else:
                room, many, held = size, 1 << 62, []
            each = min(room // length, n)
            used = min(many, n // each)
            if held and used < many:
                open_by_room[room].append((many - used, held))
                rooms[room] = True
            after = room - each * length
            open_by_room[after].append((used, [*held, (length, each)]))
            rooms[after] = after > 0
            n -= used * each
    rooms[0] = False
    made += [x for group in open_by_room.values() for x in group]
    return made


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: pieces of `length` ranked from `rank` on go to sequences from `sequence` on, `each` to one, from `offset` on."""
    rows, used, sequence = [], defaultdict(int), 0
    for many, parts in made:
        offset = 0
        for length, each in parts:
            rows.append((length, used[length], sequence, each, offset))
            used[length] += many * each
            offset += each * length
        sequence += many
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def assign(plan_places: dict[str, np.ndarray]):
    """A function for mapInArrow that adds sequence_id and offset to rows with length and rank."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan_places["length"] * (1 << 48) + plan_places["rank"]
        for batch in found:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            nth, each = rank - plan_places["rank"][at], plan_places["each"][at]
            sequence = plan_places["sequence"][at] + nth // each
            offset = plan_places["offset"][at] + nth % each * length
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = ship(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces_of(tokenizer or default_tokenizer(), size), PIECE)
    bucket = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    cut = materialize(cut.withColumn("bucket", bucket), "pieces")
    counts = cut.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    starts = materialize(counts.withColumn("before", before), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in starts.groupBy("length").agg(F.sum("n")).collect():  # at most `size` rows
        histogram[length] = n
    rank = F.row_number().over(W.partitionBy("bucket", "length").orderBy("id", "piece")) - 1
    ranked = cut.withColumn("nth", rank).join(starts.select("bucket", "length", "before"), ["bucket", "length"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(assign(places(plan(histogram, size))), f"{PIECE}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
