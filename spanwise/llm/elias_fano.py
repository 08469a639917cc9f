"""Elias-Fano sequences and an n-gram trie made of them, with vectorised queries.

A sequence of m non-decreasing integers below u keeps about log2(u / m) low bits of each
packed, and the rest as a bit vector with a directory for select. A trie has, for each
level, the children's words and the monotone pointers to them as such sequences, and
probabilities as codes of their distinct values, so none is rounded. Words of one context lie in one range; adding to them what the
range before ended with makes the whole level monotone, so a word is found by a successor
search relative to its context.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th 1 (from 0) of each 64-bit word."""
    word, k, at = word.copy(), k.astype(np.int64), np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        up = k >= low
        k -= np.where(up, low, 0)
        word = np.where(up, word >> np.uint64(width), word)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence. `parts` are its arrays, which may be memory-mapped."""

    def __init__(self, n: int, bits: int, parts: dict[str, np.ndarray]):
        self.n, self.bits, self.parts = n, bits, parts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off, part = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (n + (top >> bits) + 2 + 63) // 64 * 64
        flags = np.zeros(length, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, bits, {"low": low, "high": high, "ones": ones.astype(np.uint32)})

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        ones = self.parts["ones"]
        before = np.arange(len(ones), dtype=np.int64) * 64 - ones if zeros else ones
        word = np.searchsorted(before, k, "right") - 1
        bits = self.parts["high"][word]
        return word * 64 + _select_in_word(~bits if zeros else bits, k - before[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        got = self.parts["low"][word] >> off
        over = off > 0
        got[over] |= self.parts["low"][word[over] + 1] << (np.uint64(64) - off[over])
        return (got & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return (self._select(i, False) - i) << self.bits | self._low(i)

    def successor(self, value: np.ndarray) -> np.ndarray:
        """Place of the first element that is not less than each value; n if there is none."""
        high, want = value >> self.bits, value & ((1 << self.bits) - 1)
        most = len(self.parts["high"]) * 64 - self.n - 1
        beyond = high > most
        high = np.minimum(high, most)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - np.maximum(high - 1, 0), 0)
        hi = self._select(high, True) - high
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return np.where(beyond, self.n, lo)
            mid = (lo[live] + hi[live]) // 2
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of as few bytes as they need, and the distinct values that they stand for."""
    book, codes = np.unique(values, return_inverse=True)
    return codes.astype(np.min_scalar_type(max(0, len(book) - 1))), book


class Trie:
    """Up to three levels over word numbers below `words`.

    Level 1 is dense. A word's `back` is the weight that its context leaves to the next shorter one.
    """

    def __init__(self, words: int, levels: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.words, self.levels, self.codes = words, levels, codes

    @classmethod
    def of(cls, words: int, back1: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Trie:
        """pairs: context, word, probability, back, sorted; triples: place of the pair, word, probability, sorted."""
        levels, codes = {}, {}
        codes["back1"], codes["back1_book"] = coded(back1)
        for name, n, (context, word) in (("2", words, pairs[:2]), ("3", len(pairs[0]), triples[:2])):
            begin = np.searchsorted(context, np.arange(n + 1))
            last = np.append(word, 0)[begin[1:] - 1] + 1
            base = np.concatenate([[0], np.cumsum(np.where(begin[1:] > begin[:-1], last, 0))])
            levels["pointers" + name] = EliasFano.of(begin)
            levels["words" + name] = EliasFano.of(base[context] + word + 1 if len(word) else np.zeros(0, np.int64))
        codes["p2"], codes["p2_book"] = coded(pairs[2])
        codes["back2"], codes["back2_book"] = coded(pairs[3])
        codes["p3"], codes["p3_book"] = coded(triples[2])
        return cls(words, levels, codes)

    def find(self, level: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words in their contexts' ranges; -1 where they are not."""
        held = self.levels["words" + level]
        if not held.n or not len(context):
            return np.full(len(context), -1, np.int64)
        begin, end = self.levels["pointers" + level].get(context), self.levels["pointers" + level].get(context + 1)
        base = np.where(begin > 0, held.get(np.maximum(begin - 1, 0)), 0)
        target = base + word + 1
        at = held.successor(target)
        inside = (at < end) & (at >= begin)
        found = np.full(len(at), -1, np.int64)
        k = np.flatnonzero(inside)
        same = held.get(at[k]) == target[k]
        found[k[same]] = at[k[same]]
        return found

    def value(self, name: str, at: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(at), missing)
        ok = at >= 0
        out[ok] = self.codes[name + "_book"][self.codes[name][at[ok]]]
        return out

    def to_bytes(self) -> bytes:
        arrays = {f"level/{a}/{b}": x for a, ef in self.levels.items() for b, x in ef.parts.items()} | {f"code/{a}": x for a, x in self.codes.items()}
        head, body, at = {}, [], 0
        for name, x in arrays.items():
            raw = np.ascontiguousarray(x).tobytes()
            head[name] = (at, len(x), x.dtype.str)
            body.append(raw + b"\0" * (-len(raw) % 8))
            at += len(body[-1])
        text = json.dumps({"words": self.words, "arrays": head, "levels": {a: (ef.n, ef.bits) for a, ef in self.levels.items()}}).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(body)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie over a memory-mapped file, which has no name any more once it is mapped."""
        handle, path = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        raw = np.memmap(path, np.uint8, "r")
        os.unlink(path)
        size = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + size])
        part = {name: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, n, kind) in head["arrays"].items()}
        levels = {a: EliasFano(n, bits, {b: part[f"level/{a}/{b}"] for b in ("low", "high", "ones")}) for a, (n, bits) in head["levels"].items()}
        return cls(head["words"], levels, {name[5:]: x for name, x in part.items() if name.startswith("code/")})
