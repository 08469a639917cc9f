"""Vectorised 64-bit hashes of words and word n-grams, for use inside Arrow batches.

A word is a maximal run of bytes other than space and \\x09-\\x0D in the UTF-8 text,
with A-Z lower-cased, so the result agrees with the pattern `[^\\x20\\x09-\\x0D]+`.
Hashes are 64 bits wide: two of m distinct values agree with probability of about
m * m / 2**65, far below one in a million for the distinct n-grams of one document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    lower = np.arange(256)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    plain = space.copy()
    for b in range(128):
        plain[b] |= not chr(b).isalnum()
    return letters[lower], space, plain


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return max(BLOCK, 1 << (n - 1).bit_length()) if n else BLOCK


def spans(buf: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; letters_only: ASCII punctuation separates words too."""
    gap = _tables()[2 if letters_only else 1][buf]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    return edge[0::2], edge[1::2]


def _hash_block(buf: np.ndarray, letters_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = spans(buf, letters_only)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    up, down = _powers(_room(len(buf) + 1))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_tables()[0][buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def words(data: bytes, letters_only: bool = False) -> np.ndarray:
    """Hashes of the words of one text, made block by block to bound the memory for long texts."""
    buf, out, at = np.frombuffer(data, np.uint8), [], 0
    gap = _tables()[1]
    while at < len(buf):
        to = min(at + BLOCK, len(buf))
        while to < len(buf):
            cut = np.flatnonzero(gap[buf[max(at, to - BLOCK) : to]])
            if len(cut):
                to = max(at, to - BLOCK) + int(cut[-1]) + 1
                break
            to = min(to + BLOCK, len(buf))
        out.append(_hash_block(buf[at:to], letters_only)[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def batches(texts: list[str | None], lower: bool = False, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of whole texts of about `size` bytes, with the index of the first."""
    first, group, held = 0, [], 0
    for k, text in enumerate(texts):
        data = ((text.lower() if lower else text) if text is not None else "").encode("utf-8", "surrogatepass")
        if group and held + len(data) > size:
            yield first, group
            first, group, held = k, [], 0
        group.append(data)
        held += len(data) + 1
    if group:
        yield first, group


def words_of(group: list[bytes], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and where each text's words begin (one entry more than texts)."""
    if len(group) == 1:
        found = words(group[0], letters_only)
        return found, np.array([0, len(found)])
    joined = np.frombuffer(b" ".join(group), np.uint8)
    found, start, _ = _hash_block(joined, letters_only)
    begins = np.cumsum([0] + [len(x) + 1 for x in group])
    return found, np.searchsorted(start, begins)


def shingles(found: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the whole sequence as one if it is shorter; none without words."""
    k = min(k, len(found))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(found) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = (total * np.uint64(_ODD)) ^ mix(found[j : j + n] + np.uint64((0xD1B54A32D192ED03 * (j + 1)) & _MASK))
    return mix(total)
