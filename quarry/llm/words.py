"""Words of long byte texts in bounded blocks, and their fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists of about ``size`` bytes of text; no word is cut."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + size)
        if end < n:
            m = _SPACE.search(text, end)
            end = m.end() if m else n
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``k`` words (space-joined, repeats included), in blocks.

    Fewer than ``k`` words: the hash of all of them; no word: nothing.
    """
    digest, tail, whole = xxhash.xxh64_intdigest, [], True
    for words in word_blocks(text.lower()):
        words = tail + words
        if len(words) >= k:
            whole = False
            runs = zip(*(words[i:] for i in range(k)), strict=False)
            yield np.array([digest(b" ".join(r), seed) for r in runs], dtype=np.uint64)
            words = words[len(words) - k + 1 :] if k > 1 else []
        tail = words
    if whole and tail:
        yield np.array([digest(b" ".join(tail), seed)], dtype=np.uint64)


def run_codes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """64-bit codes of every run of ``k`` words, A-Z lower-cased, in blocks; each word is hashed once.

    Fewer than ``k`` words: the code of all of them; no word: nothing.
    """
    digest, tail, whole = xxhash.xxh64_intdigest, np.empty(0, np.uint64), True

    def codes(h: np.ndarray, width: int) -> np.ndarray:
        n = len(h) - width + 1
        out = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
        return mixed(out, 1)

    for words in word_blocks(text.lower()):
        h = np.concatenate([tail, np.fromiter(map(digest, words), np.uint64, len(words))])
        if len(h) >= k:
            whole = False
            yield codes(h, k)
            h = h[len(h) - k + 1 :]
        tail = h
    if whole and len(tail):
        yield codes(tail, len(tail))


_LOW = np.uint64(0x0101010101010101)


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set (64 counts, lowest bit first).

    Eight byte counters are summed at once in a 64-bit word, for at most 255 values at a time.
    """
    starts, out = np.arange(0, len(h), 255), np.empty((8, 8), dtype=np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LOW, starts)
        out[:, s] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-th independent 64-bit value derived from each hash (n = 0: the hash itself)."""
    if n == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * n) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """SimHash of the text: ``lanes`` 64-bit words; a bit is set if over half the shingles set it.

    With one lane a bit that just half of them set is 0. With more it is taken from the sum of the
    hashes, so that short texts with many such bits don't come to look alike.
    """
    return signs(shingle_hashes(text or b"", k, seed), lanes)


def signs(blocks: Iterable[np.ndarray], lanes: int = 1) -> np.ndarray:
    """:func:`fingerprint` of 64-bit hashes, which come in blocks that are not empty."""
    total, ones, tie = 0, np.zeros((lanes, 64), dtype=np.int64), np.zeros(lanes, dtype=np.uint64)
    for h in blocks:
        total += len(h)
        for i in range(lanes):
            own = mixed(h, i)
            ones[i] += set_bits(own)
            tie[i] += own.sum(dtype=np.uint64)
    bits = (2 * ones > total).astype(np.uint8)
    if lanes > 1:
        drawn = np.unpackbits(mixed(tie, lanes).view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
        bits = np.where((2 * ones == total) & (total > 0), drawn, bits).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(lanes)
