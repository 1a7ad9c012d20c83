"""Hashes of the words of many texts at once, in Arrow and NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at a time (a longer text stands alone).
SLICE_BYTES = 4_000_000

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: What each byte counts as: A-Z as a-z, and what parts words as a blank.
PLAIN_WORDS = np.array([32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
LETTERS_ONLY = np.array([b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges that follow each other, each of at most ``limit`` in total (a larger single item stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, one after another, and where each begins and the last ends."""
    where = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[where[0] : where[-1]] if where[-1] > where[0] else np.zeros(0, dtype=np.uint8)
    return data, where - where[0]


def hashed(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of ``texts``: the hashes of all words, and the place of each text's first word (and past the last). Null counts as empty."""
    from xxhash import xxh3_64_intdigest

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for a, b in runs(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
        data, where = bytes_of(texts[a:b])
        shown = table[data]
        ink = shown != 32
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        # a text's first byte begins a word of its own
        begins = where[:-1][where[:-1] < where[1:]]
        first[begins] = ink[begins]
        starts = np.flatnonzero(first[ink])
        letters = shown[ink]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(letters))), pa.py_buffer(letters)]).dictionary_encode()
        own = np.array(list(map(xxh3_64_intdigest, words.dictionary.to_pylist())), dtype=_U)
        upto = np.concatenate(([0], np.cumsum(first)))[where]
        yield (own[words.indices.to_numpy()] if len(own) else own), upto


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n``-gram that begins at each word."""
    if len(h) < n:
        return np.zeros(0, dtype=_U)
    total = np.full(len(h) - n + 1, _U(n), dtype=_U)
    for k in range(n):
        total = (total + h[k : len(h) - n + 1 + k]) * _MIX[3]
        total ^= total >> _U(29)
    return mixed(total)
