"""Token ids from a byte-level BPE file of the ``tokenizers`` library, fast on repeated words.

The pre-tokenizer of such a file cuts a text into words with their leading
space, numbers, runs of signs and runs of white space, and the model encodes
each apart. For texts of ASCII and the Latin letters with marks (U+00C0 to
U+00FF) the same cut is made here on the bytes of many texts at once; each
distinct word is encoded by the library's model once and kept in a bounded
memo. Texts with other characters are cut before every single space that a
visible character follows, where a pre-token always begins; pieces with such
characters go to the library as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import bytes_of, runs

#: Words that each of a memo's two halves holds at most.
MEMO_WORDS = 350_000
#: Longer words are not worth keeping.
MEMO_LENGTH = 40
#: Bytes of text that are cut at a time (a longer text stands alone).
SLICE_BYTES = 4_000_000

#: The character by which byte-level models write each byte: visible ones of Latin-1 stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = sorted(set(range(256)) - set(_SHOWN))
_WRITTEN = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))

#: Kinds of bytes in plain texts. Bytes from 128 on are halves of letters there.
_LETTER, _DIGIT, _SIGN, _BLANK, _SPACE = 1, 2, 3, 4, 5
_KIND = np.array([_LETTER if b > 127 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SPACE if b == 32 else _BLANK if 9 <= b <= 13 else _SIGN for b in range(256)], dtype=np.uint8)
_PLAIN = r"\A[\t-\r -~À-ÖØ-öø-ÿ]*\z"
_PLAIN_PIECE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_CUT = re.compile(r"(?= \S)")
_encoders: dict[tuple[str, int], TextEncoder] = {}


def word_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the bytes of plain texts that follow each other; ``firsts`` are the places of the texts' first bytes."""
    kind = _KIND[data]
    before = np.zeros_like(kind)
    before[1:] = kind[:-1]
    before[firsts] = 0
    after = np.zeros_like(kind)
    after[:-1] = kind[1:]
    after[firsts[firsts > 0] - 1] = 0
    blank = kind >= _BLANK
    # the last of several blanks before a word stands apart: a space goes with the word
    start = np.where(blank, (before < _BLANK) | ((after > 0) & (after < _BLANK)), (kind != before) & (before != _SPACE))
    # 's 't 'm 'd 're 've 'll after anything but a sign or a space are words of their own
    at = np.flatnonzero((data == 39) & start & (after == _LETTER))
    if len(at):
        one, two = data[at + 1], np.where(after[at + 1] == _LETTER, data[np.minimum(at + 2, len(data) - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        own, size = at[short | long], np.where(short, 2, 3)[short | long]
        start[own + 1] = False
        ends = own + size
        inside = after[ends - 1] > 0
        start[ends[inside & (kind[np.minimum(ends, len(data) - 1)] == _LETTER)]] = True
    return np.flatnonzero(start)


class _Memo(dict):
    """What ``make`` gives for each key. When it is full, it becomes the older half, whose entries come back as they are asked for."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit
        self.older: dict = {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_LENGTH:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """Gives the ids of texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = _Memo(self._word, memo_words)
        form = json.loads(self.tokenizer.to_str())
        cut = form["pre_tokenizer"] or {}
        #: Whether the file cuts texts as this module does; else every text goes to the library whole.
        self.known = not form["normalizer"] and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_WRITTEN))]).tobytes()

    def _plain(self, texts: pa.LargeStringArray) -> list[bytes]:
        """Ids of plain texts."""
        data, where = bytes_of(texts)
        starts = word_starts(data, where[:-1][where[:-1] < where[1:]])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        packed = [self.words[w] for w in words.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        pool, own = np.frombuffer(b"".join(packed), dtype="<u4"), words.indices.to_numpy()
        counts = sizes[own]
        ends = np.concatenate(([0], np.cumsum(counts)))
        # where each id lies in the pool: runs of places that follow each other
        at = np.repeat(((np.cumsum(sizes) - sizes)[own] - ends[:-1]).astype(np.int32), counts)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = pool[at]
        cuts = ends[np.searchsorted(starts, where)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _mixed(self, text: str) -> bytes:
        """Ids of a text with characters of any kind."""
        if not self.known or any(a in text for a in self.added):
            return self._library([text])[0]
        pieces = _CUT.split(text)
        plain = [_PLAIN_PIECE.fullmatch(p) is not None for p in pieces]
        easy = iter(self._plain(pa.array([p for p, x in zip(pieces, plain, strict=True) if x], pa.large_string())))
        other = iter(self._library([p for p, x in zip(pieces, plain, strict=True) if not x]))
        return b"".join([next(easy if x else other) for x in plain])

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text in turn; equal to the library's own for the whole text. A null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        easy = pc.match_substring_regex(texts, _PLAIN) if self.known else pa.array([False] * len(texts))
        for a in self.added:
            easy = pc.and_not(easy, pc.match_substring(texts, a))
        for a, b in runs(pc.binary_length(texts).to_pylist(), SLICE_BYTES):
            part, plain = texts[a:b], easy[a:b]
            found = iter(self._plain(part.filter(plain)))
            for k, x in enumerate(plain.to_pylist()):
                yield next(found) if x else self._mixed(part[k].as_py())


def encoder(path: str, memo_words: int = MEMO_WORDS) -> TextEncoder:
    """This worker's encoder for ``path``; it outlives a task where Spark reuses its Python workers."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, memo_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(path, memo_words)
    return _encoders[key]


def encoded_texts(path: str, texts: pa.Array) -> Iterator[bytes]:
    """Packed ids of each text in turn; a null text counts as empty."""
    return encoder(path).encode(texts)
