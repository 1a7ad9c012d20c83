"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are word n-grams of the test items. How rare one is, is counted over all
documents. An item's seeds are the n-grams that few documents hold, or not many
more than hold the item's usual ones, and the rarest of each of its stretches:
so no item is without seeds, however often it has leaked, and copies with
edits keep some. Where a document holds a seed, the words around it are aligned with
the item; the alignment's score, as a share of the item's own, finds exact,
edited and paraphrased copies.

Test items are taken in blocks of bounded size, each block against all
documents. An alignment keeps two rows, so its memory is in proportion to the
passage, however long the item.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LETTERS_ONLY, gram_hashes, hashed

_U = np.uint64
#: Characters of test items that are held on the driver and sent to the executors at a time.
BLOCK_CHARS = 24_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: An n-gram in so many documents is rare; or in so many times as many as the item's n-grams are in by median.
RARE, RARE_FACTOR = 10, 3


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order: runs of anything but ASCII punctuation and white space, A-Z lower-cased."""
    return next(hashed(pa.array([text], pa.string()), LETTERS_ONLY))[0]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment with linear gap costs: score, first and past-the-last aligned position in ``words``.

    Each cell carries where its alignment began, so no table is kept for a way
    back: two rows of ``words``' length are all there is.
    """
    m = len(words)
    score, begin = np.zeros(m + 1, dtype=np.int32), np.arange(m + 1, dtype=np.int32)
    places = np.arange(m + 1, dtype=np.int32)
    slope = -GAP * places
    best = (0, 0, 0)
    for word in item:
        own = np.maximum(score + GAP, 0)
        own_begin = np.where(own > 0, begin, places)
        pair = score[:-1] + np.where(words == word, MATCH, MISMATCH).astype(np.int32)
        better = pair >= np.maximum(own[1:], 1)
        own[1:][better] = pair[better]
        own_begin[1:][better] = begin[:-1][better]
        # gaps along the row: the last place from which the running maximum comes
        level = own + slope
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, places, 0))
        score = top - slope
        begin = np.where(score > 0, own_begin[source], places)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(begin[at]), at)
    return best


class Lookup:
    """Membership of hashes in a small set: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.keys >> _U(42)).astype(np.int64)] = True

    def within(self, h: np.ndarray, upto: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ``n``-grams of texts whose words are ``h``, those that are members: text, place of the first word in ``h``, place among the keys."""
        at, place = self.find(gram_hashes(h, n))
        text = np.searchsorted(upto, at, side="right") - 1
        # no gram runs from a text into the next
        own = at + n <= upto[text + 1]
        return text[own], at[own], place[own]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of members, and their places among the sorted keys."""
        at = np.flatnonzero(self.bits[(h >> _U(42)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        own = self.keys[place] == h[at]
        return at[own], place[own]


def find_copies(docs: DataFrame, items: DataFrame, n: int = 3, min_score: float = 0.5, stretch: int = 6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item that it holds a copy of.

    Returns the document's id, tie (hash of its text), the item's id, score
    (best alignment as a share of the item's own, at least ``min_score``), and
    start_word and end_word of the aligned passage. Each document and item
    gives one row, for its best passage.

    Items of fewer than ``n`` words are seeded as a whole; items without words
    or with a null text match nothing, as do such documents. Null ids are
    returned as they are; repeated documents and items give a row each. Other
    columns aren't read. An empty table on either side gives no rows.
    """
    total = items.agg(F.sum(F.length(item_text_col)), F.count(F.lit(1))).first()
    blocks = max(1, -(-(total[0] or 0) // BLOCK_CHARS))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    out = None
    for b in range(blocks):
        own = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = _find_block(texts, Items([(r["item"], word_hashes(r["text"])) for r in own.toLocalIterator()], n), min_score, stretch, docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), "tie", F.col("item").alias(item_col if item_col != id_col else f"{item_col}_item"), "score", "start_word", "end_word")


class Items:
    """Test items as flat arrays: ``names``, the words of all one after another, and each item's first."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], n: int):
        rows = [(i, h) for i, h in rows if len(h)]
        self.names = [i for i, _ in rows]
        self.words = np.concatenate([h for _, h in rows]) if rows else np.zeros(0, dtype=_U)
        self.firsts = np.concatenate(([0], np.cumsum([len(h) for _, h in rows]))).astype(np.int64)
        self.sizes = [min(n, len(h)) for _, h in rows]

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.words[self.firsts[k] : self.firsts[k + 1]]


class Seeds(NamedTuple):
    """Seeds of one length: the lookup of their hashes, and for each hash a stretch of (item, place in the item)."""

    lookup: Lookup
    firsts: np.ndarray
    item: np.ndarray
    place: np.ndarray


def choose_seeds(items: Items, every: dict[int, np.ndarray], docs_with: dict[int, np.ndarray], stretch: int) -> dict[int, Seeds]:
    """Each item's rare n-grams and the rarest of each of its stretches; ``docs_with`` counts the documents that hold each of ``every``."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in every}
    for at in range(len(items)):
        own = gram_hashes(items[at], k := items.sizes[at])
        freq = docs_with[k][np.searchsorted(every[k], own)]
        present = np.flatnonzero(freq)
        if not len(present):
            continue
        limit = max(RARE, RARE_FACTOR * float(np.median(freq[present])))
        some = np.where(freq > 0, freq, np.iinfo(np.int64).max)
        rarest = [s + int(some[s : s + stretch].argmin()) for s in range(0, len(own), stretch) if freq[s : s + stretch].any()]
        chosen = np.union1d(present[freq[present] <= limit], np.array(rarest, dtype=np.int64))
        found[k].append((own[chosen], np.full(len(chosen), at), chosen))
    out = {}
    for k, parts in found.items():
        if parts:
            gram, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            keys, firsts = np.unique(gram[order], return_index=True)
            out[k] = Seeds(Lookup(keys), np.append(firsts, len(gram)), item[order].astype(np.int32), place[order].astype(np.int32))
    return out


def _find_block(texts: DataFrame, items: Items, min_score: float, stretch: int, id_kind: str, item_kind: str) -> DataFrame:
    every = {k: np.unique(np.concatenate([gram_hashes(items[at], k) for at in range(len(items)) if items.sizes[at] == k])) for k in sorted(set(items.sizes))}

    def count(batches):
        lookups = {k: Lookup(v) for k, v in every.items()}
        for batch in batches:
            seen = {k: np.zeros(len(v), dtype=np.int64) for k, v in every.items()}
            for h, upto in hashed(batch.column(0), LETTERS_ONLY):
                for k, lookup in lookups.items():
                    text, _, place = lookup.within(h, upto, k)
                    once = np.unique(text * len(every[k]) + place) % len(every[k])
                    seen[k] += np.bincount(once, minlength=len(every[k]))
            for k, c in seen.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(c[at])], names=["n", "at", "docs"])

    docs_with = {k: np.zeros(len(v), dtype=np.int64) for k, v in every.items()}
    if len(items):
        # a row for each n-gram of the block's items at most
        counted = texts.select("text").mapInArrow(count, "n int, at long, docs long").groupBy("n", "at").agg(F.sum("docs").alias("docs")).toArrow()
        size, at, held = (counted.column(c).to_numpy() for c in ("n", "at", "docs"))
        for k, c in docs_with.items():
            c[at[size == k]] = held[size == k]
    seeds = choose_seeds(items, every, docs_with, stretch)

    def best_passage(own: np.ndarray, h: np.ndarray, begins: list[int]) -> tuple[int, int, int]:
        """Best alignment near the places at which the item would begin; far apart ones are aligned apart."""
        slack = len(own) // 2 + 4
        best, low = (0, 0, 0), begins[0]
        for a, b in zip(begins, [*begins[1:], None], strict=True):
            if b is None or b - a > len(own) + 2 * slack or b - low > 8 * len(own) + 64:
                start = max(0, low - slack)
                window = h[start : a + len(own) + slack]
                # no more words can be aligned than the passage has
                if np.isin(own, window).sum() >= min_score * len(own):
                    score, x, y = align(own, window)
                    best = max(best, (score, start + x, start + y), key=lambda t: t[0])
                low = b
        return best

    def scan(batches):
        for batch in batches:
            rows, source, first = [], [], 0
            for h, upto in hashed(batch.column(2), LETTERS_ONLY):
                # text and item -> places at which the item would begin
                hits: dict[tuple[int, int], list[int]] = {}
                for k, s in seeds.items():
                    text, at, key = s.lookup.within(h, upto, k)
                    for t, p, a, b in zip(text.tolist(), (at - upto[text]).tolist(), s.firsts[key].tolist(), s.firsts[key + 1].tolist(), strict=True):
                        for item, q in zip(s.item[a:b].tolist(), s.place[a:b].tolist(), strict=True):
                            hits.setdefault((t, item), []).append(p - q)
                for (t, item), begins in hits.items():
                    own = items[item]
                    score, x, y = best_passage(own, h[upto[t] : upto[t + 1]], sorted(begins))
                    if score >= min_score * MATCH * len(own):
                        rows.append((item, score / (MATCH * len(own)), x, y))
                        source.append(first + t)
                first += len(upto) - 1
            if rows:
                picked = pa.array(source, pa.int64())
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["id", "tie", "at", "score", "start_word", "end_word"])

    spark = texts.sparkSession
    found = texts.mapInArrow(scan, f"id {id_kind}, tie long, at long, score double, start_word long, end_word long")
    names = spark.createDataFrame([(k, i) for k, i in enumerate(items.names)], f"at long, item {item_kind}")
    # a block has at most BLOCK_CHARS characters, so its identifiers are few enough to broadcast
    return found.join(F.broadcast(names), "at").drop("at")
