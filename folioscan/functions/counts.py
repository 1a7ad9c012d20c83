"""Terms counted and placed within their text's row, in Arrow batches.

What leaves a row is its distinct terms with their counts, so no count by
(document, term) has to be exchanged or held in a table of a task's size.
Stems are made of the distinct terms of a few texts at a time, through a
bounded memo, so a vocabulary never has to be joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .porter import stem_word

#: Rows that are counted at a time, and stems that a worker remembers (some 200 bytes each).
ROWS, REMEMBERED = 500, 300_000
_memo: dict[str, str] = {}


def _stems(words: list[str]) -> list[str]:
    if len(_memo) > REMEMBERED:
        _memo.clear()
    return [_memo[w] if w in _memo else _memo.setdefault(w, stem_word(w)) for w in words]


def _coded(lists: pa.ListArray, stemming: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row and code of each term of a few rows, and the terms by code."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    codes, names = found.indices.to_numpy(zero_copy_only=False), found.dictionary
    if stemming:
        stems = pa.array(_stems(names.to_pylist()), pa.string()).dictionary_encode()
        codes, names = stems.indices.to_numpy(zero_copy_only=False)[codes], stems.dictionary
    return np.repeat(np.arange(len(lists)), sizes), names, codes.astype(np.int64)


def count_lists(lists: pa.ListArray, stemming: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and tf of each distinct term of each list of terms, by row; a null list has none."""
    row, names, codes = _coded(lists, stemming)
    width = max(1, len(names))
    held, tf = np.unique(row * width + codes, return_counts=True)
    return held // width, names.take(pa.array(held % width)), tf


def count_kinds(*lists: pa.ListArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Terms of a few rows, a text's each once, and how often each is in the text's first list, in its second, and as a stem in its third."""
    coded = [_coded(x, i == 2) for i, x in enumerate(lists)]
    every = pa.concat_arrays([names for _, names, _ in coded]).dictionary_encode()
    width, at, keys = max(1, len(every.dictionary)), 0, []
    for row, names, codes in coded:
        keys.append(row * width + every.indices.to_numpy(zero_copy_only=False)[at : at + len(names)][codes])
        at += len(names)
    held, place = np.unique(np.concatenate(keys), return_inverse=True)
    cut = np.cumsum([0, *map(len, keys)])
    return every.dictionary.take(pa.array(held % width)), [np.bincount(place[cut[i] : cut[i + 1]], minlength=len(held)) for i in range(len(lists))]


def sum_lists(lists: pa.ListArray) -> pa.ListArray:
    """Running sums within each list of numbers."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    own = total[1:] - np.repeat(total[starts[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(own.astype(np.int32)))


def counted_rows(df: DataFrame, keys: list[str], terms_col: str, stemming: bool = False) -> DataFrame:
    """(keys, term, tf) of each row's distinct terms, stemmed if asked for, from an array of terms."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                *own, lists = batch.slice(a, ROWS).columns
                row, terms, tf = count_lists(lists, stemming)
                yield pa.RecordBatch.from_arrays([*(k.take(pa.array(row)) for k in own), terms, pa.array(tf.astype(np.int64))], names=[*keys, "term", "tf"])

    return df.select(*keys, terms_col).mapInArrow(run, ", ".join(filter(None, [schema, "term string, tf bigint"])))


def counted_kinds(df: DataFrame, a: str, b: str, d: str) -> DataFrame:
    """(term, a, b, d) of each row's distinct terms: how often in the array ``a``, in ``b``, and as a stem in ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                terms, tf = count_kinds(*batch.slice(at, ROWS).columns)
                yield pa.RecordBatch.from_arrays([terms, *(pa.array(n.astype(np.int64)) for n in tf)], names=["term", "a", "b", "d"])

    return df.select(a, b, d).mapInArrow(run, "term string, a bigint, b bigint, d bigint")


def running_sums(numbers: Column) -> Column:
    """Array of the running sums of an array of whole numbers."""

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        return sum_lists(lists)

    return run(numbers)


def distinct_stems(terms: Column) -> Column:
    """The number of distinct stems of an array of terms."""

    @F.arrow_udf("bigint")
    def run(lists: pa.Array) -> pa.Array:
        sizes = [np.bincount(count_lists(part, True)[0], minlength=len(part)) for a in range(0, len(lists), ROWS) if (part := lists.slice(a, ROWS))]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64))

    return run(terms)
