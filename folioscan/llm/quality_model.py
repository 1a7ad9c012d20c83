"""A quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel; ridge regression on
them is solved from normal equations that are summed by partition, so the fit
moves matrices of a fixed size. Isotonic regression on cross-fitted scores
turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled rows that the model is fitted on at most, but for chance: the part of the ids, by hash, that is expected to give so many.
MAX_LABELLED = 200_000
#: Partitions of labelled rows, and so matrices that come to the driver.
FIT_PARTITIONS = 8
FEATURES, WIDTH, RIDGE, SEED = 384, 1.5, 1e-4, 7
BINS = 2048

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOL, _STOP, _BANG, _COMMA = b"#*$%&|<>{}[]\\^~=+@_/", b".", b"!?", b",;:"
_HIGH = bytes(range(128, 256))
STATISTICS = (
    "log_words", "log_word_size", "word_size_sd", "upper", "lower", "digit", "symbol", "stop", "bang", "comma", "high", "pipe", "caps_words",
    "distinct_words", "log_distinct", "top_word", "short_words", "log_lines", "repeated_lines", "words_a_line", "distinct_pairs", "symbol_words",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; an empty or null one has zeros."""
    if not text or not (raw := text.encode("utf-8", "replace")) or not (words := raw.split()):
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(b"".join(words))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(map(raw.count, (b"# ", b"* ", b"$ ", b"% ", b"& ", b"! ", b"| ")))
    return [
        np.log1p(n), np.log1p(size / n), float(sizes.std()), share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), share(_STOP), share(_BANG), share(_COMMA), share(_HIGH), share(b"|"),
        sum(map(bytes.isupper, words)) / n, len(kinds) / n, np.log1p(len(kinds)), max(kinds.values()) / n, float((sizes <= 3).mean()), np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), (pairs + 1) / n, ends / n,
    ]


def _statistics_of(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Model:
    """What scoring needs; its size does not depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        raw = _fourier((stats - self.mean) / self.scale) @ self.weights
        # a sliver of the raw score keeps the order within a level of the calibration
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-8 * (raw - 0.5))), 0, 1)


def _fourier(x: np.ndarray) -> np.ndarray:
    """Features whose products approximate exp(-|x-y|^2 / (2 s^2)), with s^2 = WIDTH^2 times the dimensions; and a constant."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    w = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -6, 6) @ w + b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ascending ``x``; centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for at, m, w in zip(x, mean, weight, strict=True):
        blocks.append([at * w, m * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    rows = batch.column(name)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def fit(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on rows of ``labels`` with a ``fold`` of 0 or 1; other folds and null labels aren't used.

    ``fold`` is a column expression over the label table's id, and tells apart
    the two halves for cross-fitting. Only labelled texts are read by Python:
    the labels, of which there are about ``MAX_LABELLED`` at most, are broadcast.
    """
    chosen = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("y"), fold.alias("fold")).where(F.col("y").isNotNull() & F.col("fold").isin(0, 1))
    share = min(1.0, MAX_LABELLED / max(1, chosen.count()))
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < int(1_000_000 * share))

    def measured(batches):
        for batch in batches:
            stats = _statistics_of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats.tolist(), pa.list_(pa.float64()))], names=["y", "fold", "stats"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("y", "fold", "text")
    rows = materialise(texts.mapInArrow(measured, "y double, fold int, stats array<double>").repartition(FIT_PARTITIONS), "labelled")
    n_stats = len(STATISTICS)
    moments = rows.select(*[f(F.get("stats", F.lit(i)).cast("double")).alias(f"{n}{i}") for i in range(n_stats) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        return Model(*[np.zeros(0)] * 5)
    mean = np.array([moments[f"m{i}"] for i in range(n_stats)])
    scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(n_stats)])
    size = FEATURES + 1

    def sums(batches):
        total = {k: np.zeros((size, size + 1)) for k in (0, 1)}
        seen = {0: 0, 1: 0}
        for batch in batches:
            z, y, part = _fourier((_arrays(batch, "stats") - mean) / scale), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = z[part == k]
                total[k] += own.T @ np.column_stack([own, y[part == k]])
                seen[k] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([seen[0], seen[1]], pa.int64()), pa.array([total[0].tobytes(), total[1].tobytes()])], names=["fold", "n", "sums"])

    half = {k: np.zeros((size, size + 1)) for k in (0, 1)}
    n = {0: 0, 1: 0}
    for k, count, data in rows.mapInArrow(sums, "fold int, n long, sums binary").toLocalIterator():
        half[k] += np.frombuffer(data).reshape(size, size + 1)
        n[k] += count

    def solve(a: np.ndarray, count: int) -> np.ndarray:
        penalty = np.eye(size) * RIDGE * max(count, 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    whole = solve(half[0] + half[1], n[0] + n[1])
    other = {k: solve(half[1 - k], n[1 - k]) if n[1 - k] else whole for k in (0, 1)}

    def scored(batches):
        for batch in batches:
            z, part = _fourier((_arrays(batch, "stats") - mean) / scale), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.where(part == 0, z @ other[0], z @ other[1])
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    bins = sorted(tuple(r) for r in rows.mapInArrow(scored, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count(F.lit(1))).toLocalIterator())
    knots, levels = isotonic(*(np.array([b[i] for b in bins], dtype=float) for i in (1, 2, 3)))
    return Model(mean, scale, whole, knots, levels)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of ``docs``, each whole text read once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_statistics_of(batch.column(1))))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, without moving any."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(_statistics_of(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def id_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


def learned_fold(doc_id: Column) -> Column:
    """0 or 1 for the ids that may be learned from; null for those held out, whose ``id_fold`` is 1."""
    return F.when(id_fold(doc_id) == 0, 0).when(id_fold(doc_id) == 2, 1)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Fits on the labelled documents that aren't held out and scores every document: id, held_out, score, predicted.

    Held out are the ids whose ``id_fold`` is 1. A null or empty text has
    statistics of zero and a score like any other; a null id is scored and
    never learned from; repeated rows are scored alike. Without any label to
    learn from every score is 0.5. Only the id, text and label columns are
    read. An empty table gives no rows.
    """
    if id_col in ("held_out", "score", "predicted"):
        raise ValueError(f"the result has a column {id_col} of its own")
    model = fit(docs, labels, learned_fold(F.col(id_col)), id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(F.col("id").alias(id_col), (id_fold(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
