"""Skip-gram word vectors with negative sampling, trained in blocks that don't meet.

Words are dealt to parts by a hash, and a part's vectors are one block of rows.
A pair of words belongs to a cell (part of the centre, part of the context).
Cells of one stratum, those with the same difference of parts, share no
vectors, so they are trained side by side, each by a task that holds the two
blocks it needs and streams its pairs; a round over all strata is an epoch.
Between strata the blocks are written, so nothing of the vocabulary's or the
corpus's size is ever on the driver or in one task.

Negative words come from the context's own part: over an epoch a centre meets
all parts as often as their words stand beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise

#: Pairs that are trained at once on the vectors as they stand, and the negative words that they share.
BATCH, SHARED = 256, 64
#: Words below which a part isn't worth a task.
PART_WORDS = 500
#: Words up to which the vocabulary goes to all tasks that look words up (some 60 bytes each); beyond, a shuffle join.
BROADCAST_WORDS = 500_000


@dataclass(frozen=True)
class Settings:
    size: int = 100
    window: int = 5
    min_count: int = 2
    epochs: int = 30
    seed: int = 42
    negative: int = 5
    sample: float = 0.001
    exponent: float = 0.75
    alpha: float = 0.025
    min_alpha: float = 0.0001

    def __post_init__(self):
        if min(self.size, self.window, self.min_count, self.epochs, self.negative) < 1 or self.sample < 0 or self.seed < 0 or not 0 < self.min_alpha <= self.alpha:
            raise ValueError("sizes and counts must be positive, and the last step no longer than the first")


class Alias:
    """Draws numbers in proportion to weights, each in constant time."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        scaled = weights * n / weights.sum()
        self.keep, self.other = np.ones(n), np.arange(n)
        small, large = list(np.flatnonzero(scaled < 1)), list(np.flatnonzero(scaled >= 1))
        while small and large:
            a, b = small.pop(), large[-1]
            self.keep[a], self.other[a] = scaled[a], b
            scaled[b] -= 1 - scaled[a]
            if scaled[b] < 1:
                small.append(large.pop())

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        at = rng.integers(0, len(self.keep), n)
        return np.where(rng.random(n) < self.keep[at], at, self.other[at])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_pairs(words: np.ndarray, contexts: np.ndarray, a: np.ndarray, b: np.ndarray, noise: Alias, rng: np.random.Generator, alpha: float, negative: int) -> float:
    """Trains on pairs of rows in place; returns the sum of the losses before each step."""
    loss = 0.0
    # with few words a batch would change each of them too often before it is looked at again
    batch = min(BATCH, 4 * len(contexts))
    for at in range(0, len(a), batch):
        x, y = a[at : at + batch], b[at : at + batch]
        drawn = noise.draw(rng, SHARED)
        w, c, n = words[x], contexts[y], contexts[drawn]
        good = _sigmoid(np.einsum("ij,ij->i", w, c))
        # a drawn word that is the context itself is no negative one
        bad = _sigmoid(w @ n.T) * (drawn[None, :] != y[:, None])
        share = negative / SHARED
        loss -= float(np.log(np.maximum(good, 1e-12)).sum() + share * np.log(np.maximum(1 - bad, 1e-12)).sum())
        up, down = (alpha * (1 - good))[:, None], -alpha * share * bad
        np.add.at(words, x, up * c + down @ n)
        np.add.at(contexts, y, up * w)
        np.add.at(contexts, drawn, down.T @ w)
    return loss


def vocabulary(sentences: DataFrame, tokens_col: str, min_count: int, parts: int) -> DataFrame:
    """(word, n, part, slot) of the words that are frequent enough; slots number a part's words from 0, common ones first."""
    counted = sentences.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    return dealt.withColumn("slot", F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "word")) - 1)


def pairs(sentences: DataFrame, words: DataFrame, total: int, settings: Settings, parts: int, tokens_col: str = "tokens") -> DataFrame:
    """(stratum, i, a, b, chance): each pair of words of a sentence within the window, rare words left out before.

    ``chance`` is how often an epoch takes the pair: windows are drawn from 1 to
    the full width, and very common words are passed over in part.
    """
    f = F.col("n") / F.lit(float(total))
    kept = F.least(F.lit(1.0), (F.sqrt(f / settings.sample) + 1) * settings.sample / f) if settings.sample else F.lit(1.0)
    known = words.select("word", "part", "slot", kept.alias("kept"))
    few = F.broadcast(known) if words.count() <= BROADCAST_WORDS else known
    numbered = sentences.select(F.col(tokens_col).alias("__tokens")).withColumn("sid", F.monotonically_increasing_id())
    rows = numbered.select("sid", F.posexplode("__tokens").alias("pos", "word"))
    told = rows.join(few, "word").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "slot", "kept"))).alias("s"))
    around = lambda x, i: F.transform(F.slice("s", F.greatest(i - settings.window, F.lit(0)) + 1, F.least(i, F.lit(settings.window)) + settings.window + 1), lambda y, k: F.struct(x.alias("x"), y.alias("y"), F.abs(i - F.greatest(i - settings.window, F.lit(0)) - k).alias("d")))
    both = told.select(F.explode(F.flatten(F.transform("s", around))).alias("p")).where("p.d > 0")
    chance = (settings.window - F.col("p.d") + 1) / F.lit(float(settings.window)) * F.col("p.x.kept") * F.col("p.y.kept")
    return both.select(F.pmod(F.col("p.y.part") - F.col("p.x.part"), F.lit(parts)).alias("stratum"), F.col("p.x.part").alias("i"), F.col("p.x.slot").alias("a"), F.col("p.y.slot").alias("b"), chance.cast("float").alias("chance"))


_STATE = "side string, part int, data binary, loss double, trained long"


def _first_blocks(words: DataFrame, settings: Settings) -> DataFrame:
    """Blocks as training begins: small random word vectors, contexts of zero, and the counts by which noise is drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[int]] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(part, []).append(n)
        for part, n in counts.items():
            shape = (len(n), settings.size)
            own = ((np.random.default_rng([settings.seed, part]).random(shape) - 0.5) / settings.size).astype(np.float32)
            data = [own.tobytes(), np.zeros(shape, np.float32).tobytes(), np.array(n, np.float64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(["word", "context", "count"]), pa.array([part] * 3, pa.int32()), pa.array(data, pa.binary()), pa.array([0.0] * 3), pa.array([0] * 3, pa.int64())], names=["side", "part", "data", "loss", "trained"])

    return words.repartition("part").sortWithinPartitions("part", "slot").select("part", "n").mapInArrow(run, _STATE)


def _stratum(state: DataFrame, stored: DataFrame, shift: int, parts: int, epoch: int, alpha: float, settings: Settings) -> DataFrame:
    """The blocks after one stratum: task i trains words of part i with contexts of part i + shift."""
    key = F.when(F.col("side") == "word", F.col("part")).otherwise(F.pmod(F.col("part") - shift, F.lit(parts)))
    heads = state.withColumns({"i": key.cast("int"), "kind": F.lit(0)})
    own = stored.where(F.col("stratum") == shift).drop("stratum").withColumn("kind", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, bytes, float, int]] = {}
        block: dict = {}

        def opened(i: int) -> None:
            matrix = lambda side: np.frombuffer(held[side][1], np.float32).reshape(-1, settings.size).copy()
            block.update(i=i, words=matrix("word"), contexts=matrix("context"), noise=Alias(np.frombuffer(held["count"][1]) ** settings.exponent), rng=np.random.default_rng([settings.seed, epoch, shift, i]), loss=0.0, n=0)

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                sides = sorted(held)
                data = [block[{"word": "words", "context": "contexts"}[s]].tobytes() if block and s != "count" else held[s][1] for s in sides]
                yield pa.RecordBatch.from_arrays([pa.array(sides), pa.array([held[s][0] for s in sides], pa.int32()), pa.array(data, pa.binary()), pa.array([held[s][2] + (block.get("loss", 0.0) if s == "word" else 0.0) for s in sides]), pa.array([held[s][3] + (block.get("n", 0) if s == "word" else 0) for s in sides], pa.int64())], names=["side", "part", "data", "loss", "trained"])
            held.clear()
            block.clear()

        current = None
        for batch in batches:
            key, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(key)] if len(key) else []
            for at, end in zip(cuts, cuts[1:], strict=False):
                if key[at] != current:
                    yield from closed()
                    current = key[at]
                if kind[at] == 0:
                    for k in range(at, end):
                        held[batch.column(2)[k].as_py()] = tuple(batch.column(c)[k].as_py() for c in (3, 4, 8, 9))
                    continue
                if not block:
                    opened(int(current))
                a, b, chance = (batch.column(c).slice(at, end - at).to_numpy(zero_copy_only=False) for c in (5, 6, 7))
                take = np.flatnonzero(block["rng"].random(len(a)) < chance)
                block["rng"].shuffle(take)
                block["loss"] += train_pairs(block["words"], block["contexts"], a[take], b[take], block["noise"], block["rng"], alpha, settings.negative)
                block["n"] += len(take)
        yield from closed()

    both = heads.unionByName(own, allowMissingColumns=True).repartition(parts, "i").sortWithinPartitions("i", "kind")
    return both.select("i", "kind", "side", "part", "data", "a", "b", "chance", "loss", "trained").mapInArrow(run, _STATE)


@dataclass
class Trained:
    """Word vectors (word, vector), and the mean loss of each epoch."""

    vectors: DataFrame
    losses: list[float]


def train(sentences: DataFrame, tokens_col: str = "tokens", parts: int = 4, settings: Settings | None = None) -> Trained:
    """Trains on rows of tokens, one sentence each; no context crosses a row.

    ``parts`` is how many tasks train at a time, less where the words are few.
    Fails if no two words of a sentence are frequent enough. A null array is an
    empty sentence. The result depends on the seed and on how Spark deals the
    pairs to files, not on timing: a lost task is trained again from its blocks.
    """
    settings = settings or Settings()
    known = sentences.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.min_count).count()
    parts = max(1, min(parts, known // PART_WORDS))
    words = materialise(vocabulary(sentences, tokens_col, settings.min_count, parts), "vocabulary")
    total = words.agg(F.sum("n")).first()[0] or 0
    made = pairs(sentences, words, total, settings, parts, tokens_col) if total else None
    stored = materialise(made.repartition("stratum", "i").sortWithinPartitions("stratum", "i", F.xxhash64("a", "b", F.rand(settings.seed))), "pairs") if made is not None else None
    if stored is None or stored.isEmpty():
        raise ValueError("no two words of a sentence are frequent enough to train on")
    state = materialise(_first_blocks(words, settings), "blocks")
    losses, before = [], (0.0, 0)
    for epoch in range(settings.epochs):
        alpha = settings.alpha + (settings.min_alpha - settings.alpha) * epoch / max(1, settings.epochs - 1)
        for k in range(parts):
            fresh = materialise(_stratum(state, stored, (epoch + k) % parts, parts, epoch, alpha, settings), "blocks")
            discard(state)
            state = fresh
        now = tuple(state.agg(F.sum("loss"), F.sum("trained")).first())
        losses.append((now[0] - before[0]) / max(1, now[1] - before[1]))
        before = now
    discard(stored)
    return Trained(_named(state, words, settings), losses)


def _named(state: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """(word, vector) from the blocks of word vectors."""
    heads = state.where("side = 'word'").select("part", F.lit(-1).alias("slot"), F.lit(None).cast("string").alias("word"), "data")
    both = heads.unionByName(words.select("part", "slot", "word", F.lit(None).cast("binary").alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = None
        for batch in batches:
            named, rows = [], []
            for slot, word, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if slot < 0:
                    matrix = np.frombuffer(data.as_py(), np.float32).reshape(-1, settings.size)
                else:
                    named.append(word)
                    rows.append(matrix[slot].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array(rows, pa.list_(pa.float64()))], names=["word", "vector"])

    return both.repartition("part").sortWithinPartitions("part", "slot").mapInArrow(run, "word string, vector array<double>")
