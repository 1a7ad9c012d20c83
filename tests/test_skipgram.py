"""Skip-gram with negative sampling in blocks, against a plain loop."""

import math
import random

import numpy as np
import pytest

from folioscan.operators import skipgram


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sea", "hill", "city")]
    return [[rng.choice(topic) for _ in range(rng.randint(4, 12))] for _ in range(500) for topic in [rng.choice(topics)]]


def plain_losses(corpus, epochs, size=16, window=3, negative=5, alpha=0.05, min_alpha=0.0001):
    """One pair after another, negatives drawn for each."""
    counts = {}
    for s in corpus:
        for w in s:
            counts[w] = counts.get(w, 0) + 1
    names = sorted(counts)
    at = {w: i for i, w in enumerate(names)}
    p = np.array([counts[w] for w in names]) ** 0.75
    p /= p.sum()
    rng = np.random.default_rng(0)
    words, contexts = (rng.random((len(names), size)) - 0.5) / size, np.zeros((len(names), size))
    losses = []
    for epoch in range(epochs):
        step, loss, n = alpha + (min_alpha - alpha) * epoch / max(1, epochs - 1), 0.0, 0
        for s in corpus:
            for i, w in enumerate(s):
                width = rng.integers(1, window + 1)
                for j in range(max(0, i - width), min(len(s), i + width + 1)):
                    if j == i:
                        continue
                    x, grown = words[at[w]], np.zeros(size)
                    for k, (c, label) in enumerate([(at[s[j]], 1), *((int(c), 0) for c in rng.choice(len(names), negative, p=p))]):
                        if k and c == at[s[j]]:
                            continue
                        good = 1 / (1 + math.exp(-float(x @ contexts[c])))
                        loss -= math.log(max(good if label else 1 - good, 1e-12))
                        grown += step * (label - good) * contexts[c]
                        contexts[c] += step * (label - good) * x
                    words[at[w]] = x + grown
                    n += 1
        losses.append(loss / n)
    return losses


def frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "tokens array<string>")


def near(vectors, word, n):
    own = vectors[word] / np.linalg.norm(vectors[word])
    order = sorted(vectors, key=lambda w: -float(vectors[w] @ own / np.linalg.norm(vectors[w])))
    return order[1 : n + 1]


@pytest.mark.parametrize("parts", [1, 3])
def test_learns_as_a_plain_loop_does(spark, corpus, parts, monkeypatch):
    monkeypatch.setattr(skipgram, "PART_WORDS", 1)
    settings = skipgram.Settings(size=16, window=3, min_count=1, epochs=5, sample=0, alpha=0.05)
    made = skipgram.train(frame(spark, corpus), parts=parts, settings=settings)
    plain = plain_losses(corpus, 5)
    assert made.losses[0] == pytest.approx(plain[0], rel=0.15) and made.losses[-1] == pytest.approx(plain[-1], rel=0.15) and made.losses[-1] < 0.8 * made.losses[0]
    vectors = {r.word: np.array(r.vector) for r in made.vectors.collect()}
    assert len(vectors) == 36 and all(v.shape == (16,) for v in vectors.values())
    for word in ("sea0", "hill5", "city11"):
        assert sum(w.rstrip("0123456789") == word.rstrip("0123456789") for w in near(vectors, word, 8)) >= 7


def test_pairs_and_chances(spark):
    words = skipgram.vocabulary(frame(spark, [["a", "b", "rare", "c"], ["a", "b"], ["c"], None]), "tokens", 2, 3)
    known = {r.word: r for r in words.collect()}
    assert set(known) == {"a", "b", "c"} and all(r.slot == sum(o.part == r.part and (-o.n, o.word) < (-r.n, r.word) for o in known.values()) for r in known.values())
    name = {(r.part, r.slot): w for w, r in known.items()}
    rows = skipgram.pairs(frame(spark, [["a", "b", "rare", "c"], ["a", "b"], ["c"], None]), words, 6, skipgram.Settings(window=2, sample=0), 3).collect()
    got = sorted((name[r.i, r.a], name[(r.i + r.stratum) % 3, r.b], round(r.chance, 3)) for r in rows)
    # the rare word is gone before distances are counted
    assert got == sorted([("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 0.5), ("c", "a", 0.5), ("b", "c", 1.0), ("c", "b", 1.0), ("a", "b", 1.0), ("b", "a", 1.0)])


def test_common_words_are_passed_over(spark):
    rows = frame(spark, [["the", "x"]] * 50 + [["y", "x"]])
    words = skipgram.vocabulary(rows, "tokens", 1, 1)
    chances = {round(r.chance, 6) for r in skipgram.pairs(rows, words, 102, skipgram.Settings(window=1, sample=0.01), 1).collect()}
    kept = lambda n: min(1.0, (math.sqrt(n / 102 / 0.01) + 1) * 0.01 / (n / 102))
    assert chances == {round(kept(50) * kept(51), 6), round(kept(1) * kept(51), 6)}


def test_alias_draws_in_proportion():
    weights = np.array([1.0, 5.0, 0.5, 3.5])
    drawn = np.bincount(skipgram.Alias(weights).draw(np.random.default_rng(1), 200_000), minlength=4) / 200_000
    assert np.allclose(drawn, weights / weights.sum(), atol=0.01)


def test_nothing_to_learn(spark):
    for rows in ([["one"]], [["a", "b"]], []):
        with pytest.raises(ValueError):
            skipgram.train(frame(spark, rows))
    for bad in ({"size": 0}, {"alpha": 0.1, "min_alpha": 0.2}):
        with pytest.raises(ValueError):
            skipgram.Settings(**bad)
