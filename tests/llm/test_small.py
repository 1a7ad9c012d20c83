"""Parts that need no cluster: plans, encoders, kernels."""

import functools
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import decontaminate, ngram_join, packing, quality_model, token_store, tokens, words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(text):
    return library().encode(text, add_special_tokens=False).ids


TRICKY = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "\n \nb", "a\n b", "a \n", "a \n ", "a\t b", "x  ", "don't we're I'll", "it's  so", "Ünï cödé 你好 😀 b", "a\r\n b", "#1 <|endoftext|> b",
    "é é", "1,000.50 $x", " lead and trail ", "a   b", "\x1c a", "many      blanks\n\n\n  and lines",
]


def ids_of(own, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts, pa.string()))]


@pytest.mark.parametrize("memo", [1, 3, 1000])
def test_encoder_equals_the_library(memo, monkeypatch):
    own, texts = tokens.TextEncoder(PATH, memo), [*TRICKY, None, *reversed(TRICKY)]
    assert ids_of(own, texts) == [whole(t or "") for t in texts]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 20)
    assert ids_of(own, texts) == [whole(t or "") for t in texts]
    assert ids_of(own, []) == [] and ids_of(own, [""]) == [[]]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts, pa.large_string())[3:7])] == [whole(t) for t in texts[3:7]]


def test_encoder_equals_the_library_on_random_texts():
    rng = np.random.default_rng(8)
    own = tokens.TextEncoder(PATH, 50)
    plain = [*"abzZ09 .,'!\"-<|>#\n\t\r\x0b", "é", "Ñ", "ÿ", "'s", "'re", "'ll", "'lm", "'vé", " ", "  ", "\n\n", "'d'm"]
    other = [*"\x1c\x85\xa0", "×", "ª", "²", "你", "😀", "\u2028", "\u3000", "<|endoftext|>", "e\u0301", "\u200b", "\x7f"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 14)))) for signs in (plain, plain + other) for _ in range(3000)]
    for t, got in zip(texts, ids_of(own, texts), strict=True):
        assert got == whole(t), ascii(t)


def test_other_files_go_to_the_library_whole():
    own = tokens.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not own.known and ids_of(own, ["Two  words"]) == [own.tokenizer.encode("Two  words", add_special_tokens=False).ids]


def test_runs_cover_everything():
    assert list(words.runs([5, 5, 100, 1], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(words.runs([], 10)) == []


def test_best_two_fit_replaces_the_smallest():
    # greedy takes 7 + 2 and leaves 1; instead of the 2, the two pieces of 2 and 1 fill all
    plan = packing.best_two_fit({7: 1, 2: 2, 1: 1}, 10)
    assert sum(n for _, n in plan) == 2 and plan[0][0] == [(7, 1), (2, 1), (1, 1)]


def test_two_pieces_of_one_length_need_two():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 1}, 10)
    assert sorted(length for p, n in plan for length, k in p for _ in range(k * n)) == [2, 3, 6]


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 500)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.best_two_fit(counts, 64)
    used = {}
    for pattern, times in plan:
        assert sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    assert sum(t for _, t in plan) <= best_fit_decreasing(lengths.tolist(), 64)
    layout = packing.Layout(plan, 64)
    at = np.repeat(np.array(list(counts)), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    bins, offsets = layout.place(at, rank)
    for b in np.unique(bins):
        own = np.argsort(offsets[bins == b])
        ends = np.cumsum(at[bins == b][own])
        assert (offsets[bins == b][own] == np.concatenate(([0], ends[:-1]))).all() and ends[-1] <= 64


def test_plan_rejects_bad_lengths():
    for bad in ({0: 1}, {11: 1}, {1: -1}):
        with pytest.raises(ValueError):
            packing.best_two_fit(bad, 10)
    assert packing.best_two_fit({}, 10) == []


def test_pieces():
    cut = lambda n: [(p, s, len(i) // 4) for p, s, i in packing.pieces_of(b"\0\0\0\0" * n, 4)]
    assert cut(3) == [(0, 0, 3)] and cut(4) == [(0, 0, 4)] and cut(9) == [(0, 0, 1), (1, 1, 4), (2, 5, 4)]


def table(rows, wide=False, path=None):
    out = io.BytesIO()
    writer = token_store.TableWriter(out, wide)
    for k, ids in rows:
        writer.add(k, np.array(ids, "<u4").tobytes())
    writer.close()
    path.write_bytes(out.getvalue())
    return token_store.TableReader(str(path))


@pytest.mark.parametrize("wide", [False, True])
def test_table_round_trip_and_lookup(tmp_path, wide, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 300)
    rows = [(None, [1]), (-5, [2, 3]), (0, []), (7, [50000] * 9), (7, [4])] + [(k, list(range(k % 7))) for k in range(10, 400, 3)]
    with table(rows, wide, tmp_path / "t") as t:
        assert len(t.blocks) > 3 and t.docs == len(rows) and t.ids == sum(len(i) for _, i in rows)
        got = list(t.scan())
        assert [(k, i.tolist()) for k, _, i in got] == rows
        assert [b for _, b, _ in got] == np.cumsum([0] + [len(i) for _, i in rows])[:-1].tolist()
        assert [x.tolist() for x in t.get(7)] == [[50000] * 9, [4]] and t.get(None)[0].tolist() == [1] and t.get(11) == [] and t.get(10**12) == []
        for k in (10, 199, 397):
            assert [x.tolist() for x in t.get(k)] == [list(range(k % 7))]


def test_table_detects_damage(tmp_path):
    table([(1, [1, 2, 3])], path=tmp_path / "t").file.close()
    raw = bytearray((tmp_path / "t").read_bytes())
    raw[2] ^= 255
    (tmp_path / "t").write_bytes(raw)
    with token_store.TableReader(str(tmp_path / "t")) as t, pytest.raises(ValueError):
        list(t.scan())
    with pytest.raises(ValueError):
        w = token_store.TableWriter(io.BytesIO())
        w.add(2, b"")
        w.add(1, b"")


def random_pair(rng, n):
    a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    out = int(rng.integers(0, max(1, n // 8) + 1))
    new = int(rng.integers(0, max(1, n // 8) + 1))
    b = np.delete(a, rng.choice(len(a), min(out, len(a) - 1), replace=False))
    return a, np.unique(np.concatenate([b, rng.integers(0, 2**64, new, dtype=np.uint64)]))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (9, 10), (1, 2)])
def test_partenum_misses_no_link(num, den):
    rng = np.random.default_rng(num)
    bands = ngram_join.Bands(num, den)
    linked = 0
    for _ in range(600):
        a, b = random_pair(rng, int(rng.integers(1, 250)))
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both):
            linked += 1
            assert np.array_equal(a, b) or set(bands.signatures(a)) & set(bands.signatures(b))
            assert ngram_join.plausible(np.array([len(a), len(b)]), [ngram_join.sketch(a), ngram_join.sketch(b)], num, den)
    assert linked > 100


def test_bands_hold_every_pair_of_partner_sizes():
    bands = ngram_join.Bands(85, 100)
    for s in range(1, 600):
        for t in range(s, s * 100 // 85 + 1):
            assert set(bands.of(s)) & set(bands.of(t))


def test_forest_is_exact():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate([np.delete(b, rng.choice(len(b), int(rng.integers(0, 8)), replace=False)), rng.integers(0, 2**64, int(rng.integers(0, 4)), dtype=np.uint64)])) for b in base for _ in range(12)]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    mine = list(range(len(sets)))
    get = lambda x: x if mine[x] == x else get(mine[x])
    for a, b in ngram_join.forest(sets, 85, 100):
        mine[get(a)] = get(b)
    same = lambda f: {(i, j) for i in range(len(sets)) for j in range(i) if f(i) == f(j)}
    assert same(find) == same(get)
    assert ngram_join.forest([], 1, 2) == [] and ngram_join.forest(sets[:1], 1, 2) == []


def test_shingles():
    s = lambda t: ngram_join.shingles(t, 4)
    assert len(s(None)) == len(s("")) == len(s(" \n\t")) == 0
    assert len(s("one")) == len(s("a b c")) == len(s("a b c d")) == 1 and len(s("a b c d a b c d")) == 4
    assert np.array_equal(s("A B\x0bC\r\nD"), s("a b c d")) and not np.array_equal(s("Ä b c d"), s("ä b c d"))
    assert not np.array_equal(s("a b"), s("a b a b"))


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 6, int(rng.integers(1, 20))), rng.integers(0, 6, int(rng.integers(0, 40)))
        score, start, end = decontaminate.align(a, b)
        assert score == brute_alignment(a, b) and 0 <= start <= end <= len(b)


def test_isotonic():
    x, y = quality_model.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 0.6, 0.4, 1]), np.array([1.0, 1, 1, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_statistics_take_any_text():
    for t in (None, "", " \n", "a", "\ud800 x", "word " * 5000):
        s = quality_model.statistics(t)
        assert len(s) == len(quality_model.STATISTICS) and np.isfinite(s).all()


def test_top_word_is_counted_in_all_words():
    at = quality_model.STATISTICS.index("top_word")
    for n in (100, 1024, 8192):
        # every second word is the same, in step with any even stride
        words = [f"w{i}" if i % 2 else "same" for i in range(n)]
        assert quality_model.statistics(" ".join(words))[at] == 0.5
        assert quality_model.statistics(" ".join(words[1:]))[at] == (n / 2 - 1) / (n - 1)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, len(quality_model.STATISTICS)))
    z = quality_model._fourier(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = np.exp(-d / (2 * quality_model.WIDTH**2 * x.shape[1]))
    assert np.abs(z @ z.T - want).max() < 0.3 and np.abs(z @ z.T - want).mean() < 0.06


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1], "<u4")) == zlib.crc32(b"\1\0\0\0")
