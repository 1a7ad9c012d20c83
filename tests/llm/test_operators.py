"""Operators on small tables: nulls, empty texts, ties, repeated rows, empty tables, other columns."""

import collections
import datetime
import hashlib
import hmac
import pathlib
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import chat, common, components, decontaminate, line_dedup, ngram_join, packing, pii, quality_model, quality_rules, sharding, token_store
from folioscan.llm.queries import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `count` int"


def docs(spark, rows):
    """Rows of (doc_id, text[, source])."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 0) for r in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, " \n\n "), (3, "other text"), (5, "word " * 3000)]


def test_packing_edges(spark):
    rows = packing.pack(docs(spark, EDGES), PATH, capacity=64).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == {1: 1, 2: 1, 3: 3, None: 1, 4: 1, 5: 1}
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert all(r.length == 64 for r in rows if r.doc_id == 5 and r.piece > 0)
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_token_store_edges(spark, tmp_path):
    manifest = token_store.write_store(docs(spark, EDGES), str(tmp_path / "s"), PATH)
    rows = token_store.read_store(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r[0] for r in EDGES], key=lambda x: -1 if x is None else x)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert token_store.read_store(token_store.write_store(docs(spark, []), str(tmp_path / "e"), PATH)).count() == 0


def test_token_store_of_text_keys(spark, tmp_path):
    rows = [("b", "x y"), ("a", "x"), (None, "n"), ("a", "z"), ("é", None)]
    d = spark.createDataFrame(rows, "name string, body string")
    manifest = token_store.write_store(d, str(tmp_path / "s"), PATH, id_col="name", text_col="body")
    assert manifest.first().path.startswith("file:")
    assert [r.name for r in token_store.read_store(manifest, "name", "string").orderBy("start").collect()] == [None, "a", "a", "b", "é"]
    with token_store.TableReader(manifest.first().path) as t:
        assert len(t.get("a")) + sum(len(token_store.TableReader(r.path).get("a")) for r in manifest.collect()[1:]) == 2
    assert token_store.round_trip(d, PATH, id_col="name", text_col="body").columns == ["name", "start", "n_tokens", "ids_crc32"]
    with pytest.raises(ValueError):
        token_store.round_trip(d.withColumnRenamed("name", "start"), PATH, id_col="start", text_col="body")


def test_line_dedup(spark):
    rows = [(i, f"Shared line\nown {i} line\n\n", f"site{i % 6}") for i in range(12)] + [(20, "shared LINE ", None), (21, None, "site1"), (22, "", "site2"), (None, "Shared line\nx", "site3"), (23, "pair\npair", "site1"), (24, "pair", "site2")]
    d = docs(spark, rows)
    out = {r.doc_id: r for r in line_dedup.remove_spread_lines(d, min_sites=6).collect()}
    assert len(out) == len(rows) and out[0].text == "Shared line\nown 0 line\n\n" and out[0].n_removed == 0
    assert out[3].text == "own 3 line\n\n" and (out[3].n_lines, out[3].n_removed) == (2, 1)
    assert out[20].text == "" and out[21].text is None and out[22].text == "" and out[None].text == "x" and out[23].text == "pair\npair"
    assert line_dedup.remove_spread_lines(d, min_sites=7).where("n_removed > 0").count() == 0
    assert line_dedup.remove_spread_lines(docs(spark, []), min_sites=2).count() == 0
    again = line_dedup.remove_spread_lines(docs(spark, [*rows, rows[3]]), min_sites=6)
    assert again.where("doc_id = 3").count() == 2 and again.columns[:6] == d.columns
    with pytest.raises(ValueError):
        line_dedup.remove_spread_lines(d.withColumn("n_lines", F.lit(1)), 2)


def test_long_blank_lines(spark):
    # many blanks inside a line and at its ends, which a pattern with a backtracking end takes quadratic time for
    text = " " * 1_000_000 + "Line" + " " * 1_000_000 + "end\n" + "\t" * 500_000
    d = docs(spark, [(i, text, f"s{i}") for i in range(3)])
    assert [(r.n_lines, r.n_removed) for r in line_dedup.remove_spread_lines(d, min_sites=3).orderBy("doc_id").collect()] == [(1, 0), (1, 1), (1, 1)]
    began = time.time()
    assert d.select(F.sum(F.length(line_dedup.normalised(F.col("text")))).alias("n")).first().n > 3_000_000
    assert time.time() - began < 5
    assert [r.n_words for r in quality_rules.judge(d).collect()] == [2] * 3


def brute_repeats(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_quality_counts(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abc"), 60)) for _ in range(20)] + ["a b c d e f g h " * 3, "a b c d e f g h", "a " * 9, "x", "", None, "l one\nl one\n\n|$ *\n", "é b"]
    rows = {r.doc_id: r for r in quality_rules.judge(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        assert rows[i].n_repeat_words == brute_repeats(t) and rows[i].n_words == len(words) and rows[i].word_chars == sum(map(len, words))
        assert rows[i].base_failed == (len(words) < 20 or 100 * brute_repeats(t) > 30 * len(words))
    assert (rows[26].n_dup_lines, rows[26].n_symbols) == (1, 3)


def test_quality_verdict(spark):
    own = " ".join(f"w{i}" for i in range(40))
    many = [(i, "Template " * 3 + "line one\n" + " ".join(f"{i}w{k}" for k in range(4)), "h") for i in range(30)]
    rows = [(*m[:1], m[1] + "\n" + " ".join(f"u{m[0]}x{k}" for k in range(3)) + "\nTemplate text that stands on every page of this host and is long enough to count as most of it", "h") for m in many] + [(100, own, "h"), (101, own, "h"), (102, own, None)]
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert not out[5].base_failed and not out[5].kept and out[5].lost_words > 20 and out[100].kept and out[101].kept and out[102].kept
    assert quality_rules.judge(docs(spark, [])).count() == 0
    assert quality_rules.judge(docs(spark, [rows[5], *rows])).where("doc_id = 5 and not kept and lost_words = %d" % out[5].lost_words).count() == 2


def test_classifier(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "house", "tree"], 40)) + "." for _ in range(90)]
    bad = ["!!! $$$ " + " ".join(rng.choice(["WIN", "CASH", "###", "&&&"], 40)) for _ in range(90)]
    rows = list(enumerate(good + bad)) + [(900, None), (901, ""), (None, "null id"), (0, good[0])]
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(180)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    out = quality_model.classify(docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and {r.doc_id for r in out if r.doc_id in (900, 901, None)} == {900, 901, None}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 180]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id < 90) for r in held]) > 0.95
    nothing = quality_model.classify(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def brute_classes(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("tiny_tasks", [False, True])
def test_jaccard_classes(spark, monkeypatch, tiny_tasks):
    if tiny_tasks:
        monkeypatch.setattr(ngram_join, "TASK_ELEMENTS", 300)
        monkeypatch.setattr(ngram_join, "TASK_NODES", 4)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(5, 90)))]
        for _ in range(9):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE two"), (504, "one two three"), (505, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, rows), n=4, num=85, den=100).collect()}
    want = brute_classes(rows, 4, 85, 100)
    want |= {500: (0, 500), 501: (0, 501)}
    assert got == want


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "other words here now too")]
    out = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in out) == [(0, 7), (7, 7), (7, 7), (9, 9)]
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 150), (150, 300)]
    rows = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_a_large_star(spark):
    n = 200_000
    leaves = spark.range(1, n + 1).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    ring = spark.range(n + 1, n + 21).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components.components(leaves.unionByName(ring))
    assert rows.groupBy("root").count().collect() and {(r.root, r["count"]) for r in rows.groupBy("root").count().collect()} == {(0, n + 1), (n + 1, 21)}


def test_frequent_keys_join_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 else "k", i % 7) for i in range(300)], "id int, host string, line int")
    keys = spark.createDataFrame([(None, 2, "a"), ("k", 3, "b")], "host string, line int, more string")
    want = sorted(map(str, common.join_frequent(rows, keys, ["host", "line"], F.xxhash64("id")).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, common.join_frequent(rows, keys, ["host", "line"], F.xxhash64("id")).collect())) == want and len(want) > 30


def test_shared_folder(spark):
    kept = common.materialise(spark.range(5), "x")
    files = kept.inputFiles()
    assert files and kept.count() == 5
    common.discard(kept)
    common.discard(kept)
    assert not any(pathlib.Path(f.removeprefix("file://")).exists() for f in files)


def test_chat(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye 😀"), (2, 1, None, "alone"), (3, 1, "system", "nobody"), (None, 1, "eve", "x"), (1, None, "ann", "first")]
    t = spark.createDataFrame([(*x, "y") for x in turns], "conv_id bigint, turn bigint, role string, text string, perspective string")
    segments = chat.rotate(t)
    rows = segments.collect()
    assert {(r.conv_id, r.perspective) for r in rows} == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "eve")}
    ann = sorted((r for r in rows if (r.conv_id, r.perspective) == (1, "ann")), key=lambda r: r.position)
    assert [r.turn for r in ann] == [None, 0, 1, 2, 3] and [r.masked for r in ann] == [True, False, True, False, True]
    whole = chat.assemble(segments).where("conv_id = 1 AND perspective = 'ann'").first()
    assert whole.text == "".join(r.segment for r in ann) and whole.text.count(chat.END) == 5
    assert [whole.text[s.start : s.end] for s in whole.mask_spans] == ["first<|im_end|>", "Hi <|im_end |><|im_end|>", "Bye 😀<|im_end|>"]
    assert all(whole.text[r.start : r.end] == r.segment for r in ann) and "<|im_start|>user name=bob\n" in whole.text
    assert chat.rotate(t.limit(0)).count() == 0


def test_chat_names_stay_apart(spark):
    names = ["a b", "a_b", "a<b", "a%b", "a%20b", "a", None]
    t = spark.createDataFrame([(1, i, n, "x") for i, n in enumerate(names)], "conv_id bigint, turn bigint, role string, text string")
    heads = {r.segment.split("\n")[0] for r in chat.rotate(t).where("perspective = 'a' and not masked").collect()}
    assert len(heads) == len(names) - 1 and all(re.fullmatch(r"<\|im_start\|>user name=[^\s<>|]+", h) for h in heads)


def test_chat_in_many_blocks(spark, monkeypatch):
    t = spark.createDataFrame([(1, i, "ab"[i % 2], "w" * (i % 5)) for i in range(60)], "conv_id bigint, turn bigint, role string, text string")
    want = sorted(map(tuple, chat.rotate(t).collect()))
    monkeypatch.setattr(chat, "TURN_BLOCK", 7)
    assert sorted(map(tuple, chat.rotate(t).collect())) == want


def plain_hilbert(cells, bits):
    """Index by building the curve: the inverse of Skilling's decoding."""
    n = len(cells)
    x = list(cells)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out * 2 + (x[i] >> b & 1)
    return out


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (1, 3)])
def test_hilbert_curve(spark, dims, bits):
    parts = F.array(*[F.shiftright(F.col("id"), bits * i).bitwiseAND((1 << bits) - 1).cast("int") for i in range(dims)])
    rows = spark.range(1 << (dims * bits)).select(parts.alias("c"), sharding.hilbert_index(parts, dims, bits).alias("h")).collect()
    assert all(r.h == plain_hilbert(r.c, bits) for r in rows)
    path = [r.c for r in sorted(rows, key=lambda r: r.h)]
    assert sorted(r.h for r in rows) == list(range(len(rows)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 100])
def test_shards_are_even_and_gapless(spark, n):
    rows = [(i if i % 9 else None, f"{i}", "hot" if i % 3 else f"s{i}") for i in range(n)] + ([(5, "5", "hot")] * 3 if n > 8 else [])
    d = docs(spark, rows).select("doc_id", "source", F.length("text").alias("size"))
    out = sharding.shard_by_curve(d, [F.col("source"), F.col("size")], 8, bits=3).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert len(out) == len(rows) and all(0 <= r.shard < 8 for r in out)
    assert not rows or max(sizes.values()) - min(sizes.get(k, 0) for k in range(8)) <= 1
    for k in sizes:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sizes[k]))


def test_shard_files_cover_few_values(spark, tmp_path):
    d = docs(spark, [(i, "x" * (i % 50), f"s{i % 8}") for i in range(800)]).select("doc_id", "source", F.length("text").alias("size"))
    out = sharding.shard_by_curve(d, [F.col("source"), F.col("size")], 8, bits=3)
    sharding.write_shards(out, str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 800 and back.groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.avg("n")).first()[0] <= 5
    with pytest.raises(ValueError):
        sharding.shard_by_curve(out, [F.col("size")], 8)


def test_string_cuts(spark):
    rng = np.random.default_rng(4)
    values = [f"https://www.site{k}.example" for k in np.minimum(rng.geometric(0.05, 900), 60)] + [""] * 50 + ["é"] * 50
    got = sharding.string_cuts(spark.createDataFrame([(v,) for v in values], "v string").repartition(5), F.col("v"), 8)
    ordered = sorted(values, key=lambda v: v.encode())
    assert got == sorted({ordered[-(-k * len(values) // 8) - 1] for k in range(1, 8)}, key=lambda v: v.encode())
    assert sharding.string_cuts(spark.createDataFrame([], "v string"), F.col("v"), 8) == []


def test_query_orders_by_long_sources(spark, tmp_path):
    docs(spark, [(i, "x" * (1 + i % 50), f"https://www.site{i % 8}.example") for i in range(800)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries()["op8_hilbert_shards"](spark, str(tmp_path))
    assert out.count() == 800 and out.groupBy("shard").agg(F.countDistinct("source").alias("n")).agg(F.avg("n")).first()[0] <= 5


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [draw(n) for n in (30, 45, 60)] + [["two", "words"]]
    edited = [w if i % 6 else "edit" for i, w in enumerate(items[1])]
    cut = items[2][:20] + items[2][25:]
    rows = [(1, " ".join(draw(100) + items[0] + draw(50))), (2, " ".join(draw(40) + edited)), (3, " ".join(cut).upper().replace(" ", ", ")), (4, " ".join(draw(300))), (5, None), (6, ""), (7, "some two words end"), (8, " ".join(items[0][:6] + draw(80)))] + [(i, " ".join(draw(5) + items[0])) for i in range(100, 160)]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (10, "", 1), (11, "...", 1)], "item_id int, text string, score int")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.find_copies(docs(spark, rows), bench).collect()}
    assert set(out) == {(1, 0), (2, 1), (3, 2), (7, 3)} | {(i, 0) for i in range(100, 160)}
    assert (out[1, 0].score, out[1, 0].start_word, out[1, 0].end_word) == (1.0, 100, 130)
    assert decontaminate.find_copies(docs(spark, []), bench).count() == 0 and decontaminate.find_copies(docs(spark, rows), bench.limit(0)).count() == 0


def test_long_items_are_aligned_in_little_memory(spark):
    rng = np.random.default_rng(9)
    item = rng.integers(0, 2**63, 6_000).astype(np.uint64)
    passage = np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64), item[:3_000], item[3_020:], rng.integers(0, 2**63, 8_000).astype(np.uint64)])
    tracemalloc.start()
    assert decontaminate.align(item, passage) == (2 * 5_980 - 20, 500, 6_480)
    # a whole table would take 350 MB
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def test_decontamination_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(12)], "item_id int, text string")
    d = docs(spark, [(i, f"start {r.text} end") for i, r in enumerate(items.collect())])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_copies(d, items).collect()) == [(i, i) for i in range(12)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_pseudonyms_keep_formats(spark):
    texts = [
        "card 4539578763621486, again 4539-5787-6362-1486.", "bad card 4539578763621487", "mail bob.x@mail.example.com now", "ip 10.2.33.254 and 999.1.1.1", "on 2021-02-28 or 28/02/2021 not 2021-02-30",
        "call +1 (555) 010-9999", "ssn 123-45-6789", 'key "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "no data here", "version 4.0.1 of 12 in 1999",
    ]
    out = [r.text for r in pii.pseudonymise(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    a, b = re.findall(r"[\d-]{16,}", out[0])
    assert a != "4539578763621486" and luhn(a) and b.replace("-", "") == a and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", b)
    assert out[1] == texts[1]
    assert "bob" not in out[2] and re.search(r"p[0-9a-f]{16}@mail\.invalid now$", out[2])
    ip = re.search(r"ip (\S+) and 999.1.1.1$", out[3]).group(1)
    assert ip != "10.2.33.254" and all(0 <= int(x) <= 255 for x in ip.split("."))
    iso, day = re.search(r"on (\d{4}-\d\d-\d\d) or (\d\d/\d\d/\d{4}) not 2021-02-30$", out[4]).groups()
    assert iso != "2021-02-28" and iso == "-".join(reversed(day.split("/")))
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}", out[5]) and "010-9999" not in out[5]
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", out[6]) and "123-45" not in out[6]
    assert re.search(r'"[0-9a-f]{40}"', out[7]) and "24be6443" not in out[7]
    assert out[8:] == texts[8:]


def test_checked_numbers(spark):
    texts = [
        "order 4539578763621487 and 4539-5787-6362-1487", "card 4539578763621486", "in 2024 4539 5787 6362 1486 was paid", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000",
        "ssn 123-45-6789", "ip 999.1.1.1 on 2021-02-30", "4539 5787 6362 1486 4539 5787 6362 1486", "4539 5787 6362 1487 4539 5787 6362 1487",
    ]
    out = pii.pseudonymise(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()
    assert [r.n_found for r in out] == [0, 1, 1, 0, 1, 0, 2, 0]
    assert all((r.text == t) == (r.n_found == 0) for r, t in zip(out, texts, strict=True))
    a, b = re.search(r"\d{16}", out[1].text).group(), re.fullmatch(r"in 2024 (\d{4} \d{4} \d{4} \d{4}) was paid", out[2].text).group(1)
    assert luhn(a) and b.replace(" ", "") == a and out[6].text == f"{b} {b}"
    rows = [(i, f"{area:03}-{group:02}-{serial:04}") for i, (area, group, serial) in enumerate((x, y, z) for x in (1, 665, 667, 899) for y in range(1, 100, 7) for z in (1, 5000, 9999))]
    changed = [r.text for r in pii.pseudonymise(docs(spark, rows), "k").collect()]
    assert len(set(changed)) == len(rows) and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in changed)


def test_query_leaves_unvalidated_numbers(spark, tmp_path):
    docs(spark, [(1, "order 4539578763621487"), (2, "ref 000-12-3456"), (3, "card 4539578763621486")]).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries()["op2_pii_pseudonyms"](spark, str(tmp_path)).collect()}
    assert (out[1].text, out[1].n_found, out[2].text, out[2].n_found) == ("order 4539578763621487", 0, "ref 000-12-3456", 0)
    assert out[3].n_found == 1 and out[3].text != "card 4539578763621486"


def keyed(key, *parts):
    return int(hmac.new(key.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:15], 16)


def plain_feistel(value, left, right, key, *tweak):
    """The network of the operator in plain Python."""
    a, b = divmod(value, right)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + keyed(key, *tweak, i, b) % left) % left
        else:
            b = (b + keyed(key, *tweak, i, a) % right) % right
    return a * right + b


def test_pseudonyms_equal_a_plain_network(spark):
    rng = np.random.default_rng(6)
    key = "k" * 70  # longer than a block of the hash
    cards, want = [], []
    for n in (12, 13, 16, 19):
        for _ in range(8):
            body = "".join(map(str, rng.integers(0, 10, n - 1)))
            low = (n - 1) // 2
            own = str(plain_feistel(int(body), 10 ** (n - 1 - low), 10**low, key, "card", n - 1)).zfill(n - 1)
            whole = lambda d: next(d + str(c) for c in range(10) if luhn(d + str(c)))
            cards.append(whole(body))
            want.append(whole(own))
    hosts = [tuple(map(int, rng.integers(0, 256, 4))) for _ in range(10)]
    ips = [".".join(map(str, h)) for h in hosts]
    want += [".".join(str(plain_feistel(int.from_bytes(bytes(h)), 65536, 65536, key, "ip") >> s & 255) for s in (24, 16, 8, 0)) for h in hosts]
    days = [int(d) for d in rng.integers(0, 73049, 12)]
    for d in days:
        v = plain_feistel(d, 512, 256, key, "date")
        while v >= 73049:
            v = plain_feistel(v, 512, 256, key, "date")
        want.append(str(datetime.date(1900, 1, 1) + datetime.timedelta(v)))
    dates = [str(datetime.date(1900, 1, 1) + datetime.timedelta(d)) for d in days]
    out = pii.pseudonymise(docs(spark, list(enumerate(cards + ips + dates))), key).orderBy("doc_id").collect()
    assert [r.text for r in out] == want and all(r.n_found == 1 for r in out)


def test_hard_texts_are_read_in_time(spark):
    n = 1_000_000
    texts = ["x@" + "a." * (n // 2) + "com", "x@" + "a." * 100 + "com", "a." * (n // 2), "1" * n, "." * n, " " * n, "@" * n, "x@" * (n // 2), "1234 " * (n // 5), "-" * n, "(" * n, "f" * n, "1.1.1.1." * (n // 8)]
    out = pii.pseudonymise(docs(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()
    assert [r.n_found for r in out] == [0, 1] + [0] * (len(texts) - 2) and all(r.text == t for r, t in zip(out, texts, strict=True) if r.doc_id != 1)
    run = "4539 5787 6362 1486 " * 100 + "12 34"
    long = pii.pseudonymise(docs(spark, [(0, run)]), "k").first()
    assert long.n_found == 100 and len(set(long.text[:2000].split(" "))) == 5 and long.text.endswith(" 12 34")


def test_key_is_not_in_the_plan(spark):
    out = pii.pseudonymise(docs(spark, [(1, "ip 10.2.33.254 is no version 10.2.33.254")]).withColumn("pii", F.lit(7)), "very-secret")
    plan = out._jdf.queryExecution().toString()
    assert "very-secret" not in plan and b"very-secret".hex() not in plan.lower() and out.columns[-2:] == ["pii", "n_found"]
    assert out.first().n_found == 1 and out.first().text.endswith("version 10.2.33.254") and out.first().pii == 7


def test_permutations_are_one_to_one(spark):
    KEY = pii.Key(F.lit(b"i" * 64), F.lit(b"o" * 64))
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, F.lit("0")).alias("d")).select(pii.permuted_digits(F.col("d"), KEY, F.lit("t")).alias("x"))
    assert digits.distinct().count() == 1000 and digits.where("length(x) <> 3").count() == 0
    numbers = spark.range(1024).select(pii.feistel(F.col("id"), F.lit(32).cast("long"), F.lit(32).cast("long"), KEY, F.lit("t")).alias("x"))
    assert numbers.distinct().count() == 1024 and numbers.where("x < 0 or x >= 1024").count() == 0
    days = spark.range(0, 73049, 37).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    mapped = pii.pseudonymise(days, "k")
    assert mapped.select("text").distinct().count() == days.count() and mapped.where("text NOT BETWEEN '1900-01-01' AND '2099-12-31'").count() == 0
    assert pii.pseudonymise(days.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(days.withColumn("n_found", F.lit(1)), "k")


GROUPINGS = {"378282246310005": (4, 6, 5), "30569309025904": (4, 6, 4), "6304123456789012345": (4, 4, 4, 4, 3), "4539578763621486": (4, 4, 4, 4), "6221261234567890123": (6, 13), "630400000000": (4, 4, 4)}


def grouped(number, sizes, sign):
    cuts = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    return sign.join(number[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def with_check_digit(number):
    return next(number[:-1] + c for c in "0123456789" if luhn(number[:-1] + c))


@pytest.mark.parametrize("sign", [" ", "-"])
def test_cards_in_every_grouping_have_one_pseudonym(spark, sign):
    numbers = {with_check_digit(n): sizes for n, sizes in GROUPINGS.items()}
    rows = []
    for number, sizes in numbers.items():
        shown = grouped(number, sizes, sign)
        rows += [(len(rows), number), (len(rows) + 1, f"in May {shown}, yes"), (len(rows) + 2, f"{shown}, {shown}"), (len(rows) + 3, f"no. {grouped(number[:-1] + str((int(number[-1]) + 1) % 10), sizes, sign)}")]
    out = [(r.text, r.n_found) for r in pii.pseudonymise(docs(spark, rows), "k").orderBy("doc_id").collect()]
    for i, (number, sizes) in enumerate(numbers.items()):
        (plain, n), (inside, m), (twice, two), (bad, none) = out[4 * i : 4 * i + 4]
        assert n == 1 and plain != number and luhn(plain) and len(plain) == len(number)
        assert (inside, m) == (f"in May {grouped(plain, sizes, sign)}, yes", 1), number
        assert two == 2 and re.sub("[^0-9]", "", twice) == plain * 2
        assert (bad, none) == (rows[4 * i + 3][1], 0)


def test_cards_after_a_year_and_after_each_other(spark):
    number = with_check_digit("378282246310005")
    shown = grouped(number, (4, 6, 5), " ")
    out = [r.text for r in pii.pseudonymise(docs(spark, [(0, number), (1, f"2024 {shown}"), (2, f"{shown} {shown} 17")]), "k").orderBy("doc_id").collect()]
    assert out[1] == f"2024 {grouped(out[0], (4, 6, 5), ' ')}" and out[2] == f"{out[1][5:]} {out[1][5:]} 17"


def test_no_valid_card_is_left_by_a_search_that_knows_no_pattern(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(300):
        sizes = [(4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 4, 4, 4, 1), (16,), (13,), (6, 13)][rng.integers(8)]
        number = with_check_digit("".join(map(str, rng.integers(0, 10, sum(sizes)))))
        texts.append(f"word {grouped(number, sizes, ' -'[rng.integers(2)])} word")
    out = {r.doc_id: r for r in pii.pseudonymise(docs(spark, list(enumerate(texts))), "k").collect()}
    for k, text in enumerate(texts):
        # every blank or hyphen taken out, so no grouping matters
        before, after = (re.sub("[^0-9]", "", t) for t in (text, out[k].text))
        assert out[k].n_found == 1 and luhn(after) and len(before) == len(after) and re.sub("[0-9]", "0", text) == re.sub("[0-9]", "0", out[k].text)
    assert sum(out[k].text != t for k, t in enumerate(texts)) >= 299


def test_numbers_beside_a_run_of_groups_are_still_found(spark):
    out = pii.pseudonymise(docs(spark, [(1, "1234 555-123-4567"), (2, "1999 2000 2001"), (3, "1234 5678")]), "k").orderBy("doc_id").collect()
    assert out[0].n_found == 1 and out[0].text.startswith("1234 ") and [(r.text, r.n_found) for r in out[2:]] == [("1234 5678", 0)]


BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_lines_are_counted_in_documents(spark):
    rows = [(k, f"{BODY} own{k}\nshared line here", "h") for k in range(6)] + [(k, f"{BODY} copy of all", "g") for k in range(10, 16)] + [(20, f"{BODY} said again", "f")] * 6 + [(30, "Shared LINE here", "h"), (31, None, "h")]
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert [(out[k].lost_words, out[k].kept) for k in range(6)] == [(3, True)] * 6
    assert [(out[k].lost_words, out[k].kept, out[k].base_failed) for k in range(10, 16)] == [(23, False, False)] * 6
    assert out[20].lost_words == 0 and out[20].kept and not out[30].kept and out[30].lost_words == 3


def test_cleaned_texts(spark):
    rows = [(k, f"{BODY} own{k}\n\n  Shared line HERE \nlast {k}", "h") for k in range(6)] + [(k, f"{BODY} copy of all", "g") for k in range(10, 16)] + [(None, f"{BODY} free", None), (31, None, "h"), (32, "few words", "h"), (0, f"{BODY} other text", "h"), (0, f"{BODY} other text", "h")]
    source = docs(spark, rows)
    out = quality_rules.clean(source)
    assert out.columns == source.columns
    want = [(k, f"{BODY} own{k}\n\nlast {k}") for k in range(6)] + [(None, f"{BODY} free"), (0, f"{BODY} other text"), (0, f"{BODY} other text")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    kept = quality_rules.judge(source).where("kept")
    assert out.count() == kept.count() and quality_rules.clean(source.where("doc_id < 0")).count() == 0
