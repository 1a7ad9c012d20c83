import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import evaluation, spelling, vectors
from folioscan.plans import analysis


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def counts(spark, *texts):
    rows = analysis.term_counts(analysis.document_terms(docs(spark, *texts))).collect()
    return {(r.condition, r.term): (r.cf, r.df) for r in rows}


def test_conditions(spark):
    c = counts(spark, "The cats, cats run.", "Cats run run.")
    assert c["A", "cats,"] == (1, 1) and c["B", "cats"] == (3, 2) and c["D", "cat"] == (3, 2)
    assert ("C", "the") not in c and c["C", "run"] == (3, 2)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_corpus_counts_equal_counts_by_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(analysis, "BROADCAST_TERMS", broadcast)
    d = docs(spark, "The cats run, a cat ran; running CATS run.", "Runs and cat’s cats’ ÉTÉ été", "", None, "the of", "STRASSE Straße ὈΔΥΣΣΕΎΣ 3.14 mid‐sized mid-sized", "x " * 500 + "cat runs")
    for conditions in (("A", "B", "C", "D"), ("B",), ("D",), ("A", "C")):
        rows = lambda f: sorted(map(tuple, f.select("condition", "term", "cf", "df").collect()))  # noqa: E731, B023
        assert rows(analysis.corpus_counts(d, conditions=conditions)) == rows(analysis.term_counts(analysis.document_terms(d, conditions=conditions)))
        got = {(r.condition, r.doc_id): (r.tokens, r.unique_terms) for r in analysis.document_counts(d, conditions=conditions).collect()}
        want = {(r.condition, r.doc_id): (r.tokens, r.n) for r in analysis.document_terms(d, conditions=conditions).groupBy("condition", "doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("n")).collect()}
        assert got == {(c, i): want.get((c, i), (0, 0)) for c in conditions for i in range(1, 8)}


def test_population_keeps_documents_without_terms(spark):
    d = docs(spark, "the", "cats")
    ranked = analysis.ranked_terms(analysis.term_counts(analysis.document_terms(d)), d.count())
    assert ranked.where("condition = 'C'").first().idf == pytest.approx(0.30103, abs=1e-5)
    assert analysis.document_counts(d).where("condition = 'C' AND doc_id = 1").first().tokens == 0


def test_ranks(spark):
    d = docs(spark, "b a b c c c d")
    rows = analysis.ranked_terms(analysis.term_counts(analysis.document_terms(d, conditions=("B",))), 1).orderBy("rank").collect()
    assert [(r.rank, r.term) for r in rows] == [(1, "c"), (2, "b"), (3, "a"), (4, "d")]


@pytest.mark.parametrize(
    ("points", "slope", "r2", "status"),
    [
        ([(1, 100.0), (2, 50.0), (4, 25.0), (8, 12.5)], -1, 1, "ok"),
        ([(1, 5.0), (2, 5.0)], 0, None, "constant_frequency"),
        ([(1, 5.0)], None, None, "insufficient_points"),
        ([(3, 5.0), (3, 6.0)], None, None, "constant_rank"),
    ],
)
def test_fits(spark, points, slope, r2, status):
    row = analysis.fits(spark.createDataFrame([("x", *p) for p in points], "k string, rank int, cf double"), ["k"]).first()
    assert row.status == status
    assert row.slope == (None if slope is None else pytest.approx(slope)) and row.r_squared == (None if r2 is None else pytest.approx(r2))


def test_segment_bounds(spark):
    row = spark.range(1).select(*analysis.segment_bounds(F.lit(1000))).first()
    assert tuple(row) == (10, 100)
    assert tuple(spark.range(1).select(*analysis.segment_bounds(F.lit(6))).first()) == (2, 4)


def test_best_segments(spark):
    rows = spark.createDataFrame([("A", "head", 0.99, 0.3), ("A", "middle", 0.9, 0.1), ("B", "head", 0.99, 0.1), ("B", "tail", 0.9, 0.3), ("C", "head", None, None)], "condition string, segment string, r_squared double, rmse double")
    assert {r.condition: (r.best, r.status) for r in analysis.best_segments(rows).collect()} == {"A": ("", "mixed"), "B": ("head", "agreed"), "C": ("", "insufficient")}


def test_validation_fails_the_job(spark):
    for rows in ([(0, "x")], [(1, "x"), (1, "y")], [(1, "  ")], [(1, None)]):
        with pytest.raises(Exception, match="identifier|blank"):
            analysis.validated(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()


VOCABULARY = [("cart", 5), ("cast", 9), ("cats", 9), ("catt", 1), ("coats", 2), ("insulin", 50), ("glucose", 30), ("glaucose", 2)]


def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, "term string, cf bigint")


def test_edit_distance(spark):
    pairs = [("kitten", "sitting", 3), ("insluin", "insulin", 2), ("naïve", "naive", 1), ("你好", "您好", 1)]
    rows = spark.createDataFrame(pairs, "a string, b string, d int").select("d", spelling.edit_distance(F.col("a"), F.col("b")).alias("x"), spelling.edit_distance(F.col("a"), F.col("b"), 1).alias("y")).collect()
    assert all(r.x == r.d and r.y == min(r.d, 2) for r in rows)
    with pytest.raises(ValueError):
        spelling.edit_distance(F.lit("a"), F.lit("b"), -1)


def test_candidates_match_exhaustive_search(spark):
    words = spark.createDataFrame([("catz",), ("glucoss",)], "word string")
    rows = spelling.candidates(words, vocabulary(spark)).orderBy("word", "rank").collect()
    assert [(r.word, r.term, r.distance) for r in rows] == [("catz", "cats", 1), ("catz", "catt", 1), ("glucoss", "glucose", 1), ("glucoss", "glaucose", 2)]


def test_suggestions(spark):
    q = spark.createDataFrame([(1, "Insuln for the GLP-1 glucoss, ok"), (2, "insulin"), (3, "zzzzzzz")], "query_id int, query string")
    rows = {r.query_id: r for r in spelling.suggest(q, vocabulary(spark)).collect()}
    assert rows[1].suggested_query == "Insulin for the GLP-1 glucose, ok"
    assert {p.word: p.reason for p in rows[1].protected} == {"for": "short_word", "the": "short_word", "GLP-1": "contains_digits", "ok": "short_word"}
    assert rows[2].changes == [] and rows[2].protected[0].reason == "known_word"
    assert [u.word for u in rows[3].unresolved] == ["zzzzzzz"]


@pytest.mark.parametrize(("word", "reason"), [("naïve", "non_ascii"), ("x" * 65, "long_word"), ("beta-cell", "compound_term"), ("NATO", "uppercase_abbreviation"), ("McDonald", "mixed_case"), ("insulin", None)])
def test_protection(spark, word, reason):
    assert spark.createDataFrame([(word,)], "w string").select(spelling.protection(F.col("w"), F.lit(False))).first()[0] == reason


def test_nearest(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<double>")
    rows = vectors.nearest(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [2, 3]
    rng = np.random.default_rng(2)
    many = np.round(rng.normal(size=(300, 5)), 1)
    many[40:60] = many[3]
    own = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(many)], "vec_id int, embedding array<double>").repartition(3)
    sims = np.round((u := many / np.linalg.norm(many, axis=1, keepdims=True)) @ u.T, 10)
    for block in (7, 10_000):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "ROW_BLOCK", 11)
        got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.nearest(own, own.where("vec_id % 20 = 0"), 6).collect()}
        assert got == {(q, k + 1): int(i) for q in range(0, 300, 20) for k, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-sims[q, i], i))[:6])}
    assert vectors.neighbours(v.select(F.lit("a").alias("word"), F.col("embedding").alias("vector")), "two words")[0] == "invalid_query"


def test_measures(spark):
    rows = spark.createDataFrame([("x", [1, 5], [1, 6])], "g string, p array<int>, a array<int>")
    r = evaluation.boundary_scores(rows, "p", "a", ["g"]).first()
    assert (r.tp, r.fp, r.fn, r.count_error, r.f1) == (1, 1, 1, 0, 0.5)
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, n int, s string")
    assert evaluation.latest_by_key(log, "k", ["n"]).first().s == "b"


def test_decomposed_texts_count_as_composed_ones(spark):
    import unicodedata

    texts = ["Café cafés été œuvre", "café, ÉTÉ naïve naïve", "straße STRASSE ﬁne Ångström", "plain text"]
    ranks = lambda rows: sorted(map(tuple, analysis.ranked_terms(analysis.corpus_counts(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), exact=True), len(rows)).collect()))
    whole = ranks(texts)
    assert ranks([unicodedata.normalize("NFD", t) for t in texts]) == whole
    # a document with both forms is one document of the term
    mixed = [t + " " + unicodedata.normalize("NFD", t) for t in texts]
    twice = {(c, t): (cf, df) for c, _, t, cf, df, _ in ranks(mixed)}
    once = {(c, t): (cf, df) for c, _, t, cf, df, _ in whole}
    assert twice == {k: (2 * cf, df) for k, (cf, df) in once.items()}
    # the library's own composition and folding, term by term
    known = {unicodedata.normalize("NFC", w).casefold() for t in texts for w in t.split()}
    assert {t for c, _, t, *_ in whole if c == "A"} == known
