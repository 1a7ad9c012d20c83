"""The best documents from blocks of impacts, against scoring every posting."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan import queries as queries_module
from folioscan.operators import index, scan, search, topk


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    weight = [1 / (i + 1) for i in range(400)]
    rows = [(f"PMC{i}", "b", " ".join(rng.choices(words, weight, k=rng.choice((0, 1, 5, 40, 200))))) for i in range(1500)]
    rows += [(f"PMC{2000 + i}", "b", "w7 w9 w11") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id string, block_id string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(5)
    texts = ["w0", "w399", "w0 w1 w2", "w7 w9 w11", "nothing here", "", "w5 nothing", " ".join(f"w{i}" for i in range(0, 400, 7)), *(" ".join(f"w{rng.randint(0, 399)}" for _ in range(rng.randint(1, 12))) for _ in range(12))]
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


@pytest.fixture(scope="module")
def own(spark, corpus, tmp_path_factory):
    return index.current_index(corpus, str(tmp_path_factory.mktemp("i")), locations=False, best=True)


def ranked(rows):
    return sorted((r.query_id, r["rank"], r.doc_id, pytest.approx(r.score, abs=1e-12)) for r in rows.collect())


@pytest.mark.parametrize("k", [1, 10, 130, 5000])
def test_equals_scoring_every_posting(own, queries, k):
    plain = index.Index(own.variant, own.postings, own.idf, own.norms, own.n_documents)
    want = search.search_batch(plain, queries, "OR", ranking="tfidf", limit=k).collect()
    got = search.search_batch(own, queries, "OR", ranking="tfidf", limit=k).collect()
    key = lambda r: (r.query_id, r["rank"])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(*key(r), round(r.score, 9)) for r in got] == [(*key(r), round(r.score, 9)) for r in want]
    # which of equal scores comes first may hang on the last bit where every posting is summed
    best = {(r.query_id, r.doc_id): r.score for r in want}
    assert all(abs(best.get((r.query_id, r.doc_id), r.score) - r.score) < 1e-9 for r in got)


def test_equal_documents_stand_in_the_order_of_their_names(own, spark):
    q = spark.createDataFrame([(1, "w7 w9 w11")], "query_id int, query string")
    rows = search.search_batch(own, q, "OR", ranking="tfidf", limit=20).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [f"PMC{2000 + i}" for i in range(20)]


def test_long_lists_are_dealt_over_segments(spark, own, queries, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 100)
    monkeypatch.setattr(topk, "BLOCK", 16)
    weighted = topk.weights(own.postings, own.idf, own.norms)
    rows = topk.impacts(weighted)
    assert rows.agg(F.max("segment")).first()[0] > 3 and rows.agg(F.max("n")).first()[0] == 16
    assert rows.agg(F.sum("n")).first()[0] == own.postings.count()
    assert rows.where(F.col("top") != F.array_max("weights")).isEmpty()
    terms = search.parse_queries(queries, "OR")
    score = lambda found: {(r.query_id, r.doc_id): round(r.score, 9) for r in found.collect()}
    got, want = score(topk.best_documents(rows, topk.vectors(weighted), own.idf, terms, 10)), score(search.cosine_scores(own, terms))
    assert all(want[k] == v for k, v in got.items())
    for q in {q for q, _ in want}:
        best = lambda s: sorted((v for (x, _), v in s.items() if x == q), reverse=True)[:10]  # noqa: B023, E731
        assert best(got) == best(want)


def test_reads_fewer_postings_than_there_are(own, spark):
    q = spark.createDataFrame([(1, "w0 w1 w2 w250"), (2, "w0 w1 w300 w310 w320")], "query_id int, query string")
    terms = search.parse_queries(q, "OR")
    rows = {r.query_id: r for r in topk.best_documents(own.impacts, own.vectors, own.idf, terms, 10, report=True).collect()}
    full = terms.join(own.postings, "term").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in full} == {k: r.postings for k, r in rows.items()}
    assert all(2 * r.read < r.postings for r in rows.values()), rows


def test_few_values_reach_the_scan(own):
    plan = own.impacts.where(topk.any_of("term", ["w1", "w2", "w3"]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and plan.count("EqualTo(term") >= 3
    assert own.impacts.where(topk.any_of("term", [])).isEmpty()


def test_an_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id string, block_id string, text string")
    own = index.current_index(empty, str(tmp_path / "i"), best=True, phrases=True)
    q = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    assert search.search_batch(own, q, "OR", ranking="tfidf", limit=5).count() == 0
    assert search.search_batch(own, q, "PHRASE", token_rows=index.read_tokens(spark, str(tmp_path / "i"))).count() == 0


def _scanned(corpus, queries, k, **kw):
    return search.ranked(scan.best_documents(corpus, search.parse_queries(queries, "OR"), k, **kw), "doc_id", k)


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_one_reading_equals_scoring_every_posting(corpus, own, queries, k, monkeypatch):
    # several blocks of queries, and stretches of few documents
    monkeypatch.setattr(scan, "QUERY_BLOCK", 7)
    monkeypatch.setattr(scan, "PARTS", 50)
    plain = index.Index(own.variant, own.postings, own.idf, own.norms, own.n_documents)
    want = search.search_batch(plain, queries, "OR", ranking="tfidf", limit=k).collect()
    got = _scanned(corpus, queries, k).collect()
    key = lambda r: (r.query_id, r["rank"])
    assert [(*key(r), r.score) for r in sorted(got, key=key)] == [(*key(r), pytest.approx(r.score, abs=1e-11)) for r in sorted(want, key=key)]


def test_one_reading_keeps_ties_in_order_and_counts_a_document_of_several_rows_once(spark, corpus):
    q = spark.createDataFrame([(1, "w7 w9 w11"), (2, "nothing here")], "query_id int, query string")
    assert [r.doc_id for r in _scanned(corpus, q, 20).orderBy("rank").collect()] == [f"PMC{2000 + i}" for i in range(20)]
    rows = spark.createDataFrame([(1, 0, "w1 w2"), (1, 1, "w2 w3"), (2, 0, "w1 w2 w2 w3"), (3, 0, None), (4, 0, "w9")], "doc_id int, block_id int, text string")
    one, two = _scanned(rows, spark.createDataFrame([(1, "w2 w9")], "query_id int, query string"), 10).where("doc_id < 3").collect()
    assert one.score == two.score and {one.doc_id, two.doc_id} == {1, 2}
    assert _scanned(rows.where("doc_id > 9"), q, 10).count() == 0 and _scanned(rows, q.where("query_id = 2"), 10).count() == 0


def test_a_batch_asked_once_exchanges_no_postings(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(60))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    written = []
    for name in ("write_index", "write_best"):
        monkeypatch.setattr(index, name, lambda *a, **kw: written.append(a))
    real = scan.materialise
    monkeypatch.setattr(scan, "materialise", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    scores = queries_module.QUERIES["batch_search_top10"](spark, str(tmp_path))
    assert scores.agg(F.sum("n")).first()[0] == 200
    # a row for each document or term, and ten for each task and query at most
    assert [name for name, _ in written] == ["document-terms", "idf", "norms", "query-shares", "best"]
    assert written[-1][1].count() <= 10 * 20 * written[-1][1].rdd.getNumPartitions() * 4
