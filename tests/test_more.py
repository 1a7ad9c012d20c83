import pytest
from pyspark.sql import functions as F

from folioscan import library
from folioscan.operators import evaluation, index, search, vectors
from folioscan.plans import analysis
from folioscan.schemas import DOCUMENT, TOMBSTONE
from folioscan.sources import article_xml
from tests_support import JATS


def test_timings(spark):
    rows = spark.createDataFrame([("q", float(i)) for i in range(1, 21)], "name string, ms double")
    assert tuple(evaluation.timings(rows, ["name"]).first()) == ("q", 20, 10.5, 19.0)


def test_contributions_add_up_to_the_score(spark):
    b = spark.createDataFrame([("PMC1", "b0", "cancer care cancer"), ("PMC2", "b0", "care home")], "doc_id string, block_id string, text string")
    own = index.build_index(b)
    terms = search.parse_queries(spark.createDataFrame([(1, "cancer care")], "query_id int, query string"), "OR")
    scores = search.cosine_scores(own, terms)
    parts = evaluation.term_contributions(own, terms, scores).groupBy("doc_id").agg(F.sum("contribution").alias("s"))
    for r in scores.join(parts, "doc_id").collect():
        assert r.s == pytest.approx(r.score)


def test_vectors_are_guarded(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5])], "word string, vector array<double>")
    vectors.save_vectors(v, str(tmp_path / "v"), "c1")
    assert vectors.load_vectors(spark, str(tmp_path / "v"), "c1").count() == 2
    with pytest.raises(ValueError):
        vectors.load_vectors(spark, str(tmp_path / "v"), "c2")


def test_curve(spark):
    fit = spark.createDataFrame([("A", -1.0, 2.0, 1, 1000)], "condition string, slope double, intercept double, rank_start int, rank_end int")
    rows = analysis.curve_points(fit, ["condition"]).orderBy("rank").collect()
    assert rows[0].rank == 1 and rows[-1].rank == 1000 and rows[0].cf == pytest.approx(100) and 100 < len(rows) <= 161


def test_publish(spark):
    made = [article_xml.parse_article(article_xml.articles(JATS.format(n=n, body=b).encode())[0]) for n, b in ((1, "x"), (2, "y"), (1, "z"))]
    old, new = spark.createDataFrame(made[:1], DOCUMENT), spark.createDataFrame(made[1:], DOCUMENT)
    stones = spark.createDataFrame([("PMC2", made[1], "", "")], TOMBSTONE)
    change = library.publish(old, stones, new)
    assert change.documents.count() == 2 and change.deleted.count() == 0
    assert {r.pmcid: r.status for r in change.manifest.collect()} == {"PMC1": "updated", "PMC2": "imported"}
