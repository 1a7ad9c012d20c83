"""Work that stays within a text's row, or within bounded memory."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan import queries
from folioscan.functions import sentences, text
from folioscan.operators import evaluation, index, phrases, search, spelling, vectors
from folioscan.plans import analysis

TEXTS = [(1, 0, "The cell wall of the leaf. Of the IL-6 walls, the the the."), (2, 0, "Running runs; the RUNNER ran (e.g. off). Of the end!"), (3, 0, ""), (4, 0, None)]


@pytest.fixture
def blocks(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, block_id int, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_and_pairs_need_no_exchange(blocks):
    keys = ["doc_id", "block_id"]
    for rows in (text.token_table(blocks, keys), phrases.token_pairs(blocks, keys)):
        assert "Exchange" not in plan(rows) and "Window" not in plan(rows)
    t = dict((r[0], r[2]) for r in TEXTS)
    for r in text.token_table(blocks, keys).collect():
        assert t[r.doc_id][r.start : r.end] == r.surface and t[r.doc_id][r.start - len(r.gap) : r.start] == r.gap


@pytest.mark.parametrize("variant", index.VARIANTS)
def test_counts_need_no_exchange(blocks, variant):
    rows = index.term_frequencies(blocks, variant)
    assert "Exchange" not in plan(rows)
    want = index.located_terms(blocks, variant).groupBy("term", "doc_id").count()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_documents_of_several_rows_are_counted_whole(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b c")], "doc_id bigint, text string")
    assert sorted(map(tuple, index.term_frequencies(rows).collect())) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 1)]


def test_document_counts_need_no_exchange(blocks):
    rows = analysis.document_counts(blocks)
    assert "Exchange" not in plan(rows)
    assert {(r.condition, r.doc_id): r.unique_terms for r in rows.collect()}["D", 2] == len({"run", "runner", "ran", "e", "g", "off", "end"} - {t for t in ("off",) if t in analysis.ANALYSIS_STOPWORDS})


def test_a_phrase_is_asked_without_an_index_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(index, "write_pairs", lambda *a: pytest.fail("all pairs were written"))
    assert queries.QUERIES["phrase_offsets"](spark, "/root/testdata/sf0.001").count() > 0


def test_scanned_pairs_are_the_asked_ones(spark, blocks):
    terms = search.parse_queries(queries.batch_queries(spark, ("of the", "wall", "the the the")), "PHRASE")
    keys = ["doc_id", "block_id"]
    few, every = phrases.scanned_pairs(blocks, terms, keys), phrases.token_pairs(blocks, keys)
    assert few.count() < every.count()
    got, want = (sorted(map(tuple, search.phrase_matches(x, terms).collect())) for x in (few, every))
    assert got == want and len(got) == 5


def test_rare_terms_alone_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_TERMS", 2)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 2)], "term string, doc_id bigint")
    values = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = index.joined_terms(rows, values)
    assert "BroadcastHashJoin" in plan(out) and sorted((r.term, r.doc_id, r.df) for r in out.collect()) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("b", 2, 2), ("c", 1, 1), ("d", 2, 1)]


def test_sentence_bounds_and_counts(spark, blocks):
    rows = blocks.select("text", sentences.rule_counts(F.col("text")).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: i).alias("i")).select("text", "n", F.explode("i").alias("i"))
    for r in rows.withColumn("s", sentences.sentence_at(F.col("text"), F.col("i"))).collect():
        own = sentences.split_sentences(r.text)
        assert list(r.n) == [sum(s.rule == x for s in own) for x in (sentences.PLAIN, sentences.ABBREVIATION, sentences.LAST)]
        assert (tuple(r.s) if r.s else None) == next(((s.start, s.end) for s in own if s.start <= r.i < s.end), None)


def test_nearest_holds_few_scores_at_a_time():
    rng = np.random.default_rng(1)
    best, rows = vectors.Best(list(range(5000)), rng.normal(size=(5000, 8)), 5), rng.normal(size=(1000, 8))
    tracemalloc.start()
    best.take(list(range(5000, 6000)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    want = np.sort(np.round(best.queries @ rows.T, 12), axis=1)[:, :-6:-1]
    assert np.array_equal(best.score, want)


def test_a_vocabulary_is_counted_once(spark, blocks, monkeypatch):
    made, real = [], spelling.materialise
    monkeypatch.setattr(spelling, "materialise", lambda df, name: made.append(name) or real(df, name))
    spelling.suggest(queries.batch_queries(spark, ("leef",)), spelling.build_vocabulary(blocks))
    assert "vocabulary" in made


def test_weightings_share_their_reading(spark, blocks):
    own = index.build_index(blocks, locations=False)
    rows = evaluation.weighting_profiles(own, search.parse_queries(queries.batch_queries(spark, ("wall runs",)), "OR"))
    assert plan(rows).count("FileScan") <= 6 and rows.count() == 8


def test_sentences_are_split_once_for_training(spark, blocks, monkeypatch):
    rows = vectors.training_records(blocks.select("doc_id", "text"), ["doc_id"])
    assert [(r.doc_id, r.sentence) for r in rows.collect()] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    # what gives the ranges their bounds is read twice, so it is the texts
    p = plan(rows)
    assert p.index("MapInArrow") < p.index("rangepartitioning")
    made, gone, real, drop = [], [], vectors.materialise, vectors.discard
    monkeypatch.setattr(vectors, "materialise", lambda df, name: made.append(real(df, name)) or made[-1])
    monkeypatch.setattr(vectors, "discard", lambda df: gone.append(df) or drop(df))
    assert vectors.train_words(rows, size=4, min_count=1, epochs=1).count() > 4
    assert len(made) == 1 and gone == made and made[0].columns == ["tokens"]
