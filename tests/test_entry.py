import inspect

import duckdb
import pytest

import __spark_entry__ as entry
from folioscan import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "conversations", "benchmark", "embeddings", "events")


def canonical(rows):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["condition_summary", "zipf_regression", "search_relevance", "phrase_offsets", "spelling_candidates", "status_counts"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(want)


def _two_languages(spark, tmp_path):
    rows = [(1, "One day came. Thanea went to the sea.", "en"), (2, "Un jour vint. Thanea alla en ville.", "fr"), (3, "Thanea ging fort.", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_sentences_of_every_language(spark, tmp_path):
    out = queries.QUERIES["sentence_spans"](spark, _two_languages(spark, tmp_path)).groupBy("doc_id").count()
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 2), (3, 1)]


def test_words_of_every_language_are_learned(spark, tmp_path, monkeypatch):
    seen = []
    train = queries.vectors.train_words
    monkeypatch.setattr(queries.vectors, "train_words", lambda rows, **kw: seen.append(rows) or train(rows, **kw | {"min_count": 1}))
    queries.QUERIES["word_neighbours"](spark, _two_languages(spark, tmp_path))
    assert {w for r in seen[0].collect() for w in r.tokens} >= {"one", "jour", "fort"}


def test_neighbours_come_from_the_whole_training(spark, tmp_path, monkeypatch):
    real, made = queries.vectors.train_words, []

    def spy(rows, **kw):
        made.append(inspect.signature(real).bind(rows, **kw))
        made[-1].apply_defaults()
        return real(rows, **kw | {"min_count": 1})

    monkeypatch.setattr(queries.vectors, "train_words", spy)
    assert queries.QUERIES["word_neighbours"](spark, _two_languages(spark, tmp_path)).count() == 10
    assert (made[0].arguments["size"], made[0].arguments["epochs"]) == (100, 30)
