"""Phrases from pairs of words, against the token table and a plain search."""

import random

import pytest

from folioscan.functions import text
from folioscan.operators import index, phrases, search


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(1)
    signs = ["the", "of", "the", "a", "sea", "Sea", "low-tide", "2.5", "of"]
    between = [" ", " ", " ", "  ", "\n", "\t ", ", ", ". ", " - "]
    rows = [(i // 2, i % 2, "".join(rng.choice(signs) + rng.choice(between) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    return spark.createDataFrame([*rows, (500, 0, None), (501, 0, ""), (502, 0, "the"), (503, 0, "the ")], "doc_id int, block_id int, text string")


QUERIES = ["the", '"of the"', "the the the", "the sea of the", "sea", "the of the of the", "low-tide 2.5", "nowhere the", "the nowhere", "", "a a a a a", "the sea"]


@pytest.fixture(scope="module")
def terms(spark):
    return search.parse_queries(spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string"), "PHRASE")


def places(rows):
    return sorted((r.query_id, r.doc_id, r.block_id, r.start, r.end) for r in rows.collect())


def test_pairs_find_what_the_token_table_finds(blocks, terms):
    plain = places(search.phrase_matches(text.token_table(blocks, ["doc_id", "block_id"]), terms))
    pairs = phrases.token_pairs(blocks, ["doc_id", "block_id"])
    assert places(search.phrase_matches(pairs, terms)) == plain and len({q for q, *_ in plain}) >= 7


@pytest.mark.parametrize(("name", "value"), [("BROADCAST_PLACES", -1), ("PUSHED", 2)])
def test_beyond_the_bounds(blocks, terms, monkeypatch, name, value):
    pairs = phrases.token_pairs(blocks, ["doc_id", "block_id"])
    want = places(phrases.pair_matches(pairs, terms))
    monkeypatch.setattr(phrases, name, value)
    assert places(phrases.pair_matches(pairs, terms)) == want


def test_next_words(spark):
    d = spark.createDataFrame([(1, "Low \t tide, low tide")], "doc_id int, text string")
    rows = phrases.token_pairs(d, ["doc_id"]).orderBy("pos").collect()
    assert [(r.term, r.next, r.start, r.end, r.next_end) for r in rows] == [("low", "tide", 0, 3, 10), ("tide", None, 6, 10, None), ("low", "tide", 12, 15, 20), ("tide", None, 16, 20, None)]


def test_the_rarest_pair_is_chosen(spark, blocks):
    pairs = phrases.token_pairs(blocks, ["doc_id", "block_id"])
    q = search.parse_queries(spark.createDataFrame([(1, "the sea of the"), (2, "of the nowhere")], "query_id int, query string"), "PHRASE")
    count = {(r.term, r.next): r["count"] for r in pairs.groupBy("term", "next").count().collect()}
    best = min((count[p], i) for i, p in enumerate((("the", "sea"), ("sea", "of"), ("of", "the")), 1))
    assert [tuple(r) for r in phrases.rarest(pairs, phrases.query_pairs(q)).collect()] == [(1, best[1], best[0])]


def test_written_pairs_are_looked_up_by_both_words(spark, blocks, tmp_path):
    path = str(tmp_path / "i")
    index.current_index(blocks, path, phrases=True, locations=False)
    stored = index.read_tokens(spark, path)
    terms = search.parse_queries(spark.createDataFrame([(1, "the sea")], "query_id int, query string"), "PHRASE")
    plan = search.phrase_matches(stored, terms)._jdf.queryExecution().toString()
    assert "EqualTo(term,the)" in plan and "EqualTo(next,sea)" in plan
