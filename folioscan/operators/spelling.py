"""Spelling suggestions by bounded edit distance against a corpus vocabulary.

A term is cut into one segment more than edits are allowed, so one of them is
without an edit and stands in the word in nearly its place. Words and terms
meet in an equi-join on such segments, and sets of letters prune pairs before
any distance is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.counts import counted_rows
from ..storage import materialise

#: Signatures of query words up to which they go to all tasks (some 60 bytes each); beyond, a shuffle join.
BROADCAST_SIGNATURES = 300_000
MAX_LENGTH, SHORT_LENGTH, ONE_EDIT_LENGTH, SUGGESTIONS = 64, 3, 5, 3
# Fixed value: query words keep inner punctuation, so that names are never corrected in parts.
QUERY_WORD = r"[\p{L}\p{M}\p{N}]+(?:[-‐‑‒–—_'’./][\p{L}\p{M}\p{N}]+)*"


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; beyond ``most`` it is ``most + 1``."""
    if most is None:
        return F.levenshtein(a, b)
    if most < 0:
        raise ValueError("the bound must not be negative")
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def build_vocabulary(blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, cf) over all word tokens, which are counted within their row first."""
    rows = counted_rows(blocks.select(text.terms(F.col(text_col)).alias("own")), [], "own")
    return rows.groupBy("term").agg(F.sum("tf").alias("cf"))


def prepared(vocabulary: DataFrame) -> DataFrame:
    """Candidates (term, cf, size, mask): ASCII words; counts of terms that normalise alike are added. Counts must be positive."""
    counted = vocabulary.select(text.normalize(F.col("term")).alias("term"), F.when(F.col("cf") > 0, F.col("cf")).otherwise(F.raise_error(F.lit("counts must be positive")).cast("bigint")).alias("cf"))
    rows = counted.groupBy("term").agg(F.sum("cf").alias("cf")).where(F.col("term").rlike(f"^[a-z]{{1,{MAX_LENGTH}}}$"))
    return rows.select("term", "cf", F.length("term").alias("size"), text.letter_mask(F.col("term")).alias("mask"))


def protection(word: Column, known: Column) -> Column:
    """Why a query word is left alone; null if it may be corrected."""
    title = word.rlike("^[A-Z][a-z]*$")
    return (
        F.when(known, "known_word")
        .when(word.rlike(r"\p{Nd}"), "contains_digits")
        .when(word.rlike("[^\\x00-\\x7F]"), "non_ascii")
        .when(F.length(word) <= SHORT_LENGTH, "short_word")
        .when(F.length(word) > MAX_LENGTH, "long_word")
        .when(~word.rlike("^[A-Za-z]+$"), "compound_term")
        .when(word.rlike("^[A-Z]+$"), "uppercase_abbreviation")
        .when(~(word.rlike("^[a-z]+$") | title), "mixed_case")
    )


def query_words(queries: DataFrame, vocabulary: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """Words of each query: query, ord, word, start, end, term, reason (of protection)."""
    found = F.regexp_extract_all(F.col(query_col), F.lit(QUERY_WORD), F.lit(0))
    gaps = F.slice(F.split(F.col(query_col), QUERY_WORD, -1), F.lit(1), F.size(found))
    rows = queries.select(id_col, F.posexplode(F.arrays_zip(found.alias("word"), gaps.alias("gap"))).alias("ord", "w")).select(id_col, "ord", "w.word", "w.gap")
    order = Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.length("gap") + F.length("word")).over(order).cast("int")).withColumn("term", text.normalize(F.col("word")))
    known = vocabulary.select(text.normalize(F.col("term")).alias("term")).distinct().withColumn("known", F.lit(True))
    joined = placed.join(known, "term", "left")
    return joined.select(id_col, "ord", "word", (F.col("end") - F.length("word")).alias("start"), "end", "term", protection(F.col("word"), F.coalesce("known", F.lit(False))).alias("reason"))


def _segments(size: Column, most: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of the ``most`` + 1 segments of nearly one length that a term of a size is cut into."""
    n = most + 1
    base, longer = F.floor(size / n).cast("int"), (size % n).cast("int")
    return [(base * i + F.greatest(F.lit(i) - (F.lit(n) - longer), F.lit(0)), base + F.when(F.lit(i) >= F.lit(n) - longer, 1).otherwise(0)) for i in range(n)]


def term_signatures(terms: DataFrame) -> DataFrame:
    """(most, size, segment, piece, term, cf, mask): every segment of each prepared term, for one edit and for two."""
    pieces = [F.struct(F.lit(most).alias("most"), F.lit(i).alias("segment"), F.substring(F.col("term"), start + 1, length).alias("piece")) for most in (1, 2) for i, (start, length) in enumerate(_segments(F.col("size"), most))]
    return terms.select("term", "cf", "size", "mask", F.explode(F.array(*pieces)).alias("p")).select("p.*", "term", "cf", "size", "mask")


def word_signatures(asked: DataFrame) -> DataFrame:
    """(word, word_mask, most, size, segment, piece) by which terms within ``most`` edits of a word are met.

    Of a term's most + 1 segments one at least has no edit, so the word holds it,
    moved by no more places than there are edits.
    """
    sized = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.length("word") - F.col("most")), F.length("word") + F.col("most"))))

    def pieces(i: int, start: Column, length: Column, most: int) -> Column:
        last, first = F.least(F.length("word") - length, start + most), F.greatest(F.lit(0), start - most)
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        held = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("word"), p + 1, length)))
        return F.when(F.col("most") == most, F.transform(held, lambda x: F.struct(F.lit(i).alias("segment"), x.alias("piece"))))

    out = [pieces(i, start, length, most) for most in (1, 2) for i, (start, length) in enumerate(_segments(F.col("size"), most))]
    none = F.array().cast("array<struct<segment:int,piece:string>>")
    return sized.select("word", "word_mask", "most", "size", F.explode(F.concat(*[F.coalesce(x, none) for x in out])).alias("p")).select("word", "word_mask", "most", "size", "p.segment", "p.piece")


def candidate_pairs(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, most, term, cf) of the pairs that share a segment in place and nearly all letters; whose distance is to be measured."""
    most = F.when(F.length("word") <= ONE_EDIT_LENGTH, 1).otherwise(2)
    asked = materialise(word_signatures(words.select("word").distinct().withColumn("most", most).withColumn("word_mask", text.letter_mask(F.col("word")))), "word-signatures")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_SIGNATURES else asked
    met = term_signatures(prepared(vocabulary)).join(few, ["most", "size", "segment", "piece"])
    masks = (F.bit_count(F.col("word_mask").bitwiseAND(F.bitwise_not("mask"))) <= F.col("most")) & (F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("word_mask"))) <= F.col("most"))
    return met.where(masks).select("word", "most", "term", "cf").distinct()


def candidates(words: DataFrame, vocabulary: DataFrame, top: int = SUGGESTIONS) -> DataFrame:
    """The nearest terms of each word: word, rank, term, distance, cf; by distance, falling frequency and term.

    ``words`` has a column word, normalised ASCII. Words of up to five letters allow one edit, longer ones two.
    """
    measured = candidate_pairs(words, vocabulary).withColumn("distance", F.levenshtein("word", "term", 2)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("most")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.col("cf").desc(), "term"))
    return measured.withColumn("rank", rank).where(F.col("rank") <= top).select("word", "rank", "term", "distance", "cf")


def suggest(queries: DataFrame, vocabulary: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """For each query: suggested_query, changes, protected and unresolved words. The query itself is never altered."""
    # read twice: for words that are known, and for candidates
    vocabulary = materialise(vocabulary, "vocabulary")
    words = query_words(queries, vocabulary, id_col, query_col)
    near = candidates(words.where("reason IS NULL").select(F.col("term").alias("word")), vocabulary)
    best = near.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "distance", "cf"))).alias("candidates"))
    joined = words.join(best, words["term"] == best["word"], "left").select(words["*"], "candidates")
    first = F.get("candidates", F.lit(0))["term"]
    changed = F.col("reason").isNull() & F.col("candidates").isNotNull()
    suggestion = F.when(F.col("word").rlike("^[A-Z][a-z]*$"), F.initcap(first)).otherwise(first)
    row = F.struct("ord", "start", "end", "word", F.when(changed, suggestion).alias("suggestion"), "reason", "candidates")
    per = joined.groupBy(id_col).agg(F.sort_array(F.collect_list(row)).alias("words"))
    q = queries.select(id_col, query_col).join(per, id_col, "left").withColumn("words", F.coalesce("words", F.array().cast(per.schema["words"].dataType)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    built = F.aggregate("words", start, lambda s, w: F.struct(F.concat(s["out"], F.substring(F.col(query_col), s["at"] + 1, w["start"] - s["at"]), F.coalesce(w["suggestion"], w["word"])).alias("out"), w["end"].alias("at")), lambda s: F.concat(s["out"], F.substring(F.col(query_col), s["at"] + 1, F.length(query_col))))
    pick = lambda cond: F.filter("words", cond)
    return q.select(
        id_col, query_col, built.alias("suggested_query"), pick(lambda w: w["suggestion"].isNotNull()).alias("changes"), pick(lambda w: w["reason"].isNotNull()).alias("protected"),
        pick(lambda w: w["reason"].isNull() & w["suggestion"].isNull()).alias("unresolved"),
    )


def choices(suggested: DataFrame, query_col: str = "query") -> DataFrame:
    """The suggested queries to offer: the corrected one, and with a single change its other candidates."""
    c = F.get("changes", F.lit(0))
    alternatives = F.when(F.size("changes") == 1, F.transform(F.slice(c["candidates"], 2, 2), lambda x: F.concat(F.substring(F.col(query_col), F.lit(1), c["start"]), F.when(c["word"].rlike("^[A-Z][a-z]*$"), F.initcap(x["term"])).otherwise(x["term"]), F.substring(F.col(query_col), c["end"] + 1, F.length(query_col)))))
    some = F.when(F.size("changes") > 0, F.concat(F.array("suggested_query"), F.coalesce(alternatives, F.array().cast("array<string>"))))
    return suggested.select(*[x for x in suggested.columns if x not in ("changes", "protected", "unresolved")], F.coalesce(some, F.array().cast("array<string>")).alias("choices"))
