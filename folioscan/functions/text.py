"""Tokens, terms and offsets as column expressions.

Offsets are code points from 0, half open. Terms are tokens in a normal form:
case folded, with one kind of apostrophe and one kind of hyphen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import running_sums
from .vocabulary import ANALYSIS_STOPWORDS, CELL_LETTERS, CELL_WORDS, LETTER_CONTEXTS, SEARCH_STOPWORDS

# Fixed value: decimals, or runs of letters and digits that inner hyphens and apostrophes hold together.
TOKEN = r"\p{N}+(?:\.\p{N}+)+|[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:[-‐‑'’][\p{L}\p{N}][\p{L}\p{M}\p{N}]*)*"
#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"
ALL_SPACE = r"(?U)^[\s\x1c-\x1f]+$"
HYPHEN = "[-‐‑]"
#: Where a compound falls apart: around hyphens, which become pieces, and between letters and numbers.
_PIECES = rf"(?<={HYPHEN})|(?={HYPHEN})|(?<=[\p{{L}}\p{{M}}])(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})"
CONDITIONS = ("A", "B", "C", "D")


def normalize(term: Column) -> Column:
    """Normal form without leaving the JVM: lower case with the folds of ß and ς, plain apostrophe and hyphen.

    Equal to ``normalize_exact`` for text in composed form, but for a few
    letters whose case folding is special.
    """
    folded = F.lower(term)
    # one search of bytes for each sign: F.translate looks up every letter
    for sign, plain in (("ß", "ss"), ("ς", "σ"), ("’", "'"), ("‐", "-"), ("‑", "-")):
        folded = F.replace(folded, F.lit(sign), F.lit(plain))
    return folded


@F.pandas_udf(T.StringType())
def normalize_exact(terms: pd.Series) -> pd.Series:
    """Full composition and case folding, for text that isn't composed. Arrow-batched; use it on distinct terms."""
    import unicodedata

    table = str.maketrans("’‐‑", "'--")
    return terms.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold().translate(table))


def exact_forms(rows: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, exact) of the distinct terms that ``normalize_exact`` changes; only terms beyond ASCII are looked at."""
    odd = rows.select(F.col(term_col).alias("term")).where(F.col("term").rlike(r"[^\x00-\x7F]")).distinct()
    return odd.withColumn("exact", normalize_exact(F.col("term"))).where("exact <> term")


def tokens(text: Column) -> Column:
    """Tokens as they stand in the text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """What white space separates, punctuation attached."""
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Terms in order: the text is normalised as a whole, as neither case nor the kind of a hyphen moves the bounds of a token."""
    return tokens(normalize(text))


def condition_terms(text: Column, condition: str) -> Column:
    """Array of the normalised terms of an analysis condition, before filtering and stemming."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition: {condition!r}")
    return whitespace_tokens(normalize(text)) if condition == "A" else terms(text)


def query_terms(text: Column) -> Column:
    """Distinct terms in order of appearance."""
    return F.array_distinct(terms(text))


def without_stopwords(terms: Column, words: tuple[str, ...] = ANALYSIS_STOPWORDS) -> Column:
    return F.filter(terms, lambda t: ~t.isin(list(words)))


def isolated_letter(term: Column) -> Column:
    return term.rlike("^[A-Za-z]$")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def document_order(doc_id: Column) -> Column:
    """Sort key of identifiers: the number of a PMC or PMID identifier, 0 for others, and then the identifier."""
    number = F.regexp_extract(doc_id, r"^(?:PMID|PMC)(\d+)$", 1)
    return F.struct(F.coalesce(F.when(number != "", number.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"), doc_id.alias("id"))


def letter_mask(term: Column) -> Column:
    """The set of letters a to z in a term, as 26 bits."""
    bits = [F.when(F.contains(term, F.lit(chr(97 + i))), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(26)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def token_arrays(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Keys and, of each text that isn't null, the arrays surface, gap (what lies before a token) and end.

    Every letter and digit belongs to some token, so the pieces between
    matches and the matches make up the text, and offsets are running sums,
    taken within the row: nothing is exchanged or sorted.
    """
    cut = df.where(F.col(text_col).isNotNull()).select(*[F.col(k).alias(k) for k in keys], tokens(F.col(text_col)).alias("surface"), F.split(F.col(text_col), TOKEN, -1).alias("gap"))
    cut = cut.withColumn("gap", F.slice("gap", F.lit(1), F.size("surface")))
    return cut.withColumn("end", running_sums(F.zip_with("surface", "gap", lambda t, g: F.length(t) + F.length(g))))


def token_table(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A row for each token: keys, pos (from 1), surface, term, start, end, gap (what lies before it).

    ``keys`` must identify a text. Null texts have no tokens.
    """
    # not posexplode, for which Spark makes the array once more to see whether it is empty
    own = F.arrays_zip("surface", "gap", "end")
    rows = token_arrays(df, keys, text_col).select(*keys, F.posexplode_outer(own).alias("pos", "t")).where("t IS NOT NULL")
    placed = rows.select(*keys, (F.col("pos") + 1).alias("pos"), "t.surface", "t.gap", "t.end")
    return placed.select(*keys, "pos", "surface", normalize(F.col("surface")).alias("term"), (F.col("end") - F.length("surface")).alias("start"), "end", "gap")


def compound_parts(surface: Column) -> Column:
    """Parts of a compound as (term, from, to), offsets within the token; hyphens are dropped."""
    start = F.struct(F.array().cast("array<struct<term:string,from:int,to:int>>").alias("parts"), F.lit(0).alias("at"))

    def step(state: Column, piece: Column) -> Column:
        end = (state["at"] + F.length(piece)).cast("int")
        part = F.array(F.struct(normalize(piece).alias("term"), state["at"].alias("from"), end.alias("to")))
        return F.struct(F.when(piece.rlike(rf"^{HYPHEN}?$"), state["parts"]).otherwise(F.concat(state["parts"], part)).alias("parts"), end.alias("at"))

    return F.aggregate(F.split(surface, _PIECES), start, step, lambda s: s["parts"])


def relevance_words(df: DataFrame, keys: list[str], text_col: str = "text", components: bool = True) -> DataFrame:
    """(keys, words): the terms that ``relevance_tokens`` finds in each text that isn't null, as one array.

    A token's neighbours are looked up in its own text's arrays, so nothing is
    exchanged, sorted or made a row. Only tokens with digits or hyphens are
    taken apart, and only lone letters look at their neighbours.
    """
    texts = df.where(F.col(text_col).isNotNull()).select(*keys, tokens(F.col(text_col)).alias("all"), F.split(F.col(text_col), TOKEN, -1).alias("gaps")).withColumn("own", F.transform("all", normalize))
    none = F.array().cast("array<string>")
    stop = lambda p: p.isin(list(SEARCH_STOPWORDS))

    def named_once(value: Column, use) -> Column:
        """``use`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def with_parts(parts: Column, telling: Column) -> Column:
        whole = F.array(F.array_join(parts, "-"))
        return F.when(F.size(parts) > 1, F.concat(whole, telling)).otherwise(whole) if components else whole

    def emitted(term: Column, i: Column) -> Column:
        before, after = F.get("own", i - 1), F.get("own", i + 1)
        named = F.lit(False)
        for word, letters in LETTER_CONTEXTS.items():
            named = named | ((before == word) & term.isin(list(letters)))
        cell = term.isin(list(CELL_LETTERS)) & after.isin(list(CELL_WORDS))
        protected = F.coalesce((named & F.get("gaps", i).rlike(ALL_SPACE)) | (cell & F.get("gaps", i + 1).rlike(ALL_SPACE)), F.lit(False))
        parts = F.transform(F.filter(F.split(F.get("all", i), _PIECES), lambda p: ~p.rlike(rf"^{HYPHEN}?$")), normalize)
        several = named_once(parts, lambda ps: named_once(F.filter(ps, lambda p: ~stop(p) & ~isolated_letter(p)), lambda telling: F.when(F.size(telling) == 0, none).otherwise(with_parts(ps, telling))))
        lone = F.when(~isolated_letter(term) & ~stop(term), F.array(term)).when(protected, F.array(term)).otherwise(none)
        return F.when(term.rlike(r"-|\p{N}") & (F.length(term) > 1), several).when(F.length(term) == 1, lone).when(stop(term), none).otherwise(F.array(term))

    return texts.select(*keys, F.flatten(F.transform("own", emitted)).alias("words"))


def relevance_occurrences(df: DataFrame, keys: list[str], text_col: str = "text", components: bool = True) -> DataFrame:
    """(keys, term) for each term that ``relevance_tokens`` finds, without its place."""
    return relevance_words(df, keys, text_col, components).select(*keys, F.explode_outer("words").alias("term")).where("term IS NOT NULL")


def relevance_tokens(token_rows: DataFrame, keys: list[str], components: bool = True) -> DataFrame:
    """Terms for relevance search from a ``token_table``: keys, pos, term, start, end.

    A compound is one term, its parts joined by hyphens, so that IL6 and IL-6
    are the same; with ``components`` (documents, not queries) its telling
    parts are terms as well. A token without a telling part, one that is
    neither a stopword nor a lone letter, is left out, unless a neighbour makes
    a lone letter a name (vitamin C, T cell). Within a token a term is emitted
    once for each place.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    before, after = F.lag("term").over(order), F.lead("term").over(order)
    spaced, spaced_after = F.col("gap").rlike(ALL_SPACE), F.lead("gap").over(order).rlike(ALL_SPACE)
    named = F.lit(False)
    for word, letters in LETTER_CONTEXTS.items():
        named = named | ((before == word) & F.col("term").isin(list(letters)))
    cell = F.col("term").isin(list(CELL_LETTERS)) & after.isin(list(CELL_WORDS))
    marked = token_rows.withColumn("protected", F.coalesce((named & spaced) | (cell & spaced_after), F.lit(False))).withColumn("parts", compound_parts(F.col("surface")))
    telling = F.filter("parts", lambda p: ~p["term"].isin(list(SEARCH_STOPWORDS)) & ~isolated_letter(p["term"]))
    whole = F.array(F.struct(F.array_join(F.transform("parts", lambda p: p["term"]), "-").alias("term"), F.lit(0).alias("from"), F.length("surface").alias("to")))
    emitted = F.when((F.size("parts") > 1) & F.lit(components), F.concat(whole, F.col("telling"))).otherwise(whole)
    kept = marked.withColumn("telling", telling).where(F.col("protected") | (F.size("telling") > 0))
    rows = kept.select(*keys, "pos", "start", F.explode(F.array_distinct(emitted)).alias("t"))
    return rows.select(*keys, "pos", F.col("t.term").alias("term"), (F.col("start") + F.col("t.from")).alias("start"), (F.col("start") + F.col("t.to")).alias("end"))

