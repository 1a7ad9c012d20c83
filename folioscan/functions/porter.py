"""Porter's stemmer (Program, 1980).

With the two departures of its author's own later version (bli, logi). The
measure of a stem is tested by regular expressions, as in the author's Perl
version. A vocabulary's distinct terms are stemmed, in Arrow batches, and
joined back; a chain of column expressions instead makes plans that take
longer to optimise than to run. The same rules as SQL serve as a cross-check.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_POSITIVE = f"^({_C})?{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_TWO = f"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Suffixes and what replaces them, of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _steps(match: str) -> list[str]:
    """SQL of each step over x; ``match`` is the template of a regular-expression test."""
    test = lambda x, p: match.format(x=x, p=p)
    stem = lambda n: f"substr(x, 1, length(x) - {n})"
    ends = lambda s: f"x LIKE '%{s}'"

    def longest(rules: dict[str, str], condition) -> str:
        """The longest suffix that fits decides, whether its condition holds or not."""
        cases = [f"WHEN {ends(s)} THEN CASE WHEN {condition(s)} THEN concat({stem(len(s))}, '{r}') ELSE x END" for s, r in sorted(rules.items(), key=lambda i: -len(i[0]))]
        return f"CASE {' '.join(cases)} ELSE x END"

    one_a = longest({"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda s: "TRUE")
    # a suffix that was cut is marked by a blank, for the step that repairs the stem
    one_b = (
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {test(stem(3), _POSITIVE)} THEN concat({stem(3)}, 'ee') ELSE x END "
        f"WHEN {ends('ed')} AND {test(stem(2), _VOWEL)} THEN concat({stem(2)}, ' ') WHEN {ends('ing')} AND {test(stem(3), _VOWEL)} THEN concat({stem(3)}, ' ') ELSE x END"
    )
    cut = "substr(x, 1, length(x) - 1)"
    repair = (
        f"CASE WHEN x NOT LIKE '% ' THEN x WHEN {test(cut, '(at|bl|iz)$')} THEN concat({cut}, 'e') "
        f"WHEN {test(cut, _DOUBLE)} THEN substr(x, 1, length(x) - 2) WHEN {test(cut, _ONE)} AND {test(cut, _SHORT)} THEN concat({cut}, 'e') ELSE {cut} END"
    )
    one_c = f"CASE WHEN {ends('y')} AND {test(stem(1), _VOWEL)} THEN concat({stem(1)}, 'i') ELSE x END"
    # the l of logi counts with the stem
    two = longest(STEP_2, lambda s: test(stem(3 if s == "logi" else len(s)), _POSITIVE))
    three = longest(STEP_3, lambda s: test(stem(len(s)), _POSITIVE))
    four = longest(dict.fromkeys(STEP_4, ""), lambda s: test(stem(len(s)), _TWO) + (f" AND {test(stem(3), '[st]$')}" if s == "ion" else ""))
    five_a = f"CASE WHEN {ends('e')} AND ({test(stem(1), _TWO)} OR ({test(stem(1), _ONE)} AND NOT {test(stem(1), _SHORT)})) THEN {stem(1)} ELSE x END"
    five_b = f"CASE WHEN {ends('ll')} AND {test(stem(1), _TWO)} THEN {stem(1)} ELSE x END"
    return [one_a, one_b, repair, one_c, two, three, four, five_a, five_b]


_RULES_2, _RULES_3, _RULES_4 = (sorted(r.items(), key=lambda i: -len(i[0])) for r in (STEP_2, STEP_3, dict.fromkeys(STEP_4, "")))
_PLAIN = re.compile("[A-Za-z]{3,}")
_is_positive, _is_one, _is_two, _has_vowel, _is_short, _is_double = (re.compile(p).search for p in (_POSITIVE, _ONE, _TWO, _VOWEL, _SHORT, _DOUBLE))


def _replaced(word: str, rules: list[tuple[str, str]], condition) -> str:
    """The longest suffix that fits decides, whether its condition holds or not."""
    for suffix, new in rules:
        if word.endswith(suffix):
            return word[: -len(suffix)] + new if condition(word, suffix) else word
    return word


def _past(word: str) -> str:
    """Step 1b: eed, ed and ing."""
    if word.endswith("eed"):
        return word[:-1] if _is_positive(word[:-3]) else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            stem = word[: -len(suffix)]
            if stem.endswith(("at", "bl", "iz")) or (_is_one(stem) and _is_short(stem) and not _is_double(stem)):
                return stem + "e"
            return stem[:-1] if _is_double(stem) else stem
    return word


def stem_word(term: str) -> str:
    """Stem of a normalised term; what isn't ASCII letters, or has at most two, stays."""
    if not _PLAIN.fullmatch(term):
        return term
    word = _replaced(term, [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")], lambda *_: True)
    word = _past(word)
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # the l of logi counts with the stem
    word = _replaced(word, _RULES_2, lambda w, s: _is_positive(w[: -3 if s == "logi" else -len(s)]))
    word = _replaced(word, _RULES_3, lambda w, s: _is_positive(w[: -len(s)]))
    word = _replaced(word, _RULES_4, lambda w, s: _is_two(w[: -len(s)]) and (s != "ion" or w[-4:-3] in ("s", "t")))
    stem = word[:-1]
    if word.endswith("e") and (_is_two(stem) or (_is_one(stem) and not _is_short(stem))):
        word = stem
    return word[:-1] if word.endswith("ll") and _is_two(word[:-1]) else word


@F.pandas_udf(T.StringType())
def stem_column(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem_word(t))


def stems(df: DataFrame, term_col: str = "term", out: str = "stem") -> DataFrame:
    """Adds the stem of every normalised term of a vocabulary."""
    return df.withColumn(out, stem_column(F.col(term_col)))


def stemmed(tokens: DataFrame, term_col: str = "term") -> DataFrame:
    """``tokens`` with ``term_col`` stemmed by way of the distinct terms: Python sees each once, and a join brings it back."""
    own = stems(tokens.select(term_col).distinct(), term_col, "__stem")
    rest = [F.col("__stem").alias(term_col) if c == term_col else F.col(c) for c in tokens.columns]
    return tokens.join(own, term_col).select(*rest)


def duckdb_sql(source: str, term_col: str, keep: str = "") -> str:
    """A SELECT with the stem of each row of ``source``, in the SQL of DuckDB; ``keep`` names further columns."""
    more = f", {keep}" if keep else ""
    sql = f"SELECT {term_col} AS term, {term_col} AS x{more} FROM {source}"
    for step in _steps("regexp_matches({x}, '{p}')"):
        sql = f"SELECT term, {step} AS x{more} FROM ({sql})"
    return f"SELECT term, CASE WHEN regexp_matches(term, '^[A-Za-z]{{3,}}$') THEN x ELSE term END AS stem{more} FROM ({sql})"
