"""Quality rules: base counts of every text, and lines that recur in a host's documents.

The method's verdict: lines are normalised and hashed, the distinct documents
of a host that hold each are counted, lines above the host's limit are
removed, and a document that loses too large a part of its words is rejected.
``judge`` gives the figures and ``clean`` the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, join_frequent, let, materialise, words_of
from .line_dedup import normalised

#: Words of a window whose repetition counts.
WINDOW = 8


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in ``n``-word windows that are found twice or more in ``words``, the first included.

    Windows are compared by a 64-bit hash. Sorting (hash, place) brings equal
    windows together, so the work is n log n in the text's length.
    """
    word_ids = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.transform(F.slice(h, 1, F.size(h) - (n - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def places(v: Column) -> Column:
        """Places of the windows that recur, ascending."""
        by_hash = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            by_hash,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])).alias("twice"))), lambda x: x["twice"]),
                    lambda x: x["i"],
                )
            ),
        )

    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(n)), F.lit(n))), F.lit(0), lambda a, x: a + x)
    some = lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(places(v), covered))
    return let(words, lambda w: F.when(F.size(w) < n + 1, F.lit(0)).otherwise(let(let(word_ids(w), windows), some))).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WORD_SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def _documents(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, text, tie (a hash of the text, by which equal ids are told apart)."""
    return docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))


def _line(x: Column) -> Column:
    """Hash and words of a line in its normal form; null for a line without a word."""
    return let(normalised(x), lambda n: F.when(n != "", F.struct(F.xxhash64(n).alias("line"), F.size(words_of(n)).alias("words"))))


def _lines(d: DataFrame) -> DataFrame:
    """id, host, tie, at, line, words of each line with a word."""
    rows = d.select("id", "host", "tie", F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _line)).alias("at", "l"))
    return rows.where(F.col("l").isNotNull()).select("id", "host", "tie", "at", "l.line", "l.words")


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(host, line) that more than ``min_docs`` distinct documents of the host hold; ``lines`` has id, host, tie and line.

    Exact copies under other ids are documents too; a row given twice is one.
    """
    return lines.select("host", "id", "tie", "line").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs).select("host", "line")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 5, max_loss: int = 30, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """Base counts and verdicts: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat``
    percent of them in repeated windows. kept: not failed, and the lines above
    their host's limit (``frequent_lines``) hold at most ``max_loss`` percent of
    the words: a text made of boilerplate beyond that is as poor as one that
    repeats itself, so both shares are the same by default. The limit is a
    number of documents, not a share of the host's, so that a large host has
    no more room for boilerplate than a small one.

    A null text has no words and fails. Rows without a host share one host.
    Repeated rows are judged alike and all returned; equal ids with different
    texts are told apart. Other columns are not read. An empty table gives no rows.
    """
    if id_col in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"):
        raise ValueError(f"the result has a column {id_col} of its own")
    d = _documents(docs, id_col, text_col, host_col)
    lines = _lines(d)
    limit = materialise(frequent_lines(lines, min_docs), "frequent-lines")
    # rows that are equal lose their lines together, so each line counts once, but as often as it stands in the text
    hit = join_frequent(lines, limit, ["host", "line"], F.xxhash64("id", "tie"))
    lost = hit.select("id", "tie", "host", "at", "words").distinct().groupBy("id", "tie", "host").agg(F.sum("words").alias("lost"))
    lost = lost.select(F.col("id").alias("l_id"), F.col("tie").alias("l_tie"), F.col("host").alias("l_host"), "lost")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counts = d.select("id", "host", "tie", *[c.alias(k) for k, c in base_counts(F.col("text")).items()])
    own = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in ("id", "tie", "host")]
    out = counts.join(lost, own, "left").withColumn("lost_words", F.coalesce("lost", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= max_loss * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", kept.alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 5, max_loss: int = 30, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """The documents that ``judge`` keeps, without the lines above their host's limit.

    Columns are those of ``docs``. The first lines go as well: a line that a
    host repeats is boilerplate everywhere. Null texts are never kept; see
    ``judge`` for equal ids, repeated rows and missing hosts.
    """
    d = _documents(docs, id_col, text_col, host_col)
    limit = materialise(frequent_lines(_lines(d), min_docs), "frequent-lines")
    gone = join_frequent(_lines(d), limit, ["host", "line"], F.xxhash64("id", "tie")).groupBy("id", "tie", "host").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("host").alias("__host"), "gone")
    own = F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(text_col).eqNullSafe(F.col("__tie")) & F.col(host_col).cast("string").eqNullSafe(F.col("__host"))
    pairs = F.arrays_zip(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("x"), F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), _line).alias("l"))
    split = let(F.coalesce("gone", F.array().cast("array<bigint>")), lambda g: F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), p["l"]["words"].alias("words"), F.coalesce(F.array_contains(g, p["l"]["line"]), F.lit(False)).alias("gone"))))
    lost = F.aggregate(F.filter("__split", lambda p: p["gone"]), F.lit(0).cast("long"), lambda n, p: n + p["words"])
    counts = base_counts(F.col(text_col))
    good = (F.col("__words") >= min_words) & (100 * F.col("__again") <= max_repeat * F.col("__words")) & (100 * lost <= max_loss * F.col("__words"))
    cut = docs.join(gone, own, "left").withColumns({"__split": split, "__words": counts["n_words"], "__again": counts["n_repeat_words"]}).where(good)
    left = F.array_join(F.transform(F.filter("__split", lambda p: ~p["gone"]), lambda p: p["x"]), "\n")
    return cut.select(*[left.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
