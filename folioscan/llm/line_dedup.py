"""Removal of lines that spread over many sites.

For each distinct line a HyperLogLog sketch of the sites that carry it is
built; sketches merge by aggregation, so the shuffle carries a small sketch a
line and task instead of its (line, site) pairs. Where a sketch's estimate is
near the limit, the line's sites are counted exactly. A line on enough
distinct sites is boilerplate and goes from every document but the first
that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_frequent, let, materialise

#: Registers of a sketch, as a power of 2: a relative standard error of 1.04 / sqrt(2**12), 1.6 %.
SKETCH_BITS = 12
#: Standard errors on either side of the limit within which an estimate isn't trusted.
TRUST = 6


def normalised(line: Column) -> Column:
    """What lines are compared by: ASCII white space at the ends dropped and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashes(text: Column) -> Column:
    """Hash of each line's normal form, in order; null for a line without a word.

    64 bits: a line that by chance shares the hash of one of 10 million
    boilerplate lines is expected once in some 10**12 distinct lines.
    """
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: let(normalised(x), lambda n: F.when(n != "", F.xxhash64(n))))


def spread_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: line (hash), first_id (smallest id that has it).

    A null site is no site. Exact whatever the sketches say, but for a line
    whose estimate is ``TRUST`` standard errors off.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(_hashes(F.col(text_col)))).alias("line")).where(F.col("line").isNotNull())
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"), F.min("id").alias("first_id"))
    error = TRUST * 1.04 / 2 ** (SKETCH_BITS / 2)
    counted = materialise(sketched.select("line", "first_id", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - error) - 1), "line-spread")
    sure = F.col("sites") > min_sites * (1 + error) + 1
    near = join_frequent(lines, counted.where(~sure).select("line"), ["line"], F.xxhash64("id")).where(F.col("site").isNotNull())
    exact = near.groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").count().where(F.col("count") >= min_sites)
    return counted.where(sure).select("line", "first_id").unionByName(counted.where(~sure).join(exact, "line", "left_semi").select("line", "first_id"))


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and n_lines and n_removed.

    A line that is on ``min_sites`` sites stays in the document with the
    smallest id that has it (all its occurrences there), so no line is lost
    from the corpus. A document with a null id is never that one; where only
    such documents have the line, it stays in all of them. Lines
    without a word are neither counted as boilerplate nor removed. A null text
    stays null. Documents are joined back by their id and text, so equal ids with
    different texts are told apart and repeated rows are all kept. n_lines
    counts lines with a word. Other columns are carried along; they must not
    be named n_lines or n_removed. An empty table gives no rows.
    """
    for name in ("n_lines", "n_removed"):
        if name in docs.columns:
            raise ValueError(f"the input has a column {name}")
    spread = materialise(spread_lines(docs, min_sites, id_col, text_col, site_col), "spread-lines")
    hashes = _hashes(F.col(text_col))
    where = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.explode(F.array_distinct(hashes)).alias("line")).where(F.col("line").isNotNull())
    gone = join_frequent(where, spread, ["line"], F.xxhash64("id", "tie")).where(~F.col("id").eqNullSafe(F.col("first_id"))).groupBy("id", "tie").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), "gone")
    # within a document the set of its removed lines is no larger than the document
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tie")), "left")
    pairs = F.arrays_zip(F.split(F.col(text_col), "\n", -1).alias("line"), hashes.alias("hash"))
    kept = let(F.coalesce("gone", F.array().cast("array<bigint>")), lambda g: let(pairs, lambda p: F.transform(F.filter(p, lambda x: x["hash"].isNull() | ~F.array_contains(g, x["hash"])), lambda x: x["line"])))
    text = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    cut = joined.withColumn("__text", text)
    n_kept = F.size(F.filter(F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return cut.select(*[F.col("__text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_lines - n_kept).cast("long").alias("n_removed"))
