"""Measures: judged decisions, sentence boundaries, ranking sensitivity, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .index import Index, joined_terms
from .search import asked_postings, known_terms

# Idf formulas that a ranking is compared under, by name; n and df are counts.
WEIGHTINGS = {
    "legacy": lambda n, df: F.log((n + 1.0) / (df + 1.0)) + 1.0,
    "unsmoothed_ln": lambda n, df: F.log(n / df),
    "idf_base_only": lambda n, df: F.log10(n / df),
    "lecture_log10": lambda n, df: F.log10(n / df),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall(rows: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 by group; 0 where a denominator is 0."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    g = rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*by, "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


def boundary_scores(rows: DataFrame, predicted_col: str, actual_col: str, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and the count error of sets of boundaries (arrays of offsets), summed by group."""
    both = F.size(F.array_intersect(predicted_col, actual_col))
    g = rows.groupBy(*by).agg(
        F.sum(both).alias("tp"), F.sum(F.size(F.array_except(predicted_col, actual_col))).alias("fp"), F.sum(F.size(F.array_except(actual_col, predicted_col))).alias("fn"),
        F.sum(F.abs(F.size(predicted_col) - F.size(actual_col))).alias("count_error"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*by, "tp", "fp", "fn", "count_error", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


def weighting_profiles(index: Index, terms: DataFrame, top: int = 10, id_col: str = "query_id") -> DataFrame:
    """Each query's ``top`` documents under every weighting: query, weighting, rank, doc, score.

    A logarithm's base belongs to a weighting as a whole: log10 weightings also
    take log10 of term frequencies.
    """
    n = F.lit(float(index.n_documents))
    names = list(WEIGHTINGS)
    idf = [WEIGHTINGS[w](n, F.col("df").cast("double")) for w in names]
    w = [(F.lit(1.0) + (F.log10 if name == "lecture_log10" else F.log)(F.col("tf").cast("double"))) * x for name, x in zip(names, idf, strict=True)]
    # all weightings at once: postings are read for the norms, and those of the query's terms for the scores
    norms = joined_terms(index.postings.select("term", index.doc_col, "tf"), index.idf.select("term", "df")).groupBy(index.doc_col).agg(*[F.sqrt(F.sum(x * x)).alias(f"norm_{i}") for i, x in enumerate(w)])
    q = materialise(known_terms(index, terms, id_col), "weighted-terms")
    q_norms = q.groupBy(id_col).agg(*[F.sqrt(F.sum(x * x)).alias(f"q_{i}") for i, x in enumerate(idf)])
    dots = asked_postings(index, q).groupBy(id_col, index.doc_col).agg(*[F.sum(x * y).alias(f"dot_{i}") for i, (x, y) in enumerate(zip(idf, w, strict=True))])

    def score(i: int) -> Column:
        under = F.col(f"q_{i}") * F.col(f"norm_{i}")
        return F.when(under > 0, F.least(F.lit(1.0), F.col(f"dot_{i}") / under)).otherwise(F.lit(0.0))

    each = F.explode(F.array(*[F.struct(F.lit(name).alias("weighting"), score(i).alias("score")) for i, name in enumerate(names)]))
    scored = dots.join(q_norms, id_col).join(norms, index.doc_col).select(id_col, index.doc_col, each.alias("x")).select(id_col, "x.weighting", index.doc_col, "x.score")
    rank = F.row_number().over(Window.partitionBy(id_col, "weighting").orderBy(F.round("score", 9).desc(), index.doc_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(id_col, "weighting", "rank", index.doc_col, "score")


def ranking_overlap(profiles: DataFrame, base: str = "legacy", id_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """How many documents each weighting's list shares with the base's: query, weighting, overlap."""
    b = profiles.where(F.col("weighting") == base).select(id_col, doc_col)
    return profiles.join(b.withColumn("hit", F.lit(1)), [id_col, doc_col], "left").groupBy(id_col, "weighting").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("overlap"))


def latest_by_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log: one aggregate, no sort."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


def status_counts(rows: DataFrame, status_col: str = "status") -> DataFrame:
    return rows.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))


def only_in(left: DataFrame, right: DataFrame, col: str = "term") -> DataFrame:
    """Distinct values of ``left`` that ``right`` lacks."""
    return left.select(col).distinct().join(right.select(col).distinct(), col, "left_anti")


def timings(rows: DataFrame, by: list[str], col: str = "ms") -> DataFrame:
    """Samples, median and 95th percentile of durations; the latter is the sample at place int(0.95 n), counted from 1.

    Read from how often each duration occurs, so a group is never in one value.
    """
    counted = rows.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*by)
    upto = counted.withColumn("upto", F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("samples", F.sum("n").over(own))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("value")))
    n = F.col("samples")
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    return upto.groupBy(*by, "samples").agg(middle.alias("median"), at(F.greatest(F.lit(1), F.floor(n * 0.95))).alias("p95"))


def term_contributions(index: Index, terms: DataFrame, documents: DataFrame, id_col: str = "query_id") -> DataFrame:
    """What each term adds to the cosine of given (query, doc) pairs: query, doc, term, tf, df, idf, contribution."""
    weighted = terms.select(id_col, "term").distinct().join(index.idf, "term")
    q_norm = weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("q_norm"))
    pairs = documents.select(id_col, index.doc_col).distinct().join(weighted, id_col).join(q_norm, id_col).join(index.norms, index.doc_col)
    hits = pairs.join(index.postings.select("term", index.doc_col, "tf"), ["term", index.doc_col], "left")
    part = F.when(F.col("tf").isNotNull(), (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf") * F.col("idf") / (F.col("q_norm") * F.col("norm"))).otherwise(F.lit(0.0))
    return hits.select(id_col, index.doc_col, "term", F.coalesce("tf", F.lit(0)).alias("tf"), "df", "idf", part.alias("contribution"))
