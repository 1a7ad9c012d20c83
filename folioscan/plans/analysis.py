"""Corpus analysis under four preprocessing conditions.

A: white-space tokens; B: word tokens; C: B without stopwords; D: C stemmed.
One pass over the texts counts terms and stems within each row, so that a text
gives one row for each distinct term, and these are summed up in one exchange
by term. C is a filter of B's counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import porter, text
from ..functions.counts import counted_kinds, distinct_stems
from ..functions.vocabulary import ANALYSIS_STOPWORDS, REPRESENTATIVE_TERMS, SELECTED_DOMAIN_TERMS
from ..storage import materialise

SEGMENTS = ("head", "middle", "tail")
#: Rank segments hold terms in their order, so ranking is cut at frequency classes of this many terms at most per sort.
QUANTILES = (0.01, 0.03, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.75, 1.0)


#: Terms that share their stem, up to which they are broadcast with their stems (some 40 bytes each); beyond, a shuffle join.
BROADCAST_TERMS = 500_000


def _kinds(conditions: tuple[str, ...]) -> list[str]:
    """The token conditions that ``conditions`` are made from."""
    for c in conditions:
        if c not in text.CONDITIONS:
            raise ValueError(f"unknown condition: {c!r}")
    return [k for k in ("A", "B") if k in conditions or (k == "B" and {"C", "D"} & set(conditions))]


def document_terms(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", conditions: tuple[str, ...] = text.CONDITIONS) -> DataFrame:
    """(condition, doc, term, tf)."""
    kinds = _kinds(conditions)
    raw = docs.select(doc_col, F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), text.condition_terms(F.col(text_col), k).alias("terms")) for k in kinds])).alias("c"))
    counted = raw.select(F.col("c.condition").alias("condition"), doc_col, F.explode("c.terms").alias("term")).groupBy("condition", doc_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    parts = []
    if set(kinds) & set(conditions):
        parts.append(counted.where(F.col("condition").isin(*conditions)))
    if {"C", "D"} & set(conditions):
        c = counted.where((F.col("condition") == "B") & ~F.col("term").isin(list(ANALYSIS_STOPWORDS))).withColumn("condition", F.lit("C"))
        if "C" in conditions:
            parts.append(c)
        if "D" in conditions:
            parts.append(porter.stemmed(c).groupBy(doc_col, "term").agg(F.sum("tf").alias("tf")).select(F.lit("D").alias("condition"), doc_col, "term", "tf"))
    return reduce(DataFrame.unionByName, parts)


def _shared_stems(vocabulary: DataFrame) -> DataFrame:
    """(term, stem) of the terms of ``vocabulary`` (term, stem) whose stem is another term's as well; broadcast if they are few."""
    several = vocabulary.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stem")
    shared = materialise(vocabulary.select("term", "stem").join(several, "stem", "left_semi"), "shared-stems")
    return F.broadcast(shared) if shared.count() <= BROADCAST_TERMS else shared


def _in_exact_form(counted: DataFrame, own: DataFrame, kinds: tuple[str, ...], doc_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Counts under the composed and fully folded forms of their terms, and (term, exact) of the terms that have another; None if none has.

    Only distinct terms beyond ASCII are looked at. Where terms become one, the
    documents that hold any of them are counted anew.
    """
    forms = materialise(text.exact_forms(counted), "exact-forms")
    if forms.isEmpty():
        return counted, None
    few = F.broadcast(forms) if forms.count() <= BROADCAST_TERMS else forms
    named = materialise(counted.join(few, "term", "left").withColumn("to", F.coalesce("exact", "term")), "named-counts")
    several = named.groupBy("condition", "to").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("condition", "to")
    shared = materialise(named.join(several, ["condition", "to"], "left_semi").select("condition", "term", "to"), "shared-forms")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_TERMS else shared
    rows = own.select(doc_col, F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.array_distinct(k).alias("terms")) for k in kinds])).alias("x")).select(doc_col, "x.condition", F.explode("x.terms").alias("term"))
    held = rows.join(shared, ["condition", "term"]).select("condition", "to", doc_col).distinct().groupBy("condition", "to").agg(F.count(F.lit(1)).alias("held"))
    merged = named.groupBy("condition", "to").agg(F.sum("cf").alias("cf"), F.max("df").alias("df")).join(held, ["condition", "to"], "left")
    return materialise(merged.select("condition", F.col("to").alias("term"), "cf", F.coalesce("held", "df").alias("df")), "exact-counts"), few


def _row_counts(docs: DataFrame, kinds: list[str], text_col: str, conditions: tuple[str, ...]) -> DataFrame:
    """(condition, term, cf, df), from terms that were counted and stemmed within their row: a text gives one row for each of its distinct terms, whatever the conditions."""
    none = F.array().cast("array<string>")
    lists = docs.select(text.normalize(F.col(text_col)).alias("t")).select(
        (text.whitespace_tokens(F.col("t")) if "A" in kinds else none).alias("a"), (text.tokens(F.col("t")) if "B" in kinds else none).alias("b")
    )
    stems = text.without_stopwords(F.col("b")) if "D" in conditions else none
    rows = counted_kinds(lists.withColumn("d", stems), "a", "b", "d")
    summed = materialise(rows.groupBy("term").agg(*[f for k in "abd" for f in (F.sum(k).alias(k), F.count_if(F.col(k) > 0).alias(f"{k}_df"))]), "term-counts")
    stop = F.col("term").isin(list(ANALYSIS_STOPWORDS))
    of = {"A": ("a", F.lit(True)), "B": ("b", F.lit(True)), "C": ("b", ~stop), "D": ("d", F.lit(True))}
    each = [F.when((F.col(k) > 0) & held, F.struct(F.lit(c).alias("condition"), F.col(k).alias("cf"), F.col(f"{k}_df").alias("df"))) for c, (k, held) in of.items() if c in conditions]
    return summed.select("term", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select("x.condition", "term", "x.cf", "x.df")


def corpus_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", conditions: tuple[str, ...] = text.CONDITIONS, exact: bool = False) -> DataFrame:
    """(condition, term, cf, df) of all documents, written once; ``docs`` has a row for each document.

    With ``exact`` terms are composed and folded in full, for texts that may
    hold decomposed letters or letters whose folding is special.
    """
    kinds = _kinds(conditions)
    if not exact:
        return _row_counts(docs, kinds, text_col, conditions)
    # columns of their own, so that a text is cut once for each condition
    own = docs.select(doc_col, *[text.condition_terms(F.col(text_col), k).alias(k) for k in kinds])
    one = lambda k, terms, cf, df: F.struct(F.lit(k).alias("condition"), terms.alias("terms"), F.lit(cf).alias("cf"), F.lit(df).alias("df"))
    lists = own.select(F.explode(F.array(*[x for k in kinds for x in (one(k, F.col(k), 1, 0), one(k, F.array_distinct(k), 0, 1))])).alias("x"))
    rows = lists.select("x.condition", F.explode("x.terms").alias("term"), "x.cf", "x.df")
    counted = materialise(rows.groupBy("condition", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), "term-counts")
    forms = None
    if exact:
        counted, forms = _in_exact_form(counted, own, kinds, doc_col)
    if not {"C", "D"} & set(conditions):
        return counted
    c = counted.where((F.col("condition") == "B") & ~F.col("term").isin(list(ANALYSIS_STOPWORDS))).withColumn("condition", F.lit("C"))
    parts = [counted.where(F.col("condition").isin(*conditions)), *([c] if "C" in conditions else [])]
    if "D" in conditions:
        vocabulary = materialise(porter.stems(c), "stems")
        shared = _shared_stems(vocabulary)
        terms = own.select(doc_col, F.explode(F.array_distinct("B")).alias("term"))
        if forms is not None:
            terms = terms.join(forms, "term", "left").select(doc_col, F.coalesce("exact", "term").alias("term"))
        held = terms.join(shared, "term").select("stem", doc_col).distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("held"))
        by_stem = vocabulary.groupBy("stem").agg(F.sum("cf").alias("cf"), F.max("df").alias("df")).join(held, "stem", "left")
        parts.append(materialise(by_stem.select(F.lit("D").alias("condition"), F.col("stem").alias("term"), "cf", F.coalesce("held", "df").alias("df")), "stem-counts"))
    return reduce(DataFrame.unionByName, parts)


def term_counts(terms: DataFrame) -> DataFrame:
    """(condition, term, cf, df) from document terms."""
    return terms.groupBy("condition", "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def ranked_terms(counts: DataFrame, n_documents: int, with_size: bool = False) -> DataFrame:
    """(condition, rank, term, cf, df, idf): ranks from 1 by falling cf, then term; idf is log10(N / df).

    Ranks are exact without sorting all terms in one task: terms of one
    frequency and one beginning are numbered apart, and how many come before
    such a group is a running sum over the groups. ``with_size`` adds v, the
    number of the condition's terms.
    """
    keyed = counts.withColumn("part", F.substring("term", 1, 2))
    sizes = keyed.groupBy("condition", "cf", "part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("condition").orderBy(F.col("cf").desc(), "part")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("condition", "cf", "part", before.alias("offset"), F.sum("n").over(Window.partitionBy("condition")).alias("v"))
    own = F.row_number().over(Window.partitionBy("condition", "cf", "part").orderBy("term"))
    ranked = keyed.withColumn("own", own).join(offsets, ["condition", "cf", "part"])
    more = ["v"] if with_size else []
    return ranked.select("condition", (F.col("offset") + F.col("own")).alias("rank"), "term", "cf", "df", F.log10(F.lit(float(n_documents)) / F.col("df")).alias("idf"), *more)


def document_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", conditions: tuple[str, ...] = text.CONDITIONS) -> DataFrame:
    """(condition, doc, tokens, unique_terms) of every document, zeros included.

    Counted and stemmed within the row: nothing is exchanged.
    """
    kinds = _kinds(conditions)
    size = lambda x: F.greatest(F.size(x), F.lit(0)).cast("long")
    own = docs.select(doc_col, text.normalize(F.col(text_col)).alias("t")).select(doc_col, *[(text.whitespace_tokens(F.col("t")) if k == "A" else text.tokens(F.col("t"))).alias(k) for k in kinds])
    if {"C", "D"} & set(conditions):
        own = own.withColumn("C", text.without_stopwords(F.col("B")))
    unique = lambda c: distinct_stems(F.col("C")) if c == "D" else size(F.array_distinct(c))
    sizes = own.select(doc_col, *[x for c in conditions for x in (size(F.col("C" if c == "D" else c)).alias(f"n_{c}"), unique(c).alias(f"u_{c}"))])
    one = lambda c: F.struct(F.lit(c).alias("condition"), F.col(f"n_{c}").alias("tokens"), F.col(f"u_{c}").alias("unique_terms"))
    return sizes.select(doc_col, F.explode(F.array(*map(one, conditions))).alias("x")).select("x.condition", doc_col, "x.tokens", "x.unique_terms")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def summaries(ranked: DataFrame, n_documents: int) -> DataFrame:
    """A row for each condition: sizes, singletons and the share of the ten most frequent terms."""
    s = ranked.groupBy("condition").agg(
        F.sum("cf").alias("tokens"), F.count(F.lit(1)).alias("unique_terms"), F.count_if(F.col("cf") == 1).alias("singleton_terms"),
        F.sum(F.when(F.col("rank") <= 10, F.col("cf")).otherwise(0)).alias("top10"), F.sum("df").alias("postings_entries"),
    )
    return s.select(
        "condition", F.lit(n_documents).cast("long").alias("documents"), "tokens", "unique_terms", (F.col("tokens") / F.lit(float(n_documents))).alias("average_tokens_per_document"), "singleton_terms",
        _share(F.col("singleton_terms"), F.col("unique_terms")).alias("singleton_ratio"), _share(F.col("singleton_terms"), F.col("tokens")).alias("singleton_token_share"), _share(F.col("top10"), F.col("tokens")).alias("top10_token_share"), "postings_entries",
    )


def segment_bounds(size: Column) -> tuple[Column, Column]:
    """Last ranks of the head (1 %) and of the middle (10 %), with at least two points each where there are enough."""
    head = F.least(size, F.greatest(F.lit(2), F.floor(size / 100)))
    middle = F.least(size, F.greatest(head + 2, F.floor(size / 10)))
    return head, F.when(size >= 6, F.least(middle, size - 2)).otherwise(middle)


def fits(points: DataFrame, keys: list[str], rank_col: str = "rank", cf_col: str = "cf") -> DataFrame:
    """Ordinary least squares of log10(cf) on log10(rank) by ``keys``; undefined statistics are null and status says why."""
    p = points.select(*keys, F.col(rank_col).alias("rank"), F.log10(rank_col).alias("x"), F.log10(cf_col).alias("y"))
    g = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.min("rank").alias("rank_start"), F.max("rank").alias("rank_end"), F.expr("regr_sxx(y, x)").alias("sxx"), F.expr("regr_syy(y, x)").alias("syy"), F.expr("regr_sxy(y, x)").alias("sxy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    status = F.when(F.col("points") < 2, "insufficient_points").when(F.col("x0") == F.col("x1"), "constant_rank").when(F.col("y0") == F.col("y1"), "constant_frequency").otherwise("ok")
    g = g.withColumn("status", status).withColumn("b", F.when(status == "ok", F.col("sxy") / F.col("sxx")).when(status == "constant_frequency", F.lit(0.0)))
    good = F.col("status") == "ok"
    flat = F.col("status") == "constant_frequency"
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return g.select(
        *keys, "points", "rank_start", "rank_end", F.col("b").alias("slope"), F.when(flat, F.col("y0")).when(good, F.col("my") - F.col("b") * F.col("mx")).alias("intercept"), F.when(flat, F.lit(0.0)).otherwise(-F.col("b")).alias("zipf_exponent"),
        F.when(good, 1 - left / F.col("syy")).alias("r_squared"), F.when(flat, F.lit(0.0)).when(good, F.sqrt(left / F.col("points"))).alias("rmse"), "status",
    )


def zipf_fits(ranked: DataFrame) -> DataFrame:
    """(condition, segment, fit): over all ranks and over head, middle and tail. Give ``ranked`` its sizes to have it read once."""
    if "v" not in ranked.columns:
        ranked = ranked.join(F.broadcast(ranked.groupBy("condition").agg(F.count(F.lit(1)).alias("v"))), "condition")
    head, middle = segment_bounds(F.col("v"))
    segment = F.when(F.col("rank") <= head, "head").when(F.col("rank") <= middle, "middle").otherwise("tail")
    rows = ranked.select("condition", "rank", "cf", F.explode(F.array(F.lit("all"), segment)).alias("segment"))
    return fits(rows, ["condition", "segment"])


def best_segments(fit_rows: DataFrame) -> DataFrame:
    """(condition, best, status): the segments with both the largest r_squared and the smallest rmse, if any."""
    valid = (F.col("segment") != "all") & F.col("r_squared").isNotNull() & F.col("rmse").isNotNull()
    by = Window.partitionBy("condition")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    marked = fit_rows.withColumn("valid", valid).withColumns({"top": F.max(F.when(F.col("valid"), F.col("r_squared"))).over(by), "low": F.min(F.when(F.col("valid"), F.col("rmse"))).over(by)})
    best = F.col("valid") & near(F.col("r_squared"), F.col("top")) & near(F.col("rmse"), F.col("low"))
    found = marked.groupBy("condition").agg(F.array_join(F.sort_array(F.collect_list(F.when(best, F.col("segment")))), ",").alias("best"), F.count_if("valid").alias("n"))
    return found.select("condition", "best", F.when(F.col("n") == 0, "insufficient").when(F.col("best") == "", "mixed").otherwise("agreed").alias("status"))


def bubbles(ranked: DataFrame, coordinates: list[str]) -> DataFrame:
    """Terms merged by equal coordinates: how many, their idf and the first five by rank.

    Only a group's five smallest ranks are carried: they are found in each
    partition's part of the group first.
    """
    first = Window.partitionBy("condition", *coordinates).orderBy("rank")
    named = ranked.withColumn("own", F.row_number().over(first)).where("own <= 5").groupBy("condition", *coordinates).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("own", "term"))), lambda x: x["term"]), "、").alias("examples"))
    return ranked.groupBy("condition", *coordinates).agg(F.count(F.lit(1)).alias("term_count"), F.min("idf").alias("idf")).join(named, ["condition", *coordinates])


def selected_terms(ranked_b: DataFrame, n_documents: int) -> DataFrame:
    """Terms that span the frequencies: the ten first, the quantiles, the domain's, and more from the top up to twenty."""
    v = ranked_b.agg(F.count(F.lit(1)).alias("v"))
    picks = F.array(*[F.greatest(F.lit(1), F.ceil(F.col("v") * q)) for q in QUANTILES])
    marked = ranked_b.join(F.broadcast(v)).withColumn("picked", (F.col("rank") <= 10) | F.array_contains(picks, F.col("rank")) | F.col("term").isin(list(SELECTED_DOMAIN_TERMS)))
    # to reach twenty, the first unpicked ranks come in; they lie among the first twenty unpicked
    few = marked.where("picked").unionByName(marked.where("NOT picked").orderBy("rank").limit(20))
    fill = Window.partitionBy("picked").orderBy("rank")
    ready = few.withColumn("place", F.row_number().over(fill)).join(F.broadcast(marked.where("picked").agg(F.count(F.lit(1)).alias("n"))))
    kept = ready.where(F.col("picked") | (F.col("place") <= 20 - F.col("n")))
    return kept.select("condition", "rank", "term", "cf", "df", "idf", (F.col("df") / F.lit(float(n_documents))).alias("coverage"), (F.col("cf") / F.col("df")).alias("occurrences_per_document"))


def representative_terms(selected: DataFrame, limit: int = 12) -> DataFrame:
    """The preferred terms that were selected, then others by rank, up to ``limit``; in order of idf and term."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in REPRESENTATIVE_TERMS]), F.col("term")), F.lit(0))
    keyed = selected.withColumn("preferred", F.when(order == 0, F.lit(1000)).otherwise(order))
    return keyed.orderBy("preferred", "rank").limit(limit).drop("preferred").orderBy("idf", "term")


def comparison_rows(summary: DataFrame) -> DataFrame:
    """(condition, metric, value) of the sizes that conditions are compared by."""
    return summary.unpivot("condition", ["tokens", "unique_terms", "postings_entries"], "metric", "value")


def validated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` after checks that fail the job: ids are positive whole numbers and unique, texts not blank."""
    by = Window.partitionBy(id_col)
    checked = docs.withColumn("__n", F.count(F.lit(1)).over(by))
    bad = F.when(~F.coalesce(F.col(id_col).cast("string").rlike("^[1-9][0-9]*$"), F.lit(False)), F.lit("invalid identifier")).when(F.col("__n") > 1, F.lit("duplicate identifier")).when(~F.coalesce(F.col(text_col).rlike("(?U)[^\\s\\x1c-\\x1f]"), F.lit(False)), F.lit("blank text"))
    return checked.where(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def curve_points(fit_rows: DataFrame, keys: list[str], samples: int = 161) -> DataFrame:
    """Points of the fitted lines at about ``samples`` ranks, evenly spaced in the logarithm: keys, rank, cf."""
    step = (F.log10("rank_end") - F.log10("rank_start")) / (samples - 1)
    ranks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.round(F.pow(F.lit(10.0), F.log10("rank_start") + step * i)).cast("long")))
    rows = fit_rows.where(F.col("slope").isNotNull()).select(*keys, "slope", "intercept", F.explode(ranks).alias("rank"))
    return rows.select(*keys, "rank", F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.log10("rank")).alias("cf"))
