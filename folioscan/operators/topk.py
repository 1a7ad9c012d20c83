"""The best documents of each query without reading whole posting lists.

Beside the postings an index may keep *impacts*: each term's postings by
falling weight, cut into blocks that name their greatest weight, and
*vectors*, each document's weights together. A batch is then answered in three
steps, each of them joins and sums over all queries at once:

1. The first block of every query term gives some documents partial scores.
   The k-th best of them is a floor: no document below it can be among the best.
2. A level is set for each query and term so that a document whose every weight
   lies at or below its level stays under the floor. Further blocks are read if
   they are above the level, others are not. What a document may have besides bounds its score from above.
3. Documents whose bound reaches the k-th best partial score are scored in full
   from their vectors.

Weights are not negative, so partial scores never exceed the full ones, and
the result is that of scoring every posting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import dealt
from ..storage import discard, materialise

#: Postings of a block.
BLOCK = 128
#: Postings of a term that are sorted together; a longer list is dealt over several such lists by document.
SEGMENT = 16_384
#: Values up to which a lookup is pushed into the scan as equalities, which skip row groups; beyond, a join.
PUSHED = 200
#: Steps in which a weight doubles, in the outline of a term's list.
STEPS_PER_OCTAVE = 8
#: Parts of a score are added as whole numbers of so small a part of 1.
UNIT = float(1 << 60)
#: What levels may use of the floor: with less of it more postings are read, with more of it more documents are scored in full.
BUDGET = 0.8
#: Bounds and floors are sums in another order than scores; they may differ from these by so much.
SLACK = 1e-9


def any_of(column: str, values: list) -> Column:
    """Whether a column has one of a few values, as equalities: unlike a long ``isin`` they reach the scan's row groups."""
    tests = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _few(rows: DataFrame, column: str) -> list | None:
    """The distinct values of a column if there are at most ``PUSHED``."""
    found = [r[0] for r in rows.select(column).distinct().limit(PUSHED + 1).collect()]
    return found if len(found) <= PUSHED else None


def weights(postings: DataFrame, idf: DataFrame, norms: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(term, doc, df, weight) of each posting: what a document's unit vector has of the term."""
    weight = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf") / F.col("norm")
    return postings.select("term", doc_col, "tf").join(idf, "term").join(norms, doc_col).select("term", doc_col, "df", weight.alias("weight"))


def impacts(weighted: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(term, segment, block, n, top, docs, weights): a term's postings by falling weight in blocks of ``BLOCK``; top is a block's greatest weight."""
    dealt = weighted.withColumn("segment", F.pmod(F.xxhash64(doc_col), F.ceil(F.col("df") / SEGMENT)).cast("int"))
    lists = dealt.groupBy("term", "segment").agg(F.sort_array(F.collect_list(F.struct("weight", F.col(doc_col).alias("doc"))), asc=False).alias("p"))
    firsts = F.sequence(F.lit(1), F.size("p"), F.lit(BLOCK))
    cut = lists.select("term", "segment", F.posexplode(F.transform(firsts, lambda i: F.slice("p", i, F.lit(BLOCK)))).alias("block", "p"))
    return cut.select("term", "segment", "block", F.size("p").alias("n"), F.get("p", F.lit(0))["weight"].alias("top"), F.transform("p", lambda x: x["doc"]).alias("docs"), F.transform("p", lambda x: x["weight"]).alias("weights"))


def vectors(weighted: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, terms, weights) of each document with terms."""
    rows = weighted.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"))
    return rows.select(doc_col, F.transform("v", lambda x: x["term"]).alias("terms"), F.transform("v", lambda x: x["weight"]).alias("weights"))


def write_impacts(weighted: DataFrame, path: str, doc_col: str = "doc_id") -> None:
    """Writes both tables as they come out of their sums, a list or a document in one file, sorted so that few row groups hold what a lookup asks for."""
    impacts(weighted, doc_col).sortWithinPartitions("term", "block", "segment").write.mode("overwrite").parquet(f"{path}/impacts")
    vectors(weighted, doc_col).sortWithinPartitions(doc_col).write.mode("overwrite").parquet(f"{path}/vectors")


def _best(rows: DataFrame, k: int, id_col: str, by: str) -> DataFrame:
    """(query, floor): the k-th greatest value of each query; queries with fewer rows have none."""
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(by).desc()))
    return rows.select(id_col, by, place.alias("place")).where(F.col("place") <= k).groupBy(id_col).agg(F.min(by).alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(id_col, "floor")


def _postings_of(blocks: DataFrame, id_col: str, doc_col: str, *more: str) -> DataFrame:
    """A row for each posting of chosen blocks: query, doc, part of the score."""
    rows = blocks.select(id_col, "share", "weights", *more, F.posexplode("docs").alias("at", doc_col))
    return rows.select(id_col, doc_col, (F.col("share") * F.get("weights", F.col("at"))).alias("part"), *more)


def asked(terms: DataFrame, idf: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query, term, share): what each known term of a query has of its unit vector."""
    known = terms.select(id_col, "term").distinct().join(idf.select("term", "idf"), "term")
    norm = known.groupBy(id_col).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("q_norm"))
    return known.join(norm, id_col).select(id_col, "term", (F.col("idf") / F.col("q_norm")).alias("share"))


def outlines(stored: DataFrame) -> DataFrame:
    """(term, steps): how many postings lie beyond a term's first blocks at or below a weight.

    Steps (top, postings) stand for blocks of nearly one weight, so a term has
    some tens of them, however long its list.
    """
    step = F.floor(F.log2("top") * STEPS_PER_OCTAVE)
    per = stored.where("block > 0").groupBy("term", step.alias("step")).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    upto = F.sum("n").over(Window.partitionBy("term").orderBy("step"))
    return per.select("term", "top", upto.alias("postings")).groupBy("term").agg(F.collect_list(F.struct("top", "postings")).alias("steps"))


def levels(shares: DataFrame, heads: DataFrame, outline: DataFrame, k: int, id_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """(query, term, share, level), written: blocks beyond the first whose weights are at most the level needn't be read.

    With every weight at its term's level, the shares of a query's terms add
    up to ``BUDGET`` of the floor. Among such levels those are sought that leave
    out most postings: a price is put on what a level adds, each term takes the
    level that gains most at that price, and of a range of prices the best that
    stays within it is kept.
    """
    partial = _postings_of(heads, id_col, doc_col).groupBy(id_col, doc_col).agg(F.sum("part").alias("part"))
    floors = _best(partial, k, id_col, "part")
    priced = shares.join(outline, "term").withColumn("price", F.explode(F.array(*[F.lit(10.0 ** (i / 2)) for i in range(2, 17)])))
    none = F.struct(F.lit(0.0).alias("net"), F.lit(0.0).alias("cost"), F.lit(0).cast("bigint").alias("gain"), F.lit(-1.0).alias("level"))
    take = lambda x: F.struct((x["postings"] - F.col("price") * F.col("share") * x["top"]).alias("net"), (F.col("share") * x["top"]).alias("cost"), x["postings"].alias("gain"), x["top"].alias("level"))
    taken = materialise(dealt(priced).select(id_col, "term", "price", F.array_max(F.concat(F.array(none), F.transform("steps", take))).alias("t")).select(id_col, "term", "price", "t.*"), "level-choices")
    sums = taken.groupBy(id_col, "price").agg(F.sum("cost").alias("cost"), F.sum("gain").alias("gain")).join(floors, id_col)
    price = sums.where(F.col("cost") < F.col("floor") * BUDGET).groupBy(id_col).agg(F.max_by("price", "gain").alias("price"))
    chosen = taken.join(price, [id_col, "price"]).select(id_col, "term", "level")
    out = materialise(shares.join(chosen, [id_col, "term"], "left").select(id_col, "term", "share", F.coalesce("level", F.lit(-1.0)).alias("level")), "levels")
    discard(taken)
    return out


def best_documents(impact_rows: DataFrame, vector_rows: DataFrame, idf: DataFrame, terms: DataFrame, k: int, id_col: str = "query_id", doc_col: str = "doc_id", report: bool = False) -> DataFrame:
    """(query, doc, score) of documents among which each query's ``k`` best by cosine are, all ties with the last included.

    With ``report`` instead (query, postings, read): postings of the query's
    terms in all, and those of the blocks that are read.
    """
    shares = materialise(asked(terms, idf, id_col), "query-shares")
    words = _few(shares, "term")
    stored = impact_rows if words is None else impact_rows.where(any_of("term", words))
    heads = materialise(stored.where("block = 0").join(shares, "term"), "first-blocks")
    level = levels(shares, heads, outlines(stored), k, id_col, doc_col)
    weighed = stored.where("block > 0").join(level, "term")
    above = F.col("top") > F.col("level")
    if report:
        per = [F.sum("n").alias("n"), F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("read")]
        both = weighed.groupBy(id_col).agg(*per).unionByName(heads.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("n").alias("read")))
        return both.groupBy(id_col).agg(F.sum("n").alias("postings"), F.sum("read").alias("read"))
    # of what is not read, no weight is above the level or the greatest left
    rest = materialise(weighed.where(~above).groupBy(id_col, "term").agg(F.max(F.col("share") * F.col("top")).alias("rest")), "rests")
    unread = rest.groupBy(id_col).agg(F.sum("rest").alias("unread"))
    columns = [id_col, "term", "share", "docs", "weights"]
    chosen = heads.select(*columns).unionByName(weighed.where(above).select(*columns)).join(rest, [id_col, "term"], "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    seen = _postings_of(chosen, id_col, doc_col, "rest").groupBy(id_col, doc_col).agg(F.sum("part").alias("part"), F.sum("rest").alias("seen"))
    partial = materialise(seen, "partial-scores")
    floors = _best(partial, k, id_col, "part")
    bound = F.col("part") + F.coalesce("unread", F.lit(0.0)) - F.col("seen")
    able = partial.join(floors, id_col, "left").join(unread, id_col, "left").where(F.col("floor").isNull() | (bound >= F.col("floor") * (1 - SLACK))).select(id_col, doc_col)
    able = materialise(able, "able")
    for done in (heads, level, rest, partial):
        discard(done)
    ids = _few(able, doc_col)
    own = vector_rows if ids is None else vector_rows.where(any_of(doc_col, ids))
    full = own.join(able, doc_col).select(id_col, doc_col, "weights", F.posexplode("terms").alias("at", "term")).select(id_col, doc_col, "term", F.get("weights", F.col("at")).alias("weight")).join(shares, [id_col, "term"])
    # whole numbers add up to the same in any order, so equal documents have equal scores
    total = F.sum((F.col("share") * F.col("weight") * UNIT).cast("bigint")).cast("double") / UNIT
    return full.groupBy(id_col, doc_col).agg(F.least(F.lit(1.0), total).alias("score"))
