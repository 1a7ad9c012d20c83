"""Exact phrases from pairs of neighbouring words.

A token row names the word after it, if nothing but white space lies between.
Stored in the order of (word, next word), such rows give the places of a pair
without a look at the other places of either word. A phrase is read from its
rarest pair; its other pairs only confirm what that one found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import discard, materialise
from .topk import PUSHED, any_of

#: Places of a rarest pair up to which they go to all tasks (some 50 bytes each); beyond, a shuffle join.
BROADCAST_PLACES = 200_000


def token_pairs(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos, term, next, start, end, next_end of each token; next is null where a sign follows, or nothing."""
    n = F.size("surface")
    shifted = text.token_arrays(df, keys, text_col).select(
        *keys, F.posexplode_outer(F.arrays_zip("surface", "end", F.slice("surface", F.lit(2), n).alias("after"), F.slice("gap", F.lit(2), n).alias("between"), F.slice("end", F.lit(2), n).alias("after_end"))).alias("pos", "t")
    )
    rows = shifted.where("t IS NOT NULL").select(*keys, (F.col("pos") + 1).alias("pos"), "t.*").withColumn("spaced", F.col("between").rlike(text.ALL_SPACE))
    follows = lambda x: F.when(F.col("spaced"), x)
    return rows.select(*keys, "pos", text.normalize(F.col("surface")).alias("term"), follows(text.normalize(F.col("after"))).alias("next"), (F.col("end") - F.length("surface")).alias("start"), "end", follows(F.col("after_end")).alias("next_end"))


def scanned_pairs(df: DataFrame, terms: DataFrame, keys: list[str], text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """The token pairs that stated phrases are made of, found by looking through every text once and written: what ``pair_matches`` reads of an index.

    For a batch that is asked once, which costs less than writing an index of
    all pairs. Pairs beyond ``BROADCAST_PLACES`` are met by a shuffle join.
    """
    asked = query_pairs(terms, id_col).select("term", "next").distinct()
    single = terms.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.first("term").alias("term")).where("n = 1").select("term", F.lit(None).cast("string").alias("next"))
    wanted = materialise(asked.unionByName(single.distinct()).select(F.col("term").alias("__term"), F.col("next").alias("__next")), "asked-pairs")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_PLACES else wanted
    met = (F.col("term") == F.col("__term")) & (F.col("__next").isNull() | (F.col("next") == F.col("__next")))
    return materialise(token_pairs(df, keys, text_col).join(few, met, "left_semi"), "scanned-pairs")


def write_pairs(rows: DataFrame, path: str, buckets: int) -> None:
    """Writes token pairs in the order of their words; the places of a very common pair are spread over files."""
    rest = [c for c in rows.columns if c not in ("term", "next")]
    # cutting by range looks at the rows twice, and texts should be cut once
    made = materialise(rows, "token-pairs")
    made.repartitionByRange(buckets, "term", "next", rest[0]).sortWithinPartitions("term", "next", rest[0]).write.mode("overwrite").parquet(path)
    discard(made)


def _either(pairs: list[tuple[str, str]]) -> Column:
    """Whether a row holds one of a few pairs, in a form that reaches the scan's row groups."""
    firsts = any_of("term", sorted({a for a, _ in pairs})) & any_of("next", sorted({b for _, b in pairs}))
    tests = [(F.col("term") == a) & (F.col("next") == b) for a, b in pairs]
    while len(tests) > 1:
        tests = [tests[i] if i + 1 == len(tests) else tests[i] | tests[i + 1] for i in range(0, len(tests), 2)]
    return firsts & tests[0] if tests else F.lit(False)


def query_pairs(terms: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query, ord, term, next, n) of each two neighbouring words of a phrase; n is how many words it has."""
    order = Window.partitionBy(id_col).orderBy("ord")
    rows = terms.select(id_col, "term", F.row_number().over(order).alias("ord"), F.lead("term").over(order).alias("next"), F.count(F.lit(1)).over(Window.partitionBy(id_col)).cast("int").alias("n"))
    return rows.where("next IS NOT NULL").select(id_col, "ord", "term", "next", "n")


def rarest(stored: DataFrame, asked: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query, rare, places) of the phrases all of whose pairs occur: the place of the rarest pair in the phrase.

    Reads the two columns of words alone, which lie in order and take next to no room.
    """
    counted = stored.select("term", "next").join(asked.select("term", "next").distinct(), ["term", "next"]).groupBy("term", "next").agg(F.count(F.lit(1)).alias("places"))
    per = asked.join(counted, ["term", "next"]).groupBy(id_col, "n").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("places", "ord")).alias("least"))
    return per.where("known = n - 1").select(id_col, F.col("least.ord").alias("rare"), F.col("least.places").alias("places"))


def pair_matches(pairs: DataFrame, terms: DataFrame, doc_col: str = "doc_id", block_col: str = "block_id", id_col: str = "query_id") -> DataFrame:
    """Places of exact phrases: query, doc, block, start, end, overlapping ones included.

    ``pairs`` is a table of ``token_pairs``, ``terms`` has the words of each query with ord.
    """
    places = [id_col, doc_col, block_col, "first"]
    sizes = terms.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    single = terms.join(sizes.where("n = 1"), id_col).select(id_col, "term")
    words = [r[0] for r in single.select("term").distinct().limit(PUSHED + 1).collect()]
    singly = None
    if words:
        own = pairs.where(any_of("term", words)) if len(words) <= PUSHED else pairs
        singly = own.join(single, "term").select(id_col, doc_col, block_col, "start", "end")
    asked = materialise(query_pairs(terms, id_col), "query-pairs")
    wanted = [tuple(r) for r in asked.select("term", "next").distinct().limit(PUSHED + 1).collect()]
    stored = pairs.where(_either(wanted)) if len(wanted) <= PUSHED else pairs.where("next IS NOT NULL")
    longer = asked.where("n > 2")
    chosen = asked.where("n = 2").select(id_col, F.lit(1).alias("rare"))
    if not longer.isEmpty():
        chosen = chosen.unionByName(rarest(stored, longer, id_col).select(id_col, "rare"))
    marked = materialise(asked.join(chosen, id_col).withColumn("is_rare", F.col("ord") == F.col("rare")), "chosen-pairs")

    def hits(which: DataFrame) -> DataFrame:
        own = stored.join(which.select(id_col, "ord", "n", "term", "next"), ["term", "next"])
        return own.select(id_col, doc_col, block_col, (F.col("pos") - F.col("ord")).alias("first"), "n", F.when(F.col("ord") == 1, F.col("start")).alias("start"), F.when(F.col("ord") == F.col("n") - 1, F.col("next_end")).alias("end"))

    found = hits(marked.where("is_rare"))
    two = found.where("n = 2").select(id_col, doc_col, block_col, "start", "end")
    out = two if singly is None else two.unionByName(singly)
    others = marked.where("n > 2 AND NOT is_rare")
    if others.isEmpty():
        return out
    found = materialise(found.where("n > 2"), "rarest-places")
    near = found.select(*places)
    near = F.broadcast(near) if near.count() <= BROADCAST_PLACES else near
    confirmed = hits(others).join(near, places, "left_semi")
    whole = found.unionByName(confirmed).groupBy(*places, "n").agg(F.count(F.lit(1)).alias("held"), F.max("start").alias("start"), F.max("end").alias("end"))
    return out.unionByName(whole.where("held = n - 1").select(id_col, doc_col, block_col, "start", "end"))
