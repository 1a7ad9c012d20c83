"""The positional inverted index: postings, inverse document frequencies and document norms, as tables.

Four variants of terms: plain, porter (stemmed), relevance (compounds and
their parts, without words that carry no topic) and porter_relevance.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import porter, text
from ..functions.counts import counted_rows
from ..session import dealt
from ..storage import materialise
from . import topk
from .phrases import token_pairs, write_pairs

VARIANTS = ("plain", "porter", "relevance", "porter_relevance")
#: Terms up to which their idf is broadcast (some 40 bytes each); beyond, a shuffle join.
BROADCAST_TERMS = 500_000
#: Changes with anything that alters an index's content.
INDEX_VERSION = "2"


def variant_name(stemming: bool, relevance: bool) -> str:
    return ("porter_" if stemming and relevance else "porter" if stemming else "") + ("relevance" if relevance else "" if stemming else "plain")


def located_terms(blocks: DataFrame, variant: str = "plain", doc_col: str = "doc_id", block_col: str = "block_id", text_col: str = "text") -> DataFrame:
    """A row for each term occurrence: doc, block, term, start, end."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant!r}")
    keys = [doc_col, block_col]
    rows = text.token_table(blocks, keys, text_col)
    rows = text.relevance_tokens(rows, keys) if "relevance" in variant else rows.select(*keys, "pos", "term", "start", "end")
    rows = rows.select(*keys, "term", "start", "end")
    return porter.stemmed(rows) if "porter" in variant else rows


def postings(terms: DataFrame, doc_col: str = "doc_id", block_col: str = "block_id", locations: bool = True) -> DataFrame:
    """(term, doc, tf) and, if asked for, the ordered places of each term in each document."""
    aggs = [F.count(F.lit(1)).alias("tf")]
    if locations:
        aggs.append(F.sort_array(F.collect_list(F.struct(F.col(block_col).alias("block_id"), "start", "end"))).alias("locations"))
    return terms.groupBy("term", doc_col).agg(*aggs)


def whole_documents(blocks: DataFrame, doc_col: str = "doc_id") -> bool:
    """Whether every document is one row."""
    return blocks.count() == blocks.select(doc_col).distinct().count()


def row_words(blocks: DataFrame, variant: str = "plain", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, words): the array of each row's terms, not yet stemmed."""
    return text.relevance_words(blocks, [doc_col], text_col) if "relevance" in variant else blocks.select(doc_col, text.terms(F.col(text_col)).alias("words"))


def term_frequencies(blocks: DataFrame, variant: str = "plain", doc_col: str = "doc_id", text_col: str = "text", whole: bool | None = None) -> DataFrame:
    """(term, doc, tf) of a variant, counted and stemmed within each row; only documents of several rows need an exchange.

    ``whole`` says that each document is one row; it is looked up if not given.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant!r}")
    rows = counted_rows(row_words(blocks, variant, doc_col, text_col), [doc_col], "words", "porter" in variant).select("term", doc_col, "tf")
    whole = whole_documents(blocks, doc_col) if whole is None else whole
    return rows if whole else rows.groupBy("term", doc_col).agg(F.sum("tf").alias("tf"))


def joined_terms(rows: DataFrame, values: DataFrame) -> DataFrame:
    """``rows`` with what ``values`` (term, df, ...) has of their terms.

    The terms of the highest df, ``BROADCAST_TERMS`` at most, go to all tasks.
    They have nearly all postings, so few postings are exchanged, however
    many terms there are.
    """
    if values.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(values), "term")
    # no more different df than the root of twice the postings
    left, least = BROADCAST_TERMS, None
    for df, n in sorted(values.groupBy("df").count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = df
    if least is None:
        return rows.join(values, "term")
    common = F.broadcast(values.where(F.col("df") >= least))
    others = rows.join(common, "term", "left_anti").join(values.where(F.col("df") < least), "term")
    return rows.join(common, "term").unionByName(others)


def inverse_document_frequency(posting_rows: DataFrame, n_documents: int) -> DataFrame:
    """(term, df, idf) with the smoothed idf ln((N + 1) / (df + 1)) + 1."""
    df = posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", (F.log((F.lit(n_documents) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def document_norms(posting_rows: DataFrame, idf: DataFrame, documents: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, norm) of every document, those without terms included: 0."""
    weight = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    own = joined_terms(posting_rows, idf).groupBy(doc_col).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    return documents.select(doc_col).distinct().join(own, doc_col, "left").select(doc_col, F.coalesce("norm", F.lit(0.0)).alias("norm"))


@dataclass
class Index:
    """Tables of one variant, read from files."""

    variant: str
    postings: DataFrame
    idf: DataFrame
    norms: DataFrame
    n_documents: int
    doc_col: str = "doc_id"
    #: For the best documents without whole posting lists; see ``topk``.
    impacts: DataFrame | None = None
    vectors: DataFrame | None = None


def with_exact_terms(posting_rows: DataFrame, doc_col: str) -> DataFrame:
    """Postings under the exact forms of their terms, those that become one term put together."""
    forms = materialise(text.exact_forms(posting_rows), "exact-forms")
    if forms.isEmpty():
        return posting_rows
    few = F.broadcast(forms) if forms.count() <= BROADCAST_TERMS else forms
    named = posting_rows.join(few, "term", "left").withColumn("term", F.coalesce("exact", "term"))
    more = [F.sort_array(F.flatten(F.collect_list("locations"))).alias("locations")] if "locations" in posting_rows.columns else []
    return materialise(named.groupBy("term", doc_col).agg(F.sum("tf").alias("tf"), *more), "postings")


def build_index(blocks: DataFrame, variant: str = "plain", doc_col: str = "doc_id", block_col: str = "block_id", text_col: str = "text", locations: bool = True, exact: bool = False) -> Index:
    """Index of a table of text blocks; documents without terms count in N.

    The texts are read once: postings are written in the shared folder, and
    idf and norms come from there. ``write_index`` gives an index a place of
    its own. With ``exact`` terms are composed and case-folded in full, for
    texts that aren't in composed form; queries then need it as well.
    """
    n = blocks.select(doc_col).distinct().count()
    rows = postings(located_terms(blocks, variant, doc_col, block_col, text_col), doc_col, block_col) if locations else term_frequencies(blocks, variant, doc_col, text_col, blocks.count() == n)
    rows = materialise(rows, "postings")
    rows = with_exact_terms(rows, doc_col) if exact else rows
    idf = materialise(inverse_document_frequency(rows, n), "idf")
    return Index(variant, rows, idf, document_norms(rows, idf, blocks, doc_col), n, doc_col)


def rules() -> dict:
    """What decides an index's content: stored with it, and compared before it is used."""
    from ..functions import vocabulary

    words = {name: hashlib.sha256(json.dumps(getattr(vocabulary, name), sort_keys=True).encode()).hexdigest() for name in ("CELL_LETTERS", "CELL_WORDS", "LETTER_CONTEXTS", "SEARCH_STOPWORDS")}
    sign = {name: hashlib.sha256(inspect.getsource(f).encode()).hexdigest() for name, f in (("normalize", text.normalize), ("stem", porter.stem_word), ("relevance", text.relevance_words))}
    return {"version": INDEX_VERSION, "token": text.TOKEN, "space": text.SPACE, "hyphen": text.HYPHEN, **words, **sign}


def content_mark(blocks: DataFrame, doc_col: str, block_col: str, text_col: str) -> str:
    """A mark that changes with the rows of a table of blocks, whatever their order."""
    n, total = blocks.agg(F.count(F.lit(1)), F.sum(F.xxhash64(doc_col, block_col, text_col).cast("decimal(38,0)"))).first()
    return f"{n}:{total}"


def partitions(spark: SparkSession, given: int | None) -> int:
    """Into how many parts a table is cut: as many as the session's shuffles have unless a number is given."""
    return given or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _put_mark(spark: SparkSession, path: str, meta: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(meta, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _mark(spark: SparkSession, path: str) -> dict:
    """What a part was built from; nothing if it isn't there or not whole."""
    try:
        return json.loads(spark.read.text(path).first()[0])
    except AnalysisException:
        return {}


def write_index(index: Index, path: str, buckets: int | None = None, token_rows: DataFrame | None = None, content: str = "", best: bool = False) -> None:
    """Writes an index sorted by term, so a lookup of terms reads few row groups; metadata last, as the mark that it is whole.

    ``token_rows``, a table of ``token_pairs``, is what phrase search needs
    besides; with ``best`` impacts and vectors are written, by which the best
    documents are found without whole posting lists. Each part has a mark of
    its own. ``content`` is the ``content_mark`` of the blocks.
    """
    spark = index.postings.sparkSession
    # places of a very common term are spread over files
    index.postings.repartitionByRange(partitions(spark, buckets), "term", index.doc_col).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.idf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/idf")
    index.norms.write.mode("overwrite").parquet(f"{path}/norms")
    meta = {"rules": rules(), "variant": index.variant, "n_documents": index.n_documents, "doc_col": index.doc_col, "content": content}
    _put_mark(spark, f"{path}/meta", meta)
    if token_rows is not None:
        write_tokens(token_rows, path, buckets, content)
    if best:
        write_best(spark, path)


def write_tokens(token_rows: DataFrame, path: str, buckets: int | None = None, content: str = "") -> None:
    """Writes the token pairs of phrase search; they need no other part."""
    write_pairs(token_rows, f"{path}/tokens", partitions(token_rows.sparkSession, buckets))
    _put_mark(token_rows.sparkSession, f"{path}/tokens-meta", {"rules": rules(), "content": content})


def write_best(spark: SparkSession, path: str) -> None:
    """Adds impacts and vectors to a written index."""
    meta = _mark(spark, f"{path}/meta")
    few = spark.read.parquet(f"{path}/idf")
    few = F.broadcast(few) if few.count() <= BROADCAST_TERMS else few
    topk.write_impacts(topk.weights(spark.read.parquet(f"{path}/postings"), few, spark.read.parquet(f"{path}/norms"), meta["doc_col"]), path, meta["doc_col"])
    _put_mark(spark, f"{path}/best-meta", meta)


def read_index(spark: SparkSession, path: str) -> Index:
    """An index written by ``write_index``; refuses one that was built by other rules."""
    meta = _mark(spark, f"{path}/meta")
    if meta.get("rules") != rules():
        raise ValueError("the index was built by other rules; build it again")
    more = (spark.read.parquet(f"{path}/{t}") for t in ("impacts", "vectors")) if _mark(spark, f"{path}/best-meta") == meta else ()
    return Index(meta["variant"], *(spark.read.parquet(f"{path}/{t}") for t in ("postings", "idf", "norms")), meta["n_documents"], meta["doc_col"], *more)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token pairs that were written with an index."""
    if _mark(spark, f"{path}/tokens-meta").get("rules") != rules():
        raise ValueError("the index was built without a token table, which phrase search needs, or by other rules")
    return spark.read.parquet(f"{path}/tokens")


def current_tokens(blocks: DataFrame, path: str, doc_col: str = "doc_id", block_col: str = "block_id", text_col: str = "text", mark: str | None = None) -> DataFrame:
    """The token pairs at ``path``, made again if they are missing, not whole, of other rules or of other blocks."""
    mark = mark or content_mark(blocks, doc_col, block_col, text_col)
    if _mark(blocks.sparkSession, f"{path}/tokens-meta") != {"rules": rules(), "content": mark}:
        write_tokens(token_pairs(dealt(blocks), [doc_col, block_col], text_col), path, content=mark)
    return read_tokens(blocks.sparkSession, path)


def current_index(blocks: DataFrame, path: str, variant: str = "plain", doc_col: str = "doc_id", block_col: str = "block_id", text_col: str = "text", phrases: bool = False, locations: bool = True, exact: bool = False, best: bool = False) -> Index:
    """The index at ``path``; each part asked for is built again if it is missing, not whole, of other rules or of other blocks."""
    spark = blocks.sparkSession
    mark = content_mark(blocks, doc_col, block_col, text_col) + (":exact" if exact else "")
    meta = _mark(spark, f"{path}/meta")
    if (meta.get("rules"), meta.get("variant"), meta.get("content")) != (rules(), variant, mark):
        write_index(build_index(dealt(blocks), variant, doc_col, block_col, text_col, locations, exact), path, content=mark)
        meta = _mark(spark, f"{path}/meta")
    if best and _mark(spark, f"{path}/best-meta") != meta:
        write_best(spark, path)
    if phrases:
        current_tokens(blocks, path, doc_col, block_col, text_col, mark)
    return read_index(spark, path)


def index_faults(index: Index, documents: DataFrame) -> DataFrame:
    """What is wrong with an index, a row (fault, count) each: none if it is valid for ``documents``."""
    ids = documents.select(index.doc_col).distinct()
    terms = index.postings.select("term").distinct()
    bad = [
        ("term without idf", terms.join(index.idf, "term", "left_anti")),
        ("idf without postings", index.idf.join(terms, "term", "left_anti")),
        ("idf below 1", index.idf.where("idf < 1 OR idf IS NULL OR isnan(idf)")),
        ("invalid norm", index.norms.where("norm < 0 OR norm IS NULL OR isnan(norm)")),
        ("document without norm", ids.join(index.norms, index.doc_col, "left_anti")),
        ("norm without document", index.norms.join(ids, index.doc_col, "left_anti")),
    ]
    out = None
    for name, rows in bad:
        one = rows.agg(F.count(F.lit(1)).alias("count")).where("count > 0").select(F.lit(name).alias("fault"), "count")
        out = one if out is None else out.unionByName(one)
    return out
