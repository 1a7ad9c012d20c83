"""Corpus preparation in five stages, from raw documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, line_dedup, ngram_join, packing, quality_model
from folioscan.llm.common import materialise, read_table
from folioscan.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    ship_package(spark)
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"), quality_model.learned_fold(F.col("doc_id")))
    return quality_model.keep(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay only in the first document that has them; documents of nothing else go."""
    ship_package(spark)
    cut = line_dedup.remove_spread_lines(docs, min_sites=10)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed")))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id; documents without words all stay."""
    ship_package(spark)
    classes = materialise(ngram_join.near_duplicates(docs, n=5, num=80, den=100).where("n_shingles > 0"), "classes")
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("tie").alias("tie"))
    stays = first.select(F.col("component_id").alias("s_id"), F.col("tie").alias("s_tie"))
    gone = classes.join(stays, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tie") == F.col("s_tie")), "left_anti").select(F.col("doc_id").alias("g_id"), F.col("tie").alias("g_tie")).distinct()
    own = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    kept = docs.join(gone, own("g_id", "g_tie"), "left_anti")
    repeated = classes.groupBy("doc_id", "tie").count().where("count > 1").select(F.col("doc_id").alias("r_id"), F.col("tie").alias("r_tie"))
    if repeated.isEmpty():
        return kept
    # rows given more than once, which no id tells apart
    again = docs.join(repeated, own("r_id", "r_tie"), "left_semi").join(gone, own("g_id", "g_tie"), "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, own("r_id", "r_tie"), "left_anti").unionByName(again)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    ship_package(spark)
    found = decontaminate.find_copies(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("c_id"), F.col("tie").alias("c_tie")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_tie")), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as sequences of at most 2,048 tokens."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The fitted classifier, signatures and alignment are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each result written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
