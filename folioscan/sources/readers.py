"""Readers: article XML, document tables, identifier lists, sealed snapshots, markup pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse_space
from ..schemas import DOCUMENT, PARSED
from .article_xml import MAX_BYTES, parse_file

MAX_LIST_BYTES, MAX_LIST_IDS = 1024 * 1024, 100


def read_articles(spark: SparkSession, path: str | list[str], scope: str = "full", only: DataFrame | None = None) -> DataFrame:
    """A row of ``schemas.PARSED`` for each article of the XML files at ``path`` (files, or a folder's ``*.xml`` in any case).

    ``only`` has the raw_path of the files to parse (default: all). Files larger
    than the limit aren't loaded; they give a row with an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(path)
    if only is not None:
        files = files.join(only.select(F.col("raw_path").alias("path")).distinct(), "path", "left_semi")
    big = files.where(F.col("length") > MAX_BYTES).select(F.col("path").alias("raw_path"), F.lit("").alias("sha256"), F.lit(None).cast("int").alias("article_no"), F.lit("the XML is larger than 25 MiB").alias("error"), F.lit(False).alias("deleted_record"), F.lit(None).cast(DOCUMENT).alias("document"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, raw in batch.itertuples(index=False, name=None) for r in parse_file(path, bytes(raw), scope)]
            yield pd.DataFrame([json.dumps(r, ensure_ascii=False) for r in rows], columns=["row"])

    parsed = files.where(F.col("length") <= MAX_BYTES).select("path", "content").mapInPandas(run, "row string")
    return parsed.select(F.from_json("row", PARSED).alias("r")).select("r.*").unionByName(big)


def documents_of(parsed: DataFrame) -> DataFrame:
    """One document for each identifier: where files repeat it, the last file name's, and in it the last article's."""
    good = parsed.where("error = ''").select(F.col("document.pmcid").alias("pmcid"), "raw_path", "article_no", "document")
    return good.groupBy("pmcid").agg(F.max_by("document", F.struct("raw_path", "article_no")).alias("document")).select("document.*")


def blocks_of(documents: DataFrame, back: bool = False) -> DataFrame:
    """Text blocks as rows: doc_id, block_id, block_ord, kind, section, text, narrative. Back matter only if asked for."""
    column = "back_blocks" if back else "blocks"
    rows = documents.select(F.col("pmcid").alias("doc_id"), F.posexplode(column).alias("block_ord", "b"))
    return rows.select("doc_id", F.col("b.id").alias("block_id"), "block_ord", "b.kind", "b.section", "b.text", "b.narrative")


def abstract_texts(documents: DataFrame) -> DataFrame:
    """(pmid, text): a document's abstract blocks joined by line breaks; titles, labels and bodies stay out."""
    own = F.filter("blocks", lambda b: b["kind"] == "abstract")
    return documents.select("pmid", F.array_join(F.transform(own, lambda b: b["text"]), "\n").alias("text"))


def read_documents(spark: SparkSession, path: str, deleted: DataFrame | None = None) -> DataFrame:
    """Documents stored as JSON lines, without those in ``deleted``; unknown fields and repeated identifiers fail the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = F.array(*[F.lit(f.name) for f in DOCUMENT])
    extra = F.array_except(F.json_object_keys("value"), known)
    checked = lines.where(F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown field: "), F.get(extra, F.lit(0)))).cast("boolean")).otherwise(True))
    docs = checked.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("pmcid"))
    docs = docs.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated identifier: "), F.col("pmcid"))).cast("boolean")).otherwise(True)).drop("__n")
    return docs if deleted is None else docs.join(deleted.select("pmcid"), "pmcid", "left_anti")


def normalized_pmid(value: Column) -> Column:
    """The digits of ``PMID: 123`` in any usual form; null if it is none."""
    found = F.regexp_extract(F.trim(value), r"(?i)^(?:PMID\s*:?\s*)?([1-9][0-9]{0,9})$", 1)
    return F.when(found != "", found)


def read_pmid_list(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Identifiers in order of first appearance, and how many lines repeated one.

    A list has an identifier a line, blank lines aside, in UTF-8 or UTF-16 with
    a byte-order mark. A line that is none, more than ``MAX_LIST_IDS``
    identifiers, none at all, or more than ``MAX_LIST_BYTES`` raise ValueError.
    """
    file = spark.read.format("binaryFile").load(path)
    if file.agg(F.max("length")).first()[0] > MAX_LIST_BYTES:
        raise ValueError("the list is larger than 1 MiB")
    raw = F.col("content")
    wide = F.hex(F.substring(raw, 1, 2)).isin("FFFE", "FEFF")
    decoded = F.when(wide, F.decode(raw, "UTF-16")).otherwise(F.regexp_replace(F.decode(raw, "UTF-8"), "^﻿", ""))
    lines = file.select(F.posexplode(F.split(decoded, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("n", "line")).where(F.trim(F.regexp_replace("line", r"(?U)\s", "")) != "")
    rows = lines.select(F.col("n") + 1, normalized_pmid(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).orderBy("n").collect()
    if bad := [n for n, pmid in rows if pmid is None]:
        raise ValueError(f"not a PMID in line {', '.join(map(str, bad[:10]))}{' ...' if len(bad) > 10 else ''}")
    ids = list(dict.fromkeys(pmid for _, pmid in rows))
    if not ids:
        raise ValueError("the list is empty")
    if len(ids) > MAX_LIST_IDS:
        raise ValueError(f"a list has at most {MAX_LIST_IDS} identifiers")
    return ids, len(rows) - len(ids)


def reusable_license(url: Column) -> Column:
    """Whether a link is a Creative Commons licence or its dedication to the public domain."""
    path = r"^/(?:licenses/(?:by|by-sa|by-nc|by-nc-sa|by-nd|by-nc-nd)/[1-4]\.0(?:/[a-z_]+)?|publicdomain/zero/1\.0)/?$"
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(host.isin("creativecommons.org", "www.creativecommons.org") & F.try_parse_url(url, F.lit("PATH")).rlike(path), F.lit(False))


def english(language: Column) -> Column:
    return F.lower(language).isin("en", "eng", "en-us", "en-gb")


class _Page(HTMLParser):
    APART = frozenset({"p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "title"})

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.APART:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.APART:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _page_text(page: str | None) -> str | None:
    if page is None:
        return None
    p = _Page()
    p.feed(page)
    p.close()
    return "".join(p.out)


@F.pandas_udf(T.StringType())
def _page_texts(pages: pd.Series) -> pd.Series:
    return pages.map(_page_text)


def page_text(page: Column) -> Column:
    """Readable text of an HTML page, white space collapsed."""
    return collapse_space(_page_texts(page))


def verified_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The documents of a sealed snapshot, after every stored digest, count and rule about them has been checked."""
    manifest = json.loads(spark.read.text(f"{root}/snapshot.json", wholetext=True).first()[0])
    if manifest["schema_version"] == 2:
        return _verified_parts(spark, root, manifest)
    digests = {r[0]: r[1] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).collect()}
    wanted = {"abstracts.jsonl": manifest["sha256"]["abstracts"], "selection.json": manifest["sha256"]["selection"]} | {f["file"].rpartition("/")[2]: f["sha256"] for f in manifest["raw_files"]}
    if wrong := sorted(n for n, d in wanted.items() if digests.get(n) != d):
        raise ValueError(f"the snapshot was altered: {', '.join(wrong)}")
    docs = read_documents(spark, f"{root}/abstracts.jsonl")
    listed = spark.createDataFrame([(i,) for i in manifest["selected_pmids"]], "pmid string").groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))
    found = docs.groupBy("pmid").agg(F.count(F.lit(1)).alias("n_found"))
    if not found.join(listed, "pmid", "full_outer").where("n IS NULL OR n_found IS NULL OR n <> 1 OR n_found <> 1").isEmpty():
        raise ValueError("the snapshot's documents aren't those it lists")
    texts = abstract_texts(docs)
    if not docs.where("language <> 'eng'").isEmpty() or not texts.where("trim(text) = ''").isEmpty():
        raise ValueError("a document isn't English or has no abstract")
    return docs


def _verified_parts(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """The documents of a snapshot that ``seal_parts`` sealed; a part that was altered is named."""
    from .writers import PART, part_digests, root_digest

    sealed = spark.read.schema(PART).json(f"{root}/parts")
    if root_digest(sealed) != manifest["root"]:
        raise ValueError("the snapshot's list of parts was altered")
    found = part_digests(spark, root, tuple(manifest["tables"]))
    joined = sealed.alias("s").join(found.alias("f"), ["table", "part"], "full_outer")
    wrong = joined.where(~F.col("s.sha256").eqNullSafe(F.col("f.sha256")) | ~F.col("s.rows").eqNullSafe(F.col("f.rows"))).select("table", "part").orderBy("table", "part").limit(10).collect()
    if wrong:
        raise ValueError(f"the snapshot was altered: {', '.join(f'{r.table}/{r.part}' for r in wrong)}")
    if "raw_files" in manifest["tables"]:
        listed = spark.read.schema("file string, sha256 string").json(f"{root}/raw_files")
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/raw").select(F.regexp_extract("path", r"/(raw/.*)$", 1).alias("file"), F.sha2("content", 256).alias("is"))
        bad = [r[0] for r in listed.join(own, "file", "left").where(~F.col("sha256").eqNullSafe(F.col("is"))).select("file").orderBy("file").limit(10).collect()]
        if bad:
            raise ValueError(f"the snapshot was altered: {', '.join(bad)}")
    docs = read_documents(spark, f"{root}/abstracts")
    chosen = spark.read.schema("pmid string, status string").json(f"{root}/selection").where("status = 'selected'").groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))
    held = docs.groupBy("pmid").agg(F.count(F.lit(1)).alias("n_found"))
    if not held.join(chosen, "pmid", "full_outer").where("n IS NULL OR n_found IS NULL OR n <> 1 OR n_found <> 1").isEmpty():
        raise ValueError("the snapshot's documents aren't those it lists")
    if not docs.where("language <> 'eng'").isEmpty() or not abstract_texts(docs).where("trim(text) = ''").isEmpty():
        raise ValueError("a document isn't English or has no abstract")
    return docs
