"""The files behind a library: uploads, other readings of what is stored, and removal for good.

Files lie in ``raw`` and ``rejected`` below the store's folder, on any file
system that Spark reaches. One writer at a time holds the store, by a lease.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import time
import uuid
from collections.abc import Iterator
from xml.etree.ElementTree import tostring

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import Change, import_articles, manifest_rows
from .sources.article_xml import MAX_BYTES, ArticleError, articles, identifier, parse_article, parse_safely, without
from .sources.readers import read_articles
from .storage import hadoop, materialise
from .versions import Lease, LeaseError, TableLog

JOURNAL, LOCK = "purge_pending", ".writer"
#: How long a writer is taken to be alive without a sign of it.
LEASE_SECONDS = 600.0
FOLDERS = ("raw", "rejected")


class StoreError(RuntimeError):
    """Why the store's files can't be changed."""


@contextlib.contextmanager
def sole_writer(spark: SparkSession, root: str, holder: str | None = None, seconds: float = LEASE_SECONDS) -> Iterator[Lease]:
    """Holds the store; a second writer is refused at once, until the lease of a dead one has run out."""
    log = TableLog(spark, f"{root}/{LOCK}")
    try:
        with log.held(holder or uuid.uuid4().hex, seconds) as lease:
            yield lease
    except LeaseError as e:
        raise StoreError(str(e)) from e
    log.clean_up()


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """A file that is there whole or not at all; one that it replaces stays until then."""
    system, at = hadoop(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{hashlib.sha256(raw).hexdigest()[:16]}.tmp")
    out = system.create(own, True)
    out.write(bytearray(raw))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    how[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(system.makeQualified(own), system.makeQualified(at), how)


def _holds_article(raw: bytes) -> bool:
    def fine(element) -> bool:
        try:
            return bool(parse_article(element))
        except ArticleError:
            return False

    try:
        return any(map(fine, articles(raw)))
    except ArticleError:
        return False


def upload(spark: SparkSession, root: str, filename: str, raw: bytes, documents: DataFrame, deleted: DataFrame, now: str = "") -> Change:
    """Stores a file under a name made from its content, in ``rejected`` if it holds no article, and imports it.

    Deleted articles that it holds come back. The name given says what kind of
    file it is and nothing of where it is put.
    """
    if not re.split(r"[/\\]", filename)[-1].lower().endswith(".xml"):
        raise ValueError("only files that end in .xml can be uploaded")
    if not 0 < len(raw) <= MAX_BYTES:
        raise ValueError("a file must not be empty and have 25 MiB at most")
    path = f"{root}/{'raw' if _holds_article(raw) else 'rejected'}/upload-{hashlib.sha256(raw).hexdigest()}.xml"
    with sole_writer(spark, root):
        refuse_while_pending(spark, root)
        system, at = hadoop(spark, path)
        if not system.exists(at):
            write_bytes(spark, path, raw)
        return import_articles(documents, deleted, read_articles(spark, path), restore=True, now=now)


def switch_scope(spark: SparkSession, root: str, documents: DataFrame, deleted: DataFrame, ids: DataFrame, scope: str, now: str = "") -> Change:
    """Reads the stored files of ``ids`` (pmcid) again in another scope, full or abstract.

    A document stays as it is, with the status ``kept``, where its file is
    gone or can't give the scope, as a PubMed record can't give a full text.
    """
    wanted = documents.join(ids.select("pmcid").distinct(), "pmcid", "left_semi").where(F.col("content_scope") != scope)
    read = read_articles(spark, f"{root}/raw", scope, only=wanted.select("raw_path")).where((F.col("error") == "") & (F.col("document.content_scope") == scope))
    own = read.select("document.*").join(wanted.select("pmcid", F.col("raw_path").alias("from_path")), "pmcid").where("raw_path = from_path").drop("from_path")
    source = wanted.select("pmcid", F.col("source_url").alias("s"), F.col("acquired_at").alias("a"))
    fresh = own.dropDuplicates(["pmcid"]).join(source, "pmcid").withColumns({"source_url": F.col("s"), "acquired_at": F.col("a")}).select(*documents.columns)
    rest = documents.join(fresh.select("pmcid"), "pmcid", "left_anti").select(*documents.columns)
    kept = wanted.join(fresh.select("pmcid"), "pmcid", "left_anti")
    log = manifest_rows(fresh, status=F.lit("updated"), imported_at=F.lit(now)).unionByName(manifest_rows(kept, status=F.lit("kept"), reason=F.lit(f"no {scope} text is stored"), imported_at=F.lit(now)))
    return Change(rest.unionByName(fresh), deleted, log)


def refuse_while_pending(spark: SparkSession, root: str) -> None:
    system, at = hadoop(spark, f"{root}/{JOURNAL}/_SUCCESS")
    if system.exists(at):
        raise StoreError("a removal was cut short; resume it first")


def _removal_plan(spark: SparkSession, root: str, gone: list[str], known: set[str]) -> DataFrame:
    """(raw_path, before, after, content, error) of each stored file that holds one of ``gone``: what is left of it, or null for nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in batch.itertuples(index=False, name=None):
                raw = bytes(raw)
                try:
                    tree = parse_safely(raw)
                except ArticleError as e:
                    if path in known:
                        rows.append((path, "", None, None, str(e)))
                    continue
                if not without(tree, set(gone)):
                    continue
                left = tostring(tree, encoding="utf-8", xml_declaration=True) if identifier(tree) not in gone and any(identifier(n) for n in tree.iter()) else None
                rows.append((path, hashlib.sha256(raw).hexdigest(), left and hashlib.sha256(left).hexdigest(), left, ""))
            yield pd.DataFrame(rows, columns=["raw_path", "before", "after", "content", "error"])

    files = None
    for folder in FOLDERS:
        system, at = hadoop(spark, f"{root}/{folder}")
        if system.exists(at):
            own = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(f"{root}/{folder}").select("path", "content")
            files = own if files is None else files.unionByName(own)
    return files.mapInPandas(run, "raw_path string, before string, after string, content binary, error string")


def purge(spark: SparkSession, root: str, deleted: DataFrame, ids: list[str], now: str = "") -> tuple[DataFrame, DataFrame]:
    """Removes deleted articles for good, their stored files too; others in the same file stay. Returns tombstones and manifest rows.

    ``ids`` that aren't deleted are left alone. All files are looked at first;
    what is to be done is written as a journal, and ``resume_purge`` carries it
    out, again if it was cut short.
    """
    chosen = deleted.where(F.col("pmcid").isin(ids)).select("pmcid", F.col("document.raw_path").alias("raw_path")).collect()
    gone, known = [r.pmcid for r in chosen], {r.raw_path for r in chosen}
    # written before any file goes that it may have been read from
    left = materialise(deleted.where(~F.col("pmcid").isin(gone)), "tombstones")
    with sole_writer(spark, root) as lease:
        refuse_while_pending(spark, root)
        if gone:
            plan = _removal_plan(spark, root, gone, known)
            plan.write.mode("overwrite").parquet(f"{root}/{JOURNAL}")
            bad = spark.read.parquet(f"{root}/{JOURNAL}").where("error <> '' OR length(content) > " + str(MAX_BYTES)).select("raw_path").collect()
            if bad:
                system, at = hadoop(spark, f"{root}/{JOURNAL}")
                system.delete(at, True)
                raise StoreError(f"nothing was removed: {', '.join(r.raw_path for r in bad)} can't be read or would be too large")
            _carry_out(spark, root, lease)
    log = spark.createDataFrame([(g,) for g in gone], "pmcid string")
    return left, manifest_rows(log, status=F.lit("purged"), reason=F.lit("removed for good"), acquired_at=F.lit(now))


def resume_purge(spark: SparkSession, root: str) -> bool:
    """Carries out a removal that was cut short; False if there is none."""
    system, at = hadoop(spark, f"{root}/{JOURNAL}/_SUCCESS")
    if not system.exists(at):
        return False
    with sole_writer(spark, root) as lease:
        _carry_out(spark, root, lease)
    return True


def _carry_out(spark: SparkSession, root: str, lease: Lease) -> None:
    """File by file, so that no more than one is in memory; a file that someone else changed meanwhile stops it, and so does the loss of the lease."""
    renewed = time.monotonic()
    for r in spark.read.parquet(f"{root}/{JOURNAL}").toLocalIterator():
        system, at = hadoop(spark, r.raw_path)
        if time.monotonic() - renewed > lease.seconds / 4:
            lease.renew()
            renewed = time.monotonic()
        if at.getParent().getName() not in FOLDERS:
            raise StoreError(f"{r.raw_path} is no file of the store")
        if not system.exists(at):
            continue
        digest = spark.read.format("binaryFile").load(r.raw_path).select(F.sha2("content", 256)).first()[0]
        if digest not in (r.before, r.after):
            raise StoreError(f"{r.raw_path} was changed meanwhile; the journal stays")
        if r.content is None:
            system.delete(at, False)
        elif digest == r.before:
            write_bytes(spark, r.raw_path, bytes(r.content))
    system, at = hadoop(spark, f"{root}/{JOURNAL}")
    system.delete(at, True)

