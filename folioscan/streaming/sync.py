"""Keeping a library in step with a folder of XML files.

What changed is told by content digests: files are joined with the digests of
the last round, so an edit that keeps name, size and time is still seen, and a
round over an unchanged folder parses nothing. A stream serves as the trigger
only, since its file source knows paths, not contents.

A trigger every few seconds doesn't read the whole folder. It lists the files;
those that are new or have another size or time are read, and besides one of
``ROUNDS`` groups of all files in turn, so that whatever keeps name, size and
time is found within that many triggers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..library import Change, import_articles, soft_delete
from ..storage import materialise
from ..versions import TableLog, Write
from ..sources.article_xml import PARSER_VERSION
from ..sources.readers import read_articles


#: Triggers within which every file is read again.
ROUNDS = 60
#: Files up to which their names are given to the reader, which then opens no others; beyond, it goes through the folder.
NAMED_FILES = 5_000
#: What is known of a folder's files from one trigger to the next.
KNOWN = "raw_path string, length long, modified timestamp, sha256 string"
#: Columns of the state that a round leaves for the next.
STATE = "raw_path string, sha256 string, pmcids array<string>"


@dataclass
class SyncResult:
    change: Change
    files: DataFrame
    imported: int
    updated: int
    removed: int
    restored: int
    failed: int


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(list(paths))


def signature(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_path, sha256) of a folder's XML files; reads them all."""
    return _files(spark, folder).select(F.col("path").alias("raw_path"), F.sha2("content", 256).alias("sha256"))


def suspects(spark: SparkSession, folder: str, known: DataFrame, trigger: int, rounds: int = ROUNDS) -> DataFrame:
    """(raw_path, length, modified, suspect) of a folder's XML files, from a listing alone.

    Suspect are files that ``known`` (``KNOWN``) lacks or has with another size or
    time, and those whose turn it is to be read again at this ``trigger``.
    """
    now = _files(spark, folder).select(F.col("path").alias("raw_path"), "length", F.col("modificationTime").alias("modified"))
    before = known.select("raw_path", F.col("length").alias("__length"), F.col("modified").alias("__modified"))
    same = F.col("length").eqNullSafe(F.col("__length")) & F.col("modified").eqNullSafe(F.col("__modified"))
    turn = F.pmod(F.xxhash64("raw_path"), F.lit(rounds)) == trigger % rounds
    return now.join(before, "raw_path", "left").select("raw_path", "length", "modified", (~same | turn).alias("suspect"))


def looked_over(spark: SparkSession, folder: str, known: DataFrame, trigger: int, rounds: int = ROUNDS) -> DataFrame:
    """``KNOWN`` of a folder as it is: digests of the suspect files are made anew, the others' are those known."""
    listed = materialise(suspects(spark, folder, known, trigger, rounds), "listing")
    asked = [r[0] for r in listed.where("suspect").select("raw_path").limit(NAMED_FILES + 1).collect()]
    kept = listed.where("NOT suspect").join(known.select("raw_path", "sha256"), "raw_path")
    columns = ["raw_path", "length", "modified", "sha256"]
    if not asked:
        return kept.select(*columns)
    files = _files(spark, *asked) if len(asked) <= NAMED_FILES else _files(spark, folder).join(listed.where("suspect").select(F.col("raw_path").alias("path")), "path", "left_semi")
    read = files.select(F.col("path").alias("raw_path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return kept.select(*columns).unionByName(read)


def differences(now: DataFrame, before: DataFrame) -> DataFrame:
    """(raw_path, state): added, changed, removed or same, by digest."""
    n, b = now.select("raw_path", F.col("sha256").alias("new")), before.select("raw_path", F.col("sha256").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed").otherwise("same")
    return n.join(b, "raw_path", "full_outer").select("raw_path", state.alias("state"))


def sync(spark: SparkSession, folder: str, documents: DataFrame, deleted: DataFrame, before: DataFrame, version: str = PARSER_VERSION, now: str = "", found: DataFrame | None = None) -> SyncResult:
    """One round: imports what is new, moves documents whose source is gone to the tombstones, restores those whose source is back.

    ``before`` is the last round's ``files`` (``STATE``; empty at first); with
    another parser ``version`` than the present one every file is parsed again,
    otherwise only new and changed ones. When several of those hold a document,
    the last file name's wins. Documents that were deleted by hand stay deleted.
    ``found`` is the folder's signature, if it has been looked over already.
    """
    found = signature(spark, folder) if found is None else found
    found = materialise(found.select("raw_path", "sha256"), "signature")
    diff = differences(found, before)
    fresh = diff.where("state IN ('added', 'changed')" if version == PARSER_VERSION else "state <> 'removed'").select("raw_path")
    # written once: an article is parsed once however often it is asked for below
    parsed = materialise(read_articles(spark, folder, only=fresh), "parsed")
    own = parsed.where("error = ''").groupBy("raw_path").agg(F.collect_set("document.pmcid").alias("fresh_ids"))
    state = found.join(own, "raw_path", "left").join(fresh.withColumn("is_fresh", F.lit(True)), "raw_path", "left").join(before.select("raw_path", F.col("pmcids").alias("old_ids")), "raw_path", "left")
    none = F.array().cast("array<string>")
    files = state.select("raw_path", "sha256", F.when(F.col("is_fresh"), F.coalesce("fresh_ids", none)).otherwise(F.coalesce("old_ids", none)).alias("pmcids"))
    present = files.select(F.explode("pmcids").alias("pmcid")).distinct()
    came_back = deleted.where("reason = 'source_missing'").join(present, "pmcid", "left_semi").select("pmcid")
    stones = deleted.join(came_back, "pmcid", "left_anti").select(*deleted.columns)
    change = import_articles(documents, stones, parsed, now=now)
    orphans = change.documents.join(present, "pmcid", "left_anti").select("pmcid")
    removed = soft_delete(change.documents, change.deleted, orphans, "source_missing", now)
    gone = removed.manifest.withColumn("status", F.lit("source_removed"))
    back = F.col("__b") & F.col("status").isin("imported", "updated")
    log = change.manifest.join(came_back.withColumn("__b", F.lit(True)), "pmcid", "left").withColumn("status", F.when(back, "source_restored").otherwise(F.col("status"))).drop("__b").unionByName(gone)
    counts = {r["status"]: r["n"] for r in log.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    return SyncResult(Change(removed.documents, removed.deleted, log), files, *(counts.get(k, 0) for k in ("imported", "updated", "source_removed", "source_restored", "failed")))


def watch(spark: SparkSession, folder: str, on_change: Callable[[DataFrame], None], checkpoint: str, seconds: float | None = 3, rounds: int = ROUNDS):
    """Calls ``on_change`` with the folder's signature whenever a stream's trigger finds it changed.

    ``seconds`` is the time between triggers; None handles what is there and
    stops. What is known of the files is kept below ``checkpoint``, in versions,
    so a watch that begins again doesn't read everything again. A digest is
    recorded after ``on_change`` has returned: if that fails, the next trigger
    finds the change again.
    """
    log = TableLog(spark, f"{checkpoint}/digests", key="raw_path", buckets=8)
    schema = spark.createDataFrame([], KNOWN).schema

    def look(_: DataFrame, __: int) -> None:
        last = log.version()
        known = log.read(last, "files", schema)
        now = materialise(looked_over(spark, folder, known, last.number, rounds), "folder")
        if not differences(now, known).where("state <> 'same'").isEmpty():
            on_change(now.select("raw_path", "sha256"))
        # a version is made also where nothing has changed: its number is that of the trigger
        same = now.exceptAll(known).isEmpty() and known.exceptAll(now).isEmpty()
        log.commit(last, {} if same else {"files": Write(now)}, "looked over")
        log.clean_up(keep=2, older_than=0)

    if seconds is None:
        source = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(folder).drop("content")
        return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(look).trigger(availableNow=True).start()
    source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(look).trigger(processingTime=f"{seconds} seconds").start()


def sync_stored(spark: SparkSession, folder: str, library, lease=None, now: str = "", found: DataFrame | None = None):
    """One round of ``sync`` on a ``StoredLibrary``: documents, tombstones, manifest and the folder's state change in one version."""

    def writes(base) -> dict[str, Write]:
        documents, deleted, _ = library.tables(base)
        before = library.log.read(base, "files", spark.createDataFrame([], STATE).schema)
        result = sync(spark, folder, documents, deleted, before, now=now, found=found)
        log = materialise(result.change.manifest, "manifest")
        keys = log.where("pmcid <> ''").select("pmcid")
        return {"documents": Write(result.change.documents, keys), "deleted": Write(result.change.deleted, keys), "manifest": Write(log, append=True), "files": Write(result.files.withColumn("pmcid", F.col("raw_path")))}

    return library.log.transact(writes, "sync", lease)
