"""A library of documents that changes: imports, soft deletion, restoration, selection.

State is tables; an operation computes the next tables from the present ones
and what comes in, by joins on the identifier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schemas import DOCUMENT, MANIFEST, TOMBSTONE
from .sources.readers import documents_of
from .storage import materialise
from .versions import Lease, TableLog, Version, Write

CONTENT = ("sha256", "content_scope", "blocks", "back_blocks", "statistics")


@dataclass
class Change:
    """The next documents and tombstones, and manifest rows that say what happened."""

    documents: DataFrame
    deleted: DataFrame
    manifest: DataFrame


def manifest_rows(rows: DataFrame, **given: Column) -> DataFrame:
    """Rows in the manifest's columns; what isn't there is empty."""
    return rows.select(*[given.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit("")).cast(f.dataType).alias(f.name) for f in MANIFEST])


def import_articles(documents: DataFrame, deleted: DataFrame, parsed: DataFrame, restore: bool = False, now: str = "") -> Change:
    """Upserts parsed articles, each for itself: imported, updated, duplicate, failed or skipped_deleted.

    A document is a duplicate if its file's digest, scope, blocks and counts are
    those already stored. Deleted ones are passed over unless ``restore``.
    Where one identifier comes more than once, the last file's counts.
    """
    fresh = documents_of(parsed)
    same = None
    for c in CONTENT:
        one = F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
        same = one if same is None else same & one
    joined = fresh.alias("new").join(documents.alias("old"), F.col("new.pmcid") == F.col("old.pmcid"), "left").join(deleted.select(F.col("pmcid").alias("gone")).alias("g"), F.col("new.pmcid") == F.col("gone"), "left")
    skipped = F.lit(False) if restore else F.col("gone").isNotNull()
    status = F.when(skipped, "skipped_deleted").when(F.col("old.pmcid").isNull(), "imported").when(same, "duplicate").otherwise("updated")
    decided = joined.select("new.*", status.alias("status"))
    written = decided.where("status <> 'skipped_deleted'").drop("status")
    kept = documents.join(written.select("pmcid"), "pmcid", "left_anti").select(*documents.columns).unionByName(written)
    still = deleted.join(written.select("pmcid"), "pmcid", "left_anti").select(*deleted.columns) if restore else deleted
    reason = F.when(F.col("status") == "skipped_deleted", "the article was deleted").when(F.col("license") == "", "no licence was given").otherwise("")
    failed = parsed.where("error <> ''").select(F.lit("").alias("pmcid"), "raw_path", "sha256", F.lit("failed").alias("status"), F.col("error").alias("reason"))
    log = manifest_rows(decided, reason=reason, imported_at=F.lit(now)).unionByName(manifest_rows(failed, imported_at=F.lit(now)))
    return Change(kept, still, log)


def requested_only(parsed: DataFrame, requested: DataFrame) -> DataFrame:
    """Of what a service sent, the articles of ``requested`` (pmid) that came exactly once; a row with an error for each of the others.

    Records that nobody asked for are left out.
    """
    good = parsed.where("error = ''").withColumn("__pmid", F.col("document.pmid"))
    times = requested.select("pmid").distinct().join(good.groupBy("__pmid").agg(F.count(F.lit(1)).alias("n")), F.col("pmid") == F.col("__pmid"), "left").select("pmid", F.coalesce("n", F.lit(0)).alias("n"))
    once = good.join(times.where("n = 1").select(F.col("pmid").alias("__pmid")), "__pmid", "left_semi").select(*parsed.columns)
    given = {"raw_path": F.col("pmid"), "sha256": F.lit(""), "error": F.when(F.col("n") == 0, "the service sent no article of this PMID").otherwise("the service sent several articles of this PMID"), "deleted_record": F.lit(False)}
    missing = times.where("n <> 1").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in parsed.schema])
    return once.unionByName(missing)


def soft_delete(documents: DataFrame, deleted: DataFrame, ids: DataFrame, reason: str = "", now: str = "") -> Change:
    """Moves the documents of ``ids`` (pmcid) to the tombstones."""
    gone = documents.join(ids.select("pmcid").distinct(), "pmcid", "left_semi").select(*documents.columns)
    stones = gone.select("pmcid", F.struct(*documents.columns).alias("document"), F.lit(now).alias("deleted_at"), F.lit(reason).alias("reason"))
    rest = documents.join(gone.select("pmcid"), "pmcid", "left_anti").select(*documents.columns)
    older = deleted.join(gone.select("pmcid"), "pmcid", "left_anti").select(*deleted.columns)
    return Change(rest, older.unionByName(stones), manifest_rows(gone, status=F.lit("deleted"), reason=F.lit(reason), acquired_at=F.lit(now)))


def restore(documents: DataFrame, deleted: DataFrame, ids: DataFrame, sources: DataFrame, now: str = "") -> Change:
    """Brings back the documents of ``ids``, all or none: each must be deleted and have a source (raw_path) in ``sources``."""
    wanted = ids.select("pmcid").distinct()
    found = deleted.join(wanted, "pmcid", "left_semi").select(*deleted.columns)
    lost = wanted.join(found.select("pmcid"), "pmcid", "left_anti").count() + found.select("pmcid", F.col("document.raw_path").alias("raw_path")).join(sources.select("raw_path").distinct(), "raw_path", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} of the documents can't be restored; none was")
    back = found.select("document.*")
    rest = documents.join(wanted, "pmcid", "left_anti").select(*documents.columns)
    return Change(rest.unionByName(back), deleted.join(wanted, "pmcid", "left_anti").select(*deleted.columns), manifest_rows(back, status=F.lit("restored"), acquired_at=F.lit(now)))


def purge(deleted: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones without those of ``ids``: their content is gone for good."""
    return deleted.join(ids.select("pmcid").distinct(), "pmcid", "left_anti").select(*deleted.columns)


def overview(documents: DataFrame) -> DataFrame:
    """Documents, words and sentences of a library, in a row."""
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("statistics.words"), F.lit(0)).alias("words"), F.coalesce(F.sum("statistics.sentences"), F.lit(0)).alias("sentences"))


def matching(documents: DataFrame, query: str) -> DataFrame:
    """Documents whose identifier and title contain a string, whatever its case."""
    return documents.where(F.contains(F.lower(F.concat_ws(" ", "pmcid", "title")), F.lit(query.strip().lower())))


def select_candidates(candidates: DataFrame, fetched: DataFrame, target: int) -> DataFrame:
    """The outcome of each candidate (pmid, ord): the first ``target`` eligible ones in order are selected.

    ``fetched`` has a row for each record that came back: pmid, kind (article or
    book), languages, error ("" if it could be parsed) and abstract. Reasons
    are tried in order; who is eligible comes first, then the count.
    """
    by_id = fetched.groupBy("pmid").agg(F.count(F.lit(1)).alias("records"), F.first(F.struct("kind", "languages", "error", "abstract")).alias("r"))
    joined = candidates.select("pmid", "ord").join(by_id, "pmid", "left")
    # The reasons as they are stored, here and below.
    excluded = (
        F.when(F.col("records").isNull(), "missing_from_efetch")
        .when(F.col("records") > 1, "ambiguous_duplicate_record")
        .when(F.col("r.kind") == "book", "unsupported_book_record")
        .when(~F.coalesce(F.array_contains("r.languages", "eng"), F.lit(False)), "language_not_confirmed_english")
        .when(F.col("r.error") != "", "parse_error")
        .when(~F.coalesce(F.col("r.abstract").rlike("(?U)\\S"), F.lit(False)), "empty_abstract")
    )
    marked = joined.withColumn("excluded", excluded).withColumn("bucket", F.floor(F.col("ord") / 10_000))
    sums = marked.groupBy("bucket").agg(F.count_if(F.col("excluded").isNull()).alias("n"))
    before = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum(F.when(F.col("excluded").isNull(), 1).otherwise(0)).over(Window.partitionBy("bucket").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    place = marked.withColumn("own", own).join(before, "bucket").withColumn("place", F.col("own") + F.col("before"))
    chosen = F.col("place") <= target
    status = F.when(F.col("excluded").isNotNull(), "excluded").when(chosen, "selected").otherwise("not_needed")
    reason = F.coalesce("excluded", F.when(chosen, "english_nonempty_abstract").otherwise("eligible_after_target_reached"))
    return place.select("pmid", "ord", status.alias("status"), reason.alias("reason"), F.greatest(F.coalesce("records", F.lit(1)) - 1, F.lit(0)).alias("duplicate_records"), F.coalesce("r.languages", F.array().cast("array<string>")).alias("languages"))


def publish(documents: DataFrame, deleted: DataFrame, snapshot: DataFrame, now: str = "") -> Change:
    """Puts a snapshot's documents into the library: they replace those of the same identifier and lift its tombstones."""
    fresh = snapshot.select(*documents.columns)
    known = documents.select("pmcid", F.sha2(F.to_json(F.struct(*documents.columns)), 256).alias("old"))
    marked = fresh.withColumn("new", F.sha2(F.to_json(F.struct(*documents.columns)), 256)).join(known, "pmcid", "left")
    status = F.when(F.col("old").isNull(), "imported").otherwise("updated")
    log = manifest_rows(marked.where("old IS NULL OR old <> new"), status=status, reason=F.lit("published from a snapshot"), imported_at=F.lit(now))
    rest = documents.join(fresh.select("pmcid"), "pmcid", "left_anti").select(*documents.columns)
    return Change(rest.unionByName(fresh), deleted.join(fresh.select("pmcid"), "pmcid", "left_anti").select(*deleted.columns), log)


class StoredLibrary:
    """A library kept as a unit: documents, tombstones, manifest and the state of its folder change in one version.

    Every change is worked out from the last version and tried again if another
    writer was first. With a ``lease`` (``log.acquire``) no one else writes meanwhile.
    """

    def __init__(self, log: TableLog):
        self.log = log

    def tables(self, version: Version | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, tombstones and manifest of a version, the last one by default."""
        at = self.log.version() if version is None else version
        return tuple(self.log.read(at, name, kind) for name, kind in (("documents", DOCUMENT), ("deleted", TOMBSTONE), ("manifest", MANIFEST)))

    def change(self, make: Callable[[DataFrame, DataFrame], Change], operation: str, lease: Lease | None = None, tries: int = 5, more: Callable[[Version], dict[str, Write]] | None = None) -> Version:
        """Commits what ``make`` gives for the documents and tombstones; only buckets of identifiers in its manifest are written."""

        def writes(base: Version) -> dict[str, Write]:
            documents, deleted, _ = self.tables(base)
            made = make(documents, deleted)
            log = materialise(made.manifest, "manifest")
            keys = log.where("pmcid <> ''").select("pmcid")
            return {"documents": Write(made.documents, keys), "deleted": Write(made.deleted, keys), "manifest": Write(log, append=True), **(more(base) if more else {})}

        return self.log.transact(writes, operation, lease, tries)

    def import_articles(self, parsed: DataFrame, restore: bool = False, now: str = "", lease: Lease | None = None) -> Version:
        parsed = materialise(parsed, "parsed")
        return self.change(lambda documents, deleted: import_articles(documents, deleted, parsed, restore, now), "import", lease)

    def soft_delete(self, ids: DataFrame, reason: str = "", now: str = "", lease: Lease | None = None) -> Version:
        return self.change(lambda documents, deleted: soft_delete(documents, deleted, ids, reason, now), "delete", lease)

    def restore(self, ids: DataFrame, sources: DataFrame, now: str = "", lease: Lease | None = None) -> Version:
        return self.change(lambda documents, deleted: restore(documents, deleted, ids, sources, now), "restore", lease)

    def publish(self, snapshot: DataFrame, now: str = "", lease: Lease | None = None) -> Version:
        return self.change(lambda documents, deleted: publish(documents, deleted, snapshot, now), "publish", lease)

    def compact(self, lease: Lease | None = None) -> Version:
        """The manifest, a part for each change, in one part."""
        return self.log.transact(lambda base: {"manifest": Write(self.tables(base)[2])}, "compact", lease)
