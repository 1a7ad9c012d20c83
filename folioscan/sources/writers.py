"""Writers: document JSON lines, manifests, CSV exports, sealed snapshots, publication groups."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import document_order
from ..storage import hadoop

#: Columns of the digests of a sealed snapshot's parts.
PART = "table string, part string, rows long, sha256 string"


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines in the order of identifiers across files; Spark's commit makes the whole set visible at once."""
    ordered = documents.withColumn("__o", document_order(F.col("pmcid")))
    ordered.repartitionByRange("__o").sortWithinPartitions("__o").drop("__o").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV with a header and the columns in the given order; further columns are left out.

    The header begins with a byte order mark, by which spreadsheets know UTF-8.
    """
    marked = [F.col(c).alias("\ufeff" + c if i == 0 else c) for i, c in enumerate(columns)]
    df.select(*marked).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def canonical(column: Column) -> Column:
    """Compact JSON of a value, fields in schema order."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def collection_fingerprint(documents: DataFrame, id_col: str = "pmcid") -> str:
    """SHA-256 over the documents' digests: the same for the same content however it is stored.

    Digests are grouped by their first twelve bits and hashed in the order of
    identifiers within a group, so one digest a group reaches the driver.
    """
    rows = documents.select(document_order(F.col(id_col)).alias("o"), F.sha2(canonical(F.struct(*documents.columns)), 256).alias("d"))
    groups = rows.withColumn("g", F.conv(F.substring("d", 1, 3), 16, 10).cast("int")).groupBy("g").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), ""), 256).alias("h"))
    return hashlib.sha256("".join(r["h"] for r in groups.orderBy("g").collect()).encode()).hexdigest()


def text_fingerprint(pairs: list[tuple[str, str]]) -> str:
    """SHA-256 of the compact JSON list of [identifier, text] pairs."""
    return hashlib.sha256(json.dumps([list(p) for p in pairs], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def summary_json(rows: dict) -> str:
    """Indented JSON; numbers that JSON lacks are an error."""

    def check(value):
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("not a finite number")
        if isinstance(value, dict):
            for v in value.values():
                check(v)
        elif isinstance(value, list | tuple):
            for v in value:
                check(v)

    check(rows)
    return json.dumps(rows, ensure_ascii=False, indent=2, allow_nan=False)


def publication_groups(documents: DataFrame, size: int = 100) -> DataFrame:
    """Adds ``publication``: documents in the lexical order of their PMID, ``size`` to a group."""
    clash = documents.groupBy("pmcid").count().where("count > 1")
    if not clash.isEmpty():
        raise ValueError("different PMIDs share a document identifier")
    ids = documents.select("pmid").distinct()
    part = F.substring("pmid", 1, 4)
    sizes = ids.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ids.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("pmid"))).join(before, "part")
    return documents.join(ranked.select("pmid", F.floor((F.col("before") + F.col("k") - 1) / size).cast("int").alias("publication")), "pmid")


def seal_snapshot(spark: SparkSession, documents: DataFrame, selection: DataFrame, raw_files: list[dict], query: str, root: str) -> None:
    """Writes abstracts.jsonl, selection.json and, last, snapshot.json, which makes the snapshot valid.

    A snapshot is a fixed sample that people review, so it is written as single
    files; rows pass through the driver one partition at a time.
    """
    from ..operators.evaluation import status_counts

    def put(name: str, pieces: Iterable[str]) -> str:
        system, path = hadoop(spark, f"{root}/{name}")
        out, digest = system.create(path, True), hashlib.sha256()
        for piece in pieces:
            data = piece.encode()
            digest.update(data)
            out.write(bytearray(data))
        out.close()
        return digest.hexdigest()

    def listed(rows: Iterable[str]) -> Iterator[str]:
        yield "["
        for i, row in enumerate(rows):
            yield (", " if i else "") + row
        yield "]"

    ordered = documents.withColumn("__o", document_order(F.col("pmcid"))).orderBy("__o").select(canonical(F.struct(*documents.columns)))
    chosen = selection.orderBy("pmid")
    digests = {
        "abstracts": put("abstracts.jsonl", (r[0] + "\n" for r in ordered.toLocalIterator())),
        "selection": put("selection.json", listed(json.dumps(r.asDict(True), ensure_ascii=False) for r in chosen.toLocalIterator())),
    }
    selected = [r[0] for r in chosen.where("status = 'selected'").select("pmid").toLocalIterator()]
    reasons = {r["reason"]: r["n"] for r in status_counts(selection.where("status = 'excluded'"), "reason").collect()}
    meta = {"schema_version": 1, "query": query, "counts": {r["status"]: r["n"] for r in status_counts(selection).collect()}, "selected_pmids": selected, "sha256": digests, "raw_files": raw_files, "exclusion_reasons": reasons}
    put("snapshot.json", summary_json(meta))


def part_digests(spark: SparkSession, root: str, tables: tuple[str, ...] = ("abstracts", "selection")) -> DataFrame:
    """(table, part, rows, sha256) of the written parts: the digest of a part is over the sorted digests of its lines.

    Tasks make them; a part has a bounded number of lines.
    """
    found = None
    for name in tables:
        lines = spark.read.text(f"{root}/{name}").select(F.lit(name).alias("table"), F.col("_metadata.file_name").alias("part"), F.sha2("value", 256).alias("line"))
        found = lines if found is None else found.unionByName(lines)
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ""), 256)
    return found.groupBy("table", "part").agg(F.count(F.lit(1)).alias("rows"), digest.alias("sha256"))


def root_digest(parts: DataFrame) -> str:
    """One digest over those of all parts. They are brought together by their first twelve bits, so few digests reach the driver."""
    rows = parts.select(F.struct("table", "part", "rows", "sha256").alias("p"), F.substring("sha256", 1, 3).alias("g"))
    groups = rows.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: F.concat_ws(":", p["table"], p["part"], p["rows"], p["sha256"])), "\n"), 256).alias("h"))
    return hashlib.sha256("".join(r["h"] for r in groups.orderBy("g").collect()).encode()).hexdigest()


def seal_parts(spark: SparkSession, documents: DataFrame, selection: DataFrame, query: str, root: str, raw_files: DataFrame | None = None, rows_per_part: int = 50_000) -> str:
    """Seals a snapshot of any size: parts in the order of identifiers, their digests, and last snapshot.json with the root digest, which it returns.

    Tasks write the parts and make the digests; the driver sees counts and the
    root. ``raw_files`` has file (a path below ``root``) and sha256.
    """
    from ..operators.evaluation import status_counts

    def put(rows: DataFrame, order: Column, name: str) -> None:
        n = max(1, -(-rows.count() // rows_per_part))
        keyed = rows.select(order.alias("__o"), canonical(F.struct(*rows.columns)).alias("value"))
        keyed.repartitionByRange(n, "__o", "value").sortWithinPartitions("__o", "value").select("value").write.mode("overwrite").text(f"{root}/{name}")

    put(documents, document_order(F.col("pmcid")), "abstracts")
    put(selection, F.col("pmid"), "selection")
    if raw_files is not None:
        put(raw_files.select("file", "sha256"), F.col("file"), "raw_files")
    tables = ("abstracts", "selection", *(("raw_files",) if raw_files is not None else ()))
    part_digests(spark, root, tables).coalesce(1).write.mode("overwrite").json(f"{root}/parts")
    digest = root_digest(spark.read.schema(PART).json(f"{root}/parts"))
    reasons = {r["reason"]: r["n"] for r in status_counts(selection.where("status = 'excluded'"), "reason").collect()}
    meta = {"schema_version": 2, "query": query, "counts": {r["status"]: r["n"] for r in status_counts(selection).collect()}, "tables": tables, "root": digest, "exclusion_reasons": reasons}
    spark.range(1).select(F.lit(summary_json(meta))).coalesce(1).write.mode("overwrite").text(f"{root}/snapshot.json")
    return digest
