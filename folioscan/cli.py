"""Command line: ``python -m folioscan.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import itertools
import re
import urllib.parse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import library, store
from .functions import text
from .operators import index, search, spelling, vectors
from .plans import analysis
from .schemas import TOMBSTONE
from .session import local_session, ship_package
from .sources import connectors, readers, writers
from .storage import materialise
from .streaming import harvest
from .versions import TableLog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscan")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple[str, dict], help: str) -> None:
        own = sub.add_parser(name, help=help)
        for flag, options in arguments:
            own.add_argument(flag, **options)

    docs = ("documents", {"help": "folder of stored documents"})
    out = ("--out", {"required": True})
    query = ("query", {})
    command(
        "download", ("root", {"help": "folder of the library and its harvest"}), ("--count", {"type": int, "default": 15, "help": "records to ask for, 50 at most"}), ("--from-date", {"default": "2025-01-01"}), ("--until-date", {"default": "2025-01-02"}),
        ("--set", {"dest": "set_spec", "default": "pmc-open"}), help="go on with a harvest of articles and import what may be reused",
    )
    command("fetch", query, ("root", {"help": "folder of the snapshot"}), ("--count", {"type": int, "default": 1000}), help="search abstracts, take the first English ones and seal them")
    command("import", ("folder", {}), ("--scope", {"choices": ["full", "abstract"], "default": "full"}), out, help="parse a folder of XML and store its documents")
    command("build", docs, ("--variant", {"choices": index.VARIANTS, "default": "porter_relevance"}), ("--phrases", {"action": "store_true", "help": "with the token table that phrase search needs"}), out, help="build an index, unless the one there is still right")
    command("search", query, ("index", {"help": "folder of a built index"}), ("--documents", {"help": "folder of stored documents, for titles"}), ("--mode", {"choices": search.MODES}), ("--limit", {"type": int, "default": 10}), help="search a built index")
    command("stats", docs, help="totals of a library")
    command("analyze", docs, out, help="four-condition analysis of abstracts, as CSV")
    command("spell", query, docs, help="spelling suggestions from the documents' words")
    command("train", docs, out, help="train word vectors on the sentences of the abstracts")
    command("neighbors", query, ("vectors", {"help": "folder of trained vectors"}), docs, ("--top", {"type": int, "default": 10}), help="neighbours of a word")
    command("publish", ("snapshot", {}), docs, out, help="stored documents with a sealed snapshot's put in")
    command("verify", ("snapshot", {}), help="check a sealed snapshot")
    return p


# The services' addresses.
OAI_URL = "https://pmc.ncbi.nlm.nih.gov/api/oai/v1/mh/"
EUTILS_URL = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
#: Records of a request for abstracts, and candidates that are looked at for each one wanted.
FETCH_BATCH, CANDIDATES = 100, 3


def download(spark: SparkSession, a: argparse.Namespace, now: str) -> int:
    if not 1 <= a.count <= 50:
        raise SystemExit("between 1 and 50 records can be asked for at a time")
    dates = [datetime.date.fromisoformat(d) for d in (a.from_date, a.until_date)]
    if dates[0] > dates[1]:
        raise SystemExit("the first day must not lie after the last")
    asked = urllib.parse.urlencode({"verb": "ListIdentifiers", "metadataPrefix": "pmc", "set": a.set_spec, "from": a.from_date, "until": a.until_date})
    own = harvest.Harvest(
        TableLog(spark, f"{a.root}/harvest-{hashlib.sha256(asked.encode()).hexdigest()[:12]}", key="identifier"), f"{OAI_URL}?{asked}", f"{OAI_URL}?verb=GetRecord&metadataPrefix=pmc&identifier=", f"{a.root}/cache",
        next_url=f"{OAI_URL}?verb=ListIdentifiers&resumptionToken=",
    )
    left = a.count
    while left > 0:
        listing = own.pending().isEmpty()
        before = own.log.version().number
        came = own.run(1 if listing else left, now)
        left -= came
        if own.log.version().number == before or (not listing and not came):
            break
    paths = []
    for r in own.records().where(F.col("fetched_at") == now).toLocalIterator():
        paths.append(f"{a.root}/raw/{re.sub('[^A-Za-z0-9]+', '-', r.identifier)}.xml")
        store.write_bytes(spark, paths[-1], bytes(r.content))
    if not paths:
        print("nothing new has come")
        return 0
    parsed = readers.read_articles(spark, paths)
    fit = readers.english(F.col("document.language")) & readers.reusable_license(F.col("document.license_url"))
    reason = F.when((F.col("error") == "") & ~F.coalesce(fit, F.lit(False)), "not in English, or not to be reused").otherwise(F.col("error"))
    kept = library.StoredLibrary(TableLog(spark, f"{a.root}/library"))
    version = kept.import_articles(parsed.withColumn("error", reason), now=now)
    kept.tables(version)[2].where(F.col("imported_at") == now).groupBy("status").count().show()
    return 0


def fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    ask = connectors.Fetcher(f"{a.root}/cache", limit=CANDIDATES * a.count // FETCH_BATCH + 10)
    search_url = f"{EUTILS_URL}esearch.fcgi?{urllib.parse.urlencode({'db': 'pubmed', 'retmode': 'xml', 'term': a.query})}"
    ids = [pmid for _, pmid in itertools.islice(connectors.listed_ids(search_url, 500, ask), CANDIDATES * a.count)]
    files = []
    for at in range(0, len(ids), FETCH_BATCH):
        raw = ask(f"{EUTILS_URL}efetch.fcgi?db=pubmed&retmode=xml&id={','.join(ids[at : at + FETCH_BATCH])}")
        files.append((f"raw/batch-{at // FETCH_BATCH:05d}.xml", hashlib.sha256(raw).hexdigest()))
        store.write_bytes(spark, f"{a.root}/{files[-1][0]}", raw)
    if not files:
        raise SystemExit("the search finds nothing")
    parsed = materialise(readers.read_articles(spark, [f"{a.root}/{f}" for f, _ in files], "abstract"), "parsed")
    good = parsed.where("error = ''").select("document.*")
    texts = good.select("pmid", F.array("language").alias("languages")).join(readers.abstract_texts(good), "pmid")
    fetched = texts.select("pmid", F.lit("article").alias("kind"), "languages", F.lit("").alias("error"), F.col("text").alias("abstract"))
    candidates = spark.createDataFrame([(pmid, i) for i, pmid in enumerate(dict.fromkeys(ids))], "pmid string, ord int")
    selection = materialise(library.select_candidates(candidates, fetched, a.count), "selection")
    chosen = good.join(selection.where("status = 'selected'").select("pmid"), "pmid", "left_semi").select(*good.columns)
    digest = writers.seal_parts(spark, chosen, selection.select("pmid", "status", "reason"), a.query, a.root, spark.createDataFrame(files, "file string, sha256 string"))
    print(f"{readers.verified_snapshot(spark, a.root).count()} abstracts, sealed as {digest}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session("folioscan")
    ship_package(spark)
    if a.command == "download":
        return download(spark, a, datetime.datetime.now(datetime.UTC).isoformat())
    if a.command == "fetch":
        return fetch(spark, a)
    if a.command == "verify":
        print(f"{readers.verified_snapshot(spark, a.snapshot).count()} documents, all as sealed")
        return 0
    if a.command == "import":
        parsed = readers.read_articles(spark, a.folder, a.scope)
        parsed.where("error <> ''").select("raw_path", "error").show(50, truncate=False)
        writers.write_documents(readers.documents_of(parsed), a.out)
        return 0
    if a.command == "search":
        own = index.read_index(spark, a.index)
        mode = a.mode or ("RELEVANCE" if "relevance" in own.variant else "OR")
        if (mode == "RELEVANCE") != ("relevance" in own.variant):
            raise SystemExit(f"an index of the variant {own.variant} can't answer {mode}")
        rows = index.read_tokens(spark, a.index) if mode == "PHRASE" else None
        r = search.search(own, a.query, mode, "porter" in own.variant, "tfidf", rows)
        print("\n".join(x for x in (r.warning, r.query_message, f"unknown: {', '.join(r.missing_terms)}" if r.missing_terms else "") if x))
        hits = r.hits.where(F.col("rank") <= a.limit)
        if a.documents:
            hits = hits.join(readers.read_documents(spark, a.documents).select(F.col("pmcid").alias("doc_id"), "title"), "doc_id", "left")
        hits.orderBy("rank").show(a.limit, truncate=80)
        return 0
    docs = readers.read_documents(spark, a.documents)
    blocks = readers.blocks_of(docs)
    if a.command == "stats":
        library.overview(docs).show()
    elif a.command == "publish":
        change = library.publish(docs, spark.createDataFrame([], TOMBSTONE), readers.verified_snapshot(spark, a.snapshot))
        writers.write_documents(change.documents, a.out)
        change.manifest.groupBy("status").count().show()
    elif a.command == "build":
        index.current_index(blocks, a.out, a.variant, phrases=a.phrases)
    elif a.command == "analyze":
        texts = analysis.validated(readers.abstract_texts(docs), "pmid", "text")
        n = texts.count()
        counts = analysis.corpus_counts(texts, "pmid", exact=True)
        ranked = analysis.ranked_terms(counts, n)
        chosen = analysis.selected_terms(ranked.where("condition = 'B'"), n)
        summary = analysis.summaries(ranked, n)
        terms = ["condition", "rank", "term", "cf", "df", "idf"]
        chosen_terms = [*terms, "coverage", "occurrences_per_document"]
        fit = ["condition", "segment", "points", "rank_start", "rank_end", "slope", "intercept", "zipf_exponent", "r_squared", "rmse", "status"]
        for name, rows, columns in (
            ("terms", ranked, terms),
            ("top50", ranked.where("rank <= 50"), terms),
            ("documents", analysis.document_counts(texts, "pmid"), ["condition", "pmid", "tokens", "unique_terms"]),
            ("summary", summary, summary.columns),
            ("comparison", analysis.comparison_rows(summary), ["condition", "metric", "value"]),
            ("regression", analysis.zipf_fits(ranked), fit),
            ("selected", chosen, chosen_terms),
            ("representative", analysis.representative_terms(chosen), chosen_terms),
        ):
            writers.write_csv(rows, columns, f"{a.out}/{name}")
    elif a.command == "spell":
        q = spark.createDataFrame([(1, a.query)], "query_id int, query string")
        spelling.choices(spelling.suggest(q, spelling.build_vocabulary(blocks))).show(truncate=False)
    elif a.command == "train":
        rows = vectors.training_records(blocks.where("kind = 'abstract'"), ["doc_id", "block_id"])
        vectors.save_vectors(vectors.train_words_sampled(rows), a.out, writers.collection_fingerprint(docs))
    else:
        known = vectors.load_vectors(spark, a.vectors, writers.collection_fingerprint(docs))
        state, found = vectors.neighbours(known, a.query, a.top)
        print(state) if found is None else found.orderBy("rank").show(a.top)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
