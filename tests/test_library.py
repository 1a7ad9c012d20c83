import os

import pytest
from pyspark.sql import functions as F

from folioscan import library
from folioscan.schemas import DOCUMENT, TOMBSTONE
from folioscan.sources import article_xml, readers, writers
from folioscan.streaming import sync
from tests_support import JATS

PUBMED = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>77</PMID><Article><ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="AIM">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<Language>eng</Language><Journal><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""


def parse(xml, scope="full"):
    return [article_xml.parse_article(a, scope) for a in article_xml.articles(xml.encode())]


def test_full_text():
    (doc,) = parse(JATS.format(n=5, body="Low water."))
    assert (doc["pmcid"], doc["pmid"], doc["title"], doc["year"], doc["language"], doc["license_url"]) == ("PMC5", "51", "Rivers of valley 5", "2021", "en", "https://creativecommons.org/licenses/by/4.0/")
    assert [(b["kind"], b["text"]) for b in doc["blocks"]] == [
        ("title", "Rivers of valley 5"), ("heading", "Aim"), ("abstract", "We mapped every stream."), ("heading", "Flow"), ("body", "Gauges of type two"), ("caption", "The map."), ("body", "were read daily."),
        ("body", "Low water."), ("table", "low"), ("table", "high"),
    ]
    assert doc["blocks"][4]["section"] == "正文 / Flow" and [b["text"] for b in doc["back_blocks"]] == ["Sources."]
    (short,) = parse(JATS.format(n=5, body="x"), "abstract")
    assert [b["text"] for b in short["blocks"]] == ["We mapped every stream."]


def read_blocks(xml):
    reader = article_xml.Reader(set())
    reader.read(article_xml.parse_safely(xml.encode()), "S", "body")
    return [(b["kind"], b["section"], b["text"]) for b in reader.blocks]


@pytest.mark.parametrize(
    ("xml", "blocks"),
    [
        ("<body>a<p>b <i>c</i> d</p>e</body>", [("body", "S", "a"), ("body", "S", "b c d"), ("body", "S", "e")]),
        # a block within a line parts the line and what it stands in
        ("<p>a <i>b <p>c</p> d</i> e</p>", [("body", "S", "a"), ("body", "S", "b"), ("body", "S", "c"), ("body", "S", "d"), ("body", "S", "e")]),
        # the title names what comes before it, too
        ("<sec><label>1</label><title>T <b>x</b></title><sec><p>y</p></sec></sec>", [("heading", "S / T x", "1"), ("heading", "S / T x", "T x"), ("body", "S / T x", "y")]),
        ("<body><p id='k'>a</p><i id='k'>b</i><p id='k'>c</p></body>", [("body", "S", "a"), ("body", "S", "b")]),
        ("<body><td>a<p>b</p><fig>c</fig></td><sub-article><p>d</p></sub-article></body>", [("table", "S", "a b c")]),
        # silent elements give no text, but part it if they hold blocks
        ("<p>a<graphic/>b<media><p>x</p></media>c</p>", [("body", "S", "ab"), ("body", "S", "c")]),
        ("<p>one<xref>two</xref>three</p>", [("body", "S", "one two three")]),
        ("<title>a<fig><caption><p>b</p></caption></fig></title>", [("body", "S", "a"), ("caption", "S", "b")]),
    ],
)
def test_blocks(xml, blocks):
    assert read_blocks(xml) == blocks


def test_pubmed():
    (doc,) = parse(PUBMED)
    assert (doc["pmcid"], doc["year"], doc["doi"], doc["content_scope"]) == ("PMID77", "1999", "10.1/x", "abstract")
    assert [(b["section"], b["text"]) for b in doc["blocks"]] == [("摘要 / AIM", "One."), ("摘要", "Two.")]


def test_wrappers_and_name_spaces():
    assert len(parse(f'<o:OAI xmlns:o="urn:o"><o:record>{JATS.format(n=1, body="a")}</o:record><o:record>{JATS.format(n=2, body="b")}</o:record></o:OAI>')) == 2


@pytest.mark.parametrize(
    "bad",
    [
        "<article>",
        "<article><front><article-meta/></front></article>",
        '<r><error code="idDoesNotExist">x</error></r>',
        '<r><header status="deleted"/></r>',
        '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><article>&x;</article>',
        '<!DOCTYPE a [<!ENTITY x "y">]><article>&x;</article>',
        "<r/>",
    ],
)
def test_bad_xml(bad):
    rows = list(article_xml.parse_file("f", bad.encode()))
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["document"] is None


def test_statistics():
    blocks = [{"id": "b0", "kind": "title", "section": "", "text": "IL-6", "narrative": False}, {"id": "b1", "kind": "body", "section": "", "text": "Dose 3.5 mg.", "narrative": True}]
    s = article_xml.statistics(blocks, "full")
    assert (s["characters"], s["characters_no_whitespace"], s["words"], s["sentences"]) == (17, 14, 4, 1)


def folder(tmp_path, **files):
    path = tmp_path / "raw"
    path.mkdir(exist_ok=True)
    for name, content in files.items():
        (path / f"{name}.xml").write_text(content)
    return str(path)


def empty(spark):
    return spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], TOMBSTONE)


def statuses(change):
    return {r.pmcid or r.raw_path.rpartition("/")[2]: r.status for r in change.manifest.collect()}


def test_import_statuses(spark, tmp_path):
    path = folder(tmp_path, a=JATS.format(n=1, body="x"), b=JATS.format(n=2, body="y"), c="<broken>")
    docs, gone = empty(spark)
    first = library.import_articles(docs, gone, readers.read_articles(spark, path))
    assert statuses(first) == {"PMC1": "imported", "PMC2": "imported", "c.xml": "failed"}
    writers.write_documents(first.documents, str(tmp_path / "docs"))
    stored = readers.read_documents(spark, str(tmp_path / "docs"))
    assert stored.count() == 2 and writers.collection_fingerprint(stored) == writers.collection_fingerprint(first.documents)
    folder(tmp_path, a=JATS.format(n=1, body="changed"))
    again = library.import_articles(stored, gone, readers.read_articles(spark, path))
    assert statuses(again) == {"PMC1": "updated", "PMC2": "duplicate", "c.xml": "failed"}
    deleted = library.soft_delete(stored, gone, spark.createDataFrame([("PMC2",)], "pmcid string"))
    assert [r.pmcid for r in deleted.documents.collect()] == ["PMC1"]
    skipped = library.import_articles(deleted.documents, deleted.deleted, readers.read_articles(spark, path))
    assert statuses(skipped)["PMC2"] == "skipped_deleted"
    with pytest.raises(ValueError):
        library.restore(deleted.documents, deleted.deleted, spark.createDataFrame([("PMC2",), ("PMC9",)], "pmcid string"), stored)
    back = library.restore(deleted.documents, deleted.deleted, spark.createDataFrame([("PMC2",)], "pmcid string"), stored)
    assert back.documents.count() == 2 and back.deleted.count() == 0
    assert readers.blocks_of(stored).where("kind = 'body'").count() > 0
    assert library.overview(stored).first().documents == 2 and library.matching(stored, "VALLEY 2").count() == 1


def test_sync_sees_contents_and_missing_sources(spark, tmp_path):
    path = folder(tmp_path, a=JATS.format(n=1, body="abc"), b=JATS.format(n=2, body="y"))
    docs, gone = empty(spark)
    nothing = spark.createDataFrame([], sync.STATE)
    one = sync.sync(spark, path, docs, gone, nothing)
    assert (one.imported, one.removed) == (2, 0)
    state = spark.createDataFrame(one.files.collect(), one.files.schema)
    docs = spark.createDataFrame(one.change.documents.collect(), DOCUMENT)
    stat = os.stat(f"{path}/a.xml")
    (tmp_path / "raw/a.xml").write_text(JATS.format(n=1, body="xyz"))
    os.utime(f"{path}/a.xml", (stat.st_atime, stat.st_mtime))
    os.rename(f"{path}/b.xml", tmp_path / "b.away")
    two = sync.sync(spark, path, docs, gone, state)
    assert (two.updated, two.removed, two.imported) == (1, 1, 0)
    docs2 = spark.createDataFrame(two.change.documents.collect(), DOCUMENT)
    gone2 = spark.createDataFrame(two.change.deleted.collect(), TOMBSTONE)
    state2 = spark.createDataFrame(two.files.collect(), two.files.schema)
    os.rename(tmp_path / "b.away", f"{path}/b.xml")
    three = sync.sync(spark, path, docs2, gone2, state2)
    assert three.restored == 1 and three.change.documents.count() == 2 and three.change.deleted.count() == 0


def test_stream_triggers_once(spark, tmp_path):
    path = folder(tmp_path, a=JATS.format(n=1, body="abc"))
    seen = []
    query = sync.watch(spark, path, lambda s: seen.append(s.count()), str(tmp_path / "check"), seconds=None)
    query.awaitTermination(60)
    assert seen == [1]


def test_pmid_list(spark, tmp_path):
    f = tmp_path / "ids.txt"
    f.write_bytes("﻿PMID: 12\n\n 7 \npmid 12\n".encode())
    assert readers.read_pmid_list(spark, str(f)) == (["12", "7"], 1)
    f.write_bytes("5\n6\n".encode("utf-16"))
    assert readers.read_pmid_list(spark, str(f)) == (["5", "6"], 0)
    for bad in (b"x\n", b"\n", b"0\n"):
        f.write_bytes(bad)
        with pytest.raises(ValueError):
            readers.read_pmid_list(spark, str(f))


def test_selection_cascade(spark):
    candidates = spark.createDataFrame([(str(i), i) for i in range(1, 7)], "pmid string, ord int")
    fetched = spark.createDataFrame([("1", "article", ["fre"], "", "x"), ("2", "article", ["eng"], "", " "), ("3", "article", ["eng"], "", "x"), ("4", "article", ["eng"], "", "x"), ("5", "article", ["eng"], "", "x")], "pmid string, kind string, languages array<string>, error string, abstract string")
    rows = {r.pmid: (r.status, r.reason) for r in library.select_candidates(candidates, fetched, 2).collect()}
    assert rows == {"1": ("excluded", "language_not_confirmed_english"), "2": ("excluded", "empty_abstract"), "3": ("selected", "english_nonempty_abstract"), "4": ("selected", "english_nonempty_abstract"), "5": ("not_needed", "eligible_after_target_reached"), "6": ("excluded", "missing_from_efetch")}


def test_only_single_matches_are_taken(spark, tmp_path):
    path = folder(tmp_path, a=JATS.format(n=1, body="x"), b=JATS.format(n=2, body="y"), c=JATS.format(n=2, body="z"), d=PUBMED)
    wanted = spark.createDataFrame([("11",), ("21",), ("99",)], "pmid string")
    rows = library.requested_only(readers.read_articles(spark, path), wanted).collect()
    assert sorted((r.document.pmid if r.document else r.raw_path, bool(r.error)) for r in rows) == [("11", False), ("21", True), ("99", True)]


def test_sealed_snapshot(spark, tmp_path):
    path = folder(tmp_path, p=PUBMED)
    docs = readers.documents_of(readers.read_articles(spark, path))
    selection = spark.createDataFrame([("77", "selected", "english_nonempty_abstract"), ("78", "excluded", "parse_error")], "pmid string, status string, reason string")
    root = tmp_path / "snap"
    writers.seal_snapshot(spark, docs, selection, [], "q", f"file://{root}")
    assert readers.verified_snapshot(spark, f"file://{root}").count() == 1
    text = (root / "abstracts.jsonl").read_text()
    (root / "abstracts.jsonl").write_text(text.replace("One.", "Two."))
    for crc in root.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        readers.verified_snapshot(spark, f"file://{root}")


def test_licences_and_pages(spark):
    urls = [("https://creativecommons.org/licenses/by/4.0/", True), ("http://www.creativecommons.org/publicdomain/zero/1.0/", True), ("https://example.org/licenses/by/4.0/", False), ("https://creativecommons.org/licenses/by/9.0/", False), ("", False)]
    rows = spark.createDataFrame(urls, "u string, ok boolean").select("ok", readers.reusable_license(F.col("u")).alias("r")).collect()
    assert all(r.ok == r.r for r in rows)
    page = spark.createDataFrame([("<p>a<script>x</script>b</p><p>c &amp; d</p>",)], "p string")
    assert page.select(readers.page_text(F.col("p"))).first()[0] == "ab c & d"


def test_publication_groups(spark):
    rows = spark.createDataFrame([(str(i), f"PMID{i}") for i in range(1, 251)], "pmid string, pmcid string")
    groups = writers.publication_groups(rows).groupBy("publication").count().orderBy("publication").collect()
    assert [r["count"] for r in groups] == [100, 100, 50]
