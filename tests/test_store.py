"""Files of a library: uploads, other scopes, removal for good."""

import pytest

from folioscan import library, store
from folioscan.schemas import DOCUMENT, TOMBSTONE
from folioscan.sources import readers
from tests_support import JATS

PUBMED = "<PubmedArticle><MedlineCitation><PMID>77</PMID><Article><ArticleTitle>Short</ArticleTitle><Abstract><AbstractText>One line.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"


def statuses(change):
    return {r.pmcid: r.status for r in change.manifest.collect()}


def wrapped(*articles):
    return f"<set>{''.join(articles)}</set>".encode()


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], TOMBSTONE)


def test_upload(spark, tmp_path, nothing):
    root, raw = str(tmp_path), JATS.format(n=3, body="Ice.").encode()
    change = store.upload(spark, root, "C:\\\\some\\\\where\\\\../a.XML", raw, *nothing)
    assert statuses(change) == {"PMC3": "imported"} and [p.name[:7] for p in (tmp_path / "raw").glob("*.xml")] == ["upload-"]
    assert statuses(store.upload(spark, root, "b.xml", raw, change.documents, change.deleted)) == {"PMC3": "duplicate"}
    assert statuses(store.upload(spark, root, "b.xml", b"<article/>", *nothing)) == {"": "failed"} and len(list((tmp_path / "rejected").glob("*.xml"))) == 1
    gone = library.soft_delete(change.documents, change.deleted, spark.createDataFrame([("PMC3",)], "pmcid string"))
    back = store.upload(spark, root, "a.xml", raw, gone.documents, gone.deleted)
    assert back.documents.count() == 1 and back.deleted.count() == 0
    for name, content in (("a.txt", raw), ("a.xml", b"")):
        with pytest.raises(ValueError):
            store.upload(spark, root, name, content, *nothing)
    with store.sole_writer(spark, root), pytest.raises(store.StoreError):
        store.upload(spark, root, "a.xml", raw, *nothing)


def test_scope(spark, tmp_path, nothing):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.xml").write_text(JATS.format(n=1, body="Ice."))
    (tmp_path / "raw/b.xml").write_text(PUBMED)
    have = library.import_articles(*nothing, readers.read_articles(spark, str(tmp_path / "raw"))).documents
    ids = spark.createDataFrame([("PMC1",), ("PMID77",)], "pmcid string")
    short = store.switch_scope(spark, str(tmp_path), have, nothing[1], ids, "abstract")
    assert statuses(short) == {"PMC1": "updated"} and {r.pmcid: r.content_scope for r in short.documents.collect()} == {"PMC1": "abstract", "PMID77": "abstract"}
    long = store.switch_scope(spark, str(tmp_path), short.documents, nothing[1], ids, "full")
    assert statuses(long) == {"PMC1": "updated", "PMID77": "kept"} and long.documents.count() == 2


def removed(spark, tmp_path, nothing, **files):
    (tmp_path / "raw").mkdir()
    for name, content in files.items():
        (tmp_path / f"raw/{name}.xml").write_bytes(content)
    have = library.import_articles(*nothing, readers.read_articles(spark, str(tmp_path / "raw"))).documents
    return library.soft_delete(have, nothing[1], spark.createDataFrame([("PMC1",)], "pmcid string"))


def test_purge(spark, tmp_path, nothing):
    one, two = JATS.format(n=1, body="Ice."), JATS.format(n=2, body="Snow.")
    gone = removed(spark, tmp_path, nothing, a=one.encode(), b=wrapped(two, one), c=two.encode(), d=b"<broken")
    left, log = store.purge(spark, str(tmp_path), gone.deleted, ["PMC1", "PMC2"])
    assert left.count() == 0 and [(r.pmcid, r.status) for r in log.collect()] == [("PMC1", "purged")]
    assert sorted(p.name for p in (tmp_path / "raw").glob("*.xml")) == ["b.xml", "c.xml", "d.xml"]
    assert {r.document.pmcid for r in readers.read_articles(spark, str(tmp_path / "raw/b.xml")).collect()} == {"PMC2"}
    assert not (tmp_path / store.JOURNAL).exists() and not store.resume_purge(spark, str(tmp_path))


def test_purge_goes_on_where_it_was_cut_short(spark, tmp_path, nothing, monkeypatch):
    one, two = JATS.format(n=1, body="Ice."), JATS.format(n=2, body="Snow.")
    gone = removed(spark, tmp_path, nothing, a=one.encode(), b=wrapped(two, one))

    def stop(*_):
        raise OSError("the power went")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "write_bytes", stop)
        store.purge(spark, str(tmp_path), gone.deleted, ["PMC1"])
    with pytest.raises(store.StoreError):
        store.upload(spark, str(tmp_path), "x.xml", one.encode(), *nothing)
    assert store.resume_purge(spark, str(tmp_path)) and [p.name for p in (tmp_path / "raw").glob("*.xml")] == ["b.xml"]


def test_purge_stops_before_damage(spark, tmp_path, nothing):
    gone = removed(spark, tmp_path, nothing, a=JATS.format(n=1, body="Ice.").encode())
    tombstones = spark.createDataFrame(gone.deleted.collect(), TOMBSTONE)
    (tmp_path / "raw/a.xml").write_bytes(b"<broken")
    with pytest.raises(store.StoreError):
        store.purge(spark, str(tmp_path), tombstones, ["PMC1"])
    assert (tmp_path / "raw/a.xml").exists() and not (tmp_path / store.JOURNAL).exists()
