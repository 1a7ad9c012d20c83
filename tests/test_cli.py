import pytest

from folioscan import cli, library
from folioscan.sources import connectors
from folioscan.versions import TableLog
from tests_support import JATS


def test_import_stats_search_spell(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    for n, body in ((1, "Cancer treatment works."), (2, "Other words.")):
        (tmp_path / f"raw/{n}.xml").write_text(JATS.format(n=n, body=body))
    docs = str(tmp_path / "docs")
    assert cli.main(["import", str(tmp_path / "raw"), "--out", docs]) == 0
    assert cli.main(["stats", docs]) == 0
    at = str(tmp_path / "index")
    assert cli.main(["build", docs, "--out", at]) == 0
    before = sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*"))
    assert cli.main(["build", docs, "--out", at]) == 0 and before == sorted((p, p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*"))
    assert cli.main(["search", "cancers", at, "--documents", docs]) == 0
    with pytest.raises(SystemExit):
        cli.main(["search", "cancer", at, "--mode", "AND"])
    assert cli.main(["build", docs, "--variant", "plain", "--phrases", "--out", at]) == 0
    assert cli.main(["search", "cancer treatment", at, "--mode", "PHRASE"]) == 0
    assert cli.main(["spell", "treatmnet", docs]) == 0
    assert cli.main(["analyze", docs, "--out", str(tmp_path / "a")]) == 0
    head = next((tmp_path / "a/top50").glob("part-*")).read_bytes()
    assert head.startswith(b"\xef\xbb\xbfcondition,rank,term") and len(list((tmp_path / "a").iterdir())) == 8
    assert cli.main(["train", docs, "--out", str(tmp_path / "v")]) == 0
    assert cli.main(["neighbors", "stream", str(tmp_path / "v"), docs]) == 0
    out = capsys.readouterr().out
    assert "PMC1" in out and "treatment" in out


def test_download_goes_on(spark, tmp_path, capsys, monkeypatch):
    asked = []

    def answer(url):
        asked.append(url)
        if "GetRecord" in url:
            n = url.rpartition("%3A" if "%3A" in url else ":")[2]
            return JATS.format(n=n, body="Ice.").encode()
        ids = (1, 2) if "resumptionToken" not in url else (3,)
        return f"<OAI>{''.join(f'<header><identifier>oai:x:{n}</identifier></header>' for n in ids)}<resumptionToken>{'next' if len(ids) == 2 else ''}</resumptionToken></OAI>".encode()

    monkeypatch.setattr(cli.harvest, "Fetcher", lambda cache, fetch=None: answer)
    root = str(tmp_path / "lib")
    assert cli.main(["download", root, "--count", "2"]) == 0
    assert cli.main(["download", root, "--count", "5"]) == 0
    assert cli.main(["download", root, "--count", "5"]) == 0
    documents, _, manifest = library.StoredLibrary(TableLog(spark, f"{root}/library")).tables()
    assert manifest.count() == 3 and documents.count() + manifest.where("status = 'failed'").count() == 3
    lists = [u for u in asked if "ListIdentifiers" in u]
    assert [("from=2025-01-01" in u, "resumptionToken=next" in u) for u in lists] == [(True, False), (False, True)]
    assert "nothing new" in capsys.readouterr().out
    for bad in (["--count", "51"], ["--from-date", "2025-02-01"]):
        with pytest.raises(SystemExit):
            cli.main(["download", root, *bad])


RECORD = "<PubmedArticle><MedlineCitation><PMID>{n}</PMID><Article><Language>{lang}</Language><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>One {n}.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"


def test_fetch_seals_a_snapshot(spark, tmp_path, capsys, monkeypatch):
    def answer(url, **_):
        if "esearch" in url:
            return f"<r><Count>5</Count><IdList>{''.join(f'<Id>{n}</Id>' for n in range(1, 6))}</IdList></r>".encode()
        ids = url.rpartition("=")[2].split(",")
        return f"<PubmedArticleSet>{''.join(RECORD.format(n=n, lang='fre' if n == '2' else 'eng') for n in ids)}</PubmedArticleSet>".encode()

    monkeypatch.setattr(connectors, "polite_fetch", answer)
    root = str(tmp_path / "snap")
    assert cli.main(["fetch", "ice", root, "--count", "3"]) == 0
    assert "3 abstracts, sealed as" in capsys.readouterr().out
    assert cli.main(["verify", root]) == 0
    with pytest.raises(SystemExit):
        monkeypatch.setattr(connectors, "polite_fetch", lambda url: b"<r><Count>0</Count><IdList/></r>")
        cli.main(["fetch", "nothing", str(tmp_path / "none")])
