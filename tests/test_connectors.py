"""Requests without a network: the transport is a function."""

import io
import urllib.error
import urllib.parse

import pytest

from folioscan.sources import connectors


def page(total, ids):
    return f"<r><Count>{total}</Count><IdList>{''.join(f'<Id>{i}</Id>' for i in ids)}</IdList></r>".encode()


def service(total, cut=None):
    """A search of ``total`` results; from the place ``cut`` on its pages are empty."""

    def fetch(url):
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(url.partition("?")[2]).items() if k.startswith("ret")}
        stop = min(total, q["retstart"] + q["retmax"])
        return page(total, range(q["retstart"], stop if cut is None or q["retstart"] < cut else q["retstart"]))

    return fetch


def test_pages_follow_until_all_have_come():
    assert list(connectors.listed_ids("u?x=1", 4, service(10))) == [(i, str(i)) for i in range(10)]
    assert list(connectors.listed_ids("u?x=1", 4, service(0))) == []
    with pytest.raises(ValueError):
        list(connectors.listed_ids("u?x=1", 4, service(10, cut=4)))


def test_cache_and_cap(tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        return b"body of " + url.encode()

    first = connectors.Fetcher(str(tmp_path / "c"), limit=2, fetch=fetch)
    assert [first(u) for u in ("a", "b", "a")] == [b"body of a", b"body of b", b"body of a"] and asked == ["a", "b"]
    with pytest.raises(ValueError):
        first("c")
    (file,) = [p for p in (tmp_path / "c").iterdir() if p.read_bytes().endswith(b"of b")]
    file.write_bytes(file.read_bytes()[:-1] + b"!")
    again = connectors.Fetcher(str(tmp_path / "c"), fetch=fetch)
    assert again("a") == b"body of a"
    with pytest.raises(connectors.DamagedCache, match=file.name):
        again("b")
    assert asked == ["a", "b"] and file.read_bytes().endswith(b"of !")
    file.unlink()
    assert again("b") == b"body of b" and asked == ["a", "b", "b"]


def test_requests_are_tried_again():
    waited, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None), TimeoutError(), io.BytesIO(b"ok")]

    def opener(_):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert connectors.polite_fetch("u", opener, waited.append) == b"ok" and 7 in waited
    with pytest.raises(urllib.error.HTTPError):
        connectors.polite_fetch("u", lambda _: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, None)), waited.append)
