"""Network connectors as Python data sources: polite, bounded, resumable requests.

``register`` adds the formats ``article_search`` (identifiers, page by page),
``article_api`` (batches of identifiers) and ``article_harvest`` (a list that
goes on by token, as a stream). The transport
is a function, so tests and other services can bring their own.
"""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAX_BYTES, MAX_REQUESTS, ATTEMPTS, MAX_WAIT = 25 * 1024 * 1024, 100, 3, 60.0


def polite_fetch(url: str, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, pause: float = 1.0) -> bytes:
    """The body of a response of at most ``MAX_BYTES``; tries again after 429, 5xx and timeouts, as long as told, up to a minute."""
    opener = opener or (lambda u: urllib.request.urlopen(u, timeout=30))
    for attempt in range(1, ATTEMPTS + 1):
        sleep(pause)
        try:
            with opener(url) as response:
                body = response.read(MAX_BYTES + 1)
            if len(body) > MAX_BYTES:
                raise ValueError("the response is larger than 25 MiB")
            return body
        except urllib.error.HTTPError as e:
            if attempt == ATTEMPTS or not (e.code == 429 or e.code >= 500):
                raise
            told = e.headers.get("Retry-After", "") if e.headers else ""
            sleep(min(MAX_WAIT, float(told) if told.isdigit() else 2.0**attempt))
        except (TimeoutError, urllib.error.URLError):
            if attempt == ATTEMPTS:
                raise
            sleep(2.0**attempt)
    raise AssertionError


class DamagedCache(ValueError):
    """A stored response isn't what was stored; it is neither used nor silently replaced."""


class Fetcher:
    """``polite_fetch`` with a cap on requests and, in a folder that all readers share, a cache of bodies.

    A body is kept under the digest of its URL with its own digest before it,
    so a job that was cut short goes on with what it has, without asking twice.
    One that doesn't match its digest is refused by name: whoever removes the
    file has it fetched again. The folder is a path, or a URL of a file system
    that pyarrow knows.
    """

    def __init__(self, cache: str = "", limit: int = MAX_REQUESTS, fetch: Callable[[str], bytes] | None = None):
        self.cache, self.left, self.fetch = cache, limit, fetch or polite_fetch

    def _folder(self):
        from pyarrow import fs

        if "://" in self.cache:
            return fs.FileSystem.from_uri(self.cache)
        return fs.LocalFileSystem(), os.path.abspath(self.cache)

    def __call__(self, url: str) -> bytes:
        system, folder = self._folder() if self.cache else (None, "")
        at = f"{folder}/{hashlib.sha256(url.encode()).hexdigest()}"
        if system and system.get_file_info(at).is_file:
            with system.open_input_stream(at) as f:
                raw = f.read()
            digest, body = raw[:64], raw[64:]
            if hashlib.sha256(body).hexdigest().encode() != digest:
                raise DamagedCache(f"{at}: the stored response to {url} is damaged; remove the file to have it fetched again")
            return body
        if not self.left:
            raise ValueError("the limit of requests is reached")
        self.left -= 1
        body = self.fetch(url)
        if system:
            system.create_dir(folder, recursive=True)
            own = f"{at}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(own) as f:
                f.write(hashlib.sha256(body).hexdigest().encode() + body)
            system.move(own, at)
        return body


def listed_headers(page: bytes) -> tuple[list[tuple[str, bool]], str]:
    """(identifier, deleted) of a list page's records, and the token by which the list goes on; "" at its end."""
    root = ET.fromstring(page)
    local = lambda n: n.tag.rpartition("}")[2]
    if faults := [f"{n.get('code', '')}: {(n.text or '').strip()}" for n in root.iter() if local(n) == "error"]:
        raise ValueError("; ".join(faults))
    rows = []
    for header in (n for n in root.iter() if local(n) == "header"):
        own = next((c.text or "" for c in header if local(c) == "identifier"), "")
        rows.append((own.strip(), header.get("status") == "deleted"))
    return rows, next((n.text or "" for n in root.iter() if local(n) == "resumptionToken"), "").strip()


def listed_ids(url: str, size: int, fetch: Callable[[str], bytes]) -> Iterator[tuple[int, str]]:
    """(place, identifier) of a search's results, page after page of ``size``, until as many as it counts have come."""
    place, total = 0, 1
    while place < total:
        root = ET.fromstring(fetch(f"{url}&retstart={place}&retmax={size}"))
        total = int(root.findtext("Count") or 0)
        found = [n.text or "" for n in root.iterfind("IdList/Id")]
        if not found and place < total:
            raise ValueError(f"the service gave {place} of {total} identifiers")
        for own in found:
            yield place, own
            place += 1


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.size = options["url"], int(options.get("page", 500))
        self.fetch = Fetcher(options.get("cache", ""))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from listed_ids(self.url, self.size, self.fetch)


class ArticleSearch(DataSource):
    """Options: url (a search, to which the page is added), page (size), cache. A row for each identifier found, with its place."""

    @classmethod
    def name(cls):
        return "article_search"

    def schema(self):
        return "place int, pmid string"

    def reader(self, schema):
        return _SearchReader(self.options)


class _ApiReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.ids = options["url"], [i for i in options.get("ids", "").split(",") if i]
        self.batch = int(options.get("batch", 20))
        if len(self.ids) > self.batch * MAX_REQUESTS:
            raise ValueError(f"at most {MAX_REQUESTS} requests")
        self.fetch = Fetcher(options.get("cache", ""))

    def partitions(self):
        # one partition, so that requests keep their distance
        return [InputPartition(0)]

    def read(self, partition):
        for i in range(0, len(self.ids), self.batch):
            own = self.ids[i : i + self.batch]
            yield ",".join(own), self.fetch(self.url + urllib.parse.quote(",".join(own), safe=","))


class ArticleApi(DataSource):
    """Options: url (a prefix that takes a list of identifiers), ids, batch, cache."""

    @classmethod
    def name(cls):
        return "article_api"

    def schema(self):
        return "ids string, content binary"

    def reader(self, schema):
        return _ApiReader(self.options)


class _HarvestReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.url = options["url"]

    def initialOffset(self):
        return {"token": "", "done": False}

    def _page(self, token: str):
        return listed_headers(polite_fetch(f"{self.url}&resumptionToken={urllib.parse.quote(token)}" if token else self.url))

    def read(self, start):
        if start["done"]:
            return iter([]), start
        rows, token = self._page(start["token"])
        return iter(rows), {"token": token, "done": not token}

    def readBetweenOffsets(self, start, end):
        return iter([] if start["done"] else self._page(start["token"])[0])


class ArticleHarvest(DataSource):
    """Options: url of the first page. A row for each listed identifier; deleted says that the record is gone."""

    @classmethod
    def name(cls):
        return "article_harvest"

    def schema(self):
        return "identifier string, deleted boolean"

    def simpleStreamReader(self, schema):
        return _HarvestReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleApi)
    spark.dataSource.register(ArticleSearch)
    spark.dataSource.register(ArticleHarvest)
