"""A harvest that can be cut short anywhere: a list that goes on by token, and a queue of its records.

What is pending, what each record's last fault was and where the list stands
are tables of one log of versions, so they change together. A round takes the
first of the queue, asks for their records in one task, since a service wants
requests one after another, and commits what came. Bodies that came in a round
that died are in the fetcher's cache and are not asked for again.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.connectors import DamagedCache, Fetcher, listed_headers
from ..storage import materialise
from ..versions import Lease, TableLog, Version, Write

PENDING = "identifier string, ord long, tries int, error string"
RECORDS = "identifier string, content binary, fetched_at string"
EVENTS = "identifier string, status string, reason string, at string"
PROGRESS = "identifier string, token string, started boolean, listed long"
#: Tries after which a record is given up.
TRIES = 3
#: Records of a round.
ROUND = 20


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


@dataclass
class Harvest:
    """``list_url`` gives the first page of identifiers, ``next_url`` and a token the following ones; ``record_url`` and an identifier give a record."""

    log: TableLog
    list_url: str
    record_url: str
    cache: str = ""
    fetch: Callable[[str], bytes] | None = None
    #: By default the first page's with a parameter more; some services want the token alone.
    next_url: str = ""

    def table(self, name: str, schema: str, version: Version | None = None) -> DataFrame:
        return self.log.read(version or self.log.version(), name, _schema(schema))

    def pending(self) -> DataFrame:
        return self.table("pending", PENDING)

    def records(self) -> DataFrame:
        """(identifier, content, fetched_at) of what has come."""
        return self.table("records", RECORDS)

    def events(self) -> DataFrame:
        """What happened to each identifier: fetched, failed (it stays in the queue), given_up, or deleted at the service."""
        return self.table("events", EVENTS)

    def _progress(self, base: Version) -> tuple[str, bool, int]:
        row = self.table("progress", PROGRESS, base).first()
        return (row.token, row.started, row.listed) if row else ("", False, 0)

    def _list(self, base: Version, now: str) -> dict[str, Write] | None:
        """Puts the next page of the list into the queue; None at its end."""
        token, started, listed = self._progress(base)
        if started and not token:
            return None
        fetch = self.fetch or Fetcher(self.cache)
        rows, following = listed_headers(fetch((self.next_url or f"{self.list_url}&resumptionToken=") + urllib.parse.quote(token) if token else self.list_url))
        spark = self.log.spark
        known = self.table("events", EVENTS, base).where("status = 'fetched'").select("identifier").distinct()
        fresh = spark.createDataFrame([(k, listed + i, 0, "") for i, (k, gone) in enumerate(rows) if not gone], PENDING).dropDuplicates(["identifier"]).join(known, "identifier", "left_anti")
        deleted = spark.createDataFrame([(k, "deleted", "the service has deleted the record", now) for k, gone in rows if gone], EVENTS)
        progress = spark.createDataFrame([("list", following, True, listed + len(rows))], PROGRESS)
        return {"pending": Write(materialise(fresh.select(*_schema(PENDING).names), "pending")), "events": Write(deleted, append=True), "progress": Write(progress)}

    def _fetched(self, taken: DataFrame, now: str) -> DataFrame:
        """(identifier, content, error) of some pending records, asked for one after another by one task."""
        url, cache, own = self.record_url, self.cache, self.fetch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fetch = Fetcher(cache, fetch=own)
            for batch in batches:
                for identifier in batch["identifier"]:
                    try:
                        row = (identifier, fetch(url + urllib.parse.quote(identifier, safe=":")), "")
                    except DamagedCache:
                        raise
                    except (OSError, ValueError) as e:
                        row = (identifier, None, str(e))
                    yield pd.DataFrame([row], columns=["identifier", "content", "error"])

        return materialise(taken.select("identifier", "ord").coalesce(1).sortWithinPartitions("ord").mapInPandas(run, "identifier string, content binary, error string"), "fetched")

    def _round(self, base: Version, queue: DataFrame, n: int, now: str) -> dict[str, Write]:
        taken = materialise(queue.orderBy("tries", "ord").limit(n), "taken")
        got = self._fetched(taken, now)
        tried = taken.join(got.select("identifier", F.col("error").alias("fault"), F.col("content").isNotNull().alias("came")), "identifier").withColumn("tries", F.col("tries") + 1)
        again = tried.where(~F.col("came") & (F.col("tries") < TRIES)).select("identifier", "ord", "tries", F.col("fault").alias("error"))
        status = F.when(F.col("came"), "fetched").when(F.col("tries") < TRIES, "failed").otherwise("given_up")
        events = tried.select("identifier", status.alias("status"), F.col("fault").alias("reason"), F.lit(now).alias("at"))
        rest = queue.join(taken.select("identifier"), "identifier", "left_anti").select(*_schema(PENDING).names).unionByName(again)
        return {"pending": Write(rest), "records": Write(got.where("content IS NOT NULL").select("identifier", "content", F.lit(now).alias("fetched_at")), append=True), "events": Write(events, append=True)}

    def run(self, requests: int = 50, now: str = "", lease: Lease | None = None) -> int:
        """Goes on with at most so many requests; returns how many records came. None are left when the list has ended and nothing is pending."""
        came = 0
        while requests > 0:
            base = self.log.version()
            queue = self.table("pending", PENDING, base)
            if queue.isEmpty():
                writes, used = self._list(base, now), 1
                if writes is None:
                    break
            else:
                used = min(requests, ROUND, queue.count())
                writes = self._round(base, queue, used, now)
            requests -= used
            self.log.commit(base, writes, "harvest", lease)
            if "records" in writes:
                own = writes["records"].rows.count()
                came += own
                if not own:
                    # nothing came of a whole round: the service is down or will have no more
                    break
        return came
