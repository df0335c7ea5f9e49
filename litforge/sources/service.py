"""A remote bibliographic service as a Spark data source: searched on the driver's plan, fetched in batches by the tasks.

``spark.dataSource.register(SearchSource)``, then ``spark.read.format("litforge_search").option("query", …).load()``. Options:
query, retmax (20), sort (relevance or pub_date), key (an access key), base (address of the service), pause (seconds between
requests; 0.35, with a key 0.11) and opener, the import path "module:function" of what sends a request, a function of
(address, fields) that returns the response text. Requests of one task keep the pause between them.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litforge.sources import records

#: Seconds between two requests without and with an access key.
PAUSE, PAUSE_WITH_KEY = 0.35, 0.11
PLACE = "litforge.sources.service:post"


def post(address: str, fields: dict[str, str]) -> str:
    """Sends the fields as a form; a status other than success raises."""
    with urlopen(Request(address, urlencode(fields).encode(), {"Content-Type": "application/x-www-form-urlencoded"}), timeout=60) as response:  # noqa: S310
        return response.read().decode("utf-8")


class Service:
    """Calls of the service with the pause between them."""

    def __init__(self, options: dict[str, str]):
        self.key = options.get("key", "")
        self.base = options.get("base", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils").rstrip("/")
        self.pause = float(options.get("pause", PAUSE_WITH_KEY if self.key else PAUSE))
        module, _, name = options.get("opener", PLACE).partition(":")
        self.send: Callable[[str, dict[str, str]], str] = getattr(importlib.import_module(module), name)
        self.last = 0.0

    def call(self, what: str, **fields: str) -> str:
        wait = self.last + self.pause - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        try:
            return self.send(f"{self.base}/{what}.fcgi", {"db": "pubmed"} | fields | ({"api_key": self.key} if self.key else {}))
        finally:
            self.last = time.monotonic()

    def search(self, query: str, most: int, sort: str) -> list[str]:
        """Ids of the papers found, best first; an error of the service raises."""
        found = json.loads(self.call("esearch", term=query, retmax=str(most), sort=sort, retmode="json")).get("esearchresult") or {}
        if "ERROR" in found or "idlist" not in found:
            raise ValueError(found.get("ERROR", "unreadable search response"))
        return found["idlist"]

    def records(self, ids: list[str]) -> Iterator[dict]:
        text = self.call("efetch", id=",".join(ids), retmode="xml")
        end = "</PubmedArticle>"
        for part in text.split(end)[:-1]:
            at = part.find("<PubmedArticle>")
            if at >= 0 and (row := records.parse_record(part[at:] + end)):
                yield row


class Batch(InputPartition):
    def __init__(self, first: int, ids: list[str]):
        super().__init__(first)
        self.first, self.ids = first, ids


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Batch]:
        ids = Service(self.options).search(self.options["query"], int(self.options.get("retmax", 20)), self.options.get("sort", "relevance"))
        return [Batch(i, ids[i : i + records.BATCH]) for i in range(0, len(ids), records.BATCH)] or [Batch(0, [])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.ids:
            return
        rank = {pmid: partition.first + i for i, pmid in enumerate(partition.ids)}
        names = [p.split(" ")[0] for p in records.ARTICLE.split(", ")]
        for row in Service(self.options).records(partition.ids):
            if row["pmid"] in rank:
                yield rank[row["pmid"]], *[([tuple(x.values()) for x in row[n]] if n == "authors_full" else row[n]) for n in names]


class SearchSource(DataSource):
    """rank and the columns of an article for the papers that a search finds, requests of 200 ids each."""

    @classmethod
    def name(cls) -> str:
        return "litforge_search"

    def schema(self) -> str:
        return f"rank int, {records.ARTICLE}"

    def reader(self, schema) -> SearchReader:
        if not self.options.get("query"):
            raise ValueError("the option query is missing")
        return SearchReader(self.options)
