"""A paginated page source as a Python data source (A7-A9, A15): a section is read page by page until a short one, its root is read as well.

The transport is a class that is named in the options, so that tests and other services can bring their own: `Transport(**options)` with
`search(section, since, start, limit) -> list[dict]` and `page(page_id) -> dict | None`.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT = 50
SCHEMA = "page_id string, section string, title string, version int, modified_at string, ancestors array<struct<id:string,title:string>>, html string"


class Http:
    """The transport of a wiki's REST interface; the token is taken from the option, never stored."""

    def __init__(self, url: str = "", token: str = "", timeout: str = "30", **_):
        self.url, self.token, self.timeout = url.rstrip("/"), token, float(timeout)

    def get(self, path: str, **params):
        request = urllib.request.Request(f"{self.url}/rest/api/{path}?{urllib.parse.urlencode(params)}", headers={"Authorization": f"Bearer {self.token}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def search(self, section: str, since: str | None, start: int, limit: int) -> list[dict]:
        query = f"ancestor={section}" + (f" AND lastModified >= '{since}'" if since else "")
        return self.get("content/search", cql=query, start=start, limit=limit, expand="body.storage,version,ancestors,space").get("results", [])

    def page(self, page_id: str) -> dict | None:
        return self.get(f"content/{page_id}", expand="body.storage,version,ancestors,space")


def row_of(page: dict, section: str) -> tuple:
    version = page.get("version") or {}
    ancestors = [(str(a.get("id", "")), str(a.get("title") or "")) for a in page.get("ancestors") or []]
    return str(page.get("id", "")), section, page.get("title"), int(version.get("number") or 0), version.get("when"), ancestors, ((page.get("body") or {}).get("storage") or {}).get("value")


class Section(InputPartition):
    def __init__(self, section: str):
        self.section = section


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        names = [x for key in ("sections", "page_ids") for x in self.options.get(key, "").split(",") if x]
        return [Section(x) for x in names]

    def read(self, partition):
        module, _, name = self.options.get("transport", f"{__name__}:Http").partition(":")
        transport = getattr(importlib.import_module(module), name)(**self.options)
        if self.options.get("page_ids"):
            found = transport.page(partition.section)
            if found:
                yield row_of(found, "")
            return
        start, since = 0, self.options.get("since") or None
        while True:
            rows = transport.search(partition.section, since, start, LIMIT)
            for page in rows:
                yield row_of(page, partition.section)
            if len(rows) < LIMIT:
                break
            start += LIMIT
        root = transport.page(partition.section)
        when = ((root or {}).get("version") or {}).get("when") or ""
        # dates are compared to the minute, as the search does
        if root and (not since or not when or when[:16].replace("T", " ") >= since[:16]):
            yield row_of(root, partition.section)


class Pages(DataSource):
    @classmethod
    def name(cls):
        return "wiki_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))


def read(spark: SparkSession, sections: list[str], since: str | None = None, **options: str) -> DataFrame:
    """Pages of sections, modified since a minute (A7) or all of them (A8), each page once; a task for each section."""
    spark.dataSource.register(Pages)
    reader = spark.read.format("wiki_pages").options(sections=",".join(sections), since=since or "", **options)
    return reader.load().dropDuplicates(["section", "page_id"])


def read_pages(spark: SparkSession, page_ids: list[str], **options: str) -> DataFrame:
    """Single pages by id."""
    spark.dataSource.register(Pages)
    return spark.read.format("wiki_pages").options(page_ids=",".join(page_ids), **options).load()


def dates(pages: DataFrame) -> DataFrame:
    from loomfold.functions.text import parsed_date

    return pages.withColumn("modified_at", parsed_date(F.col("modified_at")))
