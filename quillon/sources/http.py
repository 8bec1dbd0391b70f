"""HTTP responses as a table: a Python data source, to be registered by name; nothing registers it by default."""
from __future__ import annotations

import json
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class HttpReader(DataSourceReader):
    """One task for each address; a status beyond 2xx or a failed request is a row without a body."""

    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self):
        return [Address(u) for u in self.urls]

    def read(self, partition: Address):
        try:
            with urlopen(Request(partition.url, headers={"Accept": "application/json, text/*"}), timeout=self.timeout) as r:
                status, body = getattr(r, "status", None) or 200, r.read().decode("utf-8", "replace")
        except HTTPError as e:
            yield partition.url, e.code, False, None, False, str(e)
            return
        except (URLError, OSError, ValueError) as e:
            yield partition.url, None, False, None, False, str(e)
            return
        try:
            json.loads(body)
            parses = True
        except ValueError:
            parses = False
        ok = 200 <= status < 300
        yield partition.url, status, ok, body if ok else None, parses and ok, None if ok else f"status {status}"


class HttpSource(DataSource):
    """Options: urls (separated by white space), hosts that may be asked (all others are refused), timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "http_text"

    def schema(self) -> str:
        return "url string, status int, ok boolean, body string, is_json boolean, error string"

    def reader(self, schema) -> HttpReader:
        urls, hosts = self.options.get("urls", "").split(), set(self.options.get("hosts", "").split())
        for u in urls:
            if urlsplit(u).scheme not in ("http", "https") or urlsplit(u).hostname not in hosts:
                raise PermissionError(f"{u} is not among the hosts that may be asked")
        return HttpReader(urls, float(self.options.get("timeout", "30")))


def enable(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
