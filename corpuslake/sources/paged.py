"""A paged source as a Python data source: pages planned from the first answer, read in parallel, and counted (SRC-11)."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """Pages of ``[{"meta": [{"searchResultsTotal": n}], "searchResults": [...]}]``.

    Options: ``url`` with {page} and {size} (http, or a path or URI of a file system that Arrow knows), ``size`` (100), ``retries`` (3), ``id`` (the
    field that is the id). The driver asks for the first page; its total plans one partition a page. A page of fewer
    rows than the total leaves for it fails the read, as does one that can't be had: a truncated table looks complete. Without a total one task goes page by
    page until a short one.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, body string, page int, total long"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class Page(InputPartition):
    def __init__(self, number: int | None, rows: int, total: int | None) -> None:
        self.number, self.rows, self.total = number, rows, total


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.url, self.size, self.retries, self.id = options["url"], int(options.get("size", 100)), int(options.get("retries", 3)), options.get("id", "id")

    def _answer(self, page: int) -> str:
        url = self.url.replace("{page}", str(page)).replace("{size}", str(self.size))
        if url.startswith(("http://", "https://")):
            with urlopen(url, timeout=60) as got:
                return got.read().decode()
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)
        with files.open_input_stream(path) as got:
            return got.read().decode()

    def _page(self, page: int) -> tuple[list[dict], int | None]:
        for attempt in range(self.retries + 1):
            try:
                body = json.loads(self._answer(page))
                break
            except (OSError, URLError) as error:
                if attempt == self.retries or isinstance(error, HTTPError) and error.code < 500:
                    raise
                time.sleep(0.2 * 2**attempt)
        envelope = body[0] if isinstance(body, list) and body else body
        if not isinstance(envelope, dict) or not isinstance(envelope.get("searchResults"), list):
            raise ValueError(f"page {page} of {self.url} has no list of results")
        total = ((envelope.get("meta") or [{}])[0] or {}).get("searchResultsTotal")
        return envelope["searchResults"], total if isinstance(total, int) and not isinstance(total, bool) else None

    def partitions(self) -> list[InputPartition]:
        total = self._page(0)[1]
        if total is None:
            return [Page(None, 0, None)]
        return [Page(i, min(self.size, total - i * self.size), total) for i in range(-(-total // self.size))] or [Page(0, 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        number = partition.number or 0
        while True:
            items, _ = self._page(number)
            if partition.number is not None and len(items) != partition.rows:
                raise ValueError(f"page {number} of {self.url} has {len(items)} rows where the total of {partition.total} leaves {partition.rows}")
            for item in items:
                yield str(item.get(self.id)), json.dumps(item, ensure_ascii=False), number, partition.total
            if partition.number is not None or len(items) < self.size:
                return
            number += 1
