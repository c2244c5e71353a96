"""Python data sources: recorded API pages as a paged stream with a call budget, and spreadsheet files."""

from __future__ import annotations

import glob
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class QuotaPaused(RuntimeError):
    """The budget of calls is used up; reading can go on from the last offset."""


#: Rows of a page by option kind: videos, a channel's playlists, or channels with the list of their uploads.
_SHAPES = {
    "items": "video_id string, title string, description string, published_at string, playlist_title string, page string",
    "playlists": "playlist_id string, title string, item_count long, page string",
    "channels": "channel_id string, uploads string, page string",
}


class RecordedPages(DataSource):
    """format("recorded_pages"): one JSON file a page, {nextPageToken?, items: [{id, title, description, publishedAt}]}.

    Options: path, the folder of <token>.json with first.json as the start; budget, calls a run may use; playlist, a title
    put on every row; start, the first page's token. A stream's offset is the next page's token, so a paused crawl goes on
    where it stopped. A page {error: quotaExceeded} pauses like a used budget. A batch read that has to pause fails with
    QuotaPaused, so that a short table is never taken for the whole; with partial=true it gives the pages that it came to.
    Pages come from files: there is no network here.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return _SHAPES[self.options.get("kind", "items")]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _AllPages(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _PageStream(self.options)


def _page(options, token: str) -> dict:  # noqa: ANN001
    with open(os.path.join(options["path"], f"{token}.json"), encoding="utf-8") as f:
        page = json.load(f)
    if page.get("error") == "quotaExceeded":
        raise QuotaPaused(token)
    return page


def _rows(options, token: str, page: dict) -> list[tuple]:  # noqa: ANN001
    kind = options.get("kind", "items")
    if kind == "playlists":
        return [(i.get("id"), i.get("title"), i.get("itemCount"), token) for i in page.get("items", [])]
    if kind == "channels":
        return [(i.get("id"), i.get("uploads"), token) for i in page.get("items", [])]
    return [(i.get("id"), i.get("title"), i.get("description"), i.get("publishedAt"), options.get("playlist"), token) for i in page.get("items", [])]


class _AllPages(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a page names the next one

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token, budget = self.options.get("start", "first"), int(self.options.get("budget", "1000000"))
        partial = self.options.get("partial", "false").lower() == "true"
        while token:
            try:
                if budget <= 0:
                    raise QuotaPaused(f"paused before page {token}")
                page = _page(self.options, token)
            except QuotaPaused:
                if partial:
                    return
                raise
            yield from _rows(self.options, token, page)
            token, budget = page.get("nextPageToken"), budget - 1


class _PageStream(SimpleDataSourceStreamReader):
    def __init__(self, options):  # noqa: ANN001
        self.options = options
        self.left = int(options.get("budget", "1000000"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": "first"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not start["next"] or self.left <= 0:
            return iter(()), start
        try:
            page = _page(self.options, start["next"])
        except QuotaPaused:
            return iter(()), start
        self.left -= 1
        return iter(_rows(self.options, start["next"], page)), {"next": page.get("nextPageToken") or ""}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        token = start["next"]
        while token and token != end["next"]:
            page = _page(self.options, token)
            yield from _rows(self.options, token, page)
            token = page.get("nextPageToken") or ""


class Spreadsheets(DataSource):
    """format("spreadsheets"): rows of the first sheet of .xlsx files as (file, n, cells map by header name).

    Option path: a file or a pattern. Each file is a partition; its XML is streamed, so memory stays constant.
    """

    @classmethod
    def name(cls) -> str:
        return "spreadsheets"

    def schema(self) -> str:
        return "file string, n int, cells map<string,string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _SheetReader(self.options["path"])


class _Sheet(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _SheetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(p) for p in sorted(glob.glob(self.path))] or [_Sheet("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as z:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in z.namelist():
                with z.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{_NS}si":
                            shared.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                            e.clear()
            head: dict[str, str] = {}
            with z.open("xl/worksheets/sheet1.xml") as f:
                n = 0
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{_NS}row":
                        continue
                    cells = {re.match("[A-Z]+", c.get("r", "A")).group(): self.value(c, shared) for c in e.iter(f"{_NS}c")}
                    e.clear()
                    if not head:
                        head = {k: v for k, v in cells.items() if v}
                    else:
                        n += 1
                        yield partition.path, n, {head[k]: v for k, v in cells.items() if k in head}

    @staticmethod
    def value(cell, shared: list[str]) -> str | None:  # noqa: ANN001
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
        v = cell.find(f"{_NS}v")
        if v is None:
            return None
        return shared[int(v.text)] if cell.get("t") == "s" else v.text


def uploads_of(spark, path: str, channel: str) -> str:  # noqa: ANN001
    """The list of a channel's uploads from recorded channel pages; LookupError without one."""
    row = spark.read.format("recorded_pages").options(path=path, kind="channels").load().where(F.col("channel_id") == channel).select("uploads").first()
    if row is None or not row.uploads:
        raise LookupError(f"no list of uploads for {channel}")
    return row.uploads


def playlists_of(spark, path: str, budget: int = 1_000_000) -> DataFrame:  # noqa: ANN001
    """(playlist_id, title, item_count) of all recorded pages of a channel's playlists."""
    return spark.read.format("recorded_pages").options(path=path, kind="playlists", budget=str(budget)).load().select("playlist_id", "title", "item_count")


def register(spark) -> None:  # noqa: ANN001
    """Make both formats known to a session."""
    spark.dataSource.register(RecordedPages)
    spark.dataSource.register(Spreadsheets)
