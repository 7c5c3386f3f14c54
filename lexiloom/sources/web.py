"""Data sources over HTTP: lines of files, and pages of a wiki's REST interface.

    spark.dataSource.register(HttpLines)
    spark.read.format("http_lines").option("url", "https://host/dump.sql.gz").load()

A plain file on a server that serves ranges is read by many tasks: each asks for its
bytes and yields the lines that start in them, so lines of any length come whole
and once. Compressed files, and servers without ranges, are read as one stream by
one task. Pages are asked for one by one, dealt over partitions. Every request waits
and tries again where the server asks for that; a lost task starts its range anew.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .dumps import send_with_retries

AGENT = "lexiloom"
#: Bytes of a range, and of one read from a stream.
RANGE, READ = 64 << 20, 1 << 20
TIMEOUT = 60


def _open(url: str, headers: dict[str, str]):
    """(status, headers, response) of a GET request; a status that isn't a success comes without a response."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT} | headers)
    try:
        response = urllib.request.urlopen(request, timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        with e:
            return e.code, e.headers, None
    # a part of a file is a success too
    return 200 if response.status == 206 else response.status, response.headers, response


def get(url: str, headers: dict[str, str] | None = None, attempts: int = 10):
    """The response to a GET request; status 429 waits as told and tries again, other failures raise."""
    return send_with_retries(lambda: _open(url, headers or {}), attempts)


def ranges(url: str, size: int = RANGE, attempts: int = 10) -> list[tuple[int, int | None]]:
    """(start, end) byte ranges of a file; one open range where it can't be read in parts."""
    with get(url, {"Range": "bytes=0-0"}, attempts) as first:
        part = first.headers.get("Content-Range", "")
        encoded = first.headers.get("Content-Encoding", "identity") != "identity"
    total = part.rpartition("/")[2]
    if encoded or url.endswith(".gz") or not total.isdigit():
        return [(0, None)]
    return [(a, min(a + size, int(total))) for a in range(0, int(total), size)]


def _chunks(response, packed: bool) -> Iterator[bytes]:
    """The bytes of a stream, unpacked; a gzip file may have several members."""
    unpack = zlib.decompressobj(47) if packed else None
    while data := response.read(READ):
        while unpack and data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(47)
        if not unpack:
            yield data
    if unpack and (rest := unpack.flush()):
        yield rest


def lines_of(url: str, start: int = 0, end: int | None = None, attempts: int = 10) -> Iterator[bytes]:
    """The lines of a file that start at byte start or behind it and before byte end.

    The byte before start tells whether a line starts there; what goes on over the
    end is read until its line ends.
    """
    parts = end is not None
    headers = {"Range": f"bytes={max(0, start - 1)}-"} if parts else {}
    with get(url, headers, attempts) as response:
        at = max(0, start - 1) if parts else 0
        # before the first line that starts here
        skipping, rest = parts and start > 0, b""
        for data in _chunks(response, not parts and (url.endswith(".gz") or response.headers.get("Content-Encoding") == "gzip")):
            rest += data
            if skipping:
                cut = rest.find(b"\n") + 1
                if not cut:
                    at, rest = at + len(rest), b""
                    continue
                at, rest, skipping = at + cut, rest[cut:], False
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if parts and at >= end:
                    return
                yield line.removesuffix(b"\r")
                at += len(line) + 1
            if parts and at >= end:
                return
        if rest:
            yield rest.removesuffix(b"\r")


class _Range(InputPartition):
    def __init__(self, url: str, start: int, end: int | None):
        self.url, self.start, self.end = url, start, end


class HttpLines(DataSource):
    """Lines of one file or of several (urls, separated by blanks). Options: url, size (bytes of a range), attempts."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options["url"].split()
        self.size, self.attempts = int(options.get("size", RANGE)), int(options.get("attempts", 10))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Range(url, a, b) for url in self.urls for a, b in ranges(url, self.size, self.attempts)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for line in lines_of(partition.url, partition.start, partition.end, self.attempts):
            yield (line.decode("utf-8", "replace"),)


def page(url: str, title: str, attempts: int = 10) -> str | None:
    """The source of one page of a REST interface; url is what stands before the title."""
    with get(url + urllib.parse.quote(title, safe=""), None, attempts) as response:
        return json.loads(response.read())["source"]


class _Titles(InputPartition):
    def __init__(self, titles: list[str]):
        self.titles = titles


class WikiPages(DataSource):
    """(title, source) of pages. Options: url (what stands before a title), titles (a JSON list), partitions, attempts."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return "title string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.titles = options["url"], json.loads(options["titles"])
        self.parts, self.attempts = int(options.get("partitions", 8)), int(options.get("attempts", 10))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Titles(own) for k in range(self.parts) if (own := self.titles[k :: self.parts])]

    def read(self, partition: _Titles) -> Iterator[tuple]:
        for title in partition.titles:
            yield title, page(self.url, title, self.attempts)


def register(spark: SparkSession) -> None:
    for source in (HttpLines, WikiPages):
        spark.dataSource.register(source)


def read_lines(spark: SparkSession, *urls: str, size: int = RANGE, attempts: int = 10) -> DataFrame:
    """(value): the lines of files over HTTP."""
    register(spark)
    return spark.read.format("http_lines").options(url=" ".join(urls), size=size, attempts=attempts).load()


def read_pages(spark: SparkSession, url: str, titles: Sequence[str] | DataFrame, attempts: int = 10) -> DataFrame:
    """(title, source) of pages. Titles in a DataFrame (title) are fetched where they lie, any number of them."""
    if not isinstance(titles, DataFrame):
        register(spark)
        return spark.read.format("wiki_pages").options(url=url, titles=json.dumps(list(titles)), attempts=attempts).load()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for title in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([title]), pa.array([page(url, title, attempts)], pa.string())], names=["title", "source"])

    return titles.select("title").where(F.col("title").isNotNull()).mapInArrow(fetch, "title string, source string")

