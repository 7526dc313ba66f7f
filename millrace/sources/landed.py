"""Landed pages as a source: one file per page, below one folder per run.

Layout: ``<root>/run=<run>/page-<number>.json``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_PAGE = re.compile(r"^page-(\d+)\.json$")
_RUN = re.compile(r"^run=(\d+)$")


def read_landed(spark: SparkSession, root: str) -> DataFrame:
    """All landed pages through Spark's own file scan; small files share a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page-*.json").load(root)
    return files.select(
        F.col("run").cast("bigint").alias("run"),
        F.regexp_extract("path", r"page-(\d+)\.json$", 1).cast("bigint").alias("page"),
        F.col("content").alias("body"),
        F.col("length").alias("size_bytes"),
        F.lit("application/json").alias("content_type"),
    )


class FileProvider:
    """Pages of a run as files on storage that every executor has mounted.

    Any class with these three methods can serve pages to :func:`paged_source`; they
    are called in tasks.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")

    def runs(self) -> Iterator[int]:
        """Runs on offer."""
        for folder in os.scandir(self.root):
            if run := _RUN.match(folder.name):
                yield int(run[1])

    def pages(self, run: int) -> Iterator[int]:
        """Page numbers of a run, in any order."""
        for file in os.scandir(f"{self.root}/run={run}"):
            if page := _PAGE.match(file.name):
                yield int(page[1])

    def fetch(self, run: int, page: int) -> bytes:
        with open(f"{self.root}/run={run}/page-{page}.json", "rb") as file:
            return file.read()


class Slice(InputPartition):
    """One of the ``ways`` that the pages of a group of runs are dealt to."""

    def __init__(self, group: int, way: int):
        self.group = group
        self.way = way


class PagedReader(DataSourceReader):
    """Deals runs to groups by a hash, and blocks of their pages to ways, before anything is listed.

    Tasks list for themselves, so the driver knows numbers of slices and no page. A task lists the
    runs and the page names of its group; the ways share a run that holds most of the pages.
    """

    def __init__(self, provider, start: int, block: int, groups: int, ways: int):
        self.provider = provider
        self.start = start
        self.block = block
        self.groups = groups
        self.ways = ways

    def partitions(self) -> list[Slice]:
        return [Slice(group, way) for group in range(self.groups) for way in range(self.ways)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for run in self.provider.runs():
            if zlib.crc32(str(run).encode()) % self.groups != partition.group:
                continue
            for page in self.provider.pages(run):
                if page >= self.start and page // self.block % self.ways == partition.way:
                    body = self.provider.fetch(run, page)
                    yield run, page, body, len(body), "application/json"


def paged_source(name: str, provider_class: type = FileProvider) -> type[DataSource]:
    """A Spark data source called ``name`` over pages from ``provider_class``.

    Options: ``start`` (first page), ``block`` (neighbouring pages that one task reads), ``groups``
    and ``ways`` (their product is the number of tasks), and the provider's own.
    Register it with ``spark.dataSource.register``.
    """

    class PagedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "run bigint, page bigint, body binary, size_bytes bigint, content_type string"

        def reader(self, schema) -> DataSourceReader:
            options = dict(self.options)
            return PagedReader(
                provider_class(options),
                int(options.get("start", 1)),
                int(options.get("block", 100)),
                int(options.get("groups", 16)),
                int(options.get("ways", 4)),
            )

    return PagedSource
