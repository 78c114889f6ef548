"""A paged repository listing as a batch and streaming source.

Pages are JSON files ``page-<n>.json`` (arrays of objects) in a folder, or
whatever a subclass fetches. The stream's offset is the number of the next page:
a query that restarts reads no page twice and skips none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "full_name string, stars int, contributors int, created date, license_spdx string, language string, topics array<string>"


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def pages(self) -> list[int]:
        return sorted(int(m[1]) for p in Path(self.folder).iterdir() if (m := re.fullmatch(r"page-(\d+)\.json", p.name)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in self.pages()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from rows_of(Path(self.folder, f"page-{partition.value}.json").read_text())


class PageStream(SimpleDataSourceStreamReader):
    """A page in each micro-batch at most pages_per_batch times."""

    def __init__(self, folder: str, pages_per_batch: int):
        self.reader, self.most = PageReader(folder), pages_per_batch

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ready = [n for n in self.reader.pages() if n >= start["page"]][: self.most]
        end = {"page": ready[-1] + 1} if ready else start
        return self._rows(ready), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows([n for n in self.reader.pages() if start["page"] <= n < end["page"]])

    def _rows(self, pages: list[int]) -> Iterator[tuple]:
        return iter([r for n in pages for r in self.reader.read(InputPartition(n))])

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


def rows_of(text: str) -> Iterator[tuple]:
    from datetime import date

    for x in json.loads(text):
        created = x.get("created")
        yield x.get("full_name"), x.get("stars"), x.get("contributors"), date.fromisoformat(created[:10]) if created else None, x.get("license_spdx"), x.get("language"), x.get("topics")


class PagedRepos(DataSource):
    """Options: path, pagesPerBatch (1)."""

    @classmethod
    def name(cls) -> str:
        return "paged_repos"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options["path"])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PageStream(self.options["path"], int(self.options.get("pagesPerBatch", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRepos)


def arrivals(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and kind, batch or streaming; late ones beyond the watermark are left out of a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
