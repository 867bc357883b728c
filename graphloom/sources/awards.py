"""A paged award service as a Spark data source: one partition an agency, pages until a short one, back-off when told to wait.

``spark.dataSource.register(AwardSource)``, then
``spark.read.format("awards").option("agencies", "A,B").option("year", 2024).option("fetcher", "module:function").load()``.
The fetcher takes (agency, year, start, rows) and returns a list of dicts; it
raises :class:`Busy` when the service asks to come back later.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.sources.records import AWARD

FIELDS = [c.strip().split(" ")[0] for c in AWARD.split(",")]


class Busy(RuntimeError):
    """The service asked to wait."""


class AgencyPart(InputPartition):
    def __init__(self, agency: str):
        super().__init__(agency)
        self.agency = agency


class AwardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.agencies = [a.strip() for a in options.get("agencies", "").split(",") if a.strip()]
        self.year, self.most, self.page = options.get("year"), int(options.get("maxrecords", 150)), int(options.get("pagesize", 100))
        self.retries, self.wait, self.fetcher = int(options.get("retries", 3)), float(options.get("waitseconds", 3)), options["fetcher"]

    def partitions(self) -> list[InputPartition]:
        return [AgencyPart(a) for a in self.agencies]

    def read(self, partition: AgencyPart) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch, start = getattr(importlib.import_module(module), name), 0
        while start < self.most:
            want = min(self.page, self.most - start)
            rows = self._patiently(fetch, partition.agency, start, want)
            for r in rows[:want]:
                yield tuple(None if r.get(f) is None else str(r[f]) for f in FIELDS)
            if len(rows) < want:
                return
            start += want

    def _patiently(self, fetch, agency: str, start: int, want: int) -> list[dict]:
        for attempt in range(self.retries + 1):
            try:
                return fetch(agency, self.year, start, want)
            except Busy:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        return []


class AwardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "awards"

    def schema(self) -> str:
        return AWARD

    def reader(self, schema) -> DataSourceReader:
        return AwardReader({k.lower(): v for k, v in self.options.items()})
