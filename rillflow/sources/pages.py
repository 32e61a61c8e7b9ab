"""Paginated sources: pages are followed one after the other, each giving rows and the next token."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillflow.dataset import Dataset


async def _wait(x):
    return await x


class _Reader(DataSourceReader):
    def __init__(self, fetch, following, extract, has_next, start):
        self.fetch, self.following, self.extract, self.has_next, self.start = fetch, following, extract, has_next, start

    def partitions(self):
        return [InputPartition(0)]  # a page is known only after the one before

    def read(self, partition) -> Iterator[tuple]:
        n = 0
        with asyncio.Runner() as runner:  # one loop for all fetches, which may share a client

            def fetched(page):
                return runner.run(_wait(page)) if inspect.isawaitable(page) else page

            page = fetched(self.fetch(self.start))
            while True:
                for item in self.extract(page):
                    yield (n, *item) if isinstance(item, tuple) else (n, item)
                    n += 1
                if not self.has_next(page):
                    return
                page = fetched(self.following(page))


def read_paginated(spark: SparkSession, schema: str, first: Callable, following: Callable, extract: Callable, has_next: Callable, start=None, name: str = "rillflow_pages") -> Dataset:
    """``first(start)`` gives a page, ``following(page)`` the next while ``has_next(page)``; ``extract`` its items.

    ``schema``: the columns of an item. Fetchers may be async functions. Runs lazily, in one task.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"ord long, {schema}"

        def reader(self, schema):
            return _Reader(first, following, extract, has_next, start)

    spark.dataSource.register(Pages)
    return Dataset(spark.read.format(name).load(), "ord")
