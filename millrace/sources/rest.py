"""A paged JSON feed as a Spark data source: a partition per day, pages of a day one after the other in its task.

spark.dataSource.register(RequestFeed)
spark.read.format("request_feed").option("url", u).option("first", "2024-01-01").option("last", "2024-01-31").load()
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "partition_date date, row_num long, payload string"


class Day(InputPartition):
    def __init__(self, day: dt.date) -> None:
        super().__init__(day)
        self.day = day


def page_query(day: dt.date, limit: int, offset: int) -> dict[str, str]:
    """Records made on a local day, in a fixed order."""
    return {"$where": f"created_date >= '{day}T00:00:00' AND created_date < '{day + dt.timedelta(1)}T00:00:00'", "$select": ":*, *", "$order": ":id", "$limit": str(limit), "$offset": str(offset)}


def fetched(url: str, query: dict[str, str], timeout: float) -> list[dict]:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(query)}", timeout=timeout) as answer:
        if answer.status != 200:
            raise OSError(f"the feed answered {answer.status}")
        return json.load(answer)


def day_rows(day: dt.date, size: int, fetch: Callable[[dict[str, str]], list[dict]]) -> Iterator[tuple[dt.date, int, str]]:
    """All records of a day. Pages end at the first that is not full, so a full last page is followed by an empty one."""
    offset = 0
    while True:
        page = fetch(page_query(day, size, offset))
        for n, record in enumerate(page, 1):
            yield day, offset + n, json.dumps(record)
        if len(page) < size:
            return
        offset += size


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size, self.timeout = options["url"], int(options.get("page_size", "50000")), float(options.get("timeout", "60"))
        self.first, self.last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))

    def partitions(self) -> list[Day]:
        return [Day(self.first + dt.timedelta(n)) for n in range((self.last - self.first).days + 1)]

    def read(self, partition: Day) -> Iterator[tuple]:
        return day_rows(partition.day, self.size, lambda q: fetched(self.url, q, self.timeout))


class RequestFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "request_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
