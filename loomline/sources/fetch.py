"""Live pages as a Spark data source: one partition for each host, so that a host is asked by one task only.

    spark.dataSource.register(PageSource)
    spark.read.format("polite_pages").option("urls", json_list).option("agent", "name").load()

A page that can't be had, or that robots.txt disallows, has a null text.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds between two requests to a host, and until a request is given up.
DELAY, TIMEOUT = 2.0, 45.0


def download(url: str, agent: str, timeout: float = TIMEOUT) -> str | None:
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except (OSError, ValueError):
        return None


def allowed(robots: str | None, agent: str, url: str) -> bool:
    """By the text of a robots.txt; without one everything is."""
    if robots is None:
        return True
    parser = RobotFileParser()
    parser.parse(robots.splitlines())
    return parser.can_fetch(agent, url)


def fetch_host(urls: list[str], agent: str, get: Callable[[str, str], str | None] = download, delay: float = DELAY, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, str | None]]:
    """(url, text) of one host's urls, in turn and not too fast."""
    robots, first = None, True
    for url in urls:
        parts = urlsplit(url)
        if first:
            robots = get(f"{parts.scheme}://{parts.netloc}/robots.txt", agent)
            first = False
        if not allowed(robots, agent, url):
            yield url, None
            continue
        wait(delay)
        yield url, get(url, agent)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls, self.agent = json.loads(options.get("urls", "[]")), options.get("agent", "loomline")

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(url).netloc, []).append(url)
        return [_Host(urls) for urls in hosts.values()] or [_Host([])]

    def read(self, partition: _Host) -> Iterator[tuple]:
        yield from fetch_host(partition.urls, self.agent)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polite_pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
