"""A Python data source for klines over HTTP, one partition a span of time, pages of PAGE bars backwards from its end.

``fetch(url, params)`` returns a decoded answer; the default uses urllib. Options: url, symbol, tf, start_ms, end_ms,
spans. An answer has retCode (0 if good) and result.list, rows of text [time, open, high, low, close, volume, turnover],
newest first. Untested against a network here; tests give it a fake fetch.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, ATTEMPTS, TIMEOUT_S, PAUSE_S = 1000, 4, 12, 0.035


def http_fetch(url: str, params: dict) -> dict:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=TIMEOUT_S) as answer:
        return json.load(answer)


def _page(fetch, url: str, params: dict, pause: float) -> list[list[str]]:
    for attempt in range(1, ATTEMPTS + 1):
        try:
            found = fetch(url, params)
        except OSError:
            if attempt == ATTEMPTS:
                raise
            time.sleep(pause * attempt)
            continue
        if found.get("retCode") != 0:
            raise ValueError(f"the server refused: {found.get('retMsg')}")
        return found["result"]["list"]
    return []


def read_span(fetch, url: str, symbol: str, tf: int, start_ms: int, end_ms: int, pause: float = 0.8, pace: float = PAUSE_S):
    """Rows of a span, page by page; ends at an empty page, fails if pages do not go back."""
    cursor = end_ms
    while cursor >= start_ms:
        rows = _page(fetch, url, {"symbol": symbol, "interval": tf, "start": start_ms, "end": cursor, "limit": PAGE}, pause)
        if not rows:
            return
        first = min(int(r[0]) for r in rows)
        if first > cursor:
            raise ValueError("pages do not go back in time")
        yield from (tuple(r[:7]) for r in rows)
        cursor = first - 1
        time.sleep(pace)


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict, fetch=http_fetch):
        self.o, self.fetch = options, fetch

    def partitions(self):
        a, b, n = int(self.o["start_ms"]), int(self.o["end_ms"]), max(1, int(self.o.get("spans", 1)))
        step = -(-(b - a + 1) // n)
        return [Span(x, min(x + step - 1, b)) for x in range(a, b + 1, step)]

    def read(self, partition: Span):
        yield from read_span(self.fetch, self.o["url"], self.o["symbol"], int(self.o["tf"]), partition.start, partition.end)


class KlineSource(DataSource):
    """Register with spark.dataSource.register(KlineSource), read with format("klines"); clean the rows with candles.clean."""

    @classmethod
    def name(cls):
        return "klines"

    def schema(self):
        return ", ".join(f"{c} string" for c in ("timestamp", "open", "high", "low", "close", "volume", "turnover"))

    def reader(self, schema):
        return KlineReader(dict(self.options))
