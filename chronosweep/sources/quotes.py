"""A data source for folders of compressed binary ticks or candles: partitions are a pair's days, and filters decide which files are opened.

    spark.dataSource.register(quotes.QuoteSource)
    spark.read.format("quotes").option("path", folder).option("kind", "ticks").load().where("pair = 'EUR_USD' and s >= 1704067200")

Paths tell pair, day and hour, so equalities on the pair and bounds on s drop files when the scan is planned; with
`spark.sql.python.filterPushdown.enabled` Spark hands such filters down.  The options `pairs` (names with commas between),
`since` and `until` (epoch seconds, both inclusive) do the same without it.  Rows are filtered by Spark all the same, as a file may hold
more than what is asked for.

The folder must be mounted where Spark runs; `files.located_ticks` and `files.located_candles` read any store instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from chronosweep.sources.files import CANDLE, PLACE, TICK, decode

SCHEMAS = {
    "ticks": "pair string, s long, us long, bid double, ask double, bid_volume double, ask_volume double",
    "candles": "pair string, s long, open double, high double, low double, close double, volume double",
}
SPAN = {"ticks": 3600, "candles": 86_400}


def placed(path: str) -> tuple[str, int] | None:
    """(pair, epoch second of the file's hour or day) as a path tells, or None."""
    found = re.search(PLACE, path)
    if not found:
        return None
    name, year, month, day, hour = found.groups()
    try:
        start = datetime(int(year), int(month) + 1, int(day), int(hour or 0), tzinfo=UTC)
    except ValueError:
        return None
    return f"{name[:3]}_{name[3:]}".upper(), int(start.timestamp())


@dataclass
class Day(InputPartition):
    """A pair's files of one day, in order: (start, path)."""

    pair: str
    files: tuple[tuple[int, str], ...]


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "ticks")
        self.pairs = set(options["pairs"].split(",")) if options.get("pairs") else None
        self.since, self.until = (int(options[k]) if options.get(k) else None for k in ("since", "until"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("pair",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pairs = named if self.pairs is None else self.pairs & named
            elif name == ("s",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                bound = f.value + isinstance(f, GreaterThan)
                self.since = bound if self.since is None else max(self.since, bound)
            if name == ("s",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = f.value - isinstance(f, LessThan)
                self.until = bound if self.until is None else min(self.until, bound)
            yield f  # files only bound the rows, so Spark filters them too

    def partitions(self) -> list[Day]:
        days: dict[tuple[str, int], list] = {}
        for folder, _, names in os.walk(self.path):
            for name in names:
                path = os.path.join(folder, name)
                place = placed(path)
                if place is None or (self.pairs is not None and place[0] not in self.pairs):
                    continue
                pair, start = place
                if (self.since is None or start + SPAN[self.kind] > self.since) and (self.until is None or start <= self.until):
                    days.setdefault((pair, start // 86_400), []).append((start, path))
        return [Day(pair, tuple(sorted(held))) for (pair, _), held in sorted(days.items())]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        scale = 1e3 if partition.pair.endswith("JPY") else 1e5
        for start, path in partition.files:
            with open(path, "rb") as file:
                rows = decode(file.read(), TICK if self.kind == "ticks" else CANDLE)
            if self.kind == "ticks":
                us = start * 1_000_000 + rows["ms"].astype("i8") * 1000
                values = {"s": us // 1_000_000, "us": us} | {c: rows[c].astype("f8") / (scale if c in ("bid", "ask") else 1) for c in ("bid", "ask", "bid_volume", "ask_volume")}
            else:
                values = {"s": start + rows["sec"].astype("i8")} | {c: rows[c].astype("f8") / (1 if c == "volume" else scale) for c in ("open", "high", "low", "close", "volume")}
            columns = {"pair": pa.array([partition.pair] * len(rows), pa.string())} | {c: pa.array(np.asarray(v)) for c, v in values.items()}
            yield pa.RecordBatch.from_pydict(columns)


class QuoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "ticks")]

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(dict(self.options))
