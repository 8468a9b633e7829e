"""The data source of quotes, footers, file order, commits, and paths of varying logs."""

from __future__ import annotations

import json
import lzma
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronosweep.sources import files, quotes, stored
from tests.conftest import SMALL, TABLES

DAY = 1_704_153_600  # 2024-01-02


def write(folder, pair, day, name, rows, layout):
    place = folder / pair / "2024" / "00" / f"{day:02d}"
    place.mkdir(parents=True, exist_ok=True)
    (place / name).write_bytes(lzma.compress(np.array(rows, layout).tobytes()) if rows is not None else b"broken: must not be opened")


@pytest.fixture
def source(spark):
    spark.dataSource.register(quotes.QuoteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("quotes")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_out_of_range_are_never_opened(spark, tmp_path, source):
    for hour in range(6, 12):
        asked = 8 <= hour <= 9
        write(tmp_path, "EURUSD", 2, f"{hour:02d}h_ticks.bi5", [(1500, 110002, 110000, 1.0, 2.0), (3_599_999, 110012, 110010, 1.0, 2.0)] if asked else None, files.TICK)
    write(tmp_path, "EURUSD", 3, "08h_ticks.bi5", None, files.TICK)
    write(tmp_path, "USDJPY", 2, "08h_ticks.bi5", [(0, 150002, 150000, 1.0, 2.0)], files.TICK)
    (tmp_path / "notes.txt").write_text("no quotes")
    rows = source.option("path", str(tmp_path)).load()
    got = rows.where(f"pair = 'EUR_USD' AND s >= {DAY + 8 * 3600} AND s < {DAY + 10 * 3600}")
    assert sorted((r["s"] - DAY, round(r["bid"], 5)) for r in got.collect()) == [(28801, 1.1), (32399, 1.1001), (32401, 1.1), (35999, 1.1001)]
    yen = source.option("pairs", "USD_JPY").load().collect()
    assert [(r["pair"], r["s"], r["us"], r["ask"]) for r in yen] == [("USD_JPY", DAY + 28800, (DAY + 28800) * 10**6, 150.002)]
    assert source.option("pairs", "EUR_USD").option("since", DAY + 8 * 3600).option("until", DAY + 9 * 3600).load().count() == 4
    with pytest.raises(Exception, match="LZMA|format"):
        spark.read.format("quotes").option("path", str(tmp_path)).option("pairs", "EUR_USD").load().count()


def test_days_are_partitions_and_equal_the_plain_reader(spark, tmp_path, source):
    for pair in ("EURUSD", "GBPJPY"):
        for day in (2, 3):
            write(tmp_path, pair, day, "BID_candles_min_1.bi5", [(60 * k, 110000 + k, 110001 + k, 109990 + k, 110020 + k, 3.0) for k in range(5)], files.CANDLE)
    rows = source.option("path", str(tmp_path)).option("kind", "candles").load()
    assert rows.rdd.getNumPartitions() == 4
    plain = files.located_candles(spark, f"{tmp_path}/*/*/*/*")
    told = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select("pair", "s", "open", "high", "low", "close", "volume").collect())
    assert told(rows) == told(plain) and len(told(rows)) == 20 and told(rows)[0][:2] == ("EUR_USD", DAY)


def test_inventory_of_the_given_tables_from_footers(spark):
    tables = {t: f"{SMALL}/{t}.parquet" for t in TABLES}
    got = {r["name"]: r for r in stored.inventory(spark, tables | {"absent": f"{SMALL}/absent.parquet"}).collect()}
    for name, path in tables.items():
        own = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")] if os.path.isdir(path) else [path]
        assert (got[name]["files"], got[name]["bytes"]) == (len(own), sum(map(os.path.getsize, own)))
        table = spark.read.parquet(path)
        assert got[name]["rows"] == table.count() and got[name]["status"] == stored.status(table.count())
    assert got["absent"]["status"] == "error" and got["absent"]["error"] and stored.status(0) == "empty" and stored.status(499) == "thin"


def test_footers_alone_are_read(spark):
    with stored._set(spark, **{"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}):
        plan = spark.read.parquet(f"{SMALL}/events.parquet").agg(F.count("*"), F.min("event_id"), F.count("value"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(event_id), COUNT(value)]" in plan


def test_backward_times_by_file_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[int(rng.integers(2))], None if rng.random() < 0.1 else int(k + rng.integers(-3, 3)), None if k % 7 == 0 else 1.0) for k in range(500)]
    spark.createDataFrame(rows, "k long, pair string, s long, v double").coalesce(1).write.parquet(str(tmp_path / "t"))
    last, want = {}, {"a": 0, "b": 0}
    for _, p, s, _ in rows:
        if s is not None:
            want[p] += p in last and s < last[p]
            last[p] = s
    for block in (20_000, 16, 1):
        got = {r["pair"]: r for r in stored.backward_times(spark, str(tmp_path / "t"), "pair", "s", block).collect()}
        assert {p: r["backward"] for p, r in got.items()} == want and sum(r["nulls_v"] for r in got.values()) == 72 and sum(r["rows"] for r in got.values()) == 500
        assert sum(r["nulls_s"] for r in got.values()) == sum(r[2] is None for r in rows)


def test_commits_are_whole_or_absent(spark, tmp_path):
    path, table = str(tmp_path / "run"), lambda n: spark.range(n)
    with pytest.raises(FileNotFoundError):
        stored.read(spark, path, "trades")
    assert stored.commit(spark, path, {"trades": table(3), "metrics": table(1)}, {"cursor": 5}) == 1
    assert stored.commit(spark, path, {"trades": table(4)}) == 2
    assert (stored.read(spark, path, "trades").count(), stored.read(spark, path, "metrics").count(), stored.manifest(spark, path)["state"]) == (4, 1, {"cursor": 5})
    assert stored.read(spark, path, "trades", 1).count() == 3

    def broken(rows):
        raise RuntimeError("lost half way")
        yield rows

    with pytest.raises(Exception, match="lost half way"):  # trades is written, metrics fails: readers still see version 2 of both
        stored.commit(spark, path, {"trades": table(9), "metrics": table(9).mapInPandas(broken, "id long")})
    assert stored.versions(spark, path) == [1, 2] and stored.read(spark, path, "trades").count() == 4
    with pytest.raises(RuntimeError, match="came after"):
        stored.commit(spark, path, {"trades": table(7)}, base=1)
    # another writer takes the number between this one's look and its rename
    seen = stored.versions
    try:
        stored.versions = lambda *_: [1]
        with pytest.raises(RuntimeError, match="taken by another writer"):
            stored.commit(spark, path, {"trades": table(7)})
    finally:
        stored.versions = seen
    assert stored.read(spark, path, "trades").count() == 4 and not [f for f in os.listdir(f"{path}/_drafts") if f.endswith(".json")]


def test_paths_of_logs_whose_fields_vary(spark):
    logs = [{"a": 1, "b": {"c": [1, {"d": "x"}], "e": None}}, {"a": "one"}, [], {}, 5, {"z": [[1.5]]}]
    rows = [(k, json.dumps(x)) for k, x in enumerate(logs)] + [(90, "{broken"), (91, None)]
    got = sorted((r["id"], r["path"], r["value"]) for r in stored.paths_of(spark.createDataFrame(rows, "id long, log string"), "log").collect() if r["kind"] != "void")
    assert got == [(0, "$.a", "1"), (0, "$.b.c[0]", "1"), (0, "$.b.c[1].d", "x"), (1, "$.a", "one"), (4, "$", "5"), (5, "$.z[0][0]", "1.5")]
