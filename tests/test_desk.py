"""The live desk over several batches, restarts and a pair that fails, against batches and plain loops."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronosweep.streaming import desk

KIND = "pair string, s long, open double, high double, low double, close double, volume double, spread double, arrival long"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in desk.CONF}
    for k, v in desk.CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def minutes(seed, n=240, pairs=("A", "B", "C")):
    rng = random.Random(seed)
    rows = []
    for p in pairs:
        for k in range(n):
            o, c = 1 + rng.random(), 1 + rng.random()
            rows.append((p, 1_704_067_200 + 60 * k, o, max(o, c) + 0.1, min(o, c) - 0.1, c, float(rng.randint(1, 9)), rng.choice([None, rng.random()]), 0))
    return rows


def batches(rows, seed, size, delay=40):
    """Rows in an order that is late by up to `delay` places of a pair's minutes, some of them sent again with other prices, cut into batches."""
    rng = random.Random(seed)
    sent = [(r[1] / 60 + rng.random() * delay, r) for r in rows]
    sent += [(at + rng.random() * 20, (*r[:5], r[5] + 0.001, *r[6:])) for at, r in sent if rng.random() < 0.2]
    sent = [(*r[:-1], k) for k, (_, r) in enumerate(sorted(sent, key=lambda x: x[0]))]
    return sent, [sent[k : k + size] for k in range(0, len(sent), size)]


def feed(spark, folder, rows, k):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")


def whole(sent, width):
    """Closed bars of all minutes, by pair: the last sent of each minute."""
    frame = pd.DataFrame(sent, columns=[c.split()[0] for c in KIND.split(", ")]).sort_values("arrival").drop_duplicates(["pair", "s"], keep="last")
    out = {}
    for pair, rows in frame.groupby("pair"):
        bars = desk.rolled(rows[rows["s"] < rows["s"].max()], width)
        for b in bars[bars["s"] + width <= rows["s"].max()].itertuples(index=False):
            out[pair, b.s] = tuple(None if pd.isna(x) else round(x, 9) for x in (b.open, b.high, b.low, b.close, b.volume, b.spread))
    return out


def run(spark, tmp, parts, told_of, name="one"):
    """Each part is a run of its own: the query stops and starts again from its checkpoint."""
    for k, part in enumerate(parts):
        feed(spark, f"{tmp}/in", part, k)
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/part=*")
        desk.run_desk(told_of(source), f"{tmp}/{name}", f"{tmp}/check-{name}", {"availableNow": True}).awaitTermination()


def read(spark, tmp, kind, name="one"):
    return spark.read.parquet(f"{tmp}/{name}/{kind}")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_minutes_gives_the_batch_result(spark, tmp_path, seed):
    sent, parts = batches(minutes(seed), seed, 230)
    seen = lambda pair, bars: [(int(s), 1 if c > o else -1) for s, o, c in bars[["s", "open", "close"]].itertuples(index=False)]
    run(spark, tmp_path, parts, lambda s: desk.buffered(s, 900, 7200, seen))
    bars = read(spark, tmp_path, "bar")
    got = {(r["pair"], r["s"]): tuple(None if r[c] is None or r[c] != r[c] else round(r[c], 9) for c in desk.PRICES) for r in desk.latest(bars).collect()}
    want = whole(sent, 900)
    assert got == want and len(want) >= 40
    assert bars.where("revision > 0").count() > 0 and bars.groupBy("pair", "s", "revision").count().where("count > 1").isEmpty()
    signals = read(spark, tmp_path, "signal").collect()
    assert len(signals) == len({(r["pair"], r["s"]) for r in signals}) == len(want)


def test_minutes_beyond_the_lookback_are_told_not_lost(spark, tmp_path):
    rows = [(*r[:-1], k) for k, r in enumerate(minutes(3, 200, ("A",)))]
    run(spark, tmp_path, [rows[60:], rows[:60]], lambda s: desk.buffered(s, 900, 3600))
    late = {r["s"] for r in read(spark, tmp_path, "late").collect()}
    assert late == {r[1] for r in rows[:60]}


def test_a_pair_that_fails_is_set_apart(spark, tmp_path):
    sent, parts = batches(minutes(5), 5, 260)
    bad = ("B", 1_704_067_200 + 60 * 90, None, 1.0, 1.0, 1.0, 1.0, 0.1, 10**6)
    parts[1] = [*parts[1], bad]

    def moody(pair, bars):
        if pair == "C":
            raise RuntimeError("no signals today")
        return []

    run(spark, tmp_path, parts, lambda s: desk.buffered(s, 900, 7200, moody))
    errors = read(spark, tmp_path, "error").collect()
    assert {r["pair"] for r in errors} == {"B", "C"} and all(r["batch"] >= 0 and r["reason"] for r in errors)
    told = [r["reason"] for r in errors if r["pair"] == "B"]
    assert len(told) == 1 and "lacks its time or a price" in told[0] and told[0].count('"arrival"') == sum(r[0] == "B" for r in parts[1])
    got = {(r["pair"], r["s"]): round(r["close"], 9) for r in desk.latest(read(spark, tmp_path, "bar")).collect() if r["pair"] == "A"}
    assert got == {k: v[3] for k, v in whole(sent, 900).items() if k[0] == "A"}
    # a pair that failed goes on with later batches, from the state before
    b = [r for part in [*parts[:1], *parts[2:]] for r in part if r[0] == "B"]
    got = {(r["pair"], r["s"]): round(r["close"], 9) for r in desk.latest(read(spark, tmp_path, "bar")).collect() if r["pair"] == "B"}
    assert got == {k: v[3] for k, v in whole(b, 900).items()}


def test_timers_tell_without_input_and_after_a_restart(spark, tmp_path):
    rows = [(*r[:-1], k) for k, r in enumerate(minutes(6, 40, ("A", "B")))]
    feed(spark, f"{tmp_path}/in", rows, 0)

    def live(seconds):
        source = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in/part=*")
        query = desk.run_desk(desk.buffered(source, 900, 7200, heartbeat_s=1, reconcile_s=3, ttl_s=3600), f"{tmp_path}/one", f"{tmp_path}/check", {"processingTime": "1 second"})
        end = time.time() + seconds
        while time.time() < end and query.isActive:
            time.sleep(0.2)
        assert query.exception() is None
        query.stop()

    live(14)
    beats = {p: [r["at_ms"] for r in read(spark, tmp_path, "heartbeat").where(F.col("pair") == p).orderBy("at_ms").collect()] for p in "AB"}
    assert all(len(b) >= 2 and all(y - x >= 1000 for x, y in zip(b[:-1], b[1:], strict=True)) for b in beats.values())
    first = read(spark, tmp_path, "reconcile").count()
    assert first >= 2 and read(spark, tmp_path, "heartbeat").where("n <> 40").isEmpty()
    live(10)
    assert read(spark, tmp_path, "reconcile").count() > first


@pytest.mark.parametrize("most", [1, 3])
def test_positions_are_capped_over_batches_and_restarts(spark, tmp_path, most):
    rng, kind = random.Random(most), "pair string, plan_id long, at_s long"
    plans = [(rng.choice("AB"), k, 10 * k + rng.randint(0, 5)) for k in range(60)]
    closes = [(p, k, at + rng.randint(5, 120)) for p, k, at in plans if rng.random() < 0.8]
    events = sorted([(at, 1, k, p) for p, k, at in plans] + [(at, 0, k, p) for p, k, at in closes])
    held, want = {"A": [], "B": []}, {}
    for _at, what, k, p in events:
        if what == 0:
            held[p] = [x for x in held[p] if x != k]
        else:
            want[k] = len(held[p]) < most
            held[p] += [k] if want[k] else []
    edges = [0, 37, 60, 61, len(events)]
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        for name, what in (("plans", 1), ("closes", 0)):
            rows = [(p, k, at) for at, w, k, p in events[a:b] if w == what] + ([(p, k, at) for at, w, k, p in events[:a] if w == what == 1][-3:])
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/part={n}")
        source = lambda name: spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}/part=*")  # noqa: E731, B023
        out = desk.admitted(source("plans"), source("closes"), most)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["plan_id"]: r["admitted"] for r in rows} == want and len(rows) == len(want) and max(r["n_open"] for r in rows) == most
