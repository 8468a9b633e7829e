"""The live side as streams with state: a rolling buffer of minutes, isolation of a pair that fails, timers, and a cap on positions.

All of it is keyed by pair, so pairs are spread over tasks and a pair's state is as large as its lookback or its open
positions, not its history.  State and timers live in the state store, so a restarted query goes on where it
stopped.  Sessions need the RocksDB state store (`CONF`).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

PRICES = ["open", "high", "low", "close", "volume", "spread"]
#: What the desk tells: bars and their revisions, signals on them, minutes that came too late, failures with the rows they left out, and what timers say.
TOLD = "kind string, pair string, s long, open double, high double, low double, close double, volume double, spread double, n long, revision int, direction int, reason string, at_ms long"
COLUMNS = [part.split()[0] for part in TOLD.split(", ")]


def rolled(minutes: pd.DataFrame, width: int) -> pd.DataFrame:
    """Bars of `width` seconds from minutes (s and PRICES) in order; the spread is a mean."""
    rows = minutes.sort_values("s")
    by = rows.groupby(rows["s"] // width * width)
    return by.agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum"), spread=("spread", "mean"), n=("s", "size")).rename_axis("s").reset_index()


class Buffer(StatefulProcessor):
    """A pair's minutes of the last `lookback` seconds: the last that arrived of each, in any order.

    The newest minute is still forming and held back; a bar is closed once a minute at or after its end has been seen.  Closed
    bars are told once, and again with a higher revision when a late minute changes them, so the last revision of each is what
    a batch over all minutes gives.  Minutes older than the lookback are told as `late`.  `evaluate` gets the pair and its closed bars when new
    ones close, and gives (s, direction) of signals.

    What raises for one pair leaves its state as it was and is told as `error`, with the batch's rows; other pairs go on.
    """

    def __init__(self, width: int, lookback: int, evaluate: Callable[[str, pd.DataFrame], list[tuple[int, int]]] | None = None, heartbeat_ms: int = 0, reconcile_ms: int = 0, ttl_ms: int | None = None):
        self.width, self.lookback, self.evaluate, self.every, self.ttl_ms = width, lookback, evaluate, {"heartbeat": heartbeat_ms, "reconcile": reconcile_ms}, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{c} double" for c in PRICES)
        self.minutes = handle.getListState("minutes", f"s long, {fields}", self.ttl_ms)
        self.bars = handle.getListState("bars", f"s long, {fields}, revision int", self.ttl_ms)
        self.due = handle.getMapState("due", "at_ms long", "kind string")

    def _held(self, state, more: list[str]) -> pd.DataFrame:
        rows = list(state.get()) if state.exists() else []
        return pd.DataFrame(rows, columns=["s", *PRICES, *more]).astype({"s": "int64", **dict.fromkeys((*PRICES, *more), "float64")})

    def _told(self, rows: pd.DataFrame, kind: str, pair: str, **more) -> pd.DataFrame:
        return rows.assign(kind=kind, pair=pair, **more).reindex(columns=COLUMNS).astype(dict.fromkeys(("kind", "pair", "reason"), object))

    def _process(self, pair: str, came: pd.DataFrame, now: int) -> list[pd.DataFrame]:
        if came[["s", *PRICES[:4]]].isna().any(axis=None):
            raise ValueError("a minute lacks its time or a price")
        came = came.assign(s=came["s"].astype("int64") // 60 * 60)
        held = self._held(self.minutes, [])
        horizon = lambda newest: (newest - self.lookback) // self.width * self.width
        # late is what the minutes before this batch have left behind; a backlog that comes at once is not
        floor = horizon(held["s"].iat[-1]) if len(held) else came["s"].min()
        late, came = came[came["s"] < floor], came[came["s"] >= floor]
        newest = max([*came["s"].tolist(), *held["s"].tolist()[-1:]])
        since = max(floor, horizon(newest))
        order = came.sort_values("arrival", kind="stable") if "arrival" in came else came
        held = pd.concat([x for x in (held, order[["s", *PRICES]]) if len(x)]).drop_duplicates("s", keep="last").sort_values("s")
        closed = rolled(held[held["s"] < newest], self.width)
        closed = closed[closed["s"] + self.width <= newest]
        before = self._held(self.bars, ["revision"])
        known = closed.merge(before, "left", "s", suffixes=("", "_was"))
        same = pd.concat([(known[c] == known[f"{c}_was"]) | (known[c].isna() & known[f"{c}_was"].isna()) for c in PRICES], axis=1).all(axis=1) & known["revision"].notna()
        changed = known[~same].assign(revision=lambda d: d["revision"].fillna(-1).astype("int64") + 1)
        out = [self._told(changed, "bar", pair, at_ms=now)] if len(changed) else []
        if self.evaluate and len(changed):
            fresh = set(changed["s"][changed["revision"] == 0])
            fired = [(s, d) for s, d in self.evaluate(pair, closed) if s in fresh]
            if fired:
                out.append(self._told(pd.DataFrame(fired, columns=["s", "direction"]), "signal", pair, at_ms=now))
        if len(late):
            out.append(self._told(late, "late", pair, at_ms=now, reason="older than the lookback"))
        # nothing has raised: now the state changes
        self.minutes.put([tuple(r) for r in held.loc[held["s"] >= since, ["s", *PRICES]].itertuples(index=False)])
        told = known.assign(revision=known["revision"].where(same, known["revision"].fillna(-1) + 1).astype("int64"))
        told = told[told["s"] >= since]
        if len(told):
            self.bars.put([tuple(r) for r in told[["s", *PRICES, "revision"]].itertuples(index=False)])
        else:
            self.bars.clear()
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, pair = int(time.time() * 1000), key[0]
        frames = pd.concat(list(rows))
        try:
            out = self._process(pair, frames, now)
        except Exception as error:  # the desk must not stop for one pair
            left_out = frames.where(frames.notna(), None).to_dict("records")
            out = [self._told(pd.DataFrame({"reason": [json.dumps({"error": repr(error), "rows": left_out}, default=str)], "n": len(frames)}), "error", pair, at_ms=now)]
        if any(self.every.values()) and not self.due.exists():
            for kind, every in self.every.items():
                if every > 0:
                    self._again(kind, now + every)
        yield from out

    def _again(self, kind: str, at: int) -> None:
        while self.due.containsKey((at,)):
            at += 1
        self.due.updateValue((at,), (kind,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), int(time.time() * 1000)
        kind = self.due.getValue((at,))[0]
        self.due.removeKey((at,))
        held = self._held(self.minutes, [])
        self._again(kind, max(at + self.every[kind], now + 1))
        yield self._told(pd.DataFrame({"n": [len(held)], "s": [held["s"].max() if len(held) else None]}), kind, key[0], at_ms=at)

    def close(self) -> None:
        pass


def buffered(minutes: DataFrame, width: int, lookback: int, evaluate=None, heartbeat_s: float = 0, reconcile_s: float = 0, ttl_s: float | None = None) -> DataFrame:
    """TOLD of a stream of minutes (pair, s, PRICES, and `arrival` where the order inside a batch matters).

    A stream with timers or a time to live runs batches without input as well, and so needs a trigger by processing time; one without may run what is there and end.
    """
    timed = heartbeat_s or reconcile_s or ttl_s is not None
    processor = Buffer(width, lookback, evaluate, int(heartbeat_s * 1000), int(reconcile_s * 1000), None if ttl_s is None else int(ttl_s * 1000))
    return minutes.where("pair is not null").groupBy("pair").transformWithStateInPandas(processor, TOLD, "Update", "ProcessingTime" if timed else "None")


def run_desk(told: DataFrame, folder: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Write what the desk tells to a table for each kind, by batch; a batch that is run again overwrites its own files only."""

    def store(rows: DataFrame, batch: int) -> None:
        held = rows.withColumn("batch", F.lit(batch)).persist()
        for kind in [r[0] for r in held.select("kind").distinct().collect()]:
            held.where(F.col("kind") == kind).drop("batch").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={batch}")
        held.unpersist()

    return told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(**trigger).start()


def latest(bars: DataFrame) -> DataFrame:
    """The last revision of each bar."""
    rest = [c for c in bars.columns if c not in ("pair", "s")]
    return bars.groupBy("pair", "s").agg(F.max_by(F.struct(*rest), F.struct("revision", "batch")).alias("r")).select("pair", "s", "r.*")


class Cap(StatefulProcessor):
    """Admits a pair's plans in order while fewer than `most` of its positions are open; a plan that is known already isn't judged again."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "plan_id long")
        self.judged = handle.getMapState("judged", "plan_id long", "at_s long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # at one moment closes come first, as they make room
        events = pd.concat(list(rows)).assign(turn=lambda d: d["kind"].map({"close": 0, "plan": 1})).sort_values(["at_s", "turn", "plan_id"])
        held, out = [r[0] for r in self.open.get()] if self.open.exists() else [], []
        for kind, plan, at in events[["kind", "plan_id", "at_s"]].itertuples(index=False):
            if kind == "close":
                held = [p for p in held if p != plan]
            elif not self.judged.containsKey((int(plan),)):
                self.judged.updateValue((int(plan),), (int(at),))
                admitted = len(held) < self.most
                held += [int(plan)] if admitted else []
                out.append((key[0], int(plan), int(at), admitted, len(held)))
        if held:
            self.open.put([(int(p),) for p in held])
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["pair", "plan_id", "at_s", "admitted", "n_open"]).astype({"pair": object})

    def close(self) -> None:
        pass


def admitted(plans: DataFrame, closes: DataFrame, most: int) -> DataFrame:
    """pair, plan_id, at_s, admitted, n_open of a stream of plans and one of closes (both pair, plan_id, at_s)."""
    both = plans.select(F.lit("plan").alias("kind"), "pair", "plan_id", "at_s").unionByName(closes.select(F.lit("close").alias("kind"), "pair", "plan_id", "at_s"))
    return both.where("pair is not null and plan_id is not null").groupBy("pair").transformWithStateInPandas(Cap(most), "pair string, plan_id long, at_s long, admitted boolean, n_open long", "Append", "None")
