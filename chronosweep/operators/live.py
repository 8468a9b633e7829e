"""Logs of live trading: plans, tickets and deals stitched to trades, and reports over them."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.functions.exprs import pip
from chronosweep.functions.lineage import cut
from chronosweep.operators.ordered import around

# A broker's reason codes.
DEAL_REASONS = {0: "CLIENT", 1: "MOBILE", 2: "WEB", 3: "EXPERT", 4: "SL", 5: "TP", 6: "SO", 7: "ROLLOVER", 8: "VMARGIN", 9: "SPLIT"}


def deal_reason(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DEAL_REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit(""))


def order_comment(family: Column, prefix: str = "sig_", bare: str = "order", most: int = 31) -> Column:
    """A short comment that names the signal family."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(family, F.lit("")))), "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(name == "", bare).otherwise(F.substring(F.concat(F.lit(prefix), name), 1, most))


def comment_fields(comment: Column) -> dict[str, Column]:
    """What a broker's comment tells: the kind and price of the stop that closed a position, and the level in a name."""
    stop = r"\[(sl|tp)\s+([0-9.]+)\]"
    told = lambda pattern, k: F.nullif(F.regexp_extract(comment, pattern, k), F.lit(""))
    return {"stop_kind": F.upper(told(stop, 1)), "stop_price": told(stop, 2).try_cast("double"), "level": told(r"_L(\d+)_", 1).cast("int")}


def own_deals(deals: DataFrame, magic: int, prefixes: tuple[str, ...] = ("sig_",)) -> DataFrame:
    """Deals of this system, by magic number or comment, one row a ticket: the newest."""
    comment = F.coalesce("comment", F.lit(""))
    mine = F.col("magic") == magic
    for p in prefixes:
        mine = mine | comment.startswith(p)
    rest = [c for c in deals.columns if c not in ("ticket", "time")]
    return deals.where(mine).groupBy("ticket").agg(F.max(F.struct("time", *rest)).alias("r")).select("ticket", "r.*")


def stitch(plans: DataFrame, tickets: DataFrame, deals: DataFrame) -> DataFrame:
    """One row a plan, with its fill, both legs, costs in account currency, close reason and slippage, and the plan's variant, family, spread and lots.

    Older plans lack these: their variant is -1, their family empty, their spread and lots null.
    """
    held = lambda c, kind, default=None: (F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in plans.columns else F.lit(default).cast(kind)).alias(c)
    plans = plans.withColumns({c: held(c, kind, default) for c, kind, default in (("signal_variant", "long", -1), ("signal_family", "string", ""), ("spread_at_fire_pips", "double", None), ("lots", "double", None))})
    is_open = F.col("position_id") == F.col("ticket")
    legs = deals.groupBy("position_id").agg(
        F.max(F.when(is_open, F.col("price"))).alias("open_price"),
        F.max_by(F.when(~is_open, F.struct("price", "reason")), F.when(~is_open, F.col("ticket"))).alias("close"),
        F.sum("commission").alias("commission_ccy"),
        F.sum("swap").alias("swap_ccy"),
    )
    rows = plans.join(tickets.select("plan_id", F.col("ticket").alias("position_id"), "fill_price"), "plan_id", "left").join(legs, "position_id", "left")
    per, side = pip(F.col("pair")), F.when(F.col("direction") > 0, 1).otherwise(-1)
    return rows.select(
        "plan_id", "pair", "direction", "signal_s", "signal_variant", "signal_family", F.col("spread_at_fire_pips").alias("spread_pips"), "lots",
        F.col("entry_ref_price").alias("entry_price"),
        F.col("close.price").alias("exit_price"),
        ((F.col("close.price") - F.col("open_price")) / per * side).alias("pnl_pips"),
        "commission_ccy", "swap_ccy",
        F.coalesce("close.reason", F.lit("")).alias("close_reason"),
        ((F.col("fill_price") - F.col("entry_ref_price")) / per * F.col("direction")).alias("slippage_pips"),
    )


# The verdicts' names.
VERDICTS = ("No backtest match", "Backtest data cut off", "No replay match", "Good match", "Close enough, review", "Broker price-path drift", "Material difference")


def verdict(matched: Column, bt_reason: Column, live_reason: Column, pnl: Column, minutes: Column, entry: Column, exit_: Column) -> Column:
    """What a trade's differences amount to, by the first rule that holds."""
    size = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    tight = (F.abs(pnl) <= 2) & (size(minutes) <= 2) & (size(entry) <= 2) & (size(exit_) <= 2)
    drift = (F.abs(pnl) <= 5) & F.lower(F.coalesce(live_reason, F.lit(""))).contains("sl") & (F.upper(F.coalesce(bt_reason, F.lit(""))) == "SL")
    rules = (~F.coalesce(matched, F.lit(False)), F.upper(F.coalesce(bt_reason, F.lit(""))) == "NONE", pnl.isNull(), tight, (F.abs(pnl) <= 5) & (size(minutes) <= 10), drift)
    return F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in zip(rules, VERDICTS, strict=False)], F.lit(VERDICTS[-1]))


def position_summary(positions: DataFrame) -> DataFrame:
    """Trades, wins, win rate and net by symbol, and in total under a null symbol."""
    sums = positions.rollup("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("profit") > 0).alias("wins"), F.sum("profit").alias("net"))
    return sums.withColumn("win_pct", F.col("wins") * 100 / F.col("n"))


def dashboard(rollup: DataFrame, universe: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """The rollup by pair with zeros for configured pairs that have no trades, and whether a position is open."""
    counts = [c for c, kind in rollup.dtypes if kind == "bigint"]
    every = rollup.join(universe.select("pair").distinct(), "pair", "full").fillna(0, counts)
    flag = open_pairs.select("pair").distinct().withColumn("has_open_position", F.lit(True))
    return every.join(flag, "pair", "left").fillna(False, ["has_open_position"])


def tail_plans(plans: DataFrame, limit: int, since_s: int | None = None, pair: str | None = None) -> DataFrame:
    """The newest plans, oldest of them first."""
    if since_s is not None:
        plans = plans.where(F.col("created_s") >= since_s)
    if pair is not None:
        plans = plans.where(F.col("pair") == pair)
    return plans.orderBy(F.desc("created_s"), F.desc("plan_id")).limit(limit).orderBy("created_s", "plan_id")


def capped(plans: DataFrame, open_now: DataFrame, most: int) -> DataFrame:
    """Plans in order while their pair has room: open positions and earlier plans count."""
    held = open_now.groupBy("pair").agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy("pair").orderBy("created_s", "plan_id"))
    rows = plans.withColumn("_place", place).join(held, "pair", "left")
    return rows.where(F.col("_place") + F.coalesce("_held", F.lit(0)) <= most).drop("_place", "_held")


def fresh_plans(plans: DataFrame, logged: DataFrame, tickets: DataFrame) -> DataFrame:
    """Plans that neither the log of plans nor that of tickets names, once each, within an instance: a restart fires none again."""
    known = logged.select("instance_id", "plan_id").unionByName(tickets.select("instance_id", "plan_id")).distinct()
    return plans.dropDuplicates(["instance_id", "plan_id"]).join(known, ["instance_id", "plan_id"], "left_anti")


def closed_positions(deals: DataFrame, orders: DataFrame, offset_s: int = 0) -> DataFrame:
    """One row a closed position: its first entry leg and last exit leg by `entry` (in, out), sums of all legs, stop and target of the entry's order.

    deals: position_id, ticket, time, order_id, entry, side, symbol, volume, price, profit, commission, swap; orders: order_id, sl, tp, where 0 is none.
    Positions without both legs are open still.  Times lose the broker's offset.
    """
    at, leg = F.struct("time", "ticket", "order_id", "price"), F.struct("time", "order_id", "side", "symbol", "volume", "price")
    into, out = F.col("entry") == "in", F.col("entry") == "out"
    sums = deals.where("coalesce(position_id, 0) <> 0").groupBy("position_id").agg(
        F.min_by(F.when(into, leg), F.when(into, at)).alias("i"), F.max_by(F.when(out, leg), F.when(out, at)).alias("o"),
        *[F.sum(c).alias(c) for c in ("profit", "commission", "swap")],
    )
    closed = sums.where("i is not null and o is not null").select("position_id", F.col("i.symbol").alias("symbol"), F.col("i.side").alias("side"), F.col("i.volume").alias("volume"), (F.col("i.time") - offset_s).alias("open_s"), F.col("i.price").alias("open_price"), (F.col("o.time") - offset_s).alias("close_s"), F.col("o.price").alias("close_price"), "profit", "commission", "swap", F.col("i.order_id").alias("order_id"))
    none = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    return closed.join(orders.select("order_id", none("sl"), none("tp")), "order_id", "left").drop("order_id")


def latencies(plans: DataFrame, tickets: DataFrame, width_s: int) -> DataFrame:
    """plan_id, fire_offset_s (from the close of the signal's bar to the plan) and execution_ms (from the plan to its ticket); times in milliseconds."""
    joined = plans.join(tickets.select("plan_id", "filled_ms"), "plan_id", "left")
    return joined.select("plan_id", (F.col("created_ms") / 1000 - (F.col("signal_s") + width_s)).alias("fire_offset_s"), (F.col("filled_ms") - F.col("created_ms")).alias("execution_ms"))


def unportable(trials: DataFrame, groups: tuple[str, ...] = ("stale", "session", "max_bars")) -> DataFrame:
    """trial_id and the groups that it has switched on and the live side can't honour."""
    flags = [F.when(F.coalesce(F.col(g).cast("boolean"), F.lit(False)), g) for g in groups]
    return trials.select("trial_id", F.array_compact(F.array(*flags)).alias("groups"))


def fired_on_last_bar(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals on their pair's newest bar."""
    return signals.join(bars.groupBy("pair").agg(F.max("s").alias("s")), ["pair", "s"], "left_semi")


def first_within(left: DataFrame, right: DataFrame, span: int) -> DataFrame:
    """left (pair, s, id) with the first row of right (pair, s, rid) in [s, s + span), by the next time of each distinct time of left."""
    near = around(left, right.select("pair", "s", F.col("rid").alias("id")), ["pair"], span).where(F.col("after.s") < F.col("s") + span).select("pair", "s", "after")
    # rows of one id have the first of them all
    first = F.min("after").over(Window.partitionBy("id"))
    return left.join(near, ["pair", "s"], "left").select("id", "pair", F.when(F.col("id").isNotNull(), first["id"]).alias("rid"))


#: Rows of one side to a cell of time that cells are halved down to, and how many windows a cell has at least.
CROWD, SPAN = 5_000, 3


def take_nearest(wanted: list[tuple], free: list[tuple], gone: set, window: int) -> list[tuple]:
    """(id, id taken, its time, gap) of rows (s, id) that in their order each take the nearest of `free` (sorted) which isn't gone or taken; of equally near ones the earlier."""
    ahead, back = list(range(len(free) + 1)), list(range(len(free) + 1))  # the next free place from here on, and up to here (one more than it)

    def find(links: list[int], k: int) -> int:
        root = k
        while links[root] != root:
            root = links[root]
        while links[k] != root:
            links[k], k = root, links[k]
        return root

    def use(k: int) -> None:
        ahead[k], back[k + 1] = k + 1, k

    for k, (_, i) in enumerate(free):
        if i in gone:
            use(k)
    out = []
    for s, i in wanted:
        at = bisect_left(free, (s,))
        later, before = find(ahead, at), find(back, at) - 1
        near = [k for k in (later,) if k < len(free)]
        if before >= 0:
            near.append(find(ahead, bisect_left(free, (free[before][0],))))  # the first of those at the same time
        near = [(abs(free[k][0] - s), k) for k in near if abs(free[k][0] - s) <= window]
        if near:
            gap, k = min(near)
            use(k)
            out.append((i, free[k][1], free[k][0], gap))
    return out


def match_greedy(bt: DataFrame, live: DataFrame, window: int, crowd: int = CROWD) -> DataFrame:
    """Backtest rows, in order of time, each take the nearest live row within the window that is still free.

    A pair and direction's time is cut into cells that are a few windows wide, halved while they hold more than `crowd` rows.  A cell only
    depends on those before it through the live rows about its start that they have taken, so all cells are matched side by side, at
    first as if none were; where what the cell before it took turns out otherwise, a cell is matched again, until nothing changes.
    The first cell is right at once, the k-th after k rounds at most, and most after two, as what is taken at a border
    seldom matters a cell later.  Each cell is a row, so a task holds one at a time.
    """
    key = ["pair", "direction"]
    sound = lambda df, name: df.where("pair is not null and direction is not null and signal_s is not null").select(*key, F.col("signal_s").cast("long").alias("s"), F.col(name).alias("id"))
    rows = cut(sound(bt, "bt_id").withColumn("side", F.lit(0)).unionByName(sound(live, "live_id").withColumn("side", F.lit(1))))
    width = max(SPAN * window, 1) + 1
    least = width
    crowded = lambda w: not rows.groupBy(*key, "side", F.floor(F.col("s") / w)).count().where(F.col("count") > crowd).isEmpty()
    while not crowded(width * 16) and width < 2**40:
        width *= 16
    while width // 2 >= least and crowded(width):
        width //= 2
    own, at = F.floor(F.col("s") / width), F.struct("s", "id")
    mine = rows.where("side = 0").groupBy(*key, own.alias("cell")).agg(F.sort_array(F.collect_list(at)).alias("wanted"))
    # a cell sees its own live rows and those a window before and after
    reach = F.array_distinct(F.array(own, F.floor((F.col("s") - window) / width), F.floor((F.col("s") + window) / width)))
    theirs = rows.where("side = 1").select("*", F.explode(reach).alias("cell")).groupBy(*key, "cell").agg(F.sort_array(F.collect_list(at)).alias("free"))
    cells = cut(mine.join(theirs, [*key, "cell"]))
    ids = dict(rows.dtypes)["id"]
    found = f"array<struct<bt_id:{ids},live_id:{ids},live_s:bigint,gap:bigint>>"

    @F.udf(found)
    def matched(wanted, free, gone):
        return take_nearest([(r["s"], r["id"]) for r in wanted], [(r["s"], r["id"]) for r in free], set(gone), window)

    def settled(some: DataFrame) -> DataFrame:
        """Cells with `gone` matched: what they took, and of that what the next cell sees."""
        told = some.withColumn("took", matched("wanted", "free", "gone"))
        passed = F.filter("took", lambda m: m["live_s"] >= (F.col("cell") + 1) * width - window)
        return told.select(*key, "cell", "gone", "took", F.sort_array(F.transform(passed, lambda m: m["live_id"])).alias("passed"))

    nothing = F.array().cast(f"array<{ids}>")
    state = cut(settled(cells.withColumn("gone", nothing)))
    while True:
        before = state.select(*key, (F.col("cell") + 1).alias("cell"), F.col("passed").alias("now"))
        told = state.join(before, [*key, "cell"], "left").withColumn("now", F.coalesce("now", nothing))
        stale = cut(told.where("now <> gone").select(*key, "cell", F.col("now").alias("gone")))
        if stale.isEmpty():
            break
        again = settled(cells.join(stale, [*key, "cell"]))
        state = cut(state.join(stale.select(*key, "cell"), [*key, "cell"], "left_anti").unionByName(again))
    return state.select(*key, F.explode("took").alias("m")).select("m.bt_id", "m.live_id", *key, "m.gap")
