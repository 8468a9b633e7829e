"""Nearest and next rows against a plain loop, and without a row for each pair in reach."""

from __future__ import annotations

import random

import pytest

from chronosweep.operators import live, reconcile
from tests.conftest import MIDDLE, same_as_oracle

ROWS = 120


def sides(kind):
    rng = random.Random(kind)
    wide = {"dense": 40, "sparse": 4000, "tied": 6}[kind]
    one = lambda: [(rng.choice("AB"), rng.choice((1, -1)), rng.randrange(-wide, wide), i) for i in rng.sample(range(1000), ROWS)]
    bt, right = one(), one()
    return [*bt, ("A", 1, 2, bt[0][3]), ("B", 1, None, 2001)], [*right, ("A", 1, 3, right[0][3]), (None, 1, 2, 2002)]


@pytest.mark.parametrize("kind", ["dense", "sparse", "tied"])
def test_nearest_against_all_pairs(spark, kind):
    bt, right = sides(kind)
    near = [(abs(a[2] - b[2]), a[3], b[3], *a[:2]) for a in bt for b in right if a[:2] == b[:2] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 20]
    mine, theirs = {}, {}
    for gap, b, i, *_ in sorted(near):
        mine[b] = min(mine.get(b, (gap, i)), (gap, i))
        theirs[i] = min(theirs.get(i, (gap, b)), (gap, b))
    want = {(b, i, p, d, gap) for gap, b, i, p, d in near if mine[b] == (gap, i) and theirs[i] == (gap, b)}
    shape = "pair string, direction int, signal_s long, {0} long"
    got = reconcile.match_nearest(spark.createDataFrame(bt, shape.format("bt_id")), spark.createDataFrame(right, shape.format("live_id")), 20)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("kind", ["dense", "sparse", "tied"])
def test_first_against_all_pairs(spark, kind):
    left, right = [[(p, s, i) for p, _, s, i in side] for side in sides(kind)]
    first = {}
    for p, s, i in left:
        found = [(t, r) for q, t, r in right if p == q and s is not None and t is not None and s <= t < s + 20]
        first[i] = min([*found, *([first[i]] if first.get(i) else [])], default=None)
    got = live.first_within(spark.createDataFrame(left, "pair string, s long, id long"), spark.createDataFrame(right, "pair string, s long, rid long"), 20)
    want = [(i, p, first[i] and first[i][1]) for p, _, i in left]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["match_fuzzy", "first_within"])
def test_pairs_in_reach_are_not_listed(spark, name):
    """Many rows of one time: what is shuffled follows the rows and not their square."""
    n = 3000
    rows = spark.range(n).selectExpr("'A' AS pair", "1 AS direction", "id % 2 AS signal_s", "id AS bt_id", "id AS live_id", "id % 2 AS s", "id", "id AS rid")
    df = reconcile.match_nearest(rows, rows, 20) if name == "match_fuzzy" else live.first_within(rows.select("pair", "s", "id"), rows.select("pair", "s", "rid"), 20)
    assert len(df.collect()) == (2 if name == "match_fuzzy" else n)
    most = 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    assert most <= 4 * n


@pytest.mark.parametrize("name", ["match_fuzzy", "first_within"])
def test_queries_of_orders(spark, name):
    import __spark_entry__

    same_as_oracle(__spark_entry__.queries()[name](spark, MIDDLE), __spark_entry__.oracle_sql()[name], MIDDLE)
