"""Queries over what is stored: footers, file order, commits and logs whose fields vary, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronosweep.functions.lineage import ready_checkpoints
from chronosweep.plans.catalogue import query
from chronosweep.sources import stored
from chronosweep.sources.bridge import table

_FOOTERS = {"lineitem": ("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag"), "orders": ("o_orderkey", "o_totalprice", "o_orderpriority"), "events": ("event_id", "value", "props"), "supplier": ("s_suppkey", "s_acctbal", "s_name"), "part": ("p_partkey", "p_size")}
_TEXT = ("l_returnflag", "o_orderpriority", "props", "s_name")
_bound = lambda f, c: "CAST(NULL AS DOUBLE)" if c in _TEXT else f"CAST({f}({c}) AS DOUBLE)"


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS field, count(*) AS rows, count(*) - count({c}) AS nulls, {_bound('min', c)} AS least, {_bound('max', c)} AS most, CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 500 THEN 'thin' ELSE 'ok' END AS status FROM {t}" for t, cs in _FOOTERS.items() for c in cs))
def footer_inventory(spark, sf_dir):
    """Rows, nulls, bounds and status of tables by column, from their files' footers alone."""
    rows = []
    for t, columns in _FOOTERS.items():
        told = stored.table_inventory(spark, f"{sf_dir}/{t}.parquet", list(columns))
        for c, k in told["columns"].items():
            number = lambda x: None if x is None else float(x)
            rows.append((t, c, told["rows"], k["nulls"], number(k["min"]), number(k["max"]), stored.status(told["rows"])))
    return spark.createDataFrame(rows, "name string, field string, rows long, nulls long, least double, most double, status string")


@query("WITH t AS (SELECT *, row_number() OVER () AS rn FROM lineitem), f AS (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_returnflag ORDER BY rn) AS before FROM t) SELECT l_returnflag, count(*) AS rows, count_if(l_shipdate < before) AS backward, count(*) - count(l_quantity) AS nulls_l_quantity, count(*) - count(l_shipdate) AS nulls_l_shipdate FROM f GROUP BY 1")
def file_order(spark, sf_dir):
    """Times that go back against the order of rows in their file, and nulls by column."""
    found = stored.backward_times(spark, f"{sf_dir}/lineitem.parquet", "l_returnflag", "l_shipdate")
    return found.select("l_returnflag", "rows", "backward", "nulls_l_quantity", "nulls_l_shipdate")


_PROPS = "SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_id, user_id FROM events"


@query(f"WITH p AS ({_PROPS}), l AS (SELECT event_type, '$.p.k' AS path, k AS value FROM p UNION ALL SELECT event_type, '$.tags[0]', CAST(user_id AS VARCHAR) FROM p UNION ALL SELECT event_type, '$.tags[1].t', event_type FROM p UNION ALL SELECT event_type, '$.deep.x.y[0]', CAST(event_id AS VARCHAR) FROM p WHERE event_id % 3 = 0) SELECT event_type, path, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS most FROM l GROUP BY ALL")
def props_paths(spark, sf_dir):
    """Every leaf of a log of JSON whose fields vary by row, by its path."""
    e = table(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    deep = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "deep": {"x": {"y": ['), text("event_id"), F.lit("]}}"))).otherwise("")
    log = F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ['), text("user_id"), F.lit(', {"t": "'), "event_type", F.lit('"}]'), deep, F.lit("}"))
    leaves = stored.paths_of(e.select("event_type", log.alias("log")), "log")
    return leaves.groupBy("event_type", "path").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(2 AS BIGINT) AS version, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1) AS BIGINT) AS n_before FROM orders GROUP BY 1")
def run_versions(spark, sf_dir):
    """A run of two commits: the newest version of a table beside the one before it."""
    ready_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/runs/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    stored.commit(spark, path, {"orders": rows.where("o_orderkey % 2 = 1"), "fixed": rows.select("status").distinct()}, {"cursor": 1})
    version = stored.commit(spark, path, {"orders": rows}, {"cursor": 2})
    count = lambda df, name: df.groupBy("status").agg(F.count("*").alias(name))
    both = count(stored.read(spark, path, "orders"), "n").join(count(stored.read(spark, path, "orders", 1), "n_before"), "status", "left")
    return stored.read(spark, path, "fixed").join(both, "status", "right").select("status", "n", F.lit(version).cast("long").alias("version"), F.coalesce("n_before", F.lit(0)).alias("n_before"))
