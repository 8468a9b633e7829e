"""What is known of stored tables without reading their rows, and commits of several tables at once."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@contextmanager
def _set(spark: SparkSession, **conf: str):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and rows of a Parquet table.  No column is read: rows are counted in the footers, empty files count as well."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    out = files.withColumn("_k", plain("file")).join(rows.withColumn("_k", plain("file")).drop("file"), "_k", "left")
    return out.select("file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))


#: Kinds whose least and largest values footers hold whole.
BOUNDED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date")


def table_inventory(spark: SparkSession, path: str, columns: list[str] | None = None) -> dict:
    """rows, and by column its nulls and, of numbers and dates, its least and largest value: one row that Spark puts together from footers alone.

    Aggregates without groups are pushed down to Parquet's statistics by its second reader, so no data page is read.
    """
    with _set(spark, **{"spark.sql.sources.useV1SourceList": "avro,csv,json,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}):
        table = spark.read.parquet(path)
        kinds = {c: k for c, k in table.dtypes if (columns is None or c in columns) and not k.startswith(("array", "map", "struct"))}
        told = [F.count("*").alias("rows"), *[F.count(F.col(c)).alias(f"n_{k}") for k, c in enumerate(kinds)]]
        told += [f(c).alias(f"{name}_{k}") for k, (c, kind) in enumerate(kinds.items()) if kind in BOUNDED for name, f in (("min", F.min), ("max", F.max))]
        row = table.agg(*told).first().asDict()
    return {"rows": row["rows"], "columns": {c: {"nulls": row["rows"] - row[f"n_{k}"], "min": row.get(f"min_{k}"), "max": row.get(f"max_{k}")} for k, c in enumerate(kinds)}}


def status(rows: int | None) -> str:
    """How much a table holds: none that can be read, no rows, under 500, or enough."""
    return "error" if rows is None else "empty" if rows == 0 else "thin" if rows < 500 else "ok"


def inventory(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """name, rows, files, bytes, nulls (of all columns), has_volume, has_spread, status and error of each table by its path."""
    out = []
    for name, path in tables.items():
        try:
            told, files = table_inventory(spark, path), file_inventory(spark, path).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        except Exception as error:  # one broken table must not hide the others
            out.append((name, None, None, None, None, None, None, status(None), type(error).__name__))
        else:
            held = {c: told["rows"] - k["nulls"] for c, k in told["columns"].items()}
            out.append((name, told["rows"], files[0], files[1], sum(k["nulls"] for k in told["columns"].values()), held.get("volume", 0) > 0, held.get("spread", 0) > 0, status(told["rows"]), None))
    return spark.createDataFrame(out, "name string, rows long, files long, bytes long, nulls long, has_volume boolean, has_spread boolean, status string, error string")


def backward_times(spark: SparkSession, path: str, key: str, time: str, block: int = 20_000) -> DataFrame:
    """key, rows, backward (rows whose time is before that of the key's row above them in their file) and the nulls of each column.

    The order is that of the rows in their file.  Files run in blocks of rows side by side; a block's first row of a key is held against the
    last known time of the blocks before it.
    """
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c != key]
    rows = table.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), F.col(key).alias("_key"), F.col(time).alias("_at"), *[F.col(c).isNull().cast("long").alias(f"_n_{c}") for c in rest])
    rows = rows.withColumn("_block", F.floor(F.col("_row") / block))
    keys = ["_file", "_key", "_block"]
    known = F.when(F.col("_at").isNotNull(), F.struct("_row", "_at"))
    ends = rows.groupBy(*keys).agg(F.max(known)["_at"].alias("_end"))
    ends = ends.select(*keys, F.last("_end", True).over(Window.partitionBy("_file", "_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    within = F.last("_at", True).over(Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("_before", within).join(ends.withColumnsRenamed({"_file": "_f", "_key": "_k", "_block": "_b"}), (F.col("_file") == F.col("_f")) & F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    back = F.coalesce(F.col("_at") < F.coalesce("_before", "_start"), F.lit(False))
    return told.groupBy(F.col("_key").alias(key)).agg(F.count("*").alias("rows"), F.count_if(back).alias("backward"), *[F.sum(f"_n_{c}").alias(f"nulls_{c}") for c in rest])


# Commits: tables lie under a name of their own, and a run is what its newest manifest names.


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a run's whole versions, oldest first."""
    _, Path, fs = _fs(spark, path)
    folder = Path(f"{path}/_manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], state: dict | None = None, base: int | None = None) -> int:
    """Write tables and a state as the next version of a run, which readers see whole or not at all; returns its number.

    Each table lies under a name that only this commit has; a manifest names them all and comes last, by a rename that fails if the number is
    taken.  So of two writers that start from the same version one raises, and a crash leaves the last version as it was.
    Tables that aren't given are those of the version before.  `base` is the version that the writer has read (by default the newest).
    """
    found = versions(spark, path)
    last = found[-1] if found else 0
    base = last if base is None else base
    if base != last:
        raise RuntimeError(f"version {last} came after {base}")
    own, named = uuid.uuid4().hex, dict(manifest(spark, path, base)["tables"]) if base else {}
    for name, table in tables.items():
        named[name] = f"{name}/{own}"
        table.write.mode("errorifexists").parquet(f"{path}/{named[name]}")
    jvm, Path, fs = _fs(spark, path)
    told = json.dumps({"version": base + 1, "tables": named, "state": state if state is not None else (manifest(spark, path, base)["state"] if base else {})})
    draft, final = Path(f"{path}/_drafts/{own}.json"), Path(f"{path}/_manifests/{base + 1}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, True)
    out.write(bytearray(told.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
    except Exception as error:
        fs.delete(draft, False)
        raise RuntimeError(f"version {base + 1} was taken by another writer") from error
    return base + 1


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, tables (name to path) and state of a version, by default of the newest."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no whole version")
    name = f"{path}/_manifests/{found[-1] if version is None else version}.json"
    return json.loads("".join(r[0] for r in spark.read.text(name, wholetext=True).collect()))


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/{manifest(spark, path, version)['tables'][name]}")


# Logs whose fields vary.


def paths_of(log: DataFrame, column: str) -> DataFrame:
    """log's other columns with path, kind and value of every leaf of a JSON column, however deep; text that isn't JSON gives none.

    Objects and lists are opened level by level as VARIANT, until no value of a level is one.
    """
    rest = [c for c in log.columns if c != column]
    level = log.select(*rest, F.lit("$").alias("path"), F.try_parse_json(column).alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        told = level.where("v is not null").withColumn("kind", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(F.regexp_replace(kind, r"\(.*", ""))))
        leaves = told.where("kind NOT IN ('object', 'array')").select(*rest, "path", "kind", F.variant_get("v", "$", "string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        nested = told.where("kind IN ('object', 'array')")
        if nested.isEmpty():
            return out
        view = f"_nested_{uuid.uuid4().hex}"
        nested.createOrReplaceTempView(view)
        names = ", ".join(f"`{c}`" for c in rest)
        opened = log.sparkSession.sql(f"SELECT {names}{', ' if rest else ''}concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v FROM {view}, LATERAL variant_explode(v) AS e")
        level = opened
