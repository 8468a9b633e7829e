"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group that stays together.  Groups are placed largest
first, each where the dot product of its (bytes, tokens, rows) with a shard's
residual capacity is highest.  Groups over a thousandth of a shard by any measure, of which
there can only be a bounded number, are placed together first; all others are dealt by
hash into blocks, and each block fills its share of what the large ones left, in a
task of its own.  Places inside a shard come from counts by bucket, so no task sees
a whole shard.

A group larger than a shard's fair share of bytes, tokens or rows can't stay together
if all three are to be balanced: it is split by a number of each of its rows, so
repeated and null ids split too.  Tokens are counted as runs of characters that aren't
white space.

Defined results: null text has no bytes, size 1 and CRC 0, and is a group of its own
apart from empty text; null ids are kept; repeated rows each get a place; shards may
be empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import cut

#: Groups over a shard's fair share divided by this are placed first and together.
FINE = 1000
#: Parts that a group too large is split into, for each shard's share of it.
SPLIT = 4
#: Groups to a block, and rows to a numbering bucket.
BLOCK, BUCKET = 20_000, 5_000

#: How much bytes, tokens and rows count: bytes come first, as the law names them.
WEIGHTS = np.array([10.0, 1.0, 1.0])


def pack(sizes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place rows of sizes (group, measure), largest first; the shard of each, and the room that is left.  Both are fractions of all."""
    sizes, room, where = sizes * WEIGHTS, room * WEIGHTS, np.zeros(len(sizes), "i4")
    for i in np.lexsort((np.arange(len(sizes)), -sizes[:, 0])):
        where[i] = np.argmax(room @ sizes[i])
        room[where[i]] -= sizes[i]
    return where, room / WEIGHTS


def shard_documents(documents: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    spark = documents.sparkSession
    body = F.col(text)
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.regexp_count(body, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sha2(body.cast("binary"), 256), F.lit("null")).alias("text_key"),
    )
    rows = cut(rows)
    whole = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    totals = np.maximum(np.array([float(x) for x in total]), 1.0)
    # of the measure that a group has most of, in fair shares of a shard
    share = lambda: F.greatest(*[F.col(c) * (shards / x) for c, x in zip(("bytes", "tokens", "n"), totals.tolist(), strict=True)])
    too_large = {r["text_key"]: math.ceil(SPLIT * shards * r["share"]) for r in whole.withColumn("share", share()).where("share > 1").collect()}  # fewer than `shards` by each measure
    part = F.lit(0).cast("long")
    for key, parts in too_large.items():
        part = F.when(F.col("text_key") == key, F.pmod(F.xxhash64("row"), F.lit(parts))).otherwise(part)
    rows = rows.withColumn("part", part)
    groups = cut(rows.groupBy("text_key", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")))

    def fractions(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[["bytes", "tokens", "n"]].to_numpy(float) / totals

    # at most 3 * shards * FINE of them, whatever the input
    large = groups.where(share() > 1 / FINE).orderBy(F.desc("bytes"), "text_key", "part").toPandas()
    where, room = pack(fractions(large), np.full((shards, 3), 1.0 / shards))
    small = groups.where(share() <= 1 / FINE)
    blocks = max(1, math.ceil(small.count() / BLOCK))
    rest = np.maximum(room, 0).sum(0)
    left = np.maximum(room, 0) / np.where(rest > 0, rest, 1)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "text_key", "part"], ascending=[False, True, True])
        sizes = fractions(pdf)
        found, _ = pack(sizes, left * sizes.sum(0))
        return pdf[["text_key", "part"]].assign(shard=found)

    kind = "text_key string, part long, shard int"
    dealt = small.withColumn("block", F.pmod(F.xxhash64("text_key", "part"), F.lit(blocks)))
    placed = dealt.groupBy("block").applyInPandas(place, kind)
    first = spark.createDataFrame([(k, int(p), int(s)) for k, p, s in zip(large["text_key"], large["part"], where, strict=True)], kind)
    buckets = max(1, math.ceil(total[2] / shards / BUCKET))
    at = rows.join(placed.unionByName(first), ["text_key", "part"]).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    at = cut(at.select("row", "id", "size", "crc", "shard", "bucket"))
    counts = at.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", F.expr("sum(n) over (partition by shard order by bucket) - n").alias("before"))
    numbered = at.withColumn("k", F.expr("row_number() over (partition by shard, bucket order by id, crc, size, row) - 1"))
    out = numbered.join(before, ["shard", "bucket"])
    return out.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
