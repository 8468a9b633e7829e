r"""Secret scans with multipart credential linking, in built-in SQL functions only.

Base spans are matches of three fixed patterns over the whole text.  The linking
step adds weaker candidates (account names, long opaque words, endpoints), and
reports one only where parts that complete it stand within ``reach`` code points:
an account name needs a secret, an opaque word needs an identifier, an endpoint
needs both.  Identifiers and secrets are interval-joined to the candidates on
(row key, bucket of ``reach`` code points): a candidate is dealt to all buckets that
its span touches, a part to all that touch its span widened by ``reach`` on both
sides.  What counts is the gap between the two spans, however long they are; a bucket
holds no more parts than touch three such stretches of text.

Defined results: null text reads as empty; rows with the same id and text get
the same spans, each row its own output row; null ids are kept; empty tables give
no rows; other columns of the input are ignored by ``scan_secrets`` and kept by
``mask_secrets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosweep.llm.common import cut, let, pieces, running

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more, as runs are maximal
HEX = r"[0-9a-f]{24,}"
# The weak candidates of the linking step.
IDENT = r"""(?i)(?:client_id|key_id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{32,}"  # letters and digits both
ENDPOINT = r"""(?:https?|s3|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>|]+"""
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = 3
REACH = 400
ASSIGN_MIN = 6
#: Spans that may be sent to all tasks.
SENT = 200_000

_SPAN = "struct<start:int,rank:int,end:int>"


def _spans(text: Column, pattern: str, rank: int, group: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern's matches: their places follow from the lengths of the matches and of the text between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    # the text after the last match is no cell
    cells = F.zip_with(F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), value, lambda x, v: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(v).alias("value")))
    cells = F.filter(cells, lambda c: c["hit"].isNotNull())

    def spans(c: Column) -> Column:
        ends = running(F.transform(c, lambda x: x["gap"] + x["hit"]))
        every = F.zip_with(c, ends, lambda x, e: F.struct((e - x["hit"]).cast("int").alias("start"), F.lit(rank).alias("rank"), e.cast("int").alias("end"), x["value"].alias("value")))
        return F.transform(F.filter(every, lambda s: s["value"] >= least), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    return F.when(text.rlike(pattern), let(cells, spans).cast(f"array<{_SPAN}>")).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _base(text: Column) -> Column:
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, ASSIGN_MIN), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _weak(text: Column) -> Column:
    return F.concat(_spans(text, IDENT, 3), _spans(text, OPAQUE, 4), _spans(text, ENDPOINT, 5))


def _row_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), F.coalesce(F.col(text), F.lit(""))))


def _found(documents: DataFrame, columns: list[str], doc_id: str, text: str) -> DataFrame:
    """columns, row_key, base and weak spans, written so that the patterns run once over each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return cut(documents.select(F.struct(*columns).alias("c"), _row_key(doc_id, text).alias("row_key"), _base(body).alias("base"), _weak(body).alias("weak")))


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """row_key, added: the weak candidates whose complementary parts stand within reach, for rows that have any."""
    one = found.where(F.size("weak") > 0).select("row_key", F.explode(F.concat("base", "weak")).alias("part")).distinct()
    in_text = Window.partitionBy("row_key")
    is_base, start, end = F.col("part.rank") < BASE, F.col("part.start"), F.col("part.end")
    reached = F.max(F.when(is_base, end)).over(in_text.orderBy(start))
    next_base = F.min(F.when(is_base, start)).over(in_text.orderBy(start.desc()))
    # a weak span that overlaps a base span is that base span seen again
    seen = F.coalesce(reached > start, F.lit(False)) | F.coalesce(next_base < end, F.lit(False))
    fresh = one.withColumn("seen", seen).where(is_base | ~F.col("seen"))
    first, last = F.floor(start / reach), F.floor(end / reach)
    dealt = fresh.select("row_key", "part", first.alias("first"), last.alias("last"), F.explode(F.sequence(first - 1, last + 1)).alias("bucket"))
    near = dealt.groupBy("row_key", "bucket").agg(
        F.collect_set(F.when(F.col("bucket").between(F.col("first"), F.col("last")) & (F.col("part.rank") >= BASE), F.col("part"))).alias("weak"),
        F.collect_set(F.when(F.col("part.rank").isin(1, 3), F.col("part"))).alias("ids"),
        F.collect_set(F.when(F.col("part.rank").isin(0, 2, 4), F.col("part"))).alias("secrets"),
    )

    def met(parts: str) -> Column:
        return F.filter("weak", lambda w: F.exists(F.col(parts), lambda p: (p["start"] - w["end"] <= reach) & (w["start"] - p["end"] <= reach)))

    # a long candidate may meet its identifier in one bucket and its secret in another
    every = lambda name: F.array_distinct(F.flatten(F.collect_list(name))).alias(name)
    by_row = near.where(F.size("weak") > 0).select("row_key", met("ids").alias("by_id"), met("secrets").alias("by_secret")).groupBy("row_key").agg(every("by_id"), every("by_secret"))
    of = lambda name, rank: F.filter(name, lambda w: w["rank"] == rank)
    added = F.concat(of("by_secret", 3), of("by_id", 4), F.array_intersect(of("by_id", 5), of("by_secret", 5)))
    return by_row.select("row_key", added.alias("added")).where(F.size("added") > 0)


def _joined(found: DataFrame, reach: int) -> DataFrame:
    """found with all spans of each row in `every`."""
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))
    return found.join(linked_spans(found, reach), "row_key", "left").select("c", "row_key", "base", every.alias("every"))


def _told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans as kind:start:end."""
    rows = _joined(_found(documents, [doc_id], doc_id, text), reach)
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return rows.select(
        F.col("c").getField(doc_id).alias(doc_id),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"),
        _told("every").alias("spans"),
    )


def mask_secrets(documents: DataFrame, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """documents with every span of `text` replaced by a mark; spans that overlap become one mark.  Other columns stay."""
    columns = documents.columns
    spans = _joined(_found(documents, [doc_id], doc_id, text), reach).where(F.size("every") > 0).groupBy("row_key").agg(F.first("every").alias("every"))
    spans = cut(spans)
    few = (spans.agg(F.sum(F.size("every"))).first()[0] or 0) <= SENT
    spans = F.broadcast(spans) if few else spans  # texts aren't shuffled for the few that have spans
    held = documents.select(F.struct(*columns).alias("c"), _row_key(doc_id, text).alias("row_key"))
    rows = held.join(spans, "row_key", "left").select("c", F.coalesce("every", F.array().cast(f"array<{_SPAN}>")).alias("every"))
    body = F.coalesce(F.col("c").getField(text), F.lit(""))
    # what stands before the first span and between runs of overlapping spans, and after the last
    reached = running(F.transform("every", lambda s: s["end"]), F.greatest)
    before = F.concat(F.array(F.lit(0).cast("bigint")), reached)
    starts = F.concat(F.transform("every", lambda s: s["start"].cast("bigint")), F.array(F.length(body).cast("bigint")))
    gaps = F.filter(F.zip_with(before, starts, lambda e, s: F.struct(e.alias("start"), s.alias("end"))), lambda g: g["end"] >= g["start"])
    masked = F.array_join(pieces(body, gaps), mark)
    new = F.when(F.size("every") > 0, masked).otherwise(F.col("c").getField(text))
    return rows.select(*[(new if c == text else F.col("c").getField(c)).alias(c) for c in columns])
