"""Fill-in-middle transformation in Spark SQL alone: texts are cut in three and told in another order between sentinels.

A text's units are words with the white space before them, found by one regular
expression.  Cuts, form and rate come from the hex digest of a seed and the
document's id, so a text's arrangement depends on no other row and on no order of
rows: there is no shuffle and nothing to balance.

Plain texts stand as they are: those that hold a sentinel, the empty ones, and the
share that the rate leaves alone.  In all others each sentinel stands once, so the
three pieces are read back by splitting at them.

Defined results: null text reads as empty and is plain; a null id is hashed as an
empty string; repeated rows each give a row, equal ones for equal ids; a text of
white space alone is one unit; empty tables give no rows; other columns are ignored
by `fill_in_middle` unless they are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle, and what a unit is.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _checked(sentinels: Sequence[str]) -> Sequence[str]:
    """Sentinels, if no end of one is the start of one and none stands in another; else texts could make one across a border."""
    ends = any(a[k:] == b[: len(a) - k] for a in sentinels for b in sentinels for k in range(1, len(a)))
    if len({*sentinels, ""}) != 4 or ends or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three strings that can't overlap")
    return sentinels


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, sentinels: Sequence[str] = SENTINELS, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the columns to keep, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output.

    `rate` of 100 texts are cut, `spm` of 100 of those have the suffix first.
    """
    p, s, m = _checked(sentinels)
    held = documents.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), F.struct(*keep).alias("_kept") if keep else F.lit(None).alias("_kept"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = held.withColumn("_digest", digest).withColumn("_units", F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)))
    drawn = drawn.withColumns({"_n": F.size("_units").cast("long"), **{f"_h{k + 1}": _draw(F.col("_digest"), k) for k in range(4)}})
    whole = (F.col("_text") == "") | F.contains("_text", F.lit(p)) | F.contains("_text", F.lit(s)) | F.contains("_text", F.lit(m)) | (F.col("_h3") % 100 >= rate)
    cuts = [F.col(h) % (F.col("_n") + 1) for h in ("_h1", "_h2")]
    drawn = drawn.withColumns({"_form": F.when(whole, "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm"), "_lo": F.least(*cuts).cast("int"), "_hi": F.greatest(*cuts).cast("int")})
    span = lambda start, size: F.when(F.col("_form") != "plain", F.array_join(F.slice("_units", start, size), ""))
    lo, hi = F.col("_lo"), F.col("_hi")
    told = drawn.withColumns({"_prefix": span(F.lit(1), lo), "_middle": span(lo + 1, hi - lo), "_suffix": span(hi + 1, F.col("_n").cast("int") - hi)})
    psm = F.concat(F.lit(p), "_prefix", F.lit(s), "_suffix", F.lit(m), "_middle")
    spm_ = F.concat(F.lit(s), "_suffix", F.lit(p), "_prefix", F.lit(m), "_middle")
    output = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm_).otherwise(F.col("_text"))
    return told.select(F.col("_id").alias(doc_id), *[F.col("_kept")[c].alias(c) for c in keep], F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix").alias("prefix"), F.col("_middle").alias("middle"), F.col("_suffix").alias("suffix"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = _checked(sentinels)
    any_mark = "|".join(r"\Q" + x + r"\E" for x in (p, s, m))
    parts = F.split(output, any_mark, -1)  # what stands before the first mark is empty
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def digest_fim(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text read back from it."""
    told = fill_in_middle(documents, **options)
    back = restored(F.col("output"), F.col("form"), options.get("sentinels", SENTINELS))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return told.select(
        options.get("doc_id", "doc_id"), "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"),
    )
