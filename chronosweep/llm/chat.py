"""Chat formatting with a checked grammar round trip.

A conversation is rendered as a run of turns ``<s>[INST]role[/INST]text</s>``.
A deterministic parser reads the rendered string back; where the turns that it
recovers differ from the source, the conflicting content is escaped and the
conversation rendered again, until both are identical.  Everything is built-in
SQL functions: no Python runs on the executors.

Escaping is backslash stuffing: one backslash goes in after the opening ``<``
or ``[`` of anything that looks like a control string, however many backslashes
it already holds, and reading back takes one away.  Text without such strings is
unchanged, so one escape level always suffices.

Defined results: null role or text reads as empty; null ``turn`` sorts first;
turns that tie are ordered by role, then text; repeated rows stay repeated
turns; a null ``conv_id`` is one conversation of its own; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronosweep.llm.common import let, pieces, running

# The control strings of the template.
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
_STUFFABLE = r"([<\[])(\\*/?(?:s>|INST\]))"
_STUFFED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
_TURN = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STUFFABLE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _STUFFED, "$1$2")


def _raw(text: Column) -> Column:
    return text


def _turn_text(role: Column, text: Column, level) -> Column:
    return F.concat(F.lit(OPEN + HEAD), level(role), F.lit(BODY), level(text), F.lit(CLOSE))


def render(turns: Column, level) -> Column:
    return F.array_join(F.transform(turns, lambda t: _turn_text(t["role"], t["text"], level)), "")


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation as array<struct<role,text>>; null where it isn't in the grammar."""
    pieces = F.split(rendered, CLOSE, -1)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    fields = F.transform(bodies, lambda p: F.struct(F.regexp_extract(p, _TURN, 1).alias("role"), F.regexp_extract(p, _TURN, 2).alias("text"), p.rlike(_TURN).alias("ok")))
    clean = F.forall(fields, lambda t: t["ok"] & ~t["role"].rlike(_CONTROL) & ~t["text"].rlike(_CONTROL))
    turns = F.transform(fields, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return F.when(clean & (F.element_at(pieces, -1) == ""), turns)


def _loss_spans(turns: Column, level) -> Column:
    """[start, end) in code points of the rendered string, one for each assistant text."""
    wide = F.transform(turns, lambda t: F.struct((F.length(level(t["role"])) + len(OPEN + HEAD + BODY + CLOSE)).alias("frame"), F.length(level(t["text"])).alias("own"), (t["role"] == "assistant").alias("mask")))

    def spans(w: Column) -> Column:
        ends = running(F.transform(w, lambda x: x["frame"] + x["own"]))
        every = F.zip_with(w, ends, lambda x, e: F.struct((e - len(CLOSE) - x["own"]).cast("int").alias("start"), (e - len(CLOSE)).cast("int").alias("end"), x["mask"].alias("mask")))
        return F.transform(F.filter(every, lambda s: s["mask"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(wide, spans)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped (whether escapes were needed), loss_spans in code points of formatted."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    source = grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = render(F.col("turns"), _raw)
    fits = source.withColumn("escaped", ~parse(plain).eqNullSafe(F.col("turns")))
    strict = render(F.col("turns"), escape)
    strict = F.when(parse(strict).eqNullSafe(F.col("turns")), strict).otherwise(F.raise_error(F.lit("a conversation can't be read back")).cast("string"))
    return fits.select(
        "conv_id",
        "escaped",
        F.when(F.col("escaped"), strict).otherwise(plain).alias("formatted"),
        F.when(F.col("escaped"), _loss_spans(F.col("turns"), escape)).otherwise(_loss_spans(F.col("turns"), _raw)).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold, by the parser and the loss mask alone."""
    masked = F.transform(pieces(F.col("formatted"), F.col("loss_spans")), unescape)
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
