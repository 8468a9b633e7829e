"""Sums along arrays and cuts out of strings, whose work must not grow with the square of their number."""

import itertools
import time

from pyspark.sql import functions as F

from chronosweep.llm import chat, secrets
from chronosweep.llm.common import pieces, running
from tests.llm.fixtures import odd_documents


def test_running_sums_and_maxima(spark):
    rows = [[], [5], [1, 2], [3, 0, 7], list(range(50)), [9, 1, 1, 12, 4] * 101]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    for join, plain in ((lambda a, b: a + b, None), (F.greatest, max)):
        got = {r["i"]: r["w"] for r in df.select("i", running(F.col("v"), join).alias("w")).collect()}
        assert got == {i: list(itertools.accumulate(r, plain)) for i, r in enumerate(rows)}


def test_pieces(spark):
    text = "aé\U0001f600bc" * 40
    spans = [(0, 0), (0, 3), (3, 3), (5, 9), (9, 11), *((i, i + i % 3) for i in range(12, 190, 3)), (190, 200)]
    for some in ([], spans[:1], spans):
        df = spark.createDataFrame([(text, some)], "t string, s array<struct<start:int,end:int>>")
        assert df.select(pieces(F.col("t"), F.col("s"))).first()[0] == [text[a:b] for a, b in some]


def test_long_conversation_and_many_secrets(spark):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"é turn {i} [INST" + "]" * (i % 3 == 0)) for i in range(20_000)], "conv_id long, turn int, role string, text string")
    began = time.time()
    row = chat.read_back(chat.format_chats(turns)).first()
    assert row["n_turns"] == 20_000 and row["loss_chars"] == sum(len(f"é turn {i} [INST" + "]" * (i % 3 == 0)) for i in range(1, 20_000, 2))
    assert time.time() - began < 30
    text = " ".join(f"ü token=abcdef{i:06d}" for i in range(40_000))
    began = time.time()
    assert secrets.scan_secrets(odd_documents(spark, [(1, text)])).first()["n_assign"] == 40_000
    assert secrets.mask_secrets(odd_documents(spark, [(1, text)])).first()["text"] == " ".join(["ü [SECRET]"] * 40_000)
    assert time.time() - began < 60
