"""Small tables with the rows that real ones hold now and then."""

from __future__ import annotations

import duckdb

from tests.conftest import SMALL

#: Extra columns with names that the operators use inside themselves.
EXTRA = "t string, id string, row string, key string, fp string, c string, piece string, n string, bucket string, doc string, part string, spans string, base string"
LONG = " ".join(f"word{i % 977} of {i}" for i in range(30_000))

ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "Ordinary words stand here in a row, and they go on for a while."),
    (4, "Ordinary words stand here in a row, and they go on for a while."),
    (5, "Ordinary words stand here in a row, and they go on for a while."),
    (None, "a row without an id"),
    (None, None),
    (7, LONG),
    (8, "ÅNGSTRÖM Straße ΣΊΣΥΦΟΣ é  nbsp em　wide ᲀ \U0001f600\U0001f600 ﬁ ½ ①"),
    (9, "odd\x1cwhite\x1dspace\x85and\x0bmore lines​zero ﻿"),
    (10, "<|endoftext|> and <|startoftext|>x<|endoftext|>y  don't I'LL '' --- 12,345.67"),
    (11, "a\r\n\r\n  b \n c  \t d\x00e"),
    (12, "x" * 5000),
    (13, "!" * 3000 + " " * 3000 + "end"),
]


def odd_documents(spark, rows=None):
    return spark.createDataFrame([(i, t, *["clash"] * 13) for i, t in (ODD_TEXTS if rows is None else rows)], f"doc_id long, text string, {EXTRA}")


def rows_of(table: str, columns: str, sf_dir: str = SMALL):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf_dir}/{table}.parquet')").fetchall()
