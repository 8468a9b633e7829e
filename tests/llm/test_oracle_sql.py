"""SQL and engine on rows that the given tables lack."""

from __future__ import annotations

import duckdb

from chronosweep.llm import chat, decontaminate, queries
from tests.conftest import as_rows


def both(df, sql, **tables):
    con = duckdb.connect()
    for name, (kinds, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({kinds})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    return as_rows(df.columns, df.collect()), as_rows(columns, want.fetchall())


def test_chats_are_stuffed_in_sql_where_the_engine_stuffs(spark):
    texts = ["a [s> b <INST] c", "x [s> y", "<s", "s>", "plain", "</s>", "\\</s>", "[INST", "]INST]", "[/INST] <s>", None, "<\\s>", "<", "/s>"]
    rows = [(k, 0, "user", a) for k, a in enumerate(texts)] + [(k, 1, "assistant", b) for k, b in enumerate(reversed(texts))]
    rows += [(90, 0, "<s>", "x"), (91, 0, "[INST", "]"), (92, 0, "user[/INST]", ""), (None, 0, "user", "no id"), (93, 0, "user<", "s>")]
    kinds = "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR"
    df = spark.createDataFrame(rows + [(-7, 0, "user", queries.CONFLICT), (-7, 1, "assistant", queries.CONFLICT)], "conv_id long, turn long, role string, text string")
    got, want = both(chat.read_back(chat.format_chats(df)), queries.OP1_SQL, conversations=(kinds, rows))
    assert got == want and len(got) == len(texts) + 6


def test_items_of_few_words_are_found_in_sql_too(spark):
    docs = [(1, "we say forty two here and there are more words"), (2, "forty, two"), (3, "two forty"), (4, None), (5, "one two three four five six")]
    items = [(1, "Forty two!"), (2, "three"), (3, ""), (4, "one two three four"), (5, "one two three four five six"), (6, None)]
    df = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got, want = both(df, queries.OP9_SQL, documents=("doc_id BIGINT, text VARCHAR", docs), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert got == want and len(got) == 5
