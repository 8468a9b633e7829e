"""What classifiers learn from is bounded in bytes, not in rows alone."""

from chronosweep.llm import language, quality
from chronosweep.llm.common import within_bytes


def test_rows_within_bytes(spark):
    rows = [(1, "a" * 10), (2, "é" * 10), (3, "b" * 1000), (4, ""), (5, "c" * 300), (6, "d" * 9), (7, "e" * 400), (8, "f")]
    df = spark.createDataFrame(rows, "k int, t string")
    # 3, 5 and 7 are over a sixteenth each
    assert sorted(r["k"] for r in within_bytes(df, 3200, "k").collect()) == [1, 2, 4, 6, 8]
    assert sorted(r["k"] for r in within_bytes(df, 16 * 21, "k").collect()) == [1, 2, 4, 6, 8]
    many = spark.createDataFrame([(k, "x" * 10) for k in range(100)], "k int, t string")
    assert sorted(r["k"] for r in within_bytes(many, 205, "k").collect()) == list(range(20))
    assert within_bytes(df.limit(0), 100, "k").count() == 0


def test_long_texts_do_not_fill_the_driver(spark):
    words = {"aa": "river stone garden window ", "bb": "zug baum haus straße "}
    rows = [(i, words[lang] * 10, lang) for i, lang in enumerate(["aa", "bb"] * 100)] + [(1000, "q" * 200_000, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, sample_bytes=20_000)
    assert model.names == ["aa", "bb"]  # the only text of the third language is over a sixteenth
    guessed = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(docs, model).collect()}
    assert all(guessed[i] == lang for i, _, lang in rows if i < 1000)
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, quality int")
    learned = quality.fit_quality(docs, labels, sample_bytes=20_000)
    assert learned.good and learned.bad
    assert max(len(learned.good), len(learned.bad)) < 20_000 and b"qqqq" not in learned.good + learned.bad
