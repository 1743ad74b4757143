"""AGG1 / FEA4 split rules against a Python model of Java's String.split."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import Tokenizer

from kilowatt.functions.text import java_tokens, lines, words
from kilowatt.operators.text import word_count


def java_split(s: str, pattern: str) -> list[str]:
    """Java String.split(regex) with limit 0: trailing empties removed; an
    input with no match gives [s]."""
    if s == "":
        return [""]
    parts = re.split(pattern, s)
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def text_lines(s: str) -> list[str]:
    if s == "":
        return []
    body = re.sub(r"(\r\n|\r|\n)\Z", "", s)
    return re.split(r"\r\n|\r|\n", body)


EDGE_LINES = ["", " ", "   ", " a", "a ", "a  b", "  a  b  ", "a\tb", "\t", "a\t", "x y z", "é ü"]


def test_words_edge_lines(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE_LINES)], "i int, s string")
    got = {r["i"]: list(r["w"]) for r in df.select("i", words("s").alias("w")).collect()}
    for i, s in enumerate(EDGE_LINES):
        assert got[i] == java_split(s, " "), (s, got[i])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" ab\t\r\né", max_size=12), min_size=1, max_size=8))
def test_words_and_lines_match_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", lines("t").alias("ls")).collect()
    for r in out:
        assert list(r["ls"]) == text_lines(texts[r["i"]])
    out = df.select("i", words("t").alias("w")).collect()
    for r in out:
        t = texts[r["i"]]
        assert list(r["w"]) == java_split(t, " ")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" aB\t\x0b\x0c\r\nÉ", max_size=12), min_size=1, max_size=8))
def test_tokens_match_ml_tokenizer(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    ml = {r["i"]: list(r["words"]) for r in Tokenizer(inputCol="text", outputCol="words").transform(df).collect()}
    ours = {r["i"]: list(r["w"]) for r in df.select("i", java_tokens("text").alias("w")).collect()}
    assert ml == ours


def test_word_count_text_file_semantics(spark, tmp_dir):
    content = "a b\n\n  \na  b \r\nc\tc\n"
    path = f"{tmp_dir}/words.txt"
    with open(path, "w", newline="") as fh:
        fh.write(content)
    from kilowatt.sources.text import scan_text

    got = {r["word"]: r["count"] for r in word_count(scan_text(spark, path), "value").collect()}
    expect: dict[str, int] = {}
    for ln in text_lines(content):
        for w in java_split(ln, " "):
            expect[w] = expect.get(w, 0) + 1
    assert got == expect
    whole = spark.createDataFrame([(content,)], "text string")
    got2 = {r["word"]: r["count"] for r in word_count(whole, "text", multiline_text=True).collect()}
    assert got2 == expect
