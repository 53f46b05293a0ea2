from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "wanted"), [("ﬁne ﬅ", "fine ft"), ("a–b—c−d", "a-b—c-d")])
def test_typography(spark, raw, wanted):
    assert one(spark, raw, tx.normalize_typography) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [("Rank 1 2", "rank 12"), ("1,234  x", "1234 x"), ("12\n34", "1234"), ("", ""), ("a　 b ", "a b")])
def test_norm_for_match(spark, raw, wanted):
    assert one(spark, raw, tx.norm_for_match) == wanted


def test_tokens_and_grams(spark):
    assert one(spark, "Café re-ID 中文", tx.tokenize) == ["caf", "re", "id", "中", "文"]
    assert one(spark, ["a", "b", "c"], lambda x: tx.token_ngrams(x, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda x: tx.token_ngrams(x, 2), "array<string>") == []


def test_grams_of_a_text_take_one_tokenizing(spark):
    grams = lambda n: lambda x: tx.token_ngrams(tx.tokenize(x), n)
    began, words = time.monotonic(), [f"w{k}" for k in range(20_000)]
    assert one(spark, " ".join(words), grams(3)) == [" ".join(words[k : k + 3]) for k in range(19_998)]
    assert time.monotonic() - began < 30
    assert one(spark, None, grams(2)) is None
    assert [one(spark, t, grams(3)) for t in ("", "a b", "a b c")] == [[], [], ["a b c"]]


@pytest.mark.parametrize(
    ("answer", "form"),
    [
        ("结论：不是。根据知识库，用的是别的方法", "BARE_NEGATIVE"),
        ("知识库没有提及该方法的细节", "COVERAGE"),
        ("根据已检索材料，该方法不是由扩散模型生成", "QUALIFIED_EXCLUSION"),
        ("该方法不是由扩散模型生成", "BARE_NEGATIVE"),
        ("这是一个陈述句而已", "UNKNOWN"),
        ("", "UNKNOWN"),
    ],
)
def test_overclaim(spark, answer, form):
    assert one(spark, answer, tx.classify_overclaim) == form


@pytest.mark.parametrize(("line", "kept"), [("1. 检索方法的作用是什么", True), ("的作用是什么呢呀", False), ("what is this for", False), ("什么", False)])
def test_question_gate(spark, line, kept):
    assert one(spark, line, tx.question_gate) is kept


@pytest.mark.parametrize(("name", "year", "month"), [("2301.01234v2.pdf", 2023, 1), ("9912.00001", 1999, 12), ("12301.01234", None, None), ("x", None, None)])
def test_arxiv(spark, name, year, month):
    assert (one(spark, name, tx.arxiv_year), one(spark, name, tx.arxiv_month)) == (year, month)


def test_names(spark):
    assert one(spark, "dir/a b?.pdf", tx.safe_name) == "a_b_.pdf"
    assert len(one(spark, "x" * 300 + ".pdf", tx.safe_name)) == 120
    assert one(spark, "my_paper (2).pdf", lambda x: tx.auto_title(F.lit("None"), x)) == "my paper"
    assert one(spark, 7, tx.status_text, "int") == "unknown"
    title = lambda manual, metadata, name: tuple(one(spark, name, lambda x: tx.resolved_title(F.lit(manual), F.lit(metadata), x)))
    assert title(" Own ", "Meta", "f.pdf") == ("Own", "manual") and title("", "Caf&eacute; &#8212; x ", "f.pdf") == ("Café — x", "metadata")
    assert title(None, " none", "a/b__c (3).tar.pdf") == ("b c (3).tar", "filename") and title(None, None, "v_1 (12).pdf") == ("v 1", "filename")


def test_sources(spark):
    out = "[source 1 | A Title | p.15 | relevance 0.83]\nbody\n\n[source 2 | README | sec.2 | matched on exact terms]\nx"
    got = one(spark, out, tx.parse_sources)
    assert [(s.title, s.prefix, s.page, s.score) for s in got] == [("A Title", "p", "15", 0.83), ("README", "sec", "2", None)]


def test_relevance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(tx.relevance_l2("a", "b")).first()[0] == pytest.approx(1 - 2 / 2**0.5)
