import pytest
from pyspark.sql import functions as F

from sparkquill.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first().r


CASES = [
    (T.normalize, "proﬁling a ﬂow of ﬀ and ﬃ", "profiling a flow of ff and ﬃ"),
    (T.normalize, "it’s “quoted” – so — yes", "it's \"quoted\" - so - yes"),
    (T.normalize, "re-\nmaterialize  the\tgraph \n now", "rematerialize the graph now"),
    (T.normalize, "a\x00b\x07c", "a b c"),
    (T.normalize, "", ""),
    (T.normalize, None, None),
    (T.squash, "Off-line: MILP (v2)", "offlinemilpv2"),
    (T.squash, "proﬁling", "profiling"),
    (T.squash, "é", ""),
    (T.squash, "Привет", ""),
    (T.slug, "3.1 The Method!", "3-1-the-method"),
    (T.slug, "???", "body"),
    (T.clean_title, "1 INTRODUCTION", "1 Introduction"),
    (T.clean_title, "RELATED WORK.", "Related work"),
    (T.clean_title, "A DP", "A DP"),
    (T.clean_title, "2 Method..", "2 Method"),
    (T.line_key, "Page 12 of 30", "page # of #"),
]


@pytest.mark.parametrize("function,given,expected", CASES)
def test_text(spark, function, given, expected):
    assert one(spark, function(F.col("x")), x=given) == expected


def test_tokenize_drops_stop_words(spark):
    assert one(spark, T.tokenize(F.col("x")), x="Where is the keeper's No-2 hive, and WHY?") == ["keeper", "s", "no", "2", "hive"]


MATH = [(r"B = \Omega(\sqrt{N})", "B = Ω(√N)", True), (r"x \le y", "x ≤ y", True), (r"\mathrm{Loss} \times 2", "Loss × 2", True), (r"\alpha + 1", "β + 1", False), (r"\left( a \right)", "(a)", True)]


@pytest.mark.parametrize("a,b,same", MATH)
def test_math_spelling(spark, a, b, same):
    left, right = one(spark, T.squash_math(F.col("x")), x=a), one(spark, T.squash_math(F.col("x")), x=b)
    assert (left == right) is same


QUOTES = [
    (["alphabetagamma", "deltaepsilonzeta"], "xxalphabetagammayydeltaepsilonzetazz", True),
    (["deltaepsilonzeta", "alphabetagamma"], "xxalphabetagammayydeltaepsilonzetazz", False),
    (["alphabetagamma", "alphabetagamma"], "alphabetagamma", False),
    (["short"], "short and long", False),
    (["short", "alphabetagamma"], "alphabetagamma", True),
    ([], "anything", False),
]


@pytest.mark.parametrize("parts,hay,expected", QUOTES)
def test_ordered_containment(spark, parts, hay, expected):
    df = spark.createDataFrame([(parts, hay)], "p array<string>, h string")
    assert df.select(T.ordered_containment(F.col("p"), F.col("h")).alias("r")).first().r is expected


def test_cost_and_format(spark):
    row = spark.createDataFrame([(1000, 200, None)], "i int, o int, v double").select(T.cost_usd(F.col("i"), F.col("o"), 1.0, 5.0).alias("c"), T.fmt(F.col("v")).alias("n"), T.fmt(F.lit(0.12345)).alias("f"), T.fmt(F.lit(0.12345), True).alias("p")).first()
    assert row.c == pytest.approx(0.002) and (row.n, row.f, row.p) == ("–", "0.123", "12.3%")


def test_headers_and_prefix(spark):
    assert one(spark, T.with_header(F.col("t"), F.col("p"), F.col("s"), F.col("x")), t=None, p="p1", s="1 Intro", x="body") == "p1. 1 Intro. body"
    assert one(spark, T.query_text(F.col("x"), "bge-small"), x="q").endswith("passages: q")
    assert one(spark, T.query_text(F.col("x"), "other"), x="q") == "q"


def test_windows_and_words_of_odd_texts_equal_plain_python(spark):
    import random
    import re

    from sparkquill.operators import chunking

    rng = random.Random(5)
    marks = list("abZ09  \n\n--") + ["\t", "\r", "\x0b", "\x1f", "\x00", "\x7f", "\x85", "\xa0", " ", "’", "—", "ﬁ", "é", "ß", "İ", "K", "漢", "the ", " of "]
    texts = [None, "", " ", "\n", "a-\nb", "a-\x00\n\x1fb"] + ["".join(rng.choice(marks) for _ in range(rng.choice([3, 30, 300]))) for _ in range(300)]

    def normal(t):
        for a, b in T.LIGATURES.items():
            t = t.replace(a, b)
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t.translate(str.maketrans(T.QUOTES_FROM, T.QUOTES_TO)))
        t = re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", t)
        return re.sub(r"\s+", " ", t).strip(" ")

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {}
    for i, t in enumerate(texts):
        w = normal(t or "").split(" ") if normal(t or "") else []
        for n in range((len(w) - 3) // 5 + 1 if len(w) > 7 else min(len(w), 1)):
            want[i, n] = " ".join(w[n * 5 : n * 5 + 7])
    got = {(r.doc_id, r.n): r.text for r in chunking.chunk_texts(docs, size=7, overlap=2).collect()}
    assert got == want
    words = docs.select("doc_id", T.tokenize(F.col("text")).alias("w"), F.filter(T.words(F.col("text")), lambda x: ~x.isin(T.STOPWORDS)).alias("v")).collect()
    assert all(r.w == r.v for r in words) and [r.w for r in words if r.doc_id == 0] == [None]
    assert docs.select(T.tokenize(F.col("text")).alias("w"))._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
