import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import fuzzy, text as X


def values(spark, rows, **columns):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "ab"[: len(rows[0])]))
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_normalised_texts(spark):
    cases = {None: "", "": "", "  ": "", "Récord  & Co.": "record co", "Straße_1+2": "strasse 1+2", "a\x1cb\tc": "a b c", "$5 = <x>": "$5 = <x>", "Ünïçødé": "unicøde", "हिन्दी": "हिनदी"}
    got = values(spark, [(k,) for k in cases], n=X.normalize_text(F.col("a")))
    assert [g[0] for g in got] == list(cases.values())


def test_marks_without_a_combining_class_stay(spark):
    # Vowel signs have class 0 and stay, the virama goes; neither is part of a word.
    got = values(spark, [("कि क्",)], n=X.normalize_text(F.col("a")), t=F.array_join(X.tokens(X.normalize_text(F.col("a"))), "|"))
    assert got == [("कि क", "क")]


def test_canonical_forms(spark):
    n = X.normalize_text(F.col("a"))
    got = values(spark, [("ABC Pvt. Ltd.",), ("Limited ABC Private",), ("Pvt Ltd",), ("12 Main St Apt 4",)], c=X.core_name(n), s=X.strong_address(n), l=X.strong_address(n, True), w=X.strong_name(n))
    assert [g[0] for g in got[:3]] == ["abc", "abc", ""]
    assert got[3][1:3] == ("12 4 apt main street", "12 4 apartment main street")
    assert got[0][3] == "abc private limited"


def test_sets(spark):
    n = F.col("a")
    got = values(spark, [("strasse 1+2",), ("ab c",), ("ab",), ("",)], t=F.array_join(X.tokens(n), "|"), g=F.array_join(X.char_grams(n), "|"))
    assert got == [("strasse|1|2", "str|tra|ras|ass|sse|se1|e12"), ("ab|c", "abc"), ("ab", ""), ("", "")]


@pytest.mark.parametrize("a, b, want", [("a 12", "b 12 3", 0.5), ("a", "b", -1.0), ("a 1", "b", 0.0)])
def test_digit_jaccard(spark, a, b, want):
    assert values(spark, [(a, b)], d=X.digit_jaccard(F.col("a"), F.col("b"))) == [(want,)]


def test_numbers(spark):
    r = spark.range(1).select(X.score_bin(F.lit(0.825)).alias("b"), X.quantised(F.lit(0.0005)).alias("q"), X.quantised(F.lit(7.0)).alias("m"), X.length_ratio(F.lit(""), F.lit("")).alias("l"), X.parse_ids(F.lit(" ")).alias("n"), X.parse_ids(F.lit("x,y,x")).alias("i")).first()
    assert (r.b, r.q, r.m, r.l, r.n, r.i) == (0.8, 0, 1000, 0.0, [], ["x", "y"])


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=20), st.text("abc ", max_size=20))
def test_lcs_and_bounds(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    for f in (fuzzy.ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.weighted_ratio, fuzzy.partial_ratio):
        assert 0 <= f(a, b) <= 100 and f(a, b) == pytest.approx(f(b, a))


def test_scorers_by_hand():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("ab", "") == 0
    assert fuzzy.ratio("abcd", "abxd") == 75
    assert fuzzy.token_sort_ratio("new york mets", "mets new york") == 100
    assert fuzzy.token_set_ratio("anand limited", "anand private limited") == 100
    # Common "a", the rest "bc" and "bd": sides of 4 characters, 2 apart.
    assert fuzzy.token_set_ratio("a bc", "a bd") == 75
    assert fuzzy.token_set_ratio("", "x") == 0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100
    assert fuzzy.weighted_ratio("abc", "xxxx abc xxxx xxxx") == pytest.approx(90)
    assert fuzzy.weighted_ratio("", "") == 0


def test_scores_column(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    got = [r.s for r in df.select(fuzzy.scores()("a", "b").alias("s")).collect()]
    assert got[0].token_sort == 100 and got[1].token_set == 0
