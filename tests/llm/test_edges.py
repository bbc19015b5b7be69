"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from kinloom.llm import bpe_codec, chat_snapshots, embedding_dedup, language_id, license_scan, ngram_jaccard, pii_crf, quality_rules, secret_scan, source_mixing

LONG = "word " * 60_000
ROWS = [
    (1, None, None, None, None), (None, "the of and", "en", "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
    (3, LONG, "en", "s", 1), (4, "the cat and the dog", "en", "s", 1), (4, "the cat and the dog", "en", "s", 1), (4, "another text for the id", "de", None, 1), (5, "x" * 100_000, None, "t", 1), (6, " \n\t ", "fr", "t", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

OVER_DOCUMENTS = {
    "pii": pii_crf.find,
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "mixing": source_mixing.mixed,
    "secrets": secret_scan.scan,
    "redacted": secret_scan.redacted,
    "licence": license_scan.scan,
    "quality": quality_rules.measure,
    "jaccard": ngram_jaccard.join,
    "bpe": bpe_codec.digests,
    "ids": bpe_codec.encode,
}


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_every_row_has_a_result(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert OVER_DOCUMENTS[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_empty_table(spark, name):
    assert OVER_DOCUMENTS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_columns_of_the_same_names(spark, name):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "s", 1)], SCHEMA)
    out = OVER_DOCUMENTS[name](docs)
    more = docs.selectExpr("*", *[f"'old' AS {c}" for c in out.columns if c not in docs.columns], "1 AS `a.b`", "2 AS word")
    again = OVER_DOCUMENTS[name](more)
    assert [r.asDict()[c] for r in again.collect() for c in out.columns] == [r.asDict()[c] for r in out.collect() for c in out.columns]


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, None, "b"), (4, 0, "user", None), (4, 0, "user", None), (None, None, None, None), (5, None, "user", "z"), (5, 3, "user", "y")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_snapshots.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, 2), 4: (1, 1), None: (1, 1), 5: (2, 1)}
    assert chat_snapshots.collapse(spark.createDataFrame([], schema)).count() == 0
    more = spark.createDataFrame([(1, 0, "u", "t", "x", "y")], schema + ", last string, digests string")
    assert chat_snapshots.collapse(more).first().rendered == "<|im_start|>u\nt<|im_end|>\n"


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {**{k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 10, 11, None)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
