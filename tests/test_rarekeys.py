"""Words and grams counted and filtered in batches."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, derive, rarekeys, stats
from kinloom.plans import queries as Q
from test_many_copies import COLUMNS, Counted, documents, rows

ODD = [
    "", None, "_ + $", "ab", "a+b c=d e_f ²½ ٣٤ x|y", "𝔸𝔹 𐐀𐐁𐐂 a𐐀b", "हिन्दी भाषा में", "中文 字 符 号", "ÀÉ ｆｕｌｌ ﬁ ß İ", "a b c d\x1ce", "x" * 300 + " one two", "1 2 3 4 5 6 7 8 9 1 2 3",
    "w w w w w w w rareone raretwo", "Pvt Ltd", "~ ^ ` < > rareone q",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("rarekeys"))
    odd = [(1000 + 10 * k + j, t, lang, f"src{j}") for k, t in enumerate(ODD) for j, lang in enumerate(("en", "en", "de"))]
    spark.createDataFrame(documents(400) + odd, COLUMNS).write.parquet(f"{at}/documents.parquet")
    return at


def test_frequent_keys_are_never_rows_however_many(spark, folder, monkeypatch):
    monkeypatch.setattr(blocking, "BROADCAST_KEYS", 0)
    v = Counted(spark, folder)
    plan = v.rare._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("MapInArrow") == 2
    df = blocking.eligible(rarekeys.counted(v.corpus), Q.CFG)
    for x in (v.s1, v.corpus):
        got = rarekeys.passed(x, rarekeys.bits(df))
        known = derive.blocking_keys(x, Q.CFG, (*derive.TOKENS, *derive.GRAMS)).join(df.drop("df"), blocking.KEY, "left_semi")
        assert rows(got) == rows(known.select(*got.columns)) and not got.isEmpty()


@pytest.mark.parametrize("bits", [27, 9, 6])
def test_keys_that_hit_other_bits_change_nothing(spark, folder, monkeypatch, bits):
    monkeypatch.setattr(rarekeys, "BITS", bits)
    v = Q.View(spark, folder)
    plain = blocking.rare_shared(*v.keys(*derive.TOKENS, *derive.GRAMS), Q.CFG)
    of = lambda x: rows(x.select("sid", "tid", "kind", "key", F.round("weight", 6)))
    assert of(v.rare) == of(plain) and not plain.isEmpty()


def test_counts(spark, folder):
    v = Q.View(spark, folder)
    plain = stats.document_frequency(derive.blocking_keys(v.stored, Q.CFG, (*derive.TOKENS, *derive.GRAMS)))
    assert rows(rarekeys.counted(v.stored)) == rows(plain)


def test_slices(monkeypatch):
    monkeypatch.setattr(rarekeys, "BYTES", 10)
    texts = ["", "aaaa", "bbbbbb", "c", "d" * 40, "", "ee", "ffff"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)] * 4, names=list(rarekeys.TEXT))
    got = [x["agram"].to_pylist() for x in rarekeys._slices(iter([batch, batch.slice(0, 0)]))]
    assert got == [["", "aaaa", "bbbbbb"], ["c"], ["d" * 40], ["", "ee", "ffff"]]


def test_many_countries_take_no_more_memory():
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array([f"x{k}" for k in range(n)])] * 5, names=["country", *rarekeys.TEXT])
    place, countries = rarekeys._countries(batch)
    for _, row, code, keys in rarekeys._sets(batch):
        at, of = rarekeys._different(place[row] * len(keys) + code)
        assert len(at) <= len(of) == len(row) and len(countries) == n


def test_one_row_group_is_worked_on_by_all_cores(spark, tmp_path):
    spark.createDataFrame(documents(300), COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    v = Q.View(spark, str(tmp_path))
    assert v.stored.groupBy(F.spark_partition_id()).count().count() > spark.sparkContext.defaultParallelism
    assert rows(v.stored) == rows(v.derived.select(*v.stored.columns))


def test_texts_as_they_were_are_stored_only_where_they_are_read(spark, folder):
    v = Q.View(spark, folder)
    v.top  # noqa: B018
    assert not {"business_name", "business_address"} & set(v.stored.columns)
    looked = Q.matches_lookup(Q.View(spark, folder))
    assert {"business_name", "business_address"} <= set(looked.columns) and not looked.isEmpty()
