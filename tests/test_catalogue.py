import duckdb
import pytest

import __spark_entry__ as entry
from kinloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
SOME = ["norm_text", "norm_char3grams", "df_name_grams", "top_tokens_by_country", "block_union_v2", "block_addr_gram_top3", "topk_block", "cand_stats", "recall_by_matchcount", "combined_blocker_thresholds", "rarest_describe", "strong_norm_recovery", "threshold_sweep", "posting_upper_bound", "split_stratified", "fuzzy_features13", "linear_match_v2", "match_v4_topk", "fuzzy_ceiling", "error_examples"]


def test_every_query_has_sql_or_needs_python():
    assert set(queries.VIEWS) - set(oracle.BODIES) == {"gbt_scored"}
    assert set(oracle.BODIES) <= set(queries.VIEWS) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    rows = lambda f: sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
    assert cols == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 70
