"""Queries over pairs of near copies, by blocks and by groups: the results of all pairs."""

import numpy as np
import pytest

from kinloom.operators import reports
from kinloom.plans import queries as Q

from test_many_copies import COLUMNS, Counted, Plain, documents, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("blocks"))
    spark.createDataFrame(documents(300), COLUMNS).write.parquet(f"{at}/documents.parquet")
    return at


def test_common_words_of_dense_and_rare_columns():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.choice(200, rng.integers(0, 90), p=(p := 1 / np.arange(1, 201)) / p.sum())) for _ in range(n)] for n in (60, 45))
    assert (reports.common_words(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize("blocks", [None, (7, 60)])
def test_overlap_addr_forms_no_pair(spark, folder, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(reports, "BLOCK_SETS", blocks[0])
        monkeypatch.setattr(reports, "BLOCK_WORDS", blocks[1])
    got = rows(Q.VIEWS["overlap_addr"](Counted(spark, folder)))
    assert got == rows(Q.VIEWS["overlap_addr"](Plain(spark, folder))) and got[0][0] > 100
