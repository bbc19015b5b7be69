"""Raking against plain proportional fitting, stated shares, and the calibration."""

import numpy as np
import pytest

from kinloom.llm import source_mixing
from kinloom.llm.common import cut
from kinloom.llm.source_mixing import Mix

SCHEMA = "doc_id long, text string, lang string, source string"


def cells_of(spark, rng, n_sources, n_langs, tied):
    rows = []
    for s in range(n_sources):
        for k in range(n_langs):
            n = int(rng.integers(50, 1000)) * (200 if tied and k == s % n_langs else 1)
            rows.append((f"s{s}", f"l{k}", "prose", n))
    return cut(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")), rows


@pytest.mark.parametrize("tied, broadcast_cells", [(False, 20_000), (True, 20_000), (True, 0)])
def test_raking_against_plain_fitting(spark, tied, broadcast_cells):
    mix = Mix(broadcast_cells=broadcast_cells, rounds=400)
    cells, rows = cells_of(spark, np.random.default_rng(3), 6, 4, tied)
    n = np.array([r[3] for r in rows], float).reshape(6, 4)
    target = [n.sum(1) ** 0.7, n.sum(0) ** 0.7]
    target = [t / t.sum() * n.sum() for t in target]
    w = n.copy()
    for _ in range(5000):
        w *= (target[0] / w.sum(1))[:, None]
        w *= target[1] / w.sum(0)
    got = {(r.source, r.lang): r.weight for r in source_mixing.rake(cells, mix).collect()}
    assert np.allclose([got[r[:2]] for r in rows], (w / n).ravel(), rtol=1e-6)


def test_stated_shares_are_met(spark):
    mix = Mix(shares={"source": {"s0": 0.5, "s1": 0.2, "none": 0.1}, "lang": {"l0": 0.3}})
    cells, rows = cells_of(spark, np.random.default_rng(4), 5, 3, False)
    told = {(r.dim, r.value): r for r in source_mixing.margins(source_mixing.rake(cells, mix)).collect()}
    n = sum(r[3] for r in rows)
    assert all(r.error < 1e-9 for r in told.values())
    assert told["source", "s0"].got == pytest.approx(0.5 * n) and told["source", "s1"].got == pytest.approx(0.2 * n) and told["lang", "l0"].got == pytest.approx(0.3 * n)
    assert sum(told["source", f"s{k}"].got for k in range(5)) == pytest.approx(n)


def test_shares_of_all_values_are_scaled(spark):
    cells, rows = cells_of(spark, np.random.default_rng(5), 3, 2, False)
    told = {(r.dim, r.value): r.got for r in source_mixing.margins(source_mixing.rake(cells, Mix(shares={"source": {"s0": 2.0, "s1": 1.0, "s2": 1.0}}))).collect()}
    assert told["source", "s0"] == pytest.approx(sum(r[3] for r in rows) / 2)


def test_margins_that_contradict_are_told(spark):
    rows = [("a", "x", "prose", 10), ("b", "y", "prose", 10)]
    cells = cut(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"))
    raked = source_mixing.rake(cells, Mix(shares={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}}, rounds=10))
    assert raked.count() == 2 and source_mixing.margins(raked).agg({"error": "max"}).first()[0] > 0.1


@pytest.mark.parametrize("rate", [0.05, 0.6, 0.95, 1.0])
def test_calibration_keeps_the_rate(spark, rate):
    cells, rows = cells_of(spark, np.random.default_rng(6), 8, 4, True)
    mix = Mix(rate=rate)
    raked = source_mixing.rake(cells, mix)
    n = {r[:2]: r[3] for r in rows}
    got = source_mixing.probabilities(raked, mix).collect()
    assert sum(r.prob * n[r.source, r.lang] for r in got) == pytest.approx(rate * sum(n.values()), rel=1e-6)
    ratio = {round(r.prob / r.weight, 9) for r in got if r.prob < 1}
    assert len(ratio) <= 1 and all(0 <= r.prob <= 1 for r in got)


def test_no_tokens_at_all(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s")], SCHEMA)
    out = source_mixing.mixed(docs).collect()
    assert len(out) == 3 and all(r.n_tokens == 0 and 0 <= r.prob <= 1 for r in out)
