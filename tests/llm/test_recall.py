"""Links found of planted pairs, by cosine; counts of links in dense groups; rows without id."""

import numpy as np
import pyarrow as pa
import pytest

from kinloom.llm import embedding_dedup
from kinloom.llm.embedding_dedup import Search

DIM = 64


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def frame(spark, x):
    flat = pa.array(x.astype(np.float32).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32)), flat)
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": vectors})).repartition(8)


def test_recall_by_cosine(spark):
    rng, pairs = np.random.default_rng(8), 1500
    base = unit(rng.normal(size=(50_000, DIM)))
    near, bands = [], ((0.9501, 0.96), (0.96, 0.98), (0.98, 0.9999))
    for k, (low, high) in enumerate(bands):
        u = base[k * pairs : (k + 1) * pairs]
        w = rng.normal(size=u.shape)
        w = unit(w - (w * u).sum(1, keepdims=True) * u)
        c = rng.uniform(low, high, (pairs, 1))
        near.append(c * u + np.sqrt(1 - c * c) * w)
    x = np.concatenate([base, *near]) * rng.uniform(0.5, 3, (50_000 + 3 * pairs, 1))
    got = embedding_dedup.dedup(frame(spark, x)).toPandas().set_index("vec_id").sort_index()
    assert len(got) == len(x) and got.n_links.sum() <= 2 * 3 * pairs and (got.n_links[3 * pairs : 50_000] == 0).all()
    recall = []
    for k in range(3):
        ids = np.arange(pairs) + k * pairs
        recall.append((got.component_id[ids + 50_000].to_numpy() == ids).mean())
    print("recall", dict(zip(bands, recall, strict=True)))
    assert all(r >= 0.9 for r in recall) and recall[2] >= 0.99


@pytest.mark.parametrize("block", [1024, 64])
def test_links_of_a_dense_group_count_once(spark, block):
    rng = np.random.default_rng(9)
    centre = unit(rng.normal(size=DIM))
    group = unit(centre + rng.normal(size=(600, DIM)) * 0.019)
    x = np.concatenate([group, group[:50], unit(rng.normal(size=(2000, DIM)))]).astype(np.float32)
    got = embedding_dedup.dedup(frame(spark, x), Search(block=block)).toPandas().set_index("vec_id").sort_index()
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n = near.sum(1)
    assert (got.n_links.to_numpy() <= n).all()
    assert got.n_links.sum() >= 0.95 * n.sum() > 100_000  # one cut may part many of a group's pairs at once
    assert got.component_id[:650].nunique() == 1 and not got.kept[1:650].any() and got.kept[650:].all()


def test_rows_without_id_stay(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1e300, 1e300]), (6, [1e-300, 1e-300])]
    more = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, rep long, vector string, low double")
    got = embedding_dedup.dedup(more).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True)] * 3 + [(3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False)]
