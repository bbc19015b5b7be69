"""Embedding near-duplicates by Euclidean p-stable hashing.

Unit vectors of cosine `c` are `sqrt(2 - 2c)` apart. A table's key is `k` projections
on normal directions, shifted and cut into steps of `width`; close vectors agree on a
whole key often, far ones rarely. From the number of vectors, `k` makes a vector
share its key with about `mates` orthogonal ones, and the number of tables makes a
pair at the least cosine be missed with probability `miss` at most. Vectors that
share a key are compared exactly, in double precision.

Equal vectors are one representative with a count first, so a vector that a third
of all rows share meets no other copy of itself. A bucket with more than `block`
members is cut into blocks of members, and each pair of blocks is a cell of its own,
so no task gathers a whole bucket. A cell is compared by matrix products in numpy.
No pair leaves it: a member's result is how many vectors it links with, and the
smallest member that its links in the cell lead to. So what a task returns is
linear in what it reads, however dense a group is. A pair that shares the keys of
several tables counts in the first of them: the cell computes the earlier keys of
linked members again. Projections are products of integers below 2^53, so they are
the same numbers wherever they are computed.

The number of direct links is part of the result, so different vectors of a dense
group are compared one by one, and that work grows with the square of the group.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths don't link; rows that
repeat a vec_id are one vector (of different vectors for one id, the smallest); each
row without vec_id is a row of the result that links with nothing; an empty table
gives an empty result; of other columns only the embedding is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import connected_components


@dataclass(frozen=True)
class Search:
    cosine: float = 0.95
    width: float = 2.0
    miss: float = 0.02
    mates: int = 100
    block: int = 1024
    seed: int = 5


def agreement(distance: float, width: float) -> float:
    """The probability that one projection of two points falls into the same step."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, s: Search) -> tuple[int, int]:
    """Projections a key, and tables, for `n` vectors. Far: orthogonal."""
    near, far = agreement(math.sqrt(2 - 2 * s.cosine), s.width), agreement(math.sqrt(2), s.width)
    k = max(1, math.ceil(math.log(max(n / s.mates, 1)) / -math.log(far)))
    return k, math.ceil(math.log(s.miss) / math.log(1 - near**k))


#: Unit vectors and directions as integers: parts of this.
PART = float(1 << 18)


@lru_cache(8)
def directions(dim: int, k: int, tables: int, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([s.seed, dim])
    return np.rint(rng.standard_normal((dim, k * tables)) * PART), rng.uniform(0, s.width, k * tables), rng.integers(1, 1 << 62, (tables, k), np.int64) | 1


def doubles(vectors: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The rows' vectors, scaled by powers of two so that no square overflows."""
    starts = vectors.offsets.to_numpy()[rows]
    x = vectors.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(dim)].astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def keys_of(x: np.ndarray, k: int, tables: int, s: Search) -> np.ndarray:
    """(rows, tables): the 64-bit keys of vectors as `doubles` gives them."""
    dim = x.shape[1]
    direction, shift, mix = directions(dim, k, tables, s)
    unit = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * PART)
    steps = np.floor((unit @ direction / (PART * PART) + shift) / s.width).astype(np.int64).reshape(len(x), tables, k)
    with np.errstate(over="ignore"):
        h = (steps * mix).sum(2) + np.arange(tables) * np.int64(0x632BE59BD9B4E019) + np.int64(dim)
        h ^= h >> 31
        return h * np.int64(0x9E3779B97F4A7C15 - (1 << 64))


def by_length(vectors: pa.Array, most: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of equal lengths, and their vectors."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), most):
            yield rows[at : at + most], doubles(vectors, rows[at : at + most], dim)


def keys(reps: DataFrame, k: int, tables: int, s: Search) -> DataFrame:
    """(key, rep): each representative's key in each table, as 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column(1)):
                h = keys_of(x, k, tables, s)
                reps = batch.column(0).take(pa.array(np.repeat(rows, tables)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(h.ravel()), reps], names=["table", "key", "rep"])

    return reps.select("rep", "vector").mapInArrow(run, "table int, key long, rep long")


def cells(keyed: DataFrame, s: Search) -> DataFrame:
    """(table, key, i, j, rep, own): the members of each pair of a bucket's blocks.

    A bucket's members are dealt to blocks by a hash; a small bucket is one block.
    """
    sizes = cut(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    dealt = keyed.join(sizes, ["table", "key"]).withColumn("blocks", F.ceil(F.col("n") / s.block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.select("table", "key", "rep", "own", other.alias("with")).select("table", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "own")


def linked_in(x: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine is at least the least one; across the blocks where there are two."""
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    if (own == own[0]).all():
        a, b = np.nonzero(np.triu(x @ x.T / (norm[:, None] * norm) >= cosine, 1))
        return a, b
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    a, b = np.nonzero(x[left] @ x[right].T / (norm[left][:, None] * norm[right]) >= cosine)
    return left[a], right[b]


def lowest(n: int, a: np.ndarray, b: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest rep that links lead to."""
    low = rep.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low


def compared(members: DataFrame, k: int, tables: int, s: Search) -> DataFrame:
    """(rep, others, low): links of each member within its cell.

    members: (table, key, i, j, rep, own, copies, vector), a cell's rows one after another.
    others: the vectors it links with that no earlier table's cell counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # A cell may go on in the next batch, so the last one waits.
            name = [batch.column(c).to_numpy() for c in range(4)]
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in name], axis=0)) + 1
            if rest and any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(4)):
                edge = np.concatenate(([0], edge))
            if len(edge):
                yield from solve(pa.Table.from_batches([*rest, batch.slice(0, edge[0])]))
                if len(edge) > 1:
                    yield from solve(pa.Table.from_batches([batch.slice(edge[0], edge[-1] - edge[0])]))
                rest = [batch.slice(edge[-1])]
            else:
                rest.append(batch)
        if rest:
            yield from solve(pa.Table.from_batches(rest))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole cells."""
        if t.num_rows < 2:
            return
        t = t.combine_chunks()
        name = [t.column(c).to_numpy() for c in range(4)]
        rep, own, copies = (t.column(c).to_numpy() for c in (4, 5, 6))
        vectors = t.column(7).chunk(0)
        sizes = np.diff(vectors.offsets.to_numpy())
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in name], axis=0)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, end in zip([0, *edge.tolist()], [*edge.tolist(), t.num_rows], strict=True):
            for dim in np.unique(sizes[at:end]).tolist():
                rows = at + np.flatnonzero(sizes[at:end] == dim)
                if len(rows) < 2:
                    continue
                x = doubles(vectors, rows, dim)
                a, b = linked_in(x, own[rows], s.cosine)
                if not len(a):
                    continue
                low = lowest(len(rows), a, b, rep[rows])
                if earlier := int(name[0][at]):
                    some = np.unique(np.concatenate((a, b)))
                    k_of = keys_of(x[some], k, tables, s)[:, :earlier]
                    new = first_here(k_of, np.searchsorted(some, a), np.searchsorted(some, b))
                    a, b = a[new], b[new]
                n = np.bincount(a, copies[rows][b], len(rows)) + np.bincount(b, copies[rows][a], len(rows))
                told = np.flatnonzero((n > 0) | (low != rep[rows]))
                out.append((rep[rows][told], n[told].astype(np.int64), low[told]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "others", "low"])

    return members.select("table", "key", "i", "j", "rep", "own", "copies", "vector").mapInArrow(run, "rep long, others long, low long")


def first_here(earlier: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    """Whether rows a and b agree on none of the earlier tables' keys."""
    return np.concatenate([~(earlier[a[k : k + most]] == earlier[b[k : k + most]]).any(1) for k in range(0, len(a), most)])


def usable(v) -> F.Column:
    x = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    return v.isNotNull() & F.forall(v, x) & F.exists(v, lambda e: e != 0)


def links(reps: DataFrame, s: Search) -> DataFrame:
    """(rep, others, low), for each cell in which a representative links."""
    k, tables = plan(reps.count(), s)
    members = cells(cut(keys(reps, k, tables, s)), s).join(reps.select("rep", "copies", "vector"), "rep")
    cell = ["table", "key", "i", "j"]
    return compared(members.repartition(*cell).sortWithinPartitions(*cell), k, tables, s)


def one_each(rows: DataFrame) -> DataFrame:
    """One vector an id: the smallest, where rows repeat an id. Only those rows are dealt out by id with their vectors."""
    again = cut(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least)


def dedup(vectors: DataFrame, s: Search = Search(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector"))
    rows = one_each(given.filter("vec_id IS NOT NULL"))
    # The bits of equal vectors differ only in the sign of zero.
    same = rows.filter(usable(F.col("vector"))).select("vec_id", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)).alias("vector"))
    reps = cut(same.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    found = cut(links(reps, s))
    near = found.groupBy("rep").agg(F.sum("others").alias("others"))
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    summary = reps.join(near, "rep", "left").join(component, "rep", "left").select("vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = same.join(summary, "vector").select("vec_id", "n_links", "component_id")
    full = rows.select("vec_id").join(member, "vec_id", "left").unionByName(given.filter("vec_id IS NULL").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id"))
    full = full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return full.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
