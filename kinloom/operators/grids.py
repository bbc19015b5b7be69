"""All pairs of groups of equal constant keys, block by block: scored as grids of different texts, and only what is asked for becomes rows.

Ids must be distinct and not null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import ErConfig
from kinloom.functions.grid import token_set_grid
from kinloom.shared import cut

from . import blocking

#: Records of either side in a block: two blocks meet at once.
BLOCK = 1024
#: Tasks that blocks are dealt to at least. Blocks are small and their pairs many, so they aren't put together by their size.
TASKS = 400
MATCHED = "sid string, tid string, name_score double, address_score double, match double"
BEST = "sid string, tid string, match_q int, constant double"


def named(derived: DataFrame, cfg: ErConfig) -> DataFrame:
    """(id, country, exact, core, addr, name, address) of records with a country; constant keys are null where they don't block."""
    of = {"exact": "old_name", "core": "core_name", "addr": "strong_address"}
    keys = [F.when((F.col(c) != "") | F.lit(kind == "exact" and cfg.allow_empty_exact_name), F.col(c)).alias(kind) for kind, c in of.items()]
    return derived.filter("country IS NOT NULL").select(F.col("entity_id").alias("id"), "country", *keys, F.col("old_name").alias("name"), F.col("old_address").alias("address"))


def sides(s: DataFrame, t: DataFrame, group: Column) -> tuple[DataFrame, DataFrame]:
    """Each side's rows with `group`, `a` and `b`: a row for each block of the other side that its block meets."""
    s, t = (x.withColumn("group", group).filter("group IS NOT NULL") for x in (s, t))
    many = [x.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)) for x, n in ((s, "n_a"), (t, "n_b"))]
    both = many[0].join(many[1], "group")

    def to(x: DataFrame, mine: str, theirs: str) -> DataFrame:
        own = x.join(both, "group").withColumn(mine, F.pmod(F.xxhash64("id"), F.col(f"n_{mine}")).cast("int"))
        return own.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"n_{theirs}") - 1))).drop("n_a", "n_b")

    return to(s, "a", "b"), to(t, "b", "a")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "group", "a", "b")


def blocks(s: DataFrame, t: DataFrame, group: Column) -> DataFrame:
    """Both sides' rows, dealt out by the two blocks that meet; `mine` are those of s."""
    x, y = sides(s, t, group)
    return dealt(x.withColumn("mine", F.lit(True)).unionByName(y.withColumn("mine", F.lit(False)))).groupBy("group", "a", "b")


def every_pair(s: DataFrame, t: DataFrame, rare: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, block_score): every pair that shares a constant key or is in `rare` (`blocking.rare_shared`); s, t: `blocking.constants` with `id`.

    A pair of a constant key goes straight from the join to the result: its score is one of eight numbers, and it is formed
    in its names' group or else in its addresses'. Pairs of rare keys, too few to matter, are summed up and left out there.
    """
    own = lambda x: x.withColumn("named", F.coalesce(F.concat(F.lit("c"), "core"), F.concat(F.lit("e"), "exact")))
    s, t = cut(own(s)), cut(own(t))
    summed = cut(blocking.summed(rare, s.withColumnRenamed("id", "sid"), t.withColumnRenamed("id", "tid"), cfg))
    less = summed.filter("constant > 0").groupBy(F.col("sid").alias("id")).agg(F.collect_list("tid").alias("less"))
    s = s.join(less, "id", "left")
    w = cfg.weights
    scores = F.array(*[F.round(F.lit(w.exact * e) + F.lit(w.core * c) + F.lit(w.addr * a), 6) for e in (0, 1) for c in (0, 1) for a in (0, 1)])
    same = lambda k: F.coalesce(F.col(f"x.{k}") == F.col(f"y.{k}"), F.lit(False))
    place = sum((F.when(same(k), n).otherwise(0) for k, n in (("exact", 4), ("core", 2))), F.when(same("addr"), 1).otherwise(0))
    out = [summed.select("sid", "tid", "block_score")]
    for key, once in (("named", F.lit(True)), ("addr", ~same("named"))):
        x, y = (dealt(side) for side in sides(s, t, F.when(F.col(key).isNotNull(), F.struct("country", key))))
        met = x.alias("x").join(y.alias("y"), ["group", "a", "b"])
        met = met.filter(once & (F.col("less").isNull() | ~F.array_contains("less", F.col("y.id"))))
        out.append(met.select(F.col("x.id").alias("sid"), F.col("y.id").alias("tid"), F.get(scores, place).alias("block_score")))
    return reduce(DataFrame.unionByName, out)


def _texts(column: pa.ChunkedArray, side: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different texts of one side, and each row's place among them."""
    of = column.combine_chunks().take(pa.array(side)).dictionary_encode()
    return of.dictionary.to_pylist(), of.indices.to_numpy()


def _score(block: pa.Table, column: str, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The token-set score (0 to 1) of all pairs, rounded to a float as one column of scores is."""
    (a, i), (b, j) = (_texts(block[column], side) for side in (s, t))
    return (token_set_grid(a, b).astype(np.float32).astype(np.float64) / 100)[np.ix_(i, j)]


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    mine = block["mine"].to_numpy().astype(bool)
    return np.flatnonzero(mine), np.flatnonzero(~mine)


def matched(s: DataFrame, t: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, name_score, address_score, match): pairs of equal exact names that reach `cfg.linear_threshold`."""
    name_weight, address_weight, least = cfg.name_weight, cfg.address_weight, cfg.linear_threshold

    def run(block: pa.Table) -> pa.Table:
        x, y = _sides(block)
        n, a = (_score(block, c, x, y) for c in ("name", "address"))
        match = n * name_weight + a * address_weight
        i, j = np.nonzero(match >= least)
        ids = block["id"].combine_chunks()
        return pa.table({"sid": ids.take(pa.array(x[i])), "tid": ids.take(pa.array(y[j])), "name_score": n[i, j], "address_score": a[i, j], "match": match[i, j]})

    keep = lambda x: x.select("id", "country", "exact", "name", "address")
    group = F.when(F.col("exact").isNotNull(), F.struct("country", "exact"))
    return blocks(keep(s), keep(t), group).applyInArrow(run, MATCHED)


def best_matches(s: DataFrame, t: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, match_q, constant): of pairs that share a constant key, at least each sid's best `cfg.top_k` by match, what constant keys add, and target id.

    A block gives its own best. Pairs of equal exact or core names are in one group: its core name, or the name where that is empty.
    """
    w = {"exact": cfg.weights.exact, "core": cfg.weights.core, "addr": cfg.weights.addr}
    name_weight, address_weight, top = cfg.name_weight, cfg.address_weight, cfg.top_k

    def run(block: pa.Table) -> pa.Table:
        x, y = _sides(block)
        match = _score(block, "name", x, y) * name_weight + _score(block, "address", x, y) * address_weight
        q = np.clip(np.rint(match * 1000), 0, 1000).astype(np.int64)
        constant = np.zeros(q.shape)
        for kind, weight in w.items():
            codes = block[kind].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            constant += weight * ((codes[x][:, None] == codes[y][None, :]) & (codes[x] >= 0)[:, None])
        ids = block["id"].combine_chunks()
        order = np.empty(len(y), np.int64)
        order[np.argsort(np.array([i.encode() for i in ids.take(pa.array(y)).to_pylist()], object))] = np.arange(len(y))
        levels, level = np.unique(constant, return_inverse=True)
        place = (q * len(levels) + level.reshape(q.shape)) * len(y) + order
        best = np.argpartition(place, -top, axis=1)[:, -top:] if top < len(y) else np.broadcast_to(np.arange(len(y)), q.shape)
        i, j = np.repeat(np.arange(len(x)), best.shape[1]), best.ravel()
        return pa.table({"sid": ids.take(pa.array(x[i])), "tid": ids.take(pa.array(y[j])), "match_q": q[i, j].astype(np.int32), "constant": constant[i, j]})

    groups = (F.struct("country", F.coalesce("core", "exact").alias("key"), F.col("core").isNull().alias("of")), F.coalesce("core", "exact")), (F.struct("country", F.col("addr").alias("key")), F.col("addr"))
    found = [blocks(s, t, F.when(some.isNotNull(), group)).applyInArrow(run, BEST) for group, some in groups]
    return reduce(DataFrame.unionByName, found)
