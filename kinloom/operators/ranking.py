"""Top-K a record in a total order, and budgets derived from one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(candidates: DataFrame, k: int, *order: Column) -> DataFrame:
    """The best `k` of each sid with `rnk`: block score, then target id, both descending."""
    by = order or (F.desc("block_score"), F.desc("tid"))
    return candidates.withColumn("rnk", F.row_number().over(W.partitionBy("sid").orderBy(*by))).filter(F.col("rnk") <= k)


def by_match(scored: DataFrame, k: int) -> DataFrame:
    """Ranks by quantised match, then quantised block score, then target id."""
    return top_k(scored, k, F.desc("match_q"), F.desc("block_score"), F.desc("tid"))


def budgets(ranked: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Each candidate once for every budget that holds it."""
    return ranked.withColumn("budget", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda b: b >= F.col("rnk"))))


def packed(s1: DataFrame, ranked: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """One row for every source 1 record: its candidates' ids in rank order, comma-packed."""
    some = ranked if keep is None else ranked.filter(keep)
    ids = some.groupBy("sid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rnk", "tid"))), lambda x: x["tid"]), ",").alias(name))
    return s1.select(F.col("entity_id").alias("sid")).join(ids, "sid", "left").select(F.col("sid").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))
