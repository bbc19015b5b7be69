"""Document frequencies of keys, and profiles of record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def document_frequency(keys: DataFrame, by_country: bool = True) -> DataFrame:
    """How many records have each key, a country or over all."""
    by = ["kind", "country", "key"] if by_country else ["kind", "key"]
    return keys.groupBy(*by).agg(F.count(F.lit(1)).alias("df"))


def restricted(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """The keys that `wanted` has, too: fewer rows to count, and the same counts of those."""
    return keys.join(wanted.select("kind", "country", "key").distinct(), ["kind", "country", "key"], "left_semi")


def most_frequent(df: DataFrame, n: int = 30, by_country: bool = True) -> DataFrame:
    """The `n` most frequent keys, ties by key."""
    if not by_country:
        return df.orderBy(F.desc("df"), "key").limit(n)
    w = W.partitionBy("country").orderBy(F.desc("df"), "key")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def distinct_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys"))


def profile(records: DataFrame) -> DataFrame:
    """One row a column: rows, nulls and distinct values (without null)."""
    columns = ["entity_id", "business_name", "business_address", "country"]
    one = records.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns], *[F.countDistinct(c).alias(f"{c}_distinct") for c in columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"{c}_nulls").alias("n_null"), F.col(f"{c}_distinct").alias("n_distinct")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(records: DataFrame, column: str) -> DataFrame:
    """How often each value stands, null included."""
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(records: DataFrame, column: str = "entity_id") -> DataFrame:
    """(n_ids, n_rows_of_repeated, surplus): all copies of repeated ids, and those beyond the first."""
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("n_ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows_of_repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")
    )


def row_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n_rows"))
