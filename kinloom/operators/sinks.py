"""Output tables, and resuming by the ids that are already written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def combined(s1: DataFrame, scored: DataFrame, threshold: float, score: str = "p") -> DataFrame:
    """One row for every source 1 record, with candidate and matching ids in rank order.

    scored: (sid, tid, rnk, <score>). Both files come from this one table, so they cannot disagree.
    """
    rows = F.sort_array(F.collect_list(F.struct("rnk", "tid", F.col(score).alias("s"))))
    ids = scored.groupBy("sid").agg(rows.alias("r"))
    out = s1.select(F.col("entity_id").alias("sid")).distinct().join(ids, "sid", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rnk:int,tid:string,s:double>>")))
    tids = lambda a: F.array_join(F.transform(a, lambda x: x["tid"]), ",")
    return out.select(F.col("sid").alias("source1_entity_id"), tids(F.col("r")).alias("candidate_entity_ids"), tids(F.filter("r", lambda x: x["s"] >= threshold)).alias("matched_entity_ids"))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def write_outputs(table: DataFrame, out: str) -> None:
    """The candidate and the match file of a combined table."""
    write_tsv(table.select("source1_entity_id", "candidate_entity_ids"), f"{out}/candidate_pairs")
    write_tsv(table.select("source1_entity_id", "matched_entity_ids"), f"{out}/matching_results")


def written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def pending(s1: DataFrame, done: DataFrame | None) -> DataFrame:
    """Source 1 records whose id isn't in the combined table yet."""
    return s1 if done is None else s1.join(done.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")


def totals(table: DataFrame) -> DataFrame:
    """Counts of a combined table."""
    n = lambda c: F.sum(F.size(F.filter(F.split(c, ","), lambda x: x != "")))
    return table.agg(F.count(F.lit(1)).alias("records"), n("candidate_entity_ids").alias("candidates"), n("matched_entity_ids").alias("matches"))
