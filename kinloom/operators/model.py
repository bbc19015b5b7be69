"""Samples and splits, labels, and a gradient-boosted classifier of pairs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.shared import cut

from .features import NINE, THIRTEEN


#: Rows of a task that trains.
ROWS_A_TASK = 50_000


def order_of(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary"))


def sample(records: DataFrame, n: int, column: str = "entity_id", seed: int = 42) -> DataFrame:
    """`n` rows, the same at every run."""
    return records.orderBy(order_of(F.col(column), seed), column).limit(n)


def stratified(ids: DataFrame, share: float = 0.05, seed: int = 42) -> DataFrame:
    """`share` of each stratum (country and number of matches), halves to even.

    ids: (sid, country, n_matches). A stratum's first rows by the fixed order are
    taken. The order's 16 leading bits are counted first, so rows are taken by whole
    bins, and only the bin in which a stratum's share ends is ranked.
    """
    rows = ids.withColumn("order", order_of(F.col("sid"), seed))
    rows = rows.withColumn("bin", F.conv(F.substring("order", 1, 4), 16, 10).cast("int"))
    stratum = ["country", "n_matches"]
    whole = W.partitionBy(*stratum)
    bins = rows.groupBy(*stratum, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(*stratum, "bin", "n", before.alias("before"), F.bround(F.sum("n").over(whole) * F.lit(share), 0).alias("take")).filter("before < take")
    a, b = rows.alias("a"), bins.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*stratum, "bin")]
    near = a.join(b, same[0] & same[1] & same[2]).select("a.*", "b.n", "b.before", "b.take")
    part = near.filter(F.col("before") + F.col("n") > F.col("take"))
    place = F.row_number().over(W.partitionBy(*stratum, "bin").orderBy("order", "sid"))
    last = part.withColumn("place", place).filter(F.col("before") + F.col("place") <= F.col("take"))
    return near.filter(F.col("before") + F.col("n") <= F.col("take")).select("sid", *stratum).unionByName(last.select("sid", *stratum))


def labelled(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds label: 1 if the pair is true. True pairs that blocking missed are not added."""
    true = pairs.select("sid", "tid").distinct().withColumn("label", F.lit(1.0))
    return candidates.join(true, ["sid", "tid"], "left").fillna(0.0, ["label"])


def trained(features: DataFrame, names: tuple[str, ...] = THIRTEEN, rounds: int | None = None, seed: int = 42) -> PipelineModel:
    """Boosted trees, of depth 6 over nine features or 8 over thirteen.

    Each level of each tree is a job over all rows, so the rows are stored once, in
    partitions of `ROWS_A_TASK`, and a small table isn't dealt out in more tasks than it needs.
    """
    nine = tuple(names) == NINE
    kept = cut(features.select("label", *names))  # with the folder named, the lineage of hundreds of rounds is cut, too
    kept = kept.coalesce(max(1, -(-kept.count() // ROWS_A_TASK)))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds or (300 if nine else 400), stepSize=0.05, maxDepth=6 if nine else 8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep"), trees]).fit(kept)


def predicted(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds p, the probability of a match."""
    out = model.transform(features).withColumn("p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
