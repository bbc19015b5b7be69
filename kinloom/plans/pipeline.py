"""Linkage runs: candidates, training, validation, inference, all from one configuration."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.config import ErConfig, parse
from kinloom.operators import blocking, evaluate, features, model, ranking, sinks
from kinloom.operators.derive import blocking_keys, derive
from kinloom.operators.reports import exploded
from kinloom.sources.records import IDS, read_records, read_truth, read_tsv, targets, unique_by_id

THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def candidates(s1: DataFrame, corpus: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, block_score, rnk) from derived records of both sides."""
    met = blocking.shared_keys(blocking_keys(s1, cfg, cfg.kinds), blocking_keys(corpus, cfg, cfg.kinds), cfg)
    scored = blocking.score(met)
    if cfg.rank_by == "match":
        matched = features.linear_match(features.with_texts(scored, s1, corpus), cfg)
        return ranking.by_match(matched.drop("s_name", "s_addr", "t_name", "t_addr"), cfg.top_k)
    return ranking.top_k(scored, cfg.top_k)


def vectors(s1: DataFrame, corpus: DataFrame, cfg: ErConfig) -> DataFrame:
    return features.features(features.with_texts(candidates(s1, corpus, cfg), s1, corpus), feature_names(cfg))


def feature_names(cfg: ErConfig) -> tuple[str, ...]:
    return features.NINE if cfg.features == 9 else features.THIRTEEN


def train(s1: DataFrame, corpus: DataFrame, pairs: DataFrame, validation: DataFrame, cfg: ErConfig, n_sample: int = 25_000, rounds: int | None = None) -> PipelineModel:
    """Trains on a fixed sample of source 1 records that aren't validation records."""
    rest = s1.join(validation.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_anti")
    return model.trained(model.labelled(vectors(model.sample(rest, n_sample), corpus, cfg), pairs), feature_names(cfg), rounds)


def validate(s1: DataFrame, corpus: DataFrame, pairs: DataFrame, fitted: PipelineModel, cfg: ErConfig, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Macro F0.5 and counts for each threshold, of one scoring."""
    return evaluate.sweep(s1, pairs, model.predicted(fitted, vectors(s1, corpus, cfg)), "p", thresholds)


def infer(s1: DataFrame, corpus: DataFrame, fitted: PipelineModel, cfg: ErConfig) -> DataFrame:
    """The combined output table: candidates and matches of every source 1 record."""
    return sinks.combined(s1, model.predicted(fitted, vectors(s1, corpus, cfg)), cfg.threshold)


def linear(s1: DataFrame, corpus: DataFrame, cfg: ErConfig) -> DataFrame:
    """The combined output table of the weighted linear score."""
    scored = features.linear_match(features.with_texts(candidates(s1, corpus, cfg).select("sid", "tid", "block_score", "rnk"), s1, corpus), cfg)
    return sinks.combined(s1, scored, cfg.linear_threshold, "match")


def resumed(spark: SparkSession, s1: DataFrame, corpus: DataFrame, path: str, cfg: ErConfig, fitted: PipelineModel | None = None) -> DataFrame:
    """Adds what is missing to the combined table at `path`, and returns all of it.

    A batch is one atomic append, so a lost run leaves whole batches or none.
    """
    left = sinks.pending(s1, sinks.written(spark, path))
    (infer(left, corpus, fitted, cfg) if fitted else linear(left, corpus, cfg)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored(derived: DataFrame, path: str) -> DataFrame:
    """Writes derived records, so that each pass over them reads columns and no text is normalised twice."""
    derived.write.mode("overwrite").parquet(path)
    return derived.sparkSession.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    args, cfg = parse(argv)
    spark = SparkSession.builder.appName("kinloom").getOrCreate()
    s1 = stored(derive(unique_by_id(read_records(spark, args.source1, args.limit_s1)), cfg), f"{args.out}/_derived/source1")
    corpus = stored(derive(unique_by_id(targets(*[read_records(spark, t, args.limit_target_rows) for t in args.targets])), cfg), f"{args.out}/_derived/targets")
    if args.mode in ("train", "validate"):
        pairs, ids = exploded(read_truth(spark, args.truth)), read_tsv(spark, args.validation_ids, IDS)
        if args.mode == "train":
            model.save(train(s1, corpus, pairs, ids, cfg), args.model)
            return
        own = s1.join(ids.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi")
        kept = pairs.join(ids.withColumnRenamed("source1_entity_id", "sid"), "sid", "left_semi")
        sinks.write_tsv(validate(own, corpus, kept, model.load(args.model), cfg), args.out)
        return
    fitted = model.load(args.model) if args.mode == "infer" else None
    sinks.write_outputs(resumed(spark, s1, corpus, f"{args.out}/combined", cfg, fitted), args.out)


if __name__ == "__main__":
    main()
