"""Weighted blocking: one join over all kinds of keys, and what is left of it.

The rarity limit is applied to the frequency table, and source 1's keys carry
their weight before the join, so frequent keys never reach it and the target side
needs no counters. Texts don't travel: candidates are ids and scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.config import ErConfig
from kinloom.shared import cut

from . import rarekeys
from .derive import CONSTANT, GRAMS, KINDS, TOKENS
from .stats import document_frequency

KEY = ["kind", "country", "key"]
#: Keys too frequent to block are broadcast if they were counted and are no more than this; else all keys are dealt out.
BROADCAST_KEYS = 200_000
#: The constant kinds, alone or together, that records are grouped by to find the best targets.
TOGETHER = (("exact",), ("core",), ("addr",), ("exact", "addr"), ("core", "addr"))


def eligible(df: DataFrame, cfg: ErConfig) -> DataFrame:
    """Frequencies within the limit of their kind."""
    return df.filter((F.col("kind").isin(*TOKENS) & (F.col("df") <= cfg.token_max_df)) | (F.col("kind").isin(*GRAMS) & (F.col("df") <= cfg.gram_max_df)))


def beyond(df: DataFrame, cfg: ErConfig) -> DataFrame:
    """Frequencies beyond the limit of their kind."""
    return df.filter((F.col("kind").isin(*TOKENS) & (F.col("df") > cfg.token_max_df)) | (F.col("kind").isin(*GRAMS) & (F.col("df") > cfg.gram_max_df)))


def rarest(weighted: DataFrame, k: int) -> DataFrame:
    """Of each record and kind of gram, the `k` rarest by (frequency, gram)."""
    w = W.partitionBy("entity_id", "kind").orderBy("df", "key")
    return weighted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def weighted_keys(s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig) -> DataFrame:
    """Source 1's keys that block, with their weight."""
    w = cfg.weights
    scale = F.when(F.col("kind") == "ntok", w.ntok).when(F.col("kind") == "atok", w.atok).when(F.col("kind") == "ngram", w.ngram).otherwise(w.agram)
    constant = F.when(F.col("kind") == "exact", w.exact).when(F.col("kind") == "core", w.core).otherwise(w.addr)
    df = eligible(document_frequency(target_keys.filter(F.col("kind").isin(*TOKENS, *GRAMS))), cfg)
    # One left join and one window serve all kinds, so source 1 is read once and the targets are counted once.
    known = s1_keys.join(df, KEY, "left").filter(F.col("kind").isin(*CONSTANT) | F.col("df").isNotNull())
    place = F.row_number().over(W.partitionBy("entity_id", "kind").orderBy("df", "key"))
    chosen = known.withColumn("place", place).filter(~F.col("kind").isin(*GRAMS) | (F.col("place") <= cfg.grams_per_record))
    return chosen.withColumn("weight", F.when(F.col("kind").isin(*CONSTANT), constant).otherwise(scale / (F.lit(1.0) + F.sqrt("df")))).drop("df", "place")


def shared_keys(s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, kind, key, weight): every key on which two records meet."""
    s = weighted_keys(s1_keys, target_keys, cfg).withColumnRenamed("entity_id", "sid")
    return s.join(target_keys.withColumnRenamed("entity_id", "tid"), KEY).select("sid", "tid", "kind", "key", "weight")


def without_often(keys: list[DataFrame], often: DataFrame) -> list[DataFrame]:
    """Rows of `keys` but those of the keys in `often`, if these are few enough to be broadcast; else all rows.

    Keys beyond the limits are few and stand in most rows, so these go before any are dealt out.
    """
    often = cut(often.select(*KEY))
    return [x.join(F.broadcast(often), KEY, "left_anti") for x in keys] if often.count() <= BROADCAST_KEYS else keys


def rare_shared(s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig) -> DataFrame:
    """`shared_keys` of words and grams."""
    df = cut(document_frequency(target_keys))
    return _rare_met(*without_often([s1_keys, target_keys], beyond(df, cfg)), eligible(df, cfg), cfg)


def rare_of(s1: DataFrame, targets: DataFrame, cfg: ErConfig) -> DataFrame:
    """`rare_shared` of the words and grams of derived records, whose frequent keys are never rows."""
    df = cut(eligible(rarekeys.counted(targets), cfg))
    table = rarekeys.bits(df)
    return _rare_met(*[rarekeys.passed(x, table) for x in (s1, targets)], df, cfg)


def _rare_met(s1_keys: DataFrame, target_keys: DataFrame, df: DataFrame, cfg: ErConfig) -> DataFrame:
    """The keys in `df` that two records share, with source 1's weight."""
    known = s1_keys.join(df, KEY)
    w = cfg.weights
    scale = F.when(F.col("kind") == "ntok", w.ntok).when(F.col("kind") == "atok", w.atok).when(F.col("kind") == "ngram", w.ngram).otherwise(w.agram)
    place = F.row_number().over(W.partitionBy("entity_id", "kind").orderBy("df", "key"))
    chosen = known.withColumn("place", place).filter(~F.col("kind").isin(*GRAMS) | (F.col("place") <= cfg.grams_per_record))
    chosen = chosen.withColumn("weight", scale / (F.lit(1.0) + F.sqrt("df"))).drop("df", "place")
    return chosen.withColumnRenamed("entity_id", "sid").join(target_keys.withColumnRenamed("entity_id", "tid"), KEY).select("sid", "tid", "kind", "key", "weight")


def rare_true(s1_keys: DataFrame, target_keys: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(sid, tid, kind, country, key, df): the keys within their kind's limit that true pairs share; true pairs have one tail, and ids are distinct.

    Both sides' keys have their record's tail and meet on it, so no true pair is formed that shares no rare key, and
    a record has at most as many pairs on a key as its limit.
    """
    df = cut(document_frequency(target_keys))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("kind"))
    s1_keys, target_keys = without_often([s1_keys, target_keys], df.filter(F.col("df") > limit))
    theirs = target_keys.join(df.filter(F.col("df") <= limit), KEY).withColumnRenamed("entity_id", "tid")
    return s1_keys.withColumnRenamed("entity_id", "sid").join(theirs, ["tail", *KEY]).select("sid", "tid", *KEY, "df")


def constants(derived: DataFrame, cfg: ErConfig, name: str) -> DataFrame:
    """(<name>, country, exact, core, addr): digests of a record's constant keys, null where they don't block."""
    of = {"exact": "old_name", "core": "core_name", "addr": "strong_address"}
    keys = [F.when((F.col(c) != "") | F.lit(kind == "exact" and cfg.allow_empty_exact_name), F.md5(F.col(c).cast("binary"))).alias(kind) for kind, c in of.items()]
    return derived.filter("country IS NOT NULL").select(F.col("entity_id").alias(name), "country", *keys)


def constant_weight(a: str, b: str, cfg: ErConfig) -> Column:
    """What the constant keys of the records `a` and `b` (structs) add to their pair's score."""
    w = {"exact": cfg.weights.exact, "core": cfg.weights.core, "addr": cfg.weights.addr}
    each = [F.when((F.col(f"{a}.country") == F.col(f"{b}.country")) & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}")), F.lit(x)).otherwise(F.lit(0.0)) for k, x in w.items()]
    return each[0] + each[1] + each[2]


def together(rows: DataFrame, name: str) -> DataFrame:
    """(<name>, country, of, key): a row for each of `TOGETHER` that the record has."""
    parts = [F.struct(F.lit(k).alias("of"), F.concat(*kinds).alias("key")) for k, kinds in enumerate(TOGETHER)]
    return rows.select(name, "country", F.explode(F.array(*parts)).alias("k")).filter("k.key IS NOT NULL").select(name, "country", "k.of", "k.key")


def best_pairs(s1: DataFrame, targets: DataFrame, rare: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, block_score): pairs that hold each source 1 record's `cfg.top_k` best by score and then target id descending.

    rare: `rare_shared` of both sides. `top_k` of these is `top_k` of every scored pair, but constant keys that n and m
    records share don't give n x m pairs: a pair that meets on no rare key scores what its constant keys add. All who
    share these keys score as much at least, so it is beyond the best if `top_k` larger target ids share them. Hence
    the largest ids of each group and all pairs of rare keys hold the best. That counts each id once; records whose
    id is repeated get all their pairs.
    """
    s, t = cut(constants(s1, cfg, "sid")), cut(constants(targets, cfg, "tid"))
    by = ["country", "of", "key"]
    again = [cut(x.groupBy(i).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(i)) for x, i in ((s, "sid"), (t, "tid"))]
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("tid")))
    each = together(t, "tid") if again[1].isEmpty() else together(t, "tid").distinct()
    largest = each.withColumn("place", place).filter(F.col("place") <= cfg.top_k).drop("place")
    pairs = together(s, "sid").join(largest, by).select("sid", "tid")
    for k, (x, i) in enumerate(((s, "sid"), (t, "tid"))):
        if not again[k].isEmpty():
            mine = [together(x.join(again[k], i, "left_semi"), i), together((t, s)[k], ("tid", "sid")[k])]
            pairs = pairs.unionByName(mine[0].join(mine[1], by).select("sid", "tid"))
    every = rare.select("sid", "tid", "weight").unionByName(pairs.distinct().withColumn("weight", F.lit(0.0)))
    sums = every.groupBy("sid", "tid").agg(F.sum("weight").alias("weight"))
    rows = lambda x, i, name: x.select(i, F.struct("country", "exact", "core", "addr").alias(name))
    both = sums.join(rows(s, "sid", "a"), "sid").join(rows(t, "tid", "b"), "tid").withColumn("constant", constant_weight("a", "b", cfg))
    if again[0].isEmpty() and again[1].isEmpty():
        return both.select("sid", "tid", F.round(F.col("weight") + F.col("constant"), 6).alias("block_score"))
    return both.groupBy("sid", "tid").agg(F.round(F.max("weight") + F.sum("constant"), 6).alias("block_score"))


def summed(pairs: DataFrame, s: DataFrame, t: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, constant, block_score) of `pairs` (sid, tid, weight), a row or more each; s, t: `constants` of both sides, whose ids are distinct."""
    rows = lambda x, i, name: x.select(i, F.struct("country", "exact", "core", "addr").alias(name))
    both = pairs.groupBy("sid", "tid").agg(F.sum("weight").alias("weight")).join(rows(s, "sid", "a"), "sid").join(rows(t, "tid", "b"), "tid")
    both = both.withColumn("constant", constant_weight("a", "b", cfg))
    return both.select("sid", "tid", "constant", F.round(F.col("weight") + F.col("constant"), 6).alias("block_score"))


def score(met: DataFrame) -> DataFrame:
    """(sid, tid, block_score): the sum of weights, at 6 decimals to be stable."""
    return met.groupBy("sid", "tid").agg(F.round(F.sum("weight"), 6).alias("block_score"))


def union_pairs(met: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The distinct pairs that meet on any of the kinds."""
    return met.filter(F.col("kind").isin(*kinds)).select("sid", "tid").distinct()


def posting_bound(s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig, kind: str) -> DataFrame:
    """(sid, bound): for source 1 records, the sum of their eligible keys' frequencies."""
    df = eligible(document_frequency(target_keys.filter(F.col("kind") == kind)), cfg)
    return s1_keys.join(df, KEY).groupBy(F.col("entity_id").alias("sid")).agg(F.sum("df").alias("bound"))
