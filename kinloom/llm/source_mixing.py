"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking then multiplies
cell weights until the weighted tokens meet a target share for every source,
every language and every topic; a document is kept with probability
`min(1, c * weight of its cell)`, with `c` solved so that the wanted share of
all tokens is expected, by a hash of its id, so that any rerun keeps the same documents.

Targets are stated by value (`Mix.shares`), or follow from the tokens there are. A
round updates the three margins in turn, each a window sum over cells; rounds go on
until the largest relative error of a margin is below `tolerance`, at most `rounds`
of them (margins that contradict each other are never met; `margins` tells).

Only cells are joined and raked, never documents with documents. Counting has a
partial sum before its shuffle, so a source with a third of all rows is one row
a task. Cells are broadcast, and raked in one task, only when counted and found
few; else joins and windows are shuffled ones. DataFrame functions only.

Defined results: a null source or language is a cell value of its own, shown as
''; a null or empty text has no tokens, and is still kept by its cell's
probability; repeated rows with one id share one fate, as do rows without id with
one text; an empty table gives an empty result; of the input's other columns those
with an output's name go.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut, table, unit_hash

DIMS = ("source", "lang", "topic")

# The first pattern found names the topic.
TOPICS = (("shout", "!!"), ("markup", r"[#*$%&|]{3}"), ("legal", "[Ll]icen[cs]e"), ("records", "[0-9]{4}"))


@dataclass(frozen=True)
class Mix:
    """Targets of the margins.

    shares: for a dimension, the share of all tokens that a value is to have. What
    the stated values leave goes to the dimension's other values in proportion to
    their tokens to the power `source`, `lang` or `topic`: 1 leaves them as they
    are, 0 makes them equal. Shares of values that don't occur go to the others;
    stated shares are scaled if they exceed 1, or are all there is.
    rate: the share of tokens to keep. topics: names and patterns, the first found counts.
    """

    source: float = 0.7
    lang: float = 0.7
    topic: float = 0.9
    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    rate: float = 0.6
    tolerance: float = 1e-10
    rounds: int = 100
    #: Rounds between two looks at the error.
    at_once: int = 5
    seed: int = 7
    topics: tuple[tuple[str, str], ...] = TOPICS
    broadcast_cells: int = 20_000


MIX = Mix()


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def with_keys(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Adds the cell's keys `__source`, `__lang`, `__topic` and `__tokens`."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""))
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in {"__source", "__lang", "__topic", "__tokens"}],
        F.coalesce(F.col("source"), F.lit("")).alias("__source"), F.coalesce(F.col("lang"), F.lit("")).alias("__lang"),
        topic_of(t, mix.topics).alias("__topic"), words.cast("bigint").alias("__tokens"),
    )


def targets(cells: DataFrame, dim: str, mix: Mix = MIX) -> DataFrame:
    """(dim, target): the weighted tokens that each value is to have."""
    stated = dict(mix.shares.get(dim, {}))
    m = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n"))
    share = F.lit(None).cast("double")
    for value, x in stated.items():
        share = F.when(F.col(dim) == value, F.lit(float(x))).otherwise(share)
    m = m.withColumn("share", F.when(F.col("n") > 0, share))
    m = m.withColumn("free", F.when((F.col("n") > 0) & F.col("share").isNull(), F.pow("n", F.lit(getattr(mix, dim)))).otherwise(0.0))
    # One row: sums over the values.
    told = m.agg(F.sum("n").alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"), F.sum("free").alias("free")).first()
    n, scale = told["n"] or 0.0, 1.0 if told["share"] < 1 and told["free"] else 1 / (told["share"] or 1.0)
    each = max(0.0, 1 - told["share"] * scale) / told["free"] if told["free"] else 0.0
    return m.select(dim, (F.coalesce(F.col("share") * F.lit(scale), F.col("free") * F.lit(each)) * F.lit(n)).alias(f"target_{dim}"))


def now(dim: str) -> Column:
    return F.sum(F.col("tokens") * F.col("weight")).over(W.partitionBy(dim))


def rake(cells: DataFrame, mix: Mix = MIX) -> DataFrame:
    """`cells` (the three keys and `tokens`) with `weight` and the targets.

    The targets are made from the unraked margins. Every `at_once` rounds are one
    table in the shared folder.
    """
    if cells.count() <= mix.broadcast_cells:
        cells = cells.coalesce(1)  # windows over one partition need no exchange
    out = cells.withColumn("weight", F.lit(1.0))
    for d in DIMS:
        out = out.join(F.broadcast(m) if (m := cut(targets(cells, d, mix))).count() <= mix.broadcast_cells else m, d)
    out = cut(out)
    for _ in range(0, mix.rounds, mix.at_once):
        for d in DIMS * mix.at_once:
            out = out.withColumn("now", now(d)).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"target_{d}") / F.col("now")).otherwise(F.col("weight"))).drop("now")
        out = cut(out)
        if (margins(out).agg(F.max("error")).first()[0] or 0.0) <= mix.tolerance:
            break
    return out


def margins(raked: DataFrame) -> DataFrame:
    """(dim, value, target, got, error) of raked cells; error is relative to the target."""
    parts = [raked.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), F.sum(F.col("tokens") * F.col("weight")).alias("got")) for d in DIMS]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("error", F.when(F.col("target") > 0, F.abs(F.col("got") / F.col("target") - 1)).otherwise(F.col("got")))


def probabilities(raked: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The three keys, weight and `prob`, with which `rate` of all tokens is expected.

    In the order of falling weights, the cells before some place have probability 1;
    with c solved for each place, the first place whose own probability is no more
    than 1 is the right one.
    """
    # Cells of equal weight are one row, so the order is strict.
    by_weight = raked.groupBy("weight").agg(F.sum("tokens").cast("double").alias("n"))
    order = W.orderBy(F.desc("weight"))
    sums = by_weight.select("weight", "n", F.sum("n").over(order).alias("upto"), F.sum(F.col("n") * F.col("weight")).over(order).alias("mass"))
    whole = raked.agg(F.sum("tokens").cast("double").alias("n"), F.sum(F.col("tokens") * F.col("weight")).alias("mass")).first()
    n, mass = F.lit(float(whole["n"] or 0)), F.lit(float(whole["mass"] or 0))
    rest = mass - F.col("mass") + F.col("n") * F.col("weight")
    solved = sums.select("weight", ((n * mix.rate - F.col("upto") + F.col("n")) / F.nullif(rest, F.lit(0.0))).alias("c"))
    c = solved.filter((F.col("c") * F.col("weight") <= 1) & (F.col("weight") > 0)).agg(F.max_by("c", "weight")).first()[0]
    prob = F.lit(1.0) if c is None else F.least(F.lit(1.0), F.lit(c) * F.col("weight"))
    return raked.select(*DIMS, "weight", F.when(F.col("weight") > 0, prob).otherwise(0.0).alias("prob"))


def mixed(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Every document with `topic`, `n_tokens`, `weight`, `prob` and `kept`."""
    keyed = with_keys(docs, mix)
    counted = keyed.groupBy(*[f"__{d}" for d in DIMS]).agg(F.sum("__tokens").alias("tokens"))
    cells = probabilities(rake(cut(counted.select(*[F.col(f"__{d}").alias(d) for d in DIMS], "tokens")), mix), mix)
    cells = cut(cells.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("weight").alias("__w"), F.col("prob").alias("__p")))
    if cells.count() <= mix.broadcast_cells:
        cells = F.broadcast(cells)
    out = {"topic", "n_tokens", "weight", "prob", "kept"}
    key = F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.col("doc_id").cast("string"))
    return keyed.join(cells, [f"__{d}" for d in DIMS]).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in out],
        F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__w").alias("weight"), F.col("__p").alias("prob"),
        (unit_hash(key, seed=mix.seed) < F.col("__p")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "n_tokens",
        F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), "kept",
    )


def _sql(mix: Mix = MIX) -> str:
    """The same for targets without stated shares."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in mix.topics) + " ELSE 'prose' END"
    parts = [
        f"""d AS MATERIALIZED (SELECT *, {topic} AS topic, len(list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens
            FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents))""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for k in DIMS:
        parts += [
            f"m_{k} AS MATERIALIZED (SELECT {k}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {getattr(mix, k)}::DOUBLE) ELSE 0 END AS t, sum(tokens) AS n FROM c0 GROUP BY {k})",
            f"t_{k} AS MATERIALIZED (SELECT {k}, t * (SELECT sum(n) / sum(t) FROM m_{k}) AS target_{k} FROM m_{k})",
        ]
    step = "r"
    for k in DIMS:
        before = f"(SELECT * FROM r WHERE i < {mix.rounds})" if step == "r" else f"({step})"
        step = f"SELECT * REPLACE (CASE WHEN now > 0 THEN weight * target_{k} / now ELSE weight END AS weight) FROM (SELECT * EXCLUDE (now), sum(tokens * weight) OVER (PARTITION BY {k}) AS now FROM {before})"
    parts += [
        f"""r AS (SELECT 0 AS i, source, lang, topic, tokens, 1.0::DOUBLE AS weight, 0.0::DOUBLE AS now, target_source, target_lang, target_topic FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
            UNION ALL SELECT i + 1, source, lang, topic, tokens, weight, now, target_source, target_lang, target_topic FROM ({step}))""",
        f"c AS MATERIALIZED (SELECT source, lang, topic, tokens, weight FROM r WHERE i = {mix.rounds})",
        "w AS MATERIALIZED (SELECT weight, sum(tokens) AS n FROM c GROUP BY weight)",
        f"""s AS MATERIALIZED (SELECT weight, ({mix.rate}::DOUBLE * sum(n) OVER () - sum(n) OVER (ORDER BY weight DESC) + n) / nullif(sum(n * weight) OVER () - sum(n * weight) OVER (ORDER BY weight DESC) + n * weight, 0) AS c FROM w)""",
        "p AS MATERIALIZED (SELECT *, CASE WHEN weight > 0 THEN least(1.0::DOUBLE, coalesce((SELECT max_by(c, weight) FROM s WHERE c * weight <= 1 AND weight > 0) * weight, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END AS prob FROM c)",
    ]
    u = f"('0x' || substr(md5('{mix.seed}|' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / {float(1 << 32)}::DOUBLE"
    return f"""WITH RECURSIVE {", ".join(parts)}
    SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(prob, 6) AS prob, ({u} < prob) AS kept FROM d JOIN p USING (source, lang, topic)"""


ORACLE = _sql()
