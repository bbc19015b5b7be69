"""Diagnostics of blocking and text signals on true pairs, each one DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinloom.config import ErConfig
from kinloom.functions import text as X
from kinloom.shared import cut

from .blocking import KEY, eligible, rarest
from .stats import document_frequency


def n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def pair_texts(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs with both sides' country and derived texts, missing sides null."""
    side = lambda df, p, i: df.select(F.col("entity_id").alias(i), *[F.col(c).alias(f"{p}_{c}") for c in ("country", "old_name", "old_address", "core_name", "strong_address")])
    return pairs.select("sid", "tid").join(side(s1, "s", "sid"), "sid", "left").join(side(targets, "t", "tid"), "tid", "left")


def overlap(texts: DataFrame, column: str) -> DataFrame:
    """How many pairs share words of `column`, and at which Jaccard similarity."""
    a, b = X.tokens(F.col(f"s_{column}")), X.tokens(F.col(f"t_{column}"))
    t = texts.select(X.shared(a, b).alias("s"), X.jaccard(a, b).alias("j"))
    return t.agg(
        F.count(F.lit(1)).alias("n_pairs"), n(F.col("s") >= 1).alias("shared_1"), n(F.col("s") >= 2).alias("shared_2"),
        *[n(F.col("j") >= x / 100).alias(f"jaccard_{x}") for x in (25, 50, 75)], F.round(F.avg("j"), 6).alias("avg_jaccard"),
    )


#: Word sets and words in a block: two blocks are compared at once.
BLOCK_SETS, BLOCK_WORDS = 1024, 500_000
#: Words in at least so many sets of a block are columns of a matrix product; rarer ones are added pair by pair.
DENSE = 16
COUNTED = "n_pairs long, shared_1 long, shared_2 long, jaccard_25 long, jaccard_50 long, jaccard_75 long, sum_jaccard double"


def word_blocks(records: DataFrame, column: str, side: str) -> DataFrame:
    """(tail, words, n, block, blocks): the different word sets of each tail (64-bit hashes), how many records have each, and its block."""
    sets = records.filter("tail IS NOT NULL").select("tail", F.array_sort(F.transform(X.tokens(F.col(column)), lambda w: F.xxhash64(w))).alias("words"))
    each = sets.groupBy("tail", "words").agg(F.count(F.lit(1)).alias("n"))
    size = each.groupBy("tail").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.size("words")) / BLOCK_WORDS), F.lit(1)).cast("int").alias(f"blocks_{side}"))
    return each.join(size, "tail").withColumn("block", F.pmod(F.xxhash64("words"), F.col(f"blocks_{side}")).cast("int"))


def common_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many words each set of `a` shares with each of `b`: a product of matrices over words that are in many sets, pairs of sets over others."""
    of = lambda sets: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.zeros(0, np.int64))
    (ra, wa), (rb, wb) = of(a), of(b)
    known, ids = np.unique(np.concatenate([wa, wb]), return_inverse=True)
    ia, ib = ids[: len(wa)], ids[len(wa) :]
    na, nb = np.bincount(ia, minlength=len(known)), np.bincount(ib, minlength=len(known))
    out, often = np.zeros((len(a), len(b)), np.float32), np.flatnonzero((na >= DENSE) & (nb >= DENSE))
    for at in range(0, len(often), 4096):
        place = np.full(len(known), -1)
        some = often[at : at + 4096]
        place[some] = np.arange(len(some))
        x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for m, r, i in ((x, ra, ia), (y, rb, ib)):
            got = place[i] >= 0
            m[r[got], place[i[got]]] = 1
        out += x @ y.T
    rare = (na > 0) & (nb > 0) & ~((na >= DENSE) & (nb >= DENSE))
    (ra, ia), (rb, ib) = ((r[rare[i]], i[rare[i]]) for r, i in ((ra, ia), (rb, ib)))
    ra, ia, rb, ib = ra[o := np.argsort(ia, kind="stable")], ia[o], rb[p := np.argsort(ib, kind="stable")], ib[p]
    edges = lambda i: np.flatnonzero(np.diff(i, prepend=-1, append=len(known)))
    ea, eb = edges(ia), edges(ib)
    for k in range(len(ea) - 1):  # both sides hold the same rare words in the same order
        out[np.ix_(ra[ea[k] : ea[k + 1]], rb[eb[k] : eb[k + 1]])] += 1
    return out


def counted_overlap(s1: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """`overlap` of the pairs of equal tails: different word sets are compared block by block, and no pair is a row. Ids must be distinct."""
    s, t = word_blocks(s1, column, "a"), word_blocks(targets, column, "b")
    kind = pa.schema([(c.split(" ")[0], pa.float64() if c.endswith("double") else pa.int64()) for c in COUNTED.split(", ")])
    both = cut(s.select("tail", "blocks_a").distinct().join(t.select("tail", "blocks_b").distinct(), "tail"))
    to = lambda x, mine, theirs: x.select("tail", F.col("block").alias(mine), "words", "n").join(both, "tail").withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"blocks_{theirs}") - 1)))
    rows = to(s, "a", "b").select("tail", "a", "b", F.lit(True).alias("mine"), "words", "n").unionByName(to(t, "b", "a").select("tail", "a", "b", F.lit(False).alias("mine"), "words", "n"))

    def run(block: pa.Table) -> pa.Table:
        mine, n, told = block["mine"].to_numpy().astype(bool), block["n"].to_numpy(), block["words"].combine_chunks()
        if mine.all() or not mine.any():
            return kind.empty_table()
        words = np.split(told.flatten().to_numpy(), np.cumsum(told.value_lengths().to_numpy())[:-1])
        a, b = ([words[k] for k in np.flatnonzero(side)] for side in (mine, ~mine))
        pairs, shared = np.outer(n[mine], n[~mine]), common_words(a, b)
        union = np.add.outer([len(x) for x in a], [len(x) for x in b]) - shared.astype(np.float64)
        j = np.divide(shared, union, out=np.zeros(union.shape), where=union > 0)
        of = lambda x: int(pairs[x].sum())
        row = [int(pairs.sum()), of(shared >= 1), of(shared >= 2), *(of(j >= x / 100) for x in (25, 50, 75)), float((j * pairs).sum())]
        return pa.Table.from_pylist([dict(zip(kind.names, row, strict=True))], kind)

    sums = rows.groupBy("tail", "a", "b").applyInArrow(run, COUNTED)
    names = ("shared_1", "shared_2", "jaccard_25", "jaccard_50", "jaccard_75")
    return sums.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), *[F.sum(c).alias(c) for c in names], F.round(F.sum("sum_jaccard") / F.sum("n_pairs"), 6).alias("avg_jaccard"))


def categories(texts: DataFrame) -> DataFrame:
    """Pairs by whether country and normalised name agree, with percentages."""
    c, m = F.col("s_country") == F.col("t_country"), F.col("s_old_name") == F.col("t_old_name")
    name = F.when(c & m, "BOTH_SAME").when(c, "COUNTRY_SAME_NAME_DIFFERENT").when(m, "COUNTRY_DIFFERENT_NAME_SAME").otherwise("BOTH_DIFFER")
    by = texts.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("category", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


def address_signal(texts: DataFrame) -> DataFrame:
    """How many pairs have equal normalised addresses, of all and of those whose names differ."""
    same, differ = F.col("s_old_address") == F.col("t_old_address"), F.col("s_old_name") != F.col("t_old_name")
    return texts.agg(
        F.count(F.lit(1)).alias("n_pairs"), n(same).alias("same_address"), n(differ).alias("name_differs"), n(differ & same).alias("name_differs_same_address"),
        F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("rate"),
    )


def true_shared(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(sid, tid, kind, country, key): what true pairs share, by joins on ids only."""
    s = s1_keys.withColumnRenamed("entity_id", "sid")
    t = target_keys.withColumnRenamed("entity_id", "tid")
    return pairs.select("sid", "tid").join(s, "sid").join(t, ["tid", *KEY])


def rarest_shared(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, kind: str) -> DataFrame:
    """(sid, tid, df): the lowest frequency of a shared key; null if none is shared."""
    s, t = s1_keys.filter(F.col("kind") == kind), target_keys.filter(F.col("kind") == kind)
    low = true_shared(pairs, s, t).join(document_frequency(t), KEY).groupBy("sid", "tid").agg(F.min("df").alias("df"))
    return pairs.select("sid", "tid").join(low, ["sid", "tid"], "left")


def coverage_curve(low: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Pairs whose rarest shared key is within each threshold."""
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"c{t}").alias("recovered"), F.col("n").alias("n_pairs"), F.round(F.coalesce(F.try_divide(F.col(f"c{t}"), F.col("n")), F.lit(0.0)), 6).alias("coverage")) for t in thresholds])
    return low.agg(F.count(F.lit(1)).alias("n"), *[n(F.col("df") <= t).alias(f"c{t}") for t in thresholds]).select(F.explode(rows).alias("r")).select("r.*")


def counted_curve(found: DataFrame, n_pairs: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """`coverage_curve` of pairs of which only those with a rare key are there: (sid, tid, df), and the number of all (one row)."""
    low = found.groupBy("sid", "tid").agg(F.min("df").alias("df"))
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"c{t}").alias("recovered"), F.col("n_pairs"), F.round(F.coalesce(F.try_divide(F.col(f"c{t}"), F.col("n_pairs")), F.lit(0.0)), 6).alias("coverage")) for t in thresholds])
    hits = low.agg(*[F.count(F.when(F.col("df") <= t, 1)).alias(f"c{t}") for t in thresholds])
    # Without a pair, counts are 0 and not null, as in SQL.
    return hits.join(F.broadcast(n_pairs)).select(F.explode(rows).alias("r")).select("r.*")


def product(s1: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """n_pairs (one row): how many pairs of the sides have equal, non-null `by`; counted by group, not formed."""
    some = [x.select(*by).dropna().groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for x, n in ((s1, "a"), (targets, "b"))]
    return some[0].join(some[1], list(by)).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_pairs"))


#: What may be equal in a true pair: the full name (also an empty one), a core name, a strong address, and a full name that blocks.
FORMS = {"full": ("f",), "core": ("c",), "addr": ("a",), "fc": ("f", "c"), "fa": ("f", "a"), "ca": ("c", "a"), "fca": ("f", "c", "a"), "exact": ("e",)}


def forms(records: DataFrame, name: str) -> DataFrame:
    """(<name>, tail, country, f, c, a, e): digests of a record's forms, null where they don't count."""
    d = lambda c: F.md5(F.col(c).cast("binary"))
    some = lambda c: F.when(F.col(c) != "", d(c))
    return records.select(F.col("entity_id").alias(name), "tail", "country", d("old_name").alias("f"), some("core_name").alias("c"), some("strong_address").alias("a"), some("old_name").alias("e"))


def counted_recovery(s1: DataFrame, targets: DataFrame, rare: DataFrame) -> DataFrame:
    """`strong_recovery` of the pairs of equal tails, counted by groups of equal forms; only pairs that share a rare word are formed.

    rare: (sid, tid, ...) of those. Ids must be distinct.
    """
    s, t = cut(forms(s1, "sid")), cut(forms(targets, "tid"))
    each = lambda x, one, i: x.filter("country IS NOT NULL").select("tail", "country", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.concat(*cs).alias("key")) for k, cs in FORMS.items()])).alias("k")).filter("k.key IS NOT NULL").select("tail", "country", "k.form", "k.key").groupBy("tail", "country", "form", "key").agg(F.count(F.lit(1)).alias(one))
    by_form = each(s, "x", "sid").join(each(t, "y", "tid"), ["tail", "country", "form", "key"]).groupBy("form").agg(F.sum(F.col("x") * F.col("y")).alias("n"))
    sums = by_form.agg(*[F.coalesce(F.sum(F.when(F.col("form") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in FORMS])
    side = lambda x, i, p: x.select(i, *[F.col(c).alias(f"{p}{c}") for c in ("country", "f", "c", "a", "e")])
    met = rare.select("sid", "tid").distinct().join(side(s, "sid", "s"), "sid").join(side(t, "tid", "t"), "tid")
    same = lambda c: F.coalesce((F.col("scountry") == F.col("tcountry")) & (F.col(f"s{c}") == F.col(f"t{c}")), F.lit(False))
    rest = met.filter(~same("e"))
    more = rest.agg(F.count(F.lit(1)).alias("r"), F.count(F.when(same("f") | same("c") | same("a"), 1)).alias("rs"))
    one = product(s, t, "tail").join(F.broadcast(sums)).join(F.broadcast(more))  # one row each
    strong = F.expr("n_full + n_core + n_addr - n_fc - n_fa - n_ca + n_fca")
    return one.select("n_pairs", F.col("n_full").alias("full_name"), F.col("n_core").alias("core_name"), F.col("n_addr").alias("strong_address"), strong.alias("any_strong"), (F.col("n_exact") + F.col("r")).alias("blocked_v2"), (strong - F.col("n_exact") - F.col("rs")).alias("gained"))


def describe(low: DataFrame) -> DataFrame:
    """Count, mean, deviation and interpolated percentiles of the rarest shared frequency where there is one."""
    p = F.percentile("df", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)])).alias("p")
    one = low.agg(F.count("df").alias("n"), F.round(F.avg("df"), 6).alias("mean"), F.round(F.stddev_samp("df"), 6).alias("std"), F.min("df").alias("min"), F.max("df").alias("max"), p)
    return one.select("n", "mean", "std", "min", "max", *[F.round(F.col("p")[k], 6).alias(x) for k, x in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))])


def blocked_flags(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig) -> DataFrame:
    """(sid, tid, v2): whether exact name, a rare name word or a rare address word blocks a true pair."""
    t = target_keys.filter(F.col("kind").isin("exact", "ntok", "atok"))
    met = true_shared(pairs, s1_keys, t)
    hit = met.join(eligible(document_frequency(t.filter("kind <> 'exact'")), cfg), KEY, "left").filter("kind = 'exact' OR df IS NOT NULL")
    return pairs.select("sid", "tid").join(hit.select("sid", "tid").distinct().withColumn("v2", F.lit(True)), ["sid", "tid"], "left").fillna(False, ["v2"])


def strong_recovery(texts: DataFrame, flags: DataFrame) -> DataFrame:
    """What strong forms recover of true pairs, and what that adds to the blocker."""
    same = lambda c, guard: (F.col("s_country") == F.col("t_country")) & (F.col(f"s_{c}") == F.col(f"t_{c}")) & (F.lit(not guard) | (F.col(f"s_{c}") != ""))
    t = texts.join(flags, ["sid", "tid"]).select("v2", same("old_name", False).alias("full"), same("core_name", True).alias("core"), same("strong_address", True).alias("addr"))
    strong = F.col("full") | F.col("core") | F.col("addr")
    return t.agg(F.count(F.lit(1)).alias("n_pairs"), n(F.col("full")).alias("full_name"), n(F.col("core")).alias("core_name"), n(F.col("addr")).alias("strong_address"), n(strong).alias("any_strong"), n(F.col("v2")).alias("blocked_v2"), n(strong & ~F.col("v2")).alias("gained"))


def gram_ceiling(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig) -> DataFrame:
    """Pairs that share at least 1, 2 and 3 eligible grams, of names and of addresses."""
    grams = target_keys.filter(F.col("kind").isin("ngram", "agram"))
    return shared_grams(true_shared(pairs, s1_keys, grams).join(eligible(document_frequency(grams), cfg), KEY))


def shared_grams(shared: DataFrame) -> DataFrame:
    met = shared.groupBy("sid", "tid").agg(n(F.col("kind") == "ngram").alias("a"), n(F.col("kind") == "agram").alias("b"))
    return met.agg(*[n(F.col(c) >= k).alias(f"{x}_{k}") for c, x in (("a", "name"), ("b", "address")) for k in (1, 2, 3)])


def top_gram_ceiling(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, cfg: ErConfig, most: int = 3) -> DataFrame:
    """For k = 1..most, pairs that meet on one of the record's k rarest grams of name or address."""
    grams = target_keys.filter(F.col("kind").isin("ngram", "agram"))
    weighted = s1_keys.join(eligible(document_frequency(grams), cfg), KEY)
    ranked = rarest(weighted, most).withColumn("rank", F.row_number().over(W.partitionBy("entity_id", "kind").orderBy("df", "key")))
    met = true_shared(pairs, ranked, grams).groupBy("sid", "tid").agg(F.min("rank").alias("rank"))
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"c{k}").alias("recovered")) for k in range(1, most + 1)])
    return met.agg(*[F.coalesce(n(F.col("rank") <= k), F.lit(0)).alias(f"c{k}") for k in range(1, most + 1)]).select(F.explode(rows).alias("r")).select("r.*")


def gram_ceiling_grid(pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, limits: tuple[int, ...], most: int = 3) -> DataFrame:
    """For each frequency limit and k = 1..most, pairs that meet on one of the record's k rarest grams within the limit.

    A rank by frequency doesn't depend on the limit, so one ranking serves the grid.
    """
    grams = target_keys.filter(F.col("kind").isin("ngram", "agram"))
    known = s1_keys.join(document_frequency(grams).filter(F.col("df") <= max(limits)), KEY)
    rank = F.row_number().over(W.partitionBy("entity_id", "kind").orderBy("df", "key"))
    ranked = known.withColumn("rank", rank).filter(F.col("rank") <= most)
    low = true_shared(pairs, ranked, grams).select("sid", "tid", "rank", "df").distinct()
    grid = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("max_df"), F.lit(k).cast("bigint").alias("k")) for m in limits for k in range(1, most + 1)])).alias("g")
    cells = low.select("*", grid).filter("df <= g.max_df AND rank <= g.k").select("g.max_df", "g.k", "sid", "tid")
    found = cells.groupBy("max_df", "k").agg(F.countDistinct("sid", "tid").alias("recovered"))
    # The grid itself comes from a one-row count, so that cells without a pair stay.
    every = pairs.agg(F.count(F.lit(1)).alias("n")).select(grid).select("g.*")
    return every.join(found, ["max_df", "k"], "left").fillna(0, ["recovered"])


def by_threshold(s1: DataFrame, pairs: DataFrame, met: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Candidates and recall when keys up to each threshold block.

    met: (sid, tid, df) of every shared key, 0 for one that always blocks. A pair
    counts once, by its lowest frequency.
    """
    low = met.groupBy("sid", "tid").agg(F.min("df").alias("df"))
    true = pairs.select("sid", "tid").distinct().withColumn("true", F.lit(1))
    ts = F.array(*[F.lit(t).cast("bigint") for t in thresholds])
    got = low.join(true, ["sid", "tid"], "left").select("sid", "true", F.explode(F.filter(ts, lambda t: t >= F.col("df"))).alias("threshold"))
    sums = got.groupBy("threshold").agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("sid").alias("s1_with_candidates"), F.count("true").alias("found"))
    size = s1.agg(F.count(F.lit(1)).alias("records")).join(F.broadcast(true.agg(F.count(F.lit(1)).alias("true_pairs"))))  # one row
    every = size.select("records", "true_pairs", F.explode(ts).alias("threshold"))
    out = every.join(sums, "threshold", "left").fillna(0, ["candidates", "s1_with_candidates", "found"])
    return out.select("threshold", "candidates", "s1_with_candidates", "found", F.round(F.col("candidates") / F.col("records"), 6).alias("avg_candidates"), F.round(F.coalesce(F.try_divide("found", "true_pairs"), F.lit(0.0)), 6).alias("recall"))


def counted_thresholds(s1: DataFrame, targets: DataFrame, met: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """`by_threshold` of equal names and of rare keys: equal names are counted by group, only pairs of rare keys are formed.

    met: (sid, tid, df, true) of shared rare keys. Ids must be distinct.
    """
    s, t = (cut(x.select(F.col("entity_id").alias(i), "tail", "country", F.when(F.col("old_name") != "", F.md5(F.col("old_name").cast("binary"))).alias("e"))) for x, i in ((s1, "sid"), (targets, "tid")))
    low = met.groupBy("sid", "tid").agg(F.min("df").alias("df"), F.max("true").alias("true"))
    named = t.select("country", "e").dropna().distinct().withColumn("named", F.lit(True))
    mine = cut(s.join(named, ["country", "e"], "left").select("sid", F.col("country").alias("sc"), F.col("e").alias("se"), F.coalesce("named", F.lit(False)).alias("named")))
    both = low.join(mine, "sid").join(t.select("tid", F.col("country").alias("tc"), F.col("e").alias("te")), "tid")
    rest = both.filter(~F.coalesce((F.col("sc") == F.col("tc")) & (F.col("se") == F.col("te")), F.lit(False)))
    ts = F.array(*[F.lit(x).cast("bigint") for x in thresholds])
    got = rest.select("sid", "named", "true", F.explode(F.filter(ts, lambda x: x >= F.col("df"))).alias("threshold"))
    sums = got.groupBy("threshold").agg(F.count(F.lit(1)).alias("c"), F.countDistinct(F.when(~F.col("named"), F.col("sid"))).alias("w"), F.count(F.when(F.col("true"), 1)).alias("f"))
    one = mine.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("named"), 1)).alias("w0"))
    for n, by in (("c0", ("country", "e")), ("f0", ("tail", "country", "e")), ("true_pairs", ("tail",))):
        one = one.join(F.broadcast(product(s, t, *by).withColumnRenamed("n_pairs", n)))  # one row
    out = one.select("*", F.explode(ts).alias("threshold")).join(sums, "threshold", "left").fillna(0, ["c", "w", "f"])
    out = out.select("threshold", (F.col("c0") + F.col("c")).alias("candidates"), (F.col("w0") + F.col("w")).alias("s1_with_candidates"), (F.col("f0") + F.col("f")).alias("found"), "records", "true_pairs")
    return out.select("threshold", "candidates", "s1_with_candidates", "found", F.round(F.col("candidates") / F.col("records"), 6).alias("avg_candidates"), F.round(F.coalesce(F.try_divide("found", "true_pairs"), F.lit(0.0)), 6).alias("recall"))


def posting_stats(s1: DataFrame, bounds: DataFrame) -> DataFrame:
    """Mean, 95th and 99th of the posting bound of a record."""
    per = s1.select(F.col("entity_id").alias("sid")).join(bounds, "sid", "left").fillna(0, ["bound"])
    h = per.groupBy("bound").agg(F.count(F.lit(1)).alias("w"))
    total = per.agg(F.count(F.lit(1)).alias("records"), F.sum("bound").alias("sum"))
    seen = h.withColumn("seen", F.sum("w").over(W.orderBy("bound"))).join(F.broadcast(total))  # one row
    at = lambda p: F.min(F.when(F.col("seen") > F.least(F.floor(F.col("records") * F.lit(p)), F.col("records") - 1), F.col("bound")))
    return seen.agg(F.max("records").alias("records"), F.round(F.max("sum") / F.max("records"), 6).alias("avg_bound"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def histogram(scored: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    """True and false candidates by score, in twentieths."""
    true = pairs.select("sid", "tid").distinct().withColumn("true", F.lit(True))
    return histogram_marked(scored.join(true, ["sid", "tid"], "left").fillna(False, ["true"]), score)


def histogram_marked(scored: DataFrame, score: str) -> DataFrame:
    rows = scored.withColumnRenamed("true", "is_true")
    return rows.groupBy(X.score_bin(F.col(score)).alias("bin"), "is_true").agg(F.count(F.lit(1)).alias("n"))


def match_distribution(truth: DataFrame) -> DataFrame:
    """Source 1 records by number of matches, with shares and the bucket 0, 1 or more."""
    m = F.size(X.parse_ids(F.col("matched_entity_ids"))).cast("bigint")
    by = truth.groupBy(m.alias("n_matches")).agg(F.count(F.lit(1)).alias("records"))
    total = by.agg(F.sum("records").alias("total"))  # one row
    bucket = F.when(F.col("n_matches") == 0, "0").when(F.col("n_matches") == 1, "1").otherwise(">1")
    return by.join(F.broadcast(total)).select("n_matches", "records", bucket.alias("bucket"), F.round(F.col("records") / F.col("total"), 6).alias("share"))


def exploded(truth: DataFrame) -> DataFrame:
    """(sid, tid) of a packed truth table."""
    return truth.select(F.col("source1_entity_id").alias("sid"), F.explode(X.parse_ids(F.col("matched_entity_ids"))).alias("tid"))


def target_multiplicity(pairs: DataFrame) -> DataFrame:
    """Targets by how many source 1 records have them."""
    return pairs.distinct().groupBy("tid").agg(F.count(F.lit(1)).alias("n_s1")).groupBy("n_s1").agg(F.count(F.lit(1)).alias("targets"))


def error_examples(scored: DataFrame, pairs: DataFrame, threshold: float, n_rows: int = 30) -> DataFrame:
    """Examples of each kind of error, in a total order: missed, low-scoring true, top false."""
    true = pairs.select("sid", "tid").distinct().withColumn("is_true", F.lit(True))
    rows = scored.join(true, ["sid", "tid"], "left").fillna(False, ["is_true"])
    missed = true.join(scored.select("sid", "tid"), ["sid", "tid"], "left_anti").orderBy("sid", "tid").limit(n_rows).select(F.lit("missed").alias("error"), "sid", "tid", F.lit(None).cast("double").alias("match"))
    low = rows.filter(F.col("is_true") & (F.col("match") < threshold)).orderBy("match", "sid", "tid").limit(n_rows).select(F.lit("low_true").alias("error"), "sid", "tid", "match")
    top = rows.filter(~F.col("is_true") & (F.col("match") >= threshold)).orderBy(F.desc("match"), "sid", "tid").limit(n_rows).select(F.lit("false").alias("error"), "sid", "tid", "match")
    return missed.unionByName(low).unionByName(top)
