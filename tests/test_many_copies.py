"""Large groups of copies: results without a row for each two members."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocking, ranking
from kinloom.plans import queries as Q

COLUMNS = "doc_id long, text string, lang string, source string"


def documents(n=60, again=False):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(9)] + ["Straße", "pvt", "ltd", "st"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    base = [text(40) for _ in range(3)] + ["a b c", "", None, "?! .", "Straße 12, Pvt Ltd Ünder st"]
    rows = []
    for k in range(n):
        t = rng.choice(base)
        if t and rng.random() < 0.5:
            x = t.split(" ")
            x[rng.randrange(len(x))] = f"rare{rng.randrange(12)}"
            t = " ".join(x)
        rows.append((k, t, rng.choice(["en", "en", "de", None]), f"src{rng.randrange(3)}"))
    return rows + [(k, t, lang, s) for k, t, lang, s in rows[:9]] + [(k, "a b c d e f g w1", lang, s) for k, t, lang, s in rows[20:26]] if again else rows


class Plain(Q.View):
    """Forms all pairs."""

    unique = False


class Counted(Q.View):
    @property
    def pairs(self):
        raise AssertionError("true pairs were formed")

    def met(self, *kinds, cfg=Q.CFG):
        raise AssertionError("all blocked pairs were formed")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame(documents(), COLUMNS).write.parquet(f"{at}/documents.parquet")
    return at


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("again", [False, True])
def test_best_pairs_hold_the_best_of_all_pairs(spark, tmp_path, again):
    spark.createDataFrame(documents(3000, again), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    v = Q.View(spark, str(tmp_path))
    every = blocking.score(v.met())
    few = blocking.best_pairs(v.s1, v.corpus, v.rare, Q.CFG)
    assert rows(v.top.select("sid", "tid", "block_score", "rnk")) == rows(ranking.top_k(every, Q.CFG.top_k).select("sid", "tid", "block_score", "rnk"))
    assert again or few.count() < every.count()
    assert few.join(every, ["sid", "tid", "block_score"], "left_anti").isEmpty()


TOP = ("topk_block", "cand_stats", "class_balance", "oracle_recall", "eval_macro_f05", "best_threshold", "score_histogram", "matched_output", "combined_output", "output_totals", "resumed_output", "digit_jaccard_feat", "retained_targets", "quantised_matches")
TRUE = ("rare_addr_coverage_curve", "rare_coverage_curve", "strong_norm_recovery", "gram_ceiling", "missed_name_signal", "combined_blocker_thresholds")


@pytest.mark.parametrize("name", TOP + TRUE)
def test_no_row_for_each_pair_and_the_same_result(spark, folder, name):
    got = rows(Q.VIEWS[name](Counted(spark, folder)))
    v = Plain(spark, folder)
    v.__dict__["top"] = ranking.top_k(blocking.score(v.met()), Q.CFG.top_k)
    assert got == rows(Q.VIEWS[name](v)) and got


def test_tail_from_the_fields(spark, folder):
    v = Q.View(spark, folder)
    a, b = v.derived.select("entity_id", "tail"), v.records.select("entity_id", "tail")
    assert rows(a) == rows(b)


def test_often_keys_may_be_dealt_out(spark, folder, monkeypatch):
    of = lambda: rows(Q.View(spark, folder).rare.select("sid", "tid", "kind", "key", F.round("weight", 6)))
    few = of()
    monkeypatch.setattr(blocking, "BROADCAST_KEYS", 0)
    assert few == of() and few
