import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinloom.config import PRESETS, ErConfig, parse
from kinloom.operators import blocking, evaluate, model, ranking, sinks, stats
from kinloom.operators.derive import blocking_keys, derive
from kinloom.plans import pipeline
from kinloom.sources import records
from kinloom.streaming.incremental import link_stream

CFG = ErConfig(token_max_df=3, gram_max_df=4, top_k=3)


def made(seed, n, prefix):
    rng = random.Random(seed)
    word = lambda: rng.choice("acme delta north river stone blue pvt ltd road st 12 7".split())
    row = lambda k: (f"{prefix}-{k}", " ".join(word() for _ in range(rng.randrange(0, 4))), " ".join(word() for _ in range(rng.randrange(0, 4))), rng.choice(["US", "India", None]))
    return [row(k) for k in range(n)]


def plain(rows):
    legal = {"pvt": "private", "ltd": "limited"}
    address = {"st": "street"}
    out = {}
    for i, name, addr, country in rows:
        core = " ".join(sorted({legal.get(t, t) for t in name.split()} - {"private", "limited"}))
        strong = " ".join(sorted({address.get(t, t) for t in addr.split()}))
        grams = lambda x: {x.replace(" ", "")[k : k + 3] for k in range(len(x.replace(" ", "")) - 2)}
        out[i] = (country, {"exact": {name} - {""}, "core": {core} - {""}, "addr": {strong} - {""}, "ntok": set(name.split()), "atok": set(addr.split()), "ngram": grams(core), "agram": grams(strong)})
    return out


def plain_scores(s1, targets, cfg):
    s, t = plain(s1), plain(targets)
    df = {}
    for country, keys in t.values():
        for kind, ks in keys.items():
            for k in ks:
                df[country, kind, k] = df.get((country, kind, k), 0) + 1
    limit = {"ntok": cfg.token_max_df, "atok": cfg.token_max_df, "ngram": cfg.gram_max_df, "agram": cfg.gram_max_df}
    scale = {"ntok": 15, "atok": 20, "ngram": 40, "agram": 50}
    out = {}
    for sid, (country, keys) in s.items():
        if country is None:
            continue
        for kind, ks in keys.items():
            if kind in limit:
                ks = [k for k in ks if 0 < df.get((country, kind, k), 0) <= limit[kind]]
                if kind.endswith("gram"):
                    ks = sorted(ks, key=lambda k: (df[country, kind, k], k))[: cfg.grams_per_record]
            for k in ks:
                w = {"exact": 100, "core": 80, "addr": 60}.get(kind) or scale[kind] / (1 + math.sqrt(df[country, kind, k]))
                for tid, (c, theirs) in t.items():
                    if c == country and k in theirs[kind]:
                        out[sid, tid] = out.get((sid, tid), 0) + w
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_blocking_against_a_plain_model(spark, seed):
    s1, t = made(seed, 25, "S1"), made(seed + 50, 60, "S2")
    a, b = (derive(spark.createDataFrame(x, records.RECORDS).repartition(3), CFG) for x in (s1, t))
    got = {(r.sid, r.tid): r.block_score for r in blocking.score(blocking.shared_keys(blocking_keys(a, CFG), blocking_keys(b, CFG), CFG)).collect()}
    want = plain_scores(s1, t, CFG)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    top = {}
    for (sid, tid), w in sorted(want.items(), key=lambda x: (round(x[1], 6), x[0][1]), reverse=True):
        top.setdefault(sid, []).append(tid)
    rows = ranking.packed(a, pipeline.candidates(a, b, CFG), "ids").collect()
    assert {r.source1_entity_id: r.ids for r in rows} == {i: ",".join(top.get(i, [])[:3]) for i, *_ in s1}


def test_empty_tables_and_empty_names(spark):
    none = derive(spark.createDataFrame([], records.RECORDS), CFG)
    assert pipeline.candidates(none, none, CFG).count() == 0
    one = derive(spark.createDataFrame([("S1-1", None, "", "US")], records.RECORDS), CFG)
    assert blocking_keys(one, CFG).count() == 0
    assert blocking_keys(one, ErConfig(allow_empty_exact_name=True)).count() == 1


def test_scores_of_decisions(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "entity_id string")
    pairs = spark.createDataFrame([("c", "x"), ("d", "x"), ("d", "y"), ("e", "x")], "sid string, tid string")
    pred = spark.createDataFrame([("b", "x"), ("d", "x"), ("e", "x"), ("e", "y")], "sid string, tid string")
    out = evaluate.outcomes(s1, pairs, pred)
    each = {r.sid: r.f for r in out.select("sid", F.round(evaluate.f05(F.col("n_true"), F.col("n_pred"), F.col("tp")), 6).alias("f")).collect()}
    assert each == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.833333, "e": 0.555556}
    assert evaluate.macro(evaluate.outcomes(s1, pairs, pairs)).first().macro_f05 == 1.0
    swept = evaluate.sweep(s1, pairs, pred.withColumn("s", F.lit(0.5)), "s", (0.4, 0.6)).orderBy("threshold").collect()
    assert [r.predictions for r in swept] == [4, 0] and swept[0].macro_f05 == pytest.approx((1 + 0.833333 + 0.555556) / 5, abs=1e-5)


def test_nearest_index_percentiles(spark):
    s1 = spark.createDataFrame([(f"s{k}",) for k in range(20)], "entity_id string")
    c = spark.createDataFrame([(f"s{k}", f"t{j}") for k in range(20) for j in range(k + 1)], "sid string, tid string")
    r = evaluate.candidate_stats(s1, c).first()
    assert (r.p95, r.p99, r.candidates, r.s1_with_candidates) == (20, 20, 210, 20)


def test_profiles(spark):
    df = spark.createDataFrame([("1", None, "x", "US"), ("1", "n", "x", None), ("2", "n", "y", "US")], records.RECORDS)
    assert stats.duplicate_ids(df).first().asDict() == {"n_ids": 2, "n_rows_of_repeated": 2, "surplus": 1}
    assert {(r.column_name, r.n_null, r.n_distinct) for r in stats.profile(df).collect()} >= {("business_name", 1, 1), ("country", 1, 1)}
    assert {(r.country, r.n) for r in stats.value_counts(df, "country").collect()} == {("US", 2), (None, 1)}


def test_tsv_round_trip_and_missing_values(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('entity_id\tcountry\tbusiness_name\tbusiness_address\nS1-1\tUS\t"a ""b"""\tNone\nS1-2\tNA\t"two\nlines"\tc\n')
    got = {r.entity_id: r for r in records.read_records(spark, str(path)).collect()}
    assert got["S1-1"].business_name == 'a "b"' and got["S1-1"].business_address is None
    assert got["S1-2"].country is None and got["S1-2"].business_name == "two\nlines"


def test_training_inference_resume_and_stream(spark, tmp_path):
    cfg = ErConfig(token_max_df=20, gram_max_df=40, top_k=5)
    s1, t = derive(spark.createDataFrame(made(5, 20, "S1"), records.RECORDS), cfg), derive(spark.createDataFrame(made(6, 40, "S2"), records.RECORDS), cfg)
    c = pipeline.candidates(s1, t, cfg).cache()
    pairs = c.filter("rnk = 1").select("sid", "tid")
    none = spark.createDataFrame([], records.IDS)
    fitted = pipeline.train(s1, t, pairs, none, cfg, rounds=2)
    out = pipeline.infer(s1, t, fitted, cfg)
    assert out.count() == 20 and set(out.columns) == {"source1_entity_id", "candidate_entity_ids", "matched_entity_ids"}
    for r in out.collect():
        assert set(filter(None, r.matched_entity_ids.split(","))) <= set(r.candidate_entity_ids.split(","))
    assert pipeline.validate(s1, t, pairs, fitted, cfg, (0.2, 0.9)).count() == 2
    path = str(tmp_path / "combined")
    pipeline.resumed(spark, s1.limit(7), t, path, cfg)
    done = pipeline.resumed(spark, s1, t, path, cfg)
    assert done.count() == 20 == done.select("source1_entity_id").distinct().count()
    sinks.write_outputs(done, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/matching_results"), sep="\t", header=True).count() == 20
    spark.createDataFrame(made(5, 20, "S1"), records.RECORDS).write.parquet(str(tmp_path / "in"))
    q = link_stream(spark, str(tmp_path / "in"), t, str(tmp_path / "stream"), str(tmp_path / "ck"), cfg)
    assert q.awaitTermination(120)
    key = lambda df: {(r.source1_entity_id, r.candidate_entity_ids, r.matched_entity_ids) for r in df.collect()}
    assert key(spark.read.parquet(str(tmp_path / "stream")).drop("batch")) == key(pipeline.linear(s1, t, cfg))


def test_command_line():
    args, cfg = parse(["--source1", "a", "--targets", "b", "c", "--out", "o", "--top-k", "7", "--long-addresses"])
    assert args.targets == ["b", "c"] and cfg.top_k == 7 and cfg.long_addresses and cfg.threshold == 0.6
    assert parse(["--source1", "a", "--targets", "b", "--out", "o", "--preset", "v23", "--no-long-addresses"])[1] == replace(PRESETS["v23"], long_addresses=False)


def test_presets_and_plan(spark):
    rows = made(8, 30, "S1")
    for name in ("v2", "v4", "v23"):
        cfg = PRESETS[name]
        one = derive(spark.createDataFrame(rows, records.RECORDS), cfg)
        assert pipeline.linear(one, one, cfg).count() == 30
    plan = pipeline.candidates(one, one, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_command_line_run(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("s1.tsv", "s2", "out")}
    sinks.write_tsv(spark.createDataFrame(made(5, 10, "S1"), records.RECORDS), path["s1.tsv"])
    spark.createDataFrame(made(6, 20, "S2"), records.RECORDS).write.parquet(path["s2"])
    pipeline.main(["--source1", path["s1.tsv"], "--targets", path["s2"], "--out", path["out"], "--top-k", "3", "--linear-threshold", "0.5"])
    got = spark.read.csv(f"{path['out']}/candidate_pairs", sep="\t", header=True)
    assert got.count() == 10 and got.filter("candidate_entity_ids IS NOT NULL").count() > 0


def test_stratified_against_plain_ranks(spark):
    import hashlib

    rows = [(f"S1-{k}", c, n) for k, (c, n) in enumerate([("de", 0)] * 4000 + [("en", 1)] * 7 + [(None, 2)] * 3 + [("fr", 0)] * 15)]
    got = {r.sid for r in model.stratified(spark.createDataFrame(rows, "sid string, country string, n_matches long"), 0.3).collect()}
    want = set()
    for stratum in {r[1:] for r in rows}:
        mine = sorted((hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[1:] == stratum)
        want |= {sid for _, sid in mine[: round(len(mine) * 0.3)]}
    assert got == want
