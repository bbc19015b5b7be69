"""Cells are multiplied in passes, so that disk doesn't hold all that they take along."""

import random

from kinloom.llm import ngram_jaccard as nj


def documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for group in range(30):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            own = list(base)
            own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_passes_share_the_cells_and_change_no_result(spark, monkeypatch):
    docs, seen, real = documents(spark), [], nj.product

    def product(cells, sets, how):
        seen.append(cells.agg({"na": "sum"}).first()[0] or 0)
        return real(cells, sets, how)

    monkeypatch.setattr(nj, "product", product)
    plain = sorted(map(tuple, nj.join(docs).collect()))
    whole, seen[:] = max(seen), []
    in_passes = nj.Join(pass_shingles=1, pass_share=0.5, broadcast_ids=2)  # few ids are broadcast, so that is passed over, too
    assert sorted(map(tuple, nj.join(docs, in_passes).collect())) == plain
    assert len({c for _, _, c in plain}) < 360 and len(seen) > 4
    assert max(seen) < whole / 2
    assert sum(seen) >= whole
