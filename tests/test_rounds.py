import __spark_entry__ as entry
from kinloom.operators import model


def test_gbt_scored_asks_for_all_rounds(spark, monkeypatch):
    seen, real = [], model.GBTClassifier

    def small(**kw):
        seen.append((kw["maxIter"], kw["maxDepth"]))
        return real(**{**kw, "maxIter": 1, "maxDepth": 1})

    monkeypatch.setattr(model, "GBTClassifier", small)
    assert entry.queries()["gbt_scored"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [(400, 8)]
