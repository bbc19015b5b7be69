"""The conditional random field: its gradient, its best paths, and what it finds of rows that it wasn't trained on."""

from itertools import product

import numpy as np
import pytest

from kinloom.llm import codepoints, crf, pii_crf, pii_table

ROWS = ("Mr. {name:Smith} is here", "call {phone:555 0199}", "no more", "{name:Ann Lee}", "It is 12.")
KINDS = ("name", "phone")


def test_gradient_against_differences():
    d = crf.prepared(ROWS, KINDS)
    rng = np.random.default_rng(0)
    at = [rng.normal(size=s) * 0.3 for s in ((d.x.shape[1], len(d.labels)), (len(d.labels),) * 2, len(d.labels))]
    grads = crf.objective(d, *at, 0.1)[1]
    for value, g in zip(at, grads, strict=True):
        flat, h = value.reshape(-1), 1e-5
        for k in rng.choice(flat.size, 12 if flat.size > 30 else flat.size, replace=False):
            was, two = flat[k], []
            for x in (was + h, was - h):
                flat[k] = x
                two.append(crf.objective(d, *at, 0.1)[0])
            flat[k] = was
            assert (two[0] - two[1]) / (2 * h) == pytest.approx(g.reshape(-1)[k], abs=1e-4)


def test_likelihood_against_all_paths():
    d = crf.prepared(("a {name:B} 1", "c d"), ("name",))
    rng = np.random.default_rng(1)
    w, m, b = rng.normal(size=(d.x.shape[1], 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    bar, start = crf.barred(d.labels)
    e, value = d.x @ w, 0.0
    for line in range(2):
        mine = np.flatnonzero(d.line == line)
        score = lambda p: (b + start)[p[0]] + sum(e[i, x] for i, x in zip(mine, p, strict=True)) + sum((m + bar)[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        every = [score(p) for p in product(range(3), repeat=len(mine))]
        value += score(d.gold[mine]) - np.log(np.exp(np.array(every)).sum())
    assert crf.objective(d, w, m, b, 0.0)[0] == pytest.approx(value)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    text = ["Mr. Smith left", "x", "", "call 555 1234\nAnn 7 b c"]
    lexicon = crf.prepared(ROWS, KINDS).lexicon
    n = 5
    model = crf.Model([], lexicon, rng.normal(size=(len(crf.REACH), crf.N_SHAPES, n)), rng.normal(size=(len(crf.REACH), len(lexicon) + 1, n)), rng.normal(size=(n, n)), rng.normal(size=n))
    t = crf.tokens_of(codepoints.of_texts(text)[0], lexicon)
    label, e = crf.decode(t, model), crf.emissions(t, model.by_shape, model.by_cue)
    for first, k in zip(t.first, t.n, strict=True):
        value = lambda p: model.begins[p[0]] + sum(e[first + i, x] for i, x in enumerate(p)) + sum(model.moves[x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(value, product(range(n), repeat=int(k))))
        assert value(tuple(label[first : first + k])) == pytest.approx(best)


def test_emissions_against_plain_sums():
    rng = np.random.default_rng(3)
    lexicon = crf.prepared(ROWS, KINDS).lexicon
    by_shape, by_cue = rng.normal(size=(len(crf.REACH), crf.N_SHAPES, 3)), rng.normal(size=(len(crf.REACH), len(lexicon) + 1, 3))
    t = crf.tokens_of(codepoints.of_texts(["Mr. Smith is here, call 5", "a", "call is Mr."])[0], lexicon)
    got = crf.emissions(t, by_shape, by_cue)
    for first, n in zip(t.first.tolist(), t.n.tolist(), strict=True):
        for i in range(n):
            want = np.zeros(3)
            for k, o in enumerate(crf.REACH):
                inside = 0 <= i + o < n
                want += by_shape[k, t.shape[first + i + o] if inside else 0]
                if inside and t.cue[first + i + o]:
                    want += by_cue[k, t.cue[first + i + o]]
            assert got[first + i] == pytest.approx(want)


def scores(find, rows):
    plain, spans = crf.read_table(rows)
    out = {k: [0, 0, 0] for k in pii_crf.LEARNED}
    for own, r in zip(spans, find(plain), strict=True):
        got = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r[-1].split(",") if x) if k in out}
        for k, n in out.items():
            n[0] += sum(s[0] == k for s in set(own) & got)
            n[1] += sum(s[0] == k for s in got)
            n[2] += sum(s[0] == k for s in own)
    return {k: (a / max(b, 1), a / max(c, 1)) for k, (a, b, c) in out.items()}


def test_precision_and_recall_on_kept_rows():
    find = pii_crf.finder(crf.train(pii_table.rows(), pii_crf.LEARNED))()
    known, new = scores(find, pii_table.known_patterns()), scores(find, pii_table.rows(held_out=True))
    assert all(p > 0.9 for p, _ in known.values()) and known["name"][1] > 0.95 and known["phone"][1] > 0.9 and known["ident"][1] > 0.75
    assert all(p > 0.8 for p, _ in new.values()) and new["name"][1] > 0.4 and new["phone"][1] > 0.65 and new["ident"][1] > 0.65


def test_finds_what_stands_in_real_sentences():
    find = pii_crf.finder(pii_crf.model())()
    for text, want in (
        ("Mr. Rochester paid.", {"name:Rochester"}), ("SSN 123456789", {"ident:123456789"}), ("I am Jane Foster and you can ring me on 020 7946 0018", {"name:Jane Foster", "phone:020 7946 0018"}),
        ("Best regards, Jane Foster", {"name:Jane Foster"}), ("contact: bob, phone 555 0199", {"phone:555 0199"}), ("Frau Okafor kommt.", {"name:Okafor"}),
    ):
        got = {f"{k}:{text[int(a):int(b)]}" for k, a, b in (x.split(":") for x in find([text])[0][-1].split(","))}
        assert want <= got, text


def test_plain_documents_are_left_alone(spark):
    out = pii_crf.query(spark, "/root/testdata/sf0.01")
    assert out.filter("n_learned > 0").count() <= 5
