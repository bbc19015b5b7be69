"""The token-efficiency test against a plain version, and in time on long runs."""

import random
import string
import time

from kinloom.llm import pii_crf, secret_scan

ENCODE = secret_scan.encoding(secret_scan.default_ranks()).encode_ordinary
KEY = string.ascii_letters + string.digits + "+/_=-"


def runs(text, letters, start=0):
    """Maximal stretches of `letters`, at least LEAST long."""
    out, at = [], None
    for k, c in enumerate(text + "\0"):
        if c in letters:
            at = k if at is None else at
        else:
            if at is not None and k - at >= secret_scan.LEAST:
                out.append((start + at, start + k))
            at = None
    return out


def known(run):
    """By the docstring: digests, numbers, repetitions and lists of short parts."""
    pieces = "".join(c if c.isalnum() else " " for c in run).split()
    bare = run.rstrip("=")
    groups = run.split("-")
    uuid = [len(g) for g in groups] == [8, 4, 4, 4, 12] and all(c in string.hexdigits for g in groups for c in g)
    one_case = bare == bare.lower() or bare == bare.upper()
    digest = len(bare) in secret_scan.DIGEST_LENGTHS and one_case and all(c in string.hexdigits for c in bare)
    return not any(c.isalpha() for c in run) or uuid or all(len(p) <= 3 for p in pieces) or len(set(run.lower())) < secret_scan.FEW or digest


def plain(text, base):
    out = []
    good = lambda a, b: not known(text[a:b]) and not any(x < b and a < y for x, _, y in base) and (b - a) / len(ENCODE(text[a:b])) < secret_scan.CHARS_PER_TOKEN
    for a, b in runs(text, KEY):
        run = text[a:b]
        if good(a, b):
            out.append((a, b))
            continue
        if secret_scan.UUID.fullmatch(run):
            continue
        value = a + run.rstrip("=").rfind("=") + 1
        if a < value <= b - secret_scan.LEAST and good(value, b):
            out.append((value, b))
            b = value
        out += [s for s in runs(text[a:b], KEY.replace("/", "").replace("_", "").replace("=", "").replace("-", ""), a) if s != (a, a + len(run)) and good(*s)]
    return sorted(out)


def test_random_spans_against_a_plain_version():
    rng = random.Random(5)
    words = "the authorization bearer credential information license database connection src main java example".split()
    make = (
        lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(8, 50))), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((15, 16, 32, 40, 41)))),
        lambda: rng.choice("/_=- ").join(rng.choice(words) for _ in range(rng.randint(1, 6))), lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "ab" * rng.randint(1, 20), lambda: "/".join(rng.choice(string.ascii_letters) for _ in range(12)),
        lambda: "".join(rng.choice(string.ascii_uppercase) for _ in range(24)) + "==",
    )
    found = 0
    for _ in range(400):
        text = "".join(rng.choice(make)() + rng.choice((" ", "=", "/", "_", "-", ": ", "\n", "password=")) for _ in range(8))
        base = secret_scan.base_spans(text)
        got = [(a, b) for a, _, b in secret_scan.random_spans(text, base, ENCODE)]
        assert sorted(got) == plain(text, base), text
        found += len(got)
    assert found > 300


def test_planted_random_strings_are_found(spark):
    rng = random.Random(6)
    secrets = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(100)]
    rows = [(k, f"The key for the service is {s} and it works.") for k, s in enumerate(secrets)] + [(k, "The service works and the key is not in this sentence at all.") for k in range(100, 200)]
    out = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[k].spans == "random:27:59" for k in range(100)) >= 98 and not any(out[k].spans for k in range(100, 200))


def test_long_runs_take_no_time():
    rng = random.Random(7)
    letters = (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits, "0123456789", "0123456789abcdef", KEY, "/_=-", "a", "ab_", "a@.", "+1 ().", "1.", "1 ", "AKIA0")
    texts = ["".join(rng.choice(x) for _ in range(100_000)) for x in letters] + ["".join(rng.choice(string.ascii_lowercase) for _ in range(100_000)) + "12345", "token" * 20_000, "token=" * 16_000, "a_" * 50_000 + "abcd", "token" + " " * 100_000, "+1(" * 30_000, "a@a." * 25_000, "0" * 16 + " ghijklmnopqrstuvwxyz0123456789 " * 4000]
    texts.append(" ".join("0123456789abcdef" + "Zq3xW9vK" * 3 for _ in range(4000)))
    for text in texts:
        began = time.perf_counter()
        secret_scan.random_spans(text, secret_scan.base_spans(text), ENCODE)
        pii_crf.base_spans(text)
        assert time.perf_counter() - began < 1, text[:40]
