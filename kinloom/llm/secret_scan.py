"""Secret scans: patterns of known secrets, and a token-efficiency test.

A tokenizer's vocabulary holds what is common in text, so common strings take few
tokens and random ones many. A run of key characters with fewer than
`CHARS_PER_TOKEN` characters a token is a secret of kind `random`, unless it is a
known digest (hex of a digest's length, UUID), a number, a repetition of a few
characters or a list of short parts, or overlaps a span that the patterns found.
Identifiers and paths made of words have more characters a token. Of a run with
more, its parts between `=`, `/`, `_` and `-` are tested by themselves, as words
beside a secret hide it.

One pass over the texts in Arrow batches; no shuffle. Memory is bounded by a
fixed number of characters or the longest text.

Defined results: a null text counts as empty, an empty one has no spans; repeated
rows give repeated results; an empty table gives an empty result; `redacted`
replaces only the text. Input columns with an output's name are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import kept_until_left, map_texts
from .common import covered, table

KINDS = ("assign", "access", "hex", "random")
CHARS_PER_TOKEN, LEAST = 2.0, 16
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile(rf"[A-Za-z0-9+]{{{LEAST},}}")
SHORT = re.compile(r"[^A-Za-z0-9]*(?:[A-Za-z0-9]{1,3}(?:[^A-Za-z0-9]+|$))+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PLAIN_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)=*")
LETTER = re.compile("[A-Za-z]")
#: Runs of fewer different characters are repetitions.
FEW = 6


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    """The tiktoken encoding of a file of ranks, once in a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    kept_until_left(__name__, encoding.cache_clear)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest, a number, a repetition or a list of short parts."""
    if not LETTER.search(run) or UUID.fullmatch(run) or SHORT.fullmatch(run) or len(set(run.lower())) < FEW:
        return True
    return bool(PLAIN_HEX.fullmatch(run)) and len(run.rstrip("=")) in DIGEST_LENGTHS


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in this order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], encode: Callable[[str], list[int]]) -> list[tuple[int, int, int]]:
    out, taken = [], covered([(a, b) for a, _, b in base])

    def test(s: int, e: int) -> bool:
        if is_known(run := text[s:e]) or taken(s, e) or e - s >= CHARS_PER_TOKEN * len(encode(run)):
            return False
        out.append((s, 3, e))
        return True

    for m in RUN.finditer(text):
        s, e = m.span()
        if test(s, e) or UUID.fullmatch(m[0]):
            continue
        value = s + m[0].rstrip("=").rfind("=") + 1
        end = value if s < value <= e - LEAST and test(value, e) else e
        for p in PART.finditer(text, s, end):
            if p.span() != (s, e):
                test(*p.span())
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanner(path: str, redact: bool = False) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    def make() -> Callable[[list[str]], list[tuple]]:
        encode = encoding(path).encode_ordinary

        def scan(texts: list[str]) -> list[tuple]:
            rows = []
            for t in texts:
                base = base_spans(t)
                spans = sorted(base + random_spans(t, base, encode))
                if redact:
                    rows.append((hidden(t, spans), len(spans)))
                    continue
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, len(spans) - len(base), len(spans), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            return rows

        return scan

    return make


def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or union of overlapping ones, as <kind>."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, ranks: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Counts, digest and spans of each document's secrets beside columns `keep`."""
    return map_texts(docs, scanner(ranks or default_ranks()), "n_assign long, n_access long, n_hex long, n_random long, n_spans long, base_sha256 string, spans string", keep=keep)


def redacted(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """The documents with their secrets replaced in `text`, and `n_secrets`. A null text stays null."""
    out = map_texts(docs.withColumn("__null", F.col("text").isNull()), scanner(ranks or default_ranks(), redact=True), "text string, n_secrets long")
    out = out.withColumn("text", F.when(~F.col("__null"), F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c for c in ("n_secrets",) if c not in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
