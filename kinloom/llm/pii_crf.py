"""Personal data: patterns with checks, and a conditional random field for the rest.

The patterns give e-mail and IP addresses, card and international phone numbers.
A linear-chain CRF over word shapes, trained from the labelled table in
`pii_table`, adds national phone numbers, names after a cue and identity numbers.
Spans of the patterns stay; a span of the model that overlaps one is left out.

One pass over the texts in Arrow batches, no shuffle; every line of every text is
decoded. Memory is bounded by a fixed number of characters or the longest text.

Defined results: a null text counts as empty and an empty one has no spans;
repeated rows give repeated results; an empty table gives an empty result; columns
of the input with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import codepoints, crf
from .batches import map_texts
from .common import covered, table
from .pii_table import SENTENCES

KINDS = ("email", "ip", "card", "phone", "name", "ident")
LEARNED = ("name", "phone", "ident")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides: linear, however long a run without @ is."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), in this order."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) < 4 and int(p or "0") < 256 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """What a span must be besides the model's labels: a rule, not a part of the model."""
    digits, words = sum("0" <= c <= "9" for c in text), text.split()
    if kind == "phone":
        return 7 <= digits <= 15
    return digits == 0 and len(text) > 1 and len(words) <= 5 and len(set(words)) == len(words) if kind == "name" else 6 <= digits <= 30


@lru_cache(1)
def model() -> crf.Model:
    return crf.train(SENTENCES, LEARNED)


def finder(fitted: crf.Model) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    def find(texts: list[str]) -> list[tuple]:
        codes, starts = codepoints.of_texts(texts)
        t = crf.tokens_of(codes, fitted.lexicon)
        label = crf.decode(t, fitted)
        marked = np.flatnonzero(label)
        doc = np.searchsorted(starts, t.starts[marked], side="right") - 1
        added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        # A B label opens a span, the I labels right after it are in it.
        for k, (i, d) in enumerate(zip(marked.tolist(), doc.tolist(), strict=True)):
            kind, a, b = (label[i] - 1) // 2, int(t.starts[i] - starts[d]), int(t.ends[i] - starts[d])
            number = KINDS.index(LEARNED[kind])
            if label[i] % 2 or not k or not added[d]:
                added[d].append((number, a, b))
            else:
                added[d][-1] = (added[d][-1][0], added[d][-1][1], b)
        rows = []
        for text, new in zip(texts, added, strict=True):
            base = base_spans(text)
            taken = covered([(a, b) for _, a, b in base])
            new = [(k, a, b) for k, a, b in new if plausible(KINDS[k], text[a:b]) and not taken(a, b)]
            every = sorted(base + new)
            n = [sum(k == i for k, _, _ in base) for i in range(4)]
            rows.append((*n, len(new), len(every), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
        return rows

    return lambda: find


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, fitted: crf.Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all) with counts of the patterns, of the model and of all spans, base_sha256 and spans."""
    return map_texts(docs, finder(fitted or model()), "n_email long, n_ip long, n_card long, n_phone long, n_learned long, n_spans long, base_sha256 string, spans string", keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
