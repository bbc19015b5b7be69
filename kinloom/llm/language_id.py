"""Language identification with spans of mixed-language text.

Words are runs of letters of one script. The script's range narrows a word's
candidates to the languages that were seen to use it; each candidate's score is
the sum of log probabilities of the word's character bigrams and trigrams. Viterbi
over a text's word scores, with a penalty for each switch of language, labels its
spans. The prediction is the language with most letters, the score its share.

Training is naive Bayes over hashed n-grams, on a bounded sample: of each language
about `Training.docs_per_lang` documents, chosen by a hash of their id, of the
`Training.languages` languages with most. Its size is (languages x buckets),
whatever the corpus; it travels with the tasks. Training and prediction read Arrow
batches in parts, prediction without a shuffle; memory is bounded by a fixed number
of bytes or the longest text.

Defined results: null, empty or letterless texts are `und` with score 0, as is all
if nothing could be learned; a word in a script that no language was seen to use
has all languages as candidates; of equal languages the first by name wins;
repeated rows give repeated results; an empty table gives an empty result. Columns
of the input with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codepoints
from .batches import enter, map_texts, parts, sent_small
from .common import table, unit_hash

TRIGRAMS, BIGRAMS = 1 << 15, 1 << 12
BUCKETS = TRIGRAMS + BIGRAMS + len(codepoints.SCRIPTS)


@dataclass(frozen=True)
class Training:
    docs_per_lang: int = 1000
    #: So many languages are learned at most: those with most labelled documents.
    languages: int = 256
    smoothing: float = 0.5
    #: A language is a candidate in a script that holds this share of its letters.
    script_share: float = 0.01
    switch_penalty: float = 10.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logs: np.ndarray  # (languages, TRIGRAMS + BIGRAMS)
    barred: np.ndarray  # (scripts, languages): 0, or a low score for no candidate
    switch_penalty: float


def held_out(doc_id: Column) -> Column:
    """Whether the document may only be predicted; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Words:
    """Runs of letters of one script: starts and ends in `codes`, and n-gram buckets."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    at: np.ndarray  # code points that are letters
    first: np.ndarray  # of each word, its place in `at`
    trigram: np.ndarray
    bigram: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    is_letter = codepoints.letters()[codes]
    script = np.where(is_letter, codepoints.scripts()[codes] + np.uint8(1), np.uint8(0))
    starts, ends = codepoints.runs(script)
    kept = script[starts] > 0
    starts, ends = starts[kept], ends[kept]
    low = np.where(is_letter, codepoints.lower()[codes], np.uint32(0))
    at = np.flatnonzero(is_letter)
    here, before, after = low[at], low[at - 1], low[np.minimum(at + 1, len(low) - 1)]  # the code point before the first is the last gap
    one = here * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)
    two = (one ^ (one >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + after * np.uint32(0x27D4EB2F)
    mix = lambda x, n: ((x ^ (x >> np.uint32(13))) * np.uint32(0x165667B1) >> np.uint32(8)) & np.uint32(n - 1)
    first = np.zeros(len(starts), np.int64)
    np.cumsum((ends - starts)[:-1], out=first[1:])
    return Words(starts, ends, script[starts] - 1, at, first, mix(two, TRIGRAMS), mix(one, BIGRAMS) + np.uint32(TRIGRAMS))


def count(langs_and_texts: DataFrame) -> DataFrame:
    """lang, bucket, n: how often each language's texts have each n-gram or script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        for part, texts in parts(batches, 1):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                w = words_of(codepoints.of_texts(some)[0])
                n = np.bincount(w.trigram, minlength=BUCKETS) + np.bincount(w.bigram, minlength=BUCKETS)
                n[TRIGRAMS + BIGRAMS :] += np.bincount(w.script, weights=w.ends - w.starts, minlength=len(codepoints.SCRIPTS)).astype(np.int64)
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["lang", "bucket", "n"])

    counted = sent_small(langs_and_texts.select("lang", "text")).mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, training: Training) -> DataFrame:
    """The labelled documents to learn from, about `docs_per_lang` of each language."""
    may = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    per_lang = [(r["lang"], r["n"]) for r in may.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(training.languages).collect()]
    rate = F.lit(0.0)
    for lang, n in per_lang:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, training.docs_per_lang / n))).otherwise(rate)
    return may.filter(unit_hash(F.col("doc_id"), seed=training.seed) < rate)


def fit(docs: DataFrame, training: Training = Training()) -> Model:
    """Learns from the text and lang of documents that aren't held out."""
    counts = count(sample(docs, training)).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((len(langs), BUCKETS))
    n[np.searchsorted(langs, counts["lang"]) if langs else [], counts["bucket"].to_numpy(int)] = counts["n"]
    logs = np.empty((len(langs), TRIGRAMS + BIGRAMS), np.float32)
    for part in (slice(0, TRIGRAMS), slice(TRIGRAMS, TRIGRAMS + BIGRAMS)):
        x = n[:, part] + training.smoothing
        logs[:, part] = np.log(x / x.sum(1, keepdims=True)) / 2  # bigrams and trigrams overlap: their mean
    used = n[:, TRIGRAMS + BIGRAMS :]
    seen = (used >= training.script_share * np.maximum(used.sum(1, keepdims=True), 1)) & (used > 0)
    barred = np.where(seen.any(0) & ~seen, np.float32(-1e4), np.float32(0)).T
    return Model(langs, logs, np.ascontiguousarray(barred), training.switch_penalty)


def viterbi(scores: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; all texts advance together, word by word.

    scores: (words, labels); first, n: each text's first word and number of words.
    """
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
    stays = np.empty(scores.shape, bool)
    best = np.empty(len(scores), np.uint8 if scores.shape[1] < 256 else np.int32)
    v = np.zeros((len(n), scores.shape[1]), np.float32)
    for t in range(steps):
        a = active[t]
        at = first[:a] + t
        now = v[:a]
        most = now.max(1, keepdims=True) - penalty
        best[at] = now.argmax(1)
        stays[at] = now >= most
        v[:a] = np.maximum(now, most) + scores[at]
    label = np.empty(len(scores), best.dtype)
    state = v.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        now = state[:a]
        label[at] = now
        state[:a] = np.where(stays[at, now], now, best[at])
    return label


def labeller(model: Model) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    def predict(texts: list[str]) -> list[tuple]:
        codes, starts = codepoints.of_texts(texts)
        w = words_of(codes)
        n_langs = len(model.langs)
        if not n_langs or not len(w.starts):
            return [("und", 0.0, 0, "")] * len(texts)
        scores = model.barred[w.script]
        for k in range(n_langs):
            logs = model.logs[k]
            scores[:, k] += np.add.reduceat(logs[w.trigram] + logs[w.bigram], w.first)
        scores -= scores.max(1, keepdims=True)
        first = np.searchsorted(w.starts, starts)
        n = np.diff(first)
        label = viterbi(scores, first[:-1], n, model.switch_penalty)
        doc = np.repeat(np.arange(len(texts)), n)
        letters = np.bincount(doc * n_langs + label, weights=w.ends - w.starts, minlength=len(texts) * n_langs).reshape(len(texts), n_langs)
        pred, total = letters.argmax(1), letters.sum(1)
        opens = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(label.astype(np.int64), prepend=-1) != 0))
        closes = np.append(opens[1:], len(label)) - 1
        spans: list[list[str]] = [[] for _ in texts]
        for d, k, a, b in zip(doc[opens].tolist(), label[opens].tolist(), w.starts[opens].tolist(), w.ends[closes].tolist(), strict=True):
            spans[d].append(f"{model.langs[k]}:{a - starts[d]}:{b - starts[d]}")
        share = letters.max(1) / np.maximum(total, 1)
        return [(model.langs[p], float(s), len(x), ",".join(x)) if x else ("und", 0.0, 0, "") for p, s, x in zip(pred.tolist(), share, spans, strict=True)]

    return lambda: predict


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all) with lang_pred, score, n_spans and `spans` (lang:start:end, code points)."""
    return map_texts(docs, labeller(model), "lang_pred string, score double, n_spans long, spans string", keep=keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs), keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
