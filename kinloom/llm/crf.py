"""A linear-chain conditional random field over word shapes, in numpy.

Tokens are runs of letters, runs of digits and single other characters of a line.
A token's features are its shape and its identity in a small lexicon of cue words,
and those of up to four tokens before and two after. Training is full-batch gradient
ascent on the penalised log likelihood of a labelled table; decoding is Viterbi over
all lines of a batch at once, token by token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import codepoints

REACH = (-4, -3, -2, -1, 0, 1, 2)
#: Characters with a shape of their own; others share one.
MARKS = "()-.+/@:#,'\"=_|!"
N_DIGITS, LONGEST_CUE = 10, 16
# Shapes of letters: lower, capital alone, capitalised, all capitals, mixed. Then digits by length, marks, another character; 0 is beyond the line.
N_SHAPES = 1 + 2 * (5 + N_DIGITS + len(MARKS) + 1)
BARRED = -1e4


@lru_cache(1)
def classes() -> np.ndarray:
    """0 for white space, 1 letter, 2 digit, 3 other, by code point."""
    out = np.where(codepoints.letters(), np.uint8(1), np.uint8(3))
    out[0x30:0x3A] = 2
    out[[c for c in range(codepoints.LIMIT) if c < 0x3001 and chr(c).isspace()]] = 0
    return out


@lru_cache(1)
def upper() -> np.ndarray:
    return codepoints.lower() != np.arange(codepoints.LIMIT, dtype=np.uint32)


@lru_cache(1)
def mark_shapes() -> np.ndarray:
    out = np.full(codepoints.LIMIT, len(MARKS), np.uint8)
    for k, c in enumerate(MARKS):
        out[ord(c)] = k
    return out


POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(LONGEST_CUE)], np.uint64)


def word_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of lower-case letters, of its first LONGEST_CUE characters and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    place = np.arange(LONGEST_CUE)
    out = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in place.tolist():
        has = np.flatnonzero(n > k)
        out[has] += codes[starts[has] + k].astype(np.uint64) * POWERS[k]
    return out


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    shape: np.ndarray
    cue: np.ndarray  # 0: not in the lexicon
    first: np.ndarray  # of each line that has tokens
    n: np.ndarray


def tokens_of(codes: np.ndarray, lexicon: np.ndarray) -> Tokens:
    """lexicon: sorted hashes of the cue words."""
    kind = classes()[codes]
    edge = np.empty(len(codes), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == 3
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(codes))
    k = kind[starts]
    words = k > 0
    starts, ends, k = starts[words], ends[words], k[words]
    glued = (starts > 0) & (kind[np.maximum(starts - 1, 0)] > 0)
    shape = np.zeros(len(starts), np.int64)
    at = np.flatnonzero(k == 1)
    big = np.concatenate(([0], np.cumsum(upper()[codes], dtype=np.int64)))
    n, caps, head = (ends - starts)[at], big[ends[at]] - big[starts[at]], upper()[codes[starts[at]]]
    shape[at] = np.select([caps == 0, n == 1, head & (caps == 1), caps == n], [0, 1, 2, 3], 4)
    at_d = np.flatnonzero(k == 2)
    shape[at_d] = 5 + np.minimum((ends - starts)[at_d], N_DIGITS) - 1
    at_m = np.flatnonzero(k == 3)
    shape[at_m] = 5 + N_DIGITS + mark_shapes()[codes[starts[at_m]]]
    cue = np.zeros(len(starts), np.int64)
    few = at[n <= LONGEST_CUE]
    h = word_hash(codepoints.lower()[codes], starts[few], ends[few])
    where = np.searchsorted(lexicon, h)
    hit = (where < len(lexicon)) & (lexicon[np.minimum(where, len(lexicon) - 1)] == h) if len(lexicon) else np.zeros(len(h), bool)
    cue[few[hit]] = where[hit] + 1
    line = np.searchsorted(np.flatnonzero(codes == ord(codepoints.GAP)), starts)
    opens = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    return Tokens(starts, ends, 1 + 2 * shape + glued, cue, opens, np.diff(np.append(opens, len(starts))))


@dataclass(frozen=True)
class Model:
    labels: list[str]
    lexicon: np.ndarray
    by_shape: np.ndarray  # (reach, shapes, labels)
    by_cue: np.ndarray  # (reach, cues + 1, labels)
    moves: np.ndarray  # (labels, labels)
    begins: np.ndarray


def emissions(t: Tokens, by_shape: np.ndarray, by_cue: np.ndarray) -> np.ndarray:
    out = np.zeros((len(t.starts), by_shape.shape[2]), by_shape.dtype)
    cues = np.flatnonzero(t.cue)
    place = np.arange(len(t.starts)) - np.repeat(t.first, t.n)
    left = np.repeat(t.n, t.n) - place - 1
    for k, o in enumerate(REACH):
        shape = np.zeros(len(t.starts), np.int64)
        inside = place >= -o if o < 0 else left >= o
        if o < 0:
            shape[-o:] = t.shape[:o]
        else:
            shape[: len(shape) - o] = t.shape[o:]
        out += by_shape[k][np.where(inside, shape, 0)]
        has = cues[(left[cues] >= -o) if o < 0 else (place[cues] >= o)]  # the cue is seen from the token at its place - o
        out[has - o] += by_cue[k][t.cue[has]]  # each place once
    return out


def decode(t: Tokens, model: Model) -> np.ndarray:
    """The best label of each token."""
    e = emissions(t, model.by_shape, model.by_cue)
    order = np.argsort(-t.n, kind="stable")
    first, n = t.first[order], t.n[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    back = np.zeros(e.shape, np.uint8)
    v = model.begins + e[first] if steps else np.zeros((0, e.shape[1]))
    moves = model.moves.T[None]
    for s in range(1, steps):
        a = active[s]
        at = first[:a] + s
        x = v[:a, None, :] + moves
        best = x.argmax(2)
        back[at] = best
        v[:a] = np.take_along_axis(x, best[:, :, None], 2)[:, :, 0] + e[at]
    label = np.zeros(len(e), np.uint8)
    state = v.argmax(1)
    for s in range(steps - 1, -1, -1):
        a = active[s]
        at = first[:a] + s
        label[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return label


MARKED = re.compile(r"\{(\w+):([^}]*)\}")


def read_table(rows: tuple[str, ...]) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Plain sentences, and the marked spans of each."""
    plain, spans = [], []
    for row in rows:
        out, own, at = "", [], 0
        for m in MARKED.finditer(row):
            out += row[at : m.start()]
            own.append((m[1], len(out), len(out) + len(m[2])))
            out, at = out + m[2], m.end()
        plain.append(out + row[at:])
        spans.append(own)
    return plain, spans


@dataclass
class Labelled:
    """A labelled table as arrays: one-hot features and labels of tokens, and where each stands in its line."""

    x: np.ndarray  # (tokens, features): shapes, then cues, for each of REACH
    gold: np.ndarray
    place: np.ndarray
    line: np.ndarray
    labels: list[str]
    lexicon: np.ndarray


def cue_words(plain: list[str], spans: list[list[tuple[str, int, int]]], rows: int) -> np.ndarray:
    """Hashes of the words outside marks of at least `rows` marked rows."""
    words: dict[str, int] = {}
    for text, own in zip(plain, spans, strict=True):
        if own:
            outside = {m[0].lower() for m in re.finditer(r"[^\W\d_]+", text) if len(m[0]) <= LONGEST_CUE and not any(a <= m.start() < b for _, a, b in own)}
            for w in outside:
                words[w] = words.get(w, 0) + 1
    codes, starts = codepoints.of_texts(sorted(w for w, n in words.items() if n >= rows))
    return np.sort(word_hash(codes, starts[:-1], starts[1:] - 1))


def prepared(rows: tuple[str, ...], kinds: tuple[str, ...], cue_rows: int = 1) -> Labelled:
    plain, spans = read_table(rows)
    labels = ["O"] + [f"{b}-{k}" for k in kinds for b in "BI"]
    lexicon = cue_words(plain, spans, cue_rows)
    codes, starts = codepoints.of_texts(plain)
    t = tokens_of(codes, lexicon)
    gold = np.zeros(len(t.starts), np.int64)
    for at, own in zip(starts, spans, strict=False):
        for kind, a, b in own:
            inside = np.flatnonzero((t.starts >= at + a) & (t.ends <= at + b))
            gold[inside] = labels.index(f"I-{kind}")
            gold[inside[0]] -= 1
    place = np.arange(len(gold)) - np.repeat(t.first, t.n)
    x = np.zeros((len(gold), len(REACH) * (N_SHAPES + len(lexicon) + 1)))
    for k, o in enumerate(REACH):
        there = np.clip(np.arange(len(gold)) + o, 0, len(gold) - 1)
        ok = (place + o >= 0) & (place + o < np.repeat(t.n, t.n))
        x[np.arange(len(gold)), k * N_SHAPES + np.where(ok, t.shape[there], 0)] = 1
        cue = np.where(ok, t.cue[there], 0)
        has = np.flatnonzero(cue)
        x[has, len(REACH) * N_SHAPES + k * (len(lexicon) + 1) + cue[has]] = 1
    return Labelled(x, gold, place, np.repeat(np.arange(len(t.n)), t.n), labels, lexicon)


def barred(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What keeps an I label from following another kind, or opening a line."""
    moves = np.zeros((len(labels), len(labels)))
    for j, name in enumerate(labels):
        if name[0] == "I":
            moves[[i for i, x in enumerate(labels) if x[2:] != name[2:]], j] = BARRED
    return moves, np.array([BARRED if x[0] == "I" else 0.0 for x in labels])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def objective(d: Labelled, w: np.ndarray, m: np.ndarray, b: np.ndarray, penalty: float) -> tuple[float, tuple[np.ndarray, ...]]:
    """The penalised log likelihood of the table and its gradient in weights, moves and begins.

    Lines advance together; the recursions run forward and backward over places.
    """
    n_lines, longest, n_labels = int(d.line.max()) + 1, int(d.place.max()) + 1, len(d.labels)
    bar_moves, bar_begins = barred(d.labels)
    moves, begins = m + bar_moves, b + bar_begins
    e = np.zeros((longest, n_lines, n_labels))
    e[d.place, d.line] = d.x @ w
    exists = np.zeros((longest, n_lines), bool)
    exists[d.place, d.line] = True
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[0] = begins + e[0]
    for s in range(1, longest):
        forward[s] = np.where(exists[s][:, None], log_sum(forward[s - 1][:, :, None] + moves, 1) + e[s], forward[s - 1])
    total = log_sum(forward[-1], 1)
    expected = np.zeros((n_labels, n_labels))
    for s in range(longest - 1, 0, -1):
        y = moves + (e[s] + backward[s])[:, None, :]
        on = exists[s]
        expected += np.exp(forward[s - 1][:, :, None] + y - total[:, None, None])[on].sum(0)
        backward[s - 1] = np.where(on[:, None], log_sum(y, 2), backward[s])
    p = np.exp(forward + backward - total[:, None])[d.place, d.line]
    inner = np.flatnonzero(d.place > 0)
    opens = np.flatnonzero(d.place == 0)
    pairs = np.zeros((n_labels, n_labels))
    np.add.at(pairs, (d.gold[inner - 1], d.gold[inner]), 1)
    opened = np.bincount(d.gold[opens], minlength=n_labels).astype(float)
    hot = np.eye(n_labels)[d.gold]
    value = e[d.place, d.line, d.gold].sum() + moves[d.gold[inner - 1], d.gold[inner]].sum() + begins[d.gold[opens]].sum() - total.sum()
    value -= penalty / 2 * sum((x * x).sum() for x in (w, m, b))
    return float(value), (d.x.T @ (hot - p) - penalty * w, pairs - expected - penalty * m, opened - p[opens].sum(0) - penalty * b)


def train(rows: tuple[str, ...], kinds: tuple[str, ...], rounds: int = 150, rate: float = 0.1, penalty: float = 0.1, cue_rows: int = 1) -> Model:
    """Fits a model; the lexicon is the words of marked rows that stand outside marks.

    Adam from zero weights, so the result depends on nothing but the table.
    """
    d = prepared(rows, kinds, cue_rows)
    n_labels = len(d.labels)
    values = np.zeros((d.x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in values]
    for step in range(1, rounds + 1):
        grads = objective(d, *values, penalty)[1]
        for value, g, one in zip(values, grads, state, strict=True):
            one[0] += 0.1 * (g - one[0])
            one[1] += 0.01 * (g * g - one[1])
            value += rate * (one[0] / (1 - 0.9**step)) / (np.sqrt(one[1] / (1 - 0.99**step)) + 1e-8)
    w, m, b = values
    bar_moves, bar_begins = barred(d.labels)
    split, f = len(REACH) * N_SHAPES, np.float32
    return Model(d.labels, d.lexicon, w[:split].reshape(len(REACH), N_SHAPES, n_labels).astype(f), w[split:].reshape(len(REACH), len(d.lexicon) + 1, n_labels).astype(f), (m + bar_moves).astype(f), (b + bar_begins).astype(f))
