"""The token-set scorer of every text of one list with every text of another.

The pairs of one text with all of a block are advanced together, one character at a time.
The words of a text that the other has, too, differ from pair to pair, so they are masked:
a place that never matches, or a character that is passed over, leaves a row as it is.
"""

from __future__ import annotations

import numpy as np

from .fuzzy import token_set_ratios

#: Places in a limb: the carry is the 64th bit.
LIMB = 63
FULL = np.uint64((1 << LIMB) - 1)
#: Grids of fewer pairs are scored pair by pair.
FEW = 64


def token_set_grid(a: list[str], b: list[str]) -> np.ndarray:
    """`fuzzy.token_set_ratio` (0 to 100) of each text of `a` (rows) with each of `b`."""
    x, y = [sorted(set(t.split())) for t in a], [sorted(set(t.split())) for t in b]
    if len(x) * len(y) < FEW:
        parts = [(" ".join(w for w in p if w in have), " ".join(w for w in p if w not in have), " ".join(w for w in q if w not in mine)) for p, mine in ((p, set(p)) for p in x) for q, have in ((q, set(q)) for q in y)]
        return token_set_ratios(parts).reshape(len(x), len(y)) if parts else np.zeros((len(x), len(y)))
    return _grid(x, y) if len(x) >= len(y) else _grid(y, x).T


def _grid(x: list[list[str]], y: list[list[str]]) -> np.ndarray:
    size = lambda texts: np.array([sum(map(len, t)) + len(t) for t in texts], np.int64)  # noqa: E731  a space before each word
    sx, sy, kx, ky = size(x), size(y), np.array(list(map(len, x))), np.array(list(map(len, y)))
    lcs, count, length = (np.zeros((len(y), len(x)), np.int32) for _ in range(3))
    limbs = np.maximum(-(-sx // LIMB), 1)
    for n in np.unique(limbs):  # texts of like lengths take as many limbs
        some = np.flatnonzero(limbs == n)
        _advance([x[k] for k in some], y, int(n), some, lcs, count, length)
    return _ratio(lcs.T, count.T, length.T, sx[:, None], sy[None, :], kx[:, None], ky[None, :])


def _ratio(lcs: np.ndarray, count: np.ndarray, length: np.ndarray, sx: np.ndarray, sy: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """As `fuzzy.token_set_ratios`; sizes count a space before each word, a text of words has one less."""
    n, na, nb = length - (count > 0), sx - length - (kx > count), sy - length - (ky > count)
    apart = na + nb - 2 * np.where((na > 0) & (nb > 0), lcs - 1, 0)  # both begin with a space
    gap = count > 0
    long_a, long_b = n + gap + na, n + gap + nb
    best = 1 - apart / np.maximum(long_a + long_b, 1)
    both = np.maximum(1 - (gap + na) / np.maximum(n + long_a, 1), 1 - (gap + nb) / np.maximum(n + long_b, 1))
    best = np.where(n > 0, np.maximum(best, both), best)
    best = np.where((n > 0) & ((na == 0) | (nb == 0)), 1.0, best)
    return 100.0 * np.where((n + na == 0) | (n + nb == 0), 0.0, best)


def _advance(x: list[list[str]], y: list[list[str]], limbs: int, at: np.ndarray, lcs: np.ndarray, count: np.ndarray, length: np.ndarray) -> None:
    """Fills the columns `at` of what each text of `y` (rows) shares with those of `x`: subsequence of other words, words, and their length."""
    ours, theirs = {w for t in y for w in t}, {c for t in y for w in t for c in w} | {" "}
    place = {c: k for k, c in enumerate(sorted(theirs))}
    match = np.zeros((len(place), limbs, len(x)), np.uint64)
    where: dict[str, tuple[list[int], list[list[int]]]] = {}
    for k, words in enumerate(x):
        bits: dict[str, int] = {}
        p = 0
        for w in words:
            for q, c in enumerate(" " + w, p):
                if c in place:
                    bits[c] = bits.get(c, 0) | 1 << q
            if w in ours:
                rows, masks = where.setdefault(w, ([], []))
                rows.append(k)
                masks.append(_limbs(((1 << len(w) + 1) - 1) << p, limbs))
            p += len(w) + 1
        for c, v in bits.items():
            match[place[c], :, k] = _limbs(v, limbs)
    known = {w: (np.array(rows), np.array(masks, np.uint64).T) for w, (rows, masks) in where.items()}
    blank = match[place[" "]]
    shape = (limbs, len(x))
    row, hit, apart, total, m = (np.empty(shape, np.uint64) for _ in range(5))
    carry = np.empty(len(x), np.uint64)
    top = np.uint64(LIMB)
    for j, words in enumerate(y):
        mine = np.full(shape, FULL)
        n, size = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
        for w in words:
            if w in known:
                rows, masks = known[w]
                mine[:, rows] &= ~masks
                n[rows] += 1
                size[rows] += len(w) + 1
        row.fill(FULL)
        for w in words:
            use = mine
            if w in known:
                rows = known[w][0]
                if len(rows) == len(x):
                    continue
                use = mine.copy()
                use[:, rows] = 0
            for c in " " + w:
                np.bitwise_and(blank if c == " " else match[place[c]], use, out=m)
                np.bitwise_and(row, m, out=hit)
                np.bitwise_xor(row, hit, out=apart)
                np.add(row, hit, out=total)
                for k in range(limbs - 1):
                    np.right_shift(total[k], top, out=carry)
                    np.add(total[k + 1], carry, out=total[k + 1])
                np.bitwise_and(total, FULL, out=total)
                np.bitwise_or(total, apart, out=row)
        lcs[j, at] = limbs * LIMB - np.bitwise_count(row).sum(0, dtype=np.int32)
        count[j, at], length[j, at] = n, size


def _limbs(bits: int, limbs: int) -> list[int]:
    return [bits >> LIMB * k & (1 << LIMB) - 1 for k in range(limbs)]
