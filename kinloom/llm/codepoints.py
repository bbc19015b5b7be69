"""Texts as numpy arrays of code points, with tables by code point."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LIMIT = 0x110000
GAP = "\n"

# First code points of the main blocks of scripts, and the scripts' names.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "other"),
    (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD800, "other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "other"), (0x20000, "Han"), (0x323B0, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(LIMIT)), bool, LIMIT)


@lru_cache(1)
def lower() -> np.ndarray:
    """The lower-case code point, where that is a single one."""
    out = np.arange(LIMIT, dtype=np.uint32)
    for c in np.flatnonzero(letters()[:0x20000]).tolist():
        if len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


@lru_cache(1)
def scripts() -> np.ndarray:
    """The number in SCRIPTS of each code point's script."""
    out = np.empty(LIMIT, np.uint8)
    for (start, name), (end, _) in zip(SCRIPT_STARTS, (*SCRIPT_STARTS[1:], (LIMIT, "")), strict=True):
        out[start:end] = SCRIPTS.index(name)
    return out


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with a gap character after each, and the texts' starts."""
    codes = np.frombuffer((GAP.join(texts) + GAP).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes, starts


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal values."""
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    bounds = np.concatenate(([0], edge, [len(same)]))
    return bounds[:-1], bounds[1:]
