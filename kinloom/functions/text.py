"""Normalisation, canonical forms, token and gram sets as column expressions.

Only Unicode folding needs Python, and only for rows that aren't ASCII: others pass
null to the Arrow function and take built-in functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .vocabulary import ADDRESS_LONG, ADDRESS_SHORT, LEGAL, LEGAL_SUFFIXES

ASCII = r"^[\x00-\x7F]*$"
WORD = r"[\p{L}\p{N}_]+"


class _Plain(dict):
    """For str.translate: combining marks go, punctuation is a space; each character is looked up once."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = out = None if unicodedata.combining(c) else 32 if unicodedata.category(c)[0] == "P" else code
        return out


_PLAIN = _Plain()
#: The same of ASCII alone, which str.translate does without a look-up of each character.
_PLAIN_ASCII = {c: " " for c in range(128) if unicodedata.category(chr(c))[0] == "P"}
#: The marks of most texts: texts that have no others and are else ASCII drop them at once.
_MARKS = "\u0300\u0301\u0302\u0303\u0308\u030a\u0327"


def folded(x: str) -> str:
    """Case-folded, decomposed, without combining marks; punctuation is a space."""
    whole = unicodedata.normalize("NFKD", x.casefold())
    plain = whole.encode("ascii", "ignore").decode("ascii")
    if len(whole) - len(plain) == sum(map(whole.count, _MARKS)):
        return " ".join(plain.translate(_PLAIN_ASCII).split())
    return " ".join(whole.translate(_PLAIN).split())


def folded_ascii(x: str) -> str:
    """Lower case, decomposed, without combining marks; all but a-z and 0-9 is a space."""
    out = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in out).split())


@F.pandas_udf(StringType())
def _fold(x: pd.Series) -> pd.Series:
    return x.map(folded, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_ascii(x: pd.Series) -> pd.Series:
    return x.map(folded_ascii, na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(x: pd.Series) -> pd.Series:
    return x.map(str.casefold, na_action="ignore")


def _either(x: Column, native: Column, python) -> Column:
    ascii_only = x.rlike(ASCII)
    return F.coalesce(F.when(ascii_only, native).otherwise(python(F.when(~ascii_only, x))), F.lit(""))


def normalize_text(x: Column) -> Column:
    native = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\p{P}", " "), r"[\s\x1c-\x1f]+", " "))
    return _either(x, native, _fold)


def normalize_ascii(x: Column) -> Column:
    return _either(x, F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), _fold_ascii)


def casefold(x: Column) -> Column:
    return _either(x, F.lower(x), _casefold)


def tokens(x: Column) -> Column:
    """The set of words of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))


def raw_tokens(x: Column) -> Column:
    """The set of words of a text that is only case-folded."""
    return tokens(casefold(x))


def _mapped(normal: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(F.filter(F.split(normal, " "), lambda t: t != ""), lambda t: F.coalesce(F.element_at(known, t), t))


def strong_name(normal: Column) -> Column:
    """Legal suffixes in canonical form; order and repetitions stay."""
    return F.array_join(_mapped(normal, LEGAL), " ")


def core_name(normal: Column) -> Column:
    """The sorted words of the strong name without legal suffixes."""
    words = F.array_except(_mapped(normal, LEGAL), F.array(*map(F.lit, LEGAL_SUFFIXES)))
    return F.array_join(F.sort_array(words), " ")


def strong_address_tokens(normal: Column, long: bool = False) -> Column:
    return F.sort_array(F.array_distinct(_mapped(normal, ADDRESS_LONG if long else ADDRESS_SHORT)))


def strong_address(normal: Column, long: bool = False) -> Column:
    return F.array_join(strong_address_tokens(normal, long), " ")


def char_grams(x: Column, n: int = 3) -> Column:
    """The set of windows of `n` letters and digits, across spaces."""
    letters = F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]"), F.lit(0))
    window = lambda l: F.transform(F.sequence(F.lit(0), F.size(l) - n), lambda i: F.concat(*[F.get(l, i + k) for k in range(n)]))  # noqa: E731, E741
    # A lambda variable is computed once for a row, an expression inside a lambda once for each window.
    of = F.transform(F.array(letters), lambda l: F.when(F.size(l) >= n, F.array_distinct(window(l))).otherwise(F.array().cast("array<string>")))  # noqa: E741
    return F.get(of, F.lit(0))


def digits(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\p{Nd}+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def hashed(words: Column) -> Column:
    """64-bit hashes of a set's words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def jaccard_of(a: Column, b: Column, both: Column) -> Column:
    """`jaccard` from the sizes of two sets and of what they share."""
    return F.when(a + b == both, F.lit(0.0)).otherwise(both / (a + b - both))


def digit_jaccard(a: Column, b: Column) -> Column:
    """-1 if neither text has digits, 0 if one has none."""
    x, y = digits(a), digits(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(-1.0)).otherwise(jaccard(x, y))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / (F.greatest(F.length(a), F.length(b)) + F.lit(1e-5))


def parse_ids(packed: Column) -> Column:
    """The set of a comma-packed list of ids; blank or null is empty. Ids aren't stripped."""
    blank = F.trim(F.coalesce(packed, F.lit(""))) == ""
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(packed, ",")))


def score_bin(score: Column) -> Column:
    """Twentieths, ties to even."""
    return F.bround(score * 20, 0) / 20


def quantised(score: Column, most: int = 1000) -> Column:
    """Thousandths, ties to even, clamped to 0..most."""
    return F.least(F.greatest(F.bround(score * 1000, 0), F.lit(0.0)), F.lit(float(most))).cast("int")
