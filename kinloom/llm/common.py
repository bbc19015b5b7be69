"""Small helpers that the training-data operators share.

Nothing here keeps state between queries.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.shared import cut, shared_folder  # noqa: F401

#: Regular expression class of the contracts' word characters' complement.
SPACE = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's readers need to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covered(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether start and end overlap one of the spans, in logarithmic time."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda a, b: (k := bisect_right(ends, a)) < len(ends) and starts[k] < b


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once for a row.

    An expression used inside a lambda is evaluated again for each element;
    a lambda variable is not. So the value becomes the only element of an
    array over which `body` is mapped.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) with 32 bits, from md5, which any SQL engine has."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
