"""Quality rules: one table of thresholds, compiled into a Spark projection.

Every measure is a built-in expression over the text, so a scan with one
projection answers the whole table: no shuffle, no user function, and memory
bounded by the largest single text.

Defined results: a null text counts as empty and fails; an empty text has zero
counts and fails; repeated rows give repeated results; an empty table gives an
empty result. Only `doc_id` and `text` are read, so extra columns of any name
do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table

WINDOW = 8

# Function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as be at by this are from or an "
    "der die und den das ist ein zu von mit auf im für dem eine "
    "de la le les des et un une que du est en pour dans qui par sur pas "
    "el los las y por con para se del lo su al una"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`low <= numerator / denominator <= high`; an open side is None."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are compared as products, so no division rounds.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2, high=40),
    Rule("symbols per word", "n_symbols", "n_words", high=0.5),
    Rule("shouts per word", "n_shouts", "n_words", high=0.5),
    Rule("stop words per word", "n_stop", "n_words", low=0.01),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found at least twice in the array.

    Window hashes are 64 bits wide. Most texts have no repeated window and end
    at the comparison with the distinct hashes; others sort (hash, position)
    and add up what each repeated window covers beyond the one before.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            places = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
            step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(pairs, of_sorted))

    def windows(h: Column) -> Column:
        every = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(every, F.lit(1), F.size(h) - (WINDOW - 1))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("bigint")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of the table's rules over the measures' columns."""
    kept = ~F.col("base_failed")
    for r in rules:
        n, d = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        if r.low is not None:
            kept = kept & (n >= d * F.lit(float(r.low)))
        if r.high is not None:
            kept = kept & (n <= d * F.lit(float(r.high)))
    return kept


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the measures, `base_failed` and `kept`.

    Input columns that have one of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(t, f"{SPACE}+", "")
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    counts = F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
            ),
        ).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("bigint").alias("n_shouts"),
    )
    m = F.col("__m")
    flat = docs.withColumn("__m", counts).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in OUTPUTS],
        *[m["w"][x].alias(x) for x in ("n_words", "n_repeat_words", "n_stop")],
        *[m["l"][x].alias(x) for x in ("n_lines", "n_dup_lines")],
        *[m[x].alias(x) for x in ("word_chars", "n_symbols", "n_shouts")],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return flat.withColumn("base_failed", failed).withColumn("kept", verdict(rules))


OUTPUTS = {"n_words", "n_repeat_words", "n_stop", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_shouts", "base_failed", "kept", "__m"}
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def _sql_verdict() -> str:
    parts = ["NOT base_failed"]
    for r in RULES:
        if r.low is not None:
            parts.append(f"{r.numerator}::DOUBLE >= {r.denominator}::DOUBLE * {float(r.low)}::DOUBLE")
        if r.high is not None:
            parts.append(f"{r.numerator}::DOUBLE <= {r.denominator}::DOUBLE * {float(r.high)}::DOUBLE")
    return " AND ".join(parts)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
p AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
c AS (SELECT rid, sum(k) AS n FROM (SELECT rid, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {WINDOW})) AS k FROM p) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ({_sql_verdict()}) AS kept FROM b
"""
