"""Chat formatting: logged snapshots of a growing conversation collapse into it.

A log often holds each state of a conversation. Each turn is hashed with its place;
the rolling sums of these hashes give a digest of each prefix of turns, so a
conversation is a snapshot of a longer one exactly if its last digest is among the
other's earlier digests. One anti-join of last digests against all distinct earlier
digests leaves maximal conversations; of equal ones the smallest conv_id stays.
Only those are rendered.

Rolling sums are made by a window over a conversation's turns, linear in their number,
and can spill. Digests, not turns, are joined. Earlier digests are made distinct with
a partial aggregate, so a first turn that a third of all conversations share is one
row a task. A conversation's turns meet in one task, as its rendered text is one
row; no other group does.

Defined results: a null role renders as `unknown`, a null text as an empty one;
turns are ordered by turn (null first), then role, then text; a turn row that
repeats exactly within its conversation counts once; each row without conv_id is a
conversation of one turn, as nothing says which belong together; in a rendered text
the markers' strings in roles and texts are escaped (`<|im_end|>` as `<\\|im_end|>`) and
line breaks in roles are spaces; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Parts of a hash that are summed by themselves, and hexadecimal digits of each: sums of 8 million turns stay below 2^63.
PARTS, DIGITS = 6, 10
MARKER, ESCAPED = r"<\|(im_start|im_end)\|>", r"<\\|$1|>"


def framed(role: Column, text: Column) -> Column:
    """A turn with its lengths, so that no two lists of turns read the same."""
    return F.concat(F.length(role).cast("string"), F.lit(":"), role, F.length(text).cast("string"), F.lit(":"), text)


def hashed(place: Column, role: Column, text: Column) -> list[Column]:
    """The parts of a turn's hash, as numbers."""
    h = F.sha2(F.concat(place.cast("string"), F.lit(":"), framed(role, text)), 256)
    return [F.conv(F.substring(h, DIGITS * k + 1, DIGITS), 16, 10).cast("bigint") for k in range(PARTS)]


def digest(place: Column, sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws(".", place.cast("string"), *[s.cast("string") for s in sums]), 256)


def rendered_turn(role: Column, text: Column) -> Column:
    """ChatML text of a turn."""
    safe = lambda x: F.regexp_replace(x, MARKER, ESCAPED)
    return F.concat(F.lit("<|im_start|>"), safe(F.translate(role, "\r\n", "  ")), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_turns, role, text): each different turn, with its prefix's digest."""
    same = F.struct("turn", "role", "text")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole, upto = W.partitionBy("conv_id"), order.rowsBetween(W.unboundedPreceding, W.currentRow)
    new = turns.withColumn("before", F.lag(same).over(order)).filter(~F.col("before").eqNullSafe(same))
    placed = new.drop("before").withColumn("place", F.row_number().over(order)).withColumn("n_turns", F.count(F.lit(1)).over(whole))
    parts = hashed(F.col("place"), F.col("role"), F.col("text"))
    summed = placed.select("*", *[x.alias(f"h{k}") for k, x in enumerate(parts)]).select("*", *[F.sum(f"h{k}").over(upto).alias(f"s{k}") for k in range(PARTS)])
    return summed.select("conv_id", "place", digest(F.col("place"), [F.col(f"s{k}") for k in range(PARTS)]).alias("digest"), "n_turns", "role", "text")


def collapse(conversations: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies, rendered."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = cut(prefixes(turns.filter("conv_id IS NOT NULL")))
    one = F.lit(1)
    alone = turns.filter("conv_id IS NULL").groupBy("role", "text").agg(F.count(one).alias("copies"))
    alone = alone.withColumn("digest", digest(one, hashed(one, F.col("role"), F.col("text"))))
    earlier = named.filter("place < n_turns").select("digest").distinct()
    last = named.filter("place = n_turns").select("digest", "conv_id", F.lit(1).cast("bigint").alias("copies")).unionByName(alone.selectExpr("digest", "CAST(NULL AS BIGINT) AS conv_id", "copies").withColumn("conv_id", F.col("conv_id").cast(named.schema["conv_id"].dataType)))
    kept = cut(last.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_copies")).join(earlier, "digest", "left_anti"))
    piece = rendered_turn(F.col("role"), F.col("text")).alias("piece")
    whole = named.select("conv_id", "place", piece).join(kept.select("conv_id", "n_copies").filter("conv_id IS NOT NULL"), "conv_id")
    whole = whole.groupBy("conv_id", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    whole = whole.select("conv_id", F.size("pieces").cast("bigint").alias("n_turns"), "n_copies", F.array_join("pieces.piece", "").alias("rendered"))
    rest = alone.select("digest", piece).join(kept.filter("conv_id IS NULL"), "digest")
    return whole.unionByName(rest.select("conv_id", F.lit(1).cast("bigint").alias("n_turns"), "n_copies", F.col("piece").alias("rendered")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH m AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN 'r' || row_number() OVER () ELSE 'c' || conv_id END AS k, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT DISTINCT * FROM m),
c AS (SELECT conv_id, k, count(*) AS n_turns,
  string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY turn NULLS FIRST, role, text) AS s,
  string_agg('<|im_start|>' || regexp_replace(translate(role, chr(13) || chr(10), '  '), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered FROM d GROUP BY conv_id, k)
SELECT min(a.conv_id) AS conv_id, a.n_turns, count(*) AS n_copies, a.rendered FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n_turns > a.n_turns AND starts_with(b.s, a.s)) GROUP BY a.s, a.n_turns, a.rendered
"""
