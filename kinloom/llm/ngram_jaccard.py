"""N-gram Jaccard self-join: a blocked sparse product of documents by n-grams.

Documents link when their sets of word shingles have a Jaccard similarity of at
least p / q (`Join`: op8's query takes 3 words and 9 / 10). With sizes X and Y and
overlap I that is (p + q) I >= p (X + Y): the overlap has a bound that follows from
the sizes.

The incidence matrix has a row for each distinct set and a column for each shingle
(its hash). The product of the matrix with its transpose has the overlaps. It is
made in three parts, each of which adds to a cell or discards it.

Prefix columns form cells. Columns are put in one order, rare ones first: all
shingles are counted in 2^`bits` ranges of hashes, and a column's place is the power
of two of its range's count, then its hash. Any order is right, and rare first is
cheap. A row's first n - ceil(n p / q) + 1 columns are its prefix, and two rows that
link share a column of both prefixes. On the first such column, what is left of
both must hold the bound. A column with few rows forms a cell of each two of them.
In a longer one, the row that shares most with others is the column's pivot, and
cells are formed for the pivot with each other row, so a group's cost is linear in
its size. Cells above their bound are links; linked rows merge. A long column is done
if its rows but the pivot are one component. What is left of long columns is ordered
again by exact counts among those rows, and a pair forms a cell where its rows are of
different components and the bound is in reach.

Blocks of columns bound cells. The range of hashes is cut into `blocks` blocks. A
row has its number of shingles in each, and a cell's overlap is at most the sum of
the lesser of both numbers; cells below their bound go before any product.

Steps of blocks accumulate. The blocks are multiplied in `steps` steps; each adds
the overlap in its blocks, and a cell goes when what it has and what the later blocks
can still give are below its bound. Texts are fetched once, for rows with a cell or
in a long column. Cells are multiplied in passes over the rows, and what a part of the
work has dealt out goes before the next begins, so disk holds the sets once and a share
of what the cells take along.
Nothing is capped or sampled: every pair that can link is linked or already
connected when the last step ends.

Counts, pivots and components are minima, maxima and sums with partial aggregates,
kept before they are joined to rows, so that a join can be split where a key is hot.

Defined results: a null or wordless text has 0 shingles and only itself as its
component; fewer words than a shingle's are one shingle; a row without doc_id has a null
component; where one doc_id has different texts, one of them (that of the smallest
digest) stands for it; an empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import enter, map_texts, parts, sent_small
from .common import cut, table
from .components import connected_components

U = np.uint64
P1, P2, P3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


@dataclass(frozen=True)
class Join:
    shingle: int = 3
    #: The least Jaccard similarity of a link, as a fraction.
    p: int = 9
    q: int = 10
    #: In columns of at most so many rows, cells are formed for each two of them.
    small_block: int = 64
    #: Ranges of hashes that are counted for the order: 2 to this power, a byte each.
    bits: int = 22
    #: Blocks of columns (a power of two), and steps in which they are multiplied.
    blocks: int = 64
    steps: int = 4
    #: Passes in which prefix columns are dealt out.
    passes: int = 3
    #: Ids of texts to fetch are broadcast if they were counted and are no more than this (16 bytes each); else texts and ids are dealt out.
    broadcast_ids: int = 100_000
    #: Cells are multiplied in passes of at most this share of their rows' shingles, or of so many shingles if that is more; in `most_passes` at most.
    pass_share: float = 0.5
    pass_shingles: int = 8_000_000
    most_passes: int = 16


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * P1
    x = (x ^ (x >> U(29))) * P2
    return x ^ (x >> U(32))


def sets_of(texts: list[str], size: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles.

    bytes.lower and bytes.split treat exactly A-Z and the six white spaces.
    """
    from xxhash import xxh64_intdigest as h64

    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64).tolist()
    h = np.fromiter(map(h64, chain.from_iterable(words)), U, ends[-1] if ends else 0)
    x = chained(h, size)
    out = []
    for start, end in zip([0, *ends], ends, strict=False):
        n = end - start
        s = np.sort(x[start : end - size + 1] if n >= size else chained(h[start:end], n) if n else x[:0])
        out.append(s[np.flatnonzero(np.diff(s, prepend=~s[:1]))])
    return out


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each `size` hashes that follow each other."""
    n = max(0, len(h) - size + 1)
    x = np.full(n, size, U)
    for k in range(size):
        x = mixed(x * P3 + h[k : k + n])
    return x


def shingles(text: str, size: int = 3) -> np.ndarray:
    return sets_of([text], size)[0]


#: Rows in which a task gives its counts of hash ranges.
SLICES = 64


def levels(docs: DataFrame, how: Join) -> np.ndarray:
    """The power of two of each hash range's count, over all documents; 2^bits bytes.

    A task counts in one array and gives it compressed, in slices; slices are summed.
    """
    size, shift, n = how.shingle, U(64 - how.bits), 1 << how.bits
    each = n // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        total = np.zeros(n, np.int64)
        for _, texts in parts(batches, 0):
            np.add.at(total, (np.concatenate(sets_of(texts, size)) >> shift).astype(np.int64), 1)
        told = [pa.compress(total[k : k + each], codec="zstd", asbytes=True) for k in range(0, n, each)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(told, pa.binary())], names=["slice", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, told in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(pa.decompress(told.as_buffer(), each * 8, codec="zstd"), np.int64)
                total[k] = total.get(k, 0) + got
        level = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], names=["slice", "level"])

    told = sent_small(docs.select("text")).mapInArrow(run, "slice int, n binary").repartition("slice").mapInArrow(summed, "slice int, level binary")
    out = np.zeros((SLICES, each), np.uint8)
    for row in told.collect():
        out[row["slice"]] = np.frombuffer(row["level"], np.uint8)
    return out.ravel()


def prefix(s: np.ndarray, level: np.ndarray, how: Join) -> np.ndarray:
    """The first n - ceil(n p / q) + 1 of a sorted set, in the order of all columns."""
    place = level[(s >> U(64 - how.bits)).astype(np.int64)]
    return s[np.argsort(place, kind="stable")[: len(s) - -(-len(s) * how.p // how.q) + 1]]


def _rows(how: Join, level: np.ndarray) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    shift = U(65 - how.blocks.bit_length())

    def row(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, None, None, None
        sizes = np.bincount((s >> shift).astype(np.int64), minlength=how.blocks)
        return len(s), hashlib.md5(s.tobytes()).digest(), prefix(s, level, how).view(np.int64), sizes.astype(np.int32)

    return lambda: lambda texts: [row(s) for s in sets_of(texts, how.shingle)]


def _sets(how: Join) -> Callable[[], Callable[[list[str]], list[tuple]]]:
    """A text's set, cut into its steps."""
    edges = np.array([((1 << 64) * k // how.steps) for k in range(1, how.steps)], U)
    return lambda: lambda texts: [([x.view(np.int64) for x in np.split(s, np.searchsorted(s, edges))],) for s in sets_of(texts, how.shingle)]


def release(spark: SparkSession) -> None:
    """Lets the driver find shuffles and checkpoints that nothing refers to any more, so that their files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reached(overlap: Column, how: Join) -> Column:
    """Whether the overlap of rows of sizes `na` and `nb` reaches its bound."""
    return overlap * (how.p + how.q) >= (F.col("na") + F.col("nb")) * how.p


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, y: acc + y)


def bounded(pairs: DataFrame, reps: DataFrame, how: Join) -> DataFrame:
    """(a, b, na, nb, left) of the cells that their blocks' sizes leave within reach.

    left: what the blocks of each step and those after it can give at most.
    """
    mine, theirs = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sizes").alias(f"z{x}")) for x in "ab")
    least = F.zip_with("za", "zb", lambda x, y: F.least(x, y))
    both = pairs.select("a", "b").join(mine, "a").join(theirs, "b").withColumn("least", least)
    each = how.blocks // how.steps
    both = both.withColumn("left", F.array(*[total(F.slice("least", k * each + 1, how.blocks)) for k in range(how.steps)]))
    return both.filter(reached(F.col("left")[0], how)).select("a", "b", "na", "nb", "left")


def n_passes(cells: DataFrame, how: Join) -> int:
    """In how many passes cells are multiplied: a cell takes its row a's set along, and there may be many more cells than rows."""
    ends = cells.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("na").alias("n")), F.struct(F.col("b").alias("rep"), F.col("nb").alias("n")))).alias("e"))
    taken = cells.agg(F.sum("na")).first()[0] or 0
    held = ends.select("e.*").distinct().agg(F.sum("n")).first()[0] or 0
    return min(how.most_passes, max(1, math.ceil(taken / max(how.pass_share * held, how.pass_shingles))))


def multiplied(cells: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The cells (a, b) whose overlap, accumulated step by step, reaches its bound.

    They are multiplied in passes, each over its share of the rows a, so that only a share of the sets that are
    dealt out is on disk at once.
    """
    out, n = None, n_passes(cells, how)
    for k in range(n):
        part = cut(product(cells.filter(F.pmod(F.xxhash64("a"), F.lit(n)) == k), sets, how))
        out = part if out is None else out.unionByName(part)
        release(cells.sparkSession)
    return out


def among(sets: DataFrame, wanted: DataFrame, how: Join) -> DataFrame:
    """The rows of `sets` that `wanted` (rep) names; few ids are broadcast, so that other sets aren't dealt out."""
    ids = cut(wanted.distinct())
    return sets.join(F.broadcast(ids) if ids.count() <= how.broadcast_ids else ids, "rep", "left_semi")


def product(cells: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The cells (a, b) whose overlap reaches its bound.

    A step's blocks are multiplied only while the cell's bound is in reach.
    """
    sets = among(sets, cells.select(F.explode(F.array("a", "b")).alias("rep")), how)
    mine, theirs = (sets.select(F.col("rep").alias(x), F.col("steps").alias(f"s{x}")) for x in "ab")
    both = cells.join(mine, "a").join(theirs, "b")
    step = lambda so_far, x: F.when(reached(so_far + x["left"], how), so_far + F.size(F.array_intersect(x["sa"], x["sb"]))).otherwise(F.lit(-1).cast("bigint"))
    # A cell that went has -1.
    overlap = F.aggregate(F.arrays_zip("sa", "sb", "left"), F.lit(0).cast("bigint"), lambda so_far, x: F.when(so_far < 0, so_far).otherwise(step(so_far, x)))
    return both.filter(reached(overlap, how)).select("a", "b")


def with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links).withColumnRenamed("node", "rep")
    return rows.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def met(rows: DataFrame, how: Join) -> DataFrame:
    """Pairs (a < b) of different components that share a column s, where the bound is in reach.

    rows: (s, rep, n, pos, component); pos is the column's place in the row's order, from 0.
    """
    a, b = (rows.select("s", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("pos").alias(f"p{x}")) for x in "ab")
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return a.join(b, (a["s"] == b["s"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & reached(rest, how)).select("a", "b")


def rarest_first(rows: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """Pairs that the prefixes by exact counts among `rows` (rep, n, component; distinct) leave."""
    entries = cut(rows.join(among(sets, rows.select("rep"), how), "rep").select("rep", "n", "component", F.explode(F.flatten("steps")).alias("s")))
    often = cut(entries.groupBy("s").agg(F.count(F.lit(1)).alias("df")))
    ordered = entries.join(often, "s").groupBy("rep", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("es"))
    first = F.slice("es", F.lit(1), (F.col("n") - F.ceil(F.col("n") * how.p / how.q) + 1).cast("int"))
    p = ordered.select("rep", "n", "component", F.posexplode(first).alias("pos", "e")).filter("e.df > 1")
    return met(cut(p.select("rep", "n", "component", "pos", F.col("e.s").alias("s"))), how)


def represented(every: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, n, prefix, sizes): one row for each group of equal sets."""
    reps = every.join(groups.select(F.col("rep").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi").dropDuplicates(["doc_id", "set_hash"])
    return cut(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "prefix", "sizes"))


def sharing(reps: DataFrame, how: Join) -> DataFrame:
    """(s, rep, n, pos, rows): the prefix columns that at least two rows share.

    Columns are dealt out in passes, each over its share of the hashes, so that only a share is on disk at once.
    """
    out = None
    for k in range(how.passes):
        entries = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "s")).filter(F.pmod("s", F.lit(how.passes)) == k)
        often = cut(entries.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
        release(reps.sparkSession)
        part = cut(entries.join(often, "s"))
        out = part if out is None else out.unionByName(part)
        del often
        release(reps.sparkSession)
    return out


def pivoted(shared: DataFrame) -> DataFrame:
    """Adds each column's pivot, the row that shares most with others, its size and place."""
    weight = cut(shared.groupBy("rep").agg(F.sum("rows").alias("weight")))
    own = F.struct("weight", (-F.col("rep")).alias("minus"), "n", "pos")
    pivots = cut(shared.join(weight, "rep").groupBy("s").agg(F.max(own).alias("p")))
    return cut(shared.join(pivots.select("s", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("np"), F.col("p.pos").alias("pp")), "s"))


def starred(shared: DataFrame, how: Join) -> DataFrame:
    """Cells (a, b) of each row with its columns' pivots."""
    rest = F.least(F.col("na") - F.col("pos"), F.col("nb") - F.col("pp"))
    cells = shared.filter(F.col("rep") != F.col("pivot")).withColumnsRenamed({"rep": "a", "pivot": "b", "n": "na", "np": "nb"})
    return cells.filter(reached(rest, how)).select("a", "b").distinct()


def fetched(docs: DataFrame, one: DataFrame, wanted: DataFrame, how: Join) -> DataFrame:
    """(rep, steps): the sets of the wanted rows, cut into steps, from their texts."""
    named = cut(one.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "version"))
    if named.count() <= how.broadcast_ids:
        named = F.broadcast(named)
    texts = docs.withColumn("version", version(F.col("text"))).join(named, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return cut(map_texts(texts, _sets(how), "steps array<array<long>>", keep=["doc_id"]).withColumnRenamed("doc_id", "rep"))


def version(text: Column) -> Column:
    """Tells apart the texts of one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unfinished(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, n, component), distinct, of columns whose rows besides the pivot are of several components."""
    rest = cut(with_component(shared.filter(F.col("rep") != F.col("pivot")).select("s", "rep", "n"), links))
    several = cut(rest.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("s"))
    return cut(rest.join(several, "s").select("rep", "n", "component").distinct())


def linked(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One row a row of `docs`: doc_id, version (of its text), n_shingles, component_id, stands.

    stands: whether the row's text is the one that stands for its doc_id.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    rows = docs.withColumn("version", version(F.col("text")))
    every = cut(map_texts(rows, _rows(how, levels(docs, how)), "n_shingles long, set_hash binary, prefix array<long>, sizes array<int>", keep=["doc_id", "version"]))
    brief = cut(every.select("doc_id", "version", "n_shingles", "set_hash"))
    first = brief.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("set_hash", "version")).alias("m"))
    one = cut(first.select("doc_id", "m.set_hash", "m.version"))
    groups = cut(one.groupBy("set_hash").agg(F.min("doc_id").alias("rep")))
    reps = represented(every, groups)
    del every, rows
    release(spark)
    shared = sharing(reps, how)
    few = shared.filter(F.col("rows") <= how.small_block).withColumn("component", F.col("rep"))
    many = pivoted(shared.filter(F.col("rows") > how.small_block))
    cells = cut(bounded(met(few, how).union(starred(many, how)).distinct(), reps, how))
    # Of all rows, only those of long columns may be bounded again; prefixes and shared columns have done their work.
    reps = cut(reps.select("rep", "n", "sizes").join(many.select("rep").distinct(), "rep", "left_semi"))
    del shared, few
    release(spark)
    sets = fetched(docs, one, cells.select(F.explode(F.array("a", "b")).alias("rep")).union(many.select("rep")), how)
    release(spark)  # the texts that were dealt out go before sets are
    links = multiplied(cells, sets, how)
    del cells
    release(spark)
    rest = unfinished(many, links)
    if not rest.isEmpty():
        cells = cut(bounded(rarest_first(rest, sets, how).distinct(), reps, how))
        release(spark)
        links = cut(links.union(multiplied(cells, sets, how)))
        del cells
    del sets
    del many, rest, reps
    release(spark)
    found = connected_components(links).withColumnRenamed("node", "rep")
    by_hash = groups.join(found, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    by_doc = one.join(by_hash, "set_hash").select("doc_id", "component_id", F.col("version").alias("own"))
    out = brief.select("doc_id", "version", "n_shingles").join(by_doc, "doc_id", "left")
    return out.select("doc_id", "version", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("version") == F.col("own"), F.lit(True)).alias("stands"))


def join(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    return linked(docs, how).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of `docs` that stay: of each component, one of the smallest doc_id.

    Of one id's different texts that stays which was compared. Rows without doc_id
    aren't compared; of those with equal texts one stays.
    """
    stay = cut(linked(docs, how).filter("component_id = doc_id AND stands").groupBy("doc_id").agg(F.min("version").alias("__version")))
    release(docs.sparkSession)
    named = docs.withColumn("__version", version(F.col("text"))).join(stay, ["doc_id", "__version"], "left_semi").dropDuplicates(["doc_id", "__version"])
    return named.drop("__version").unionByName(docs.filter("doc_id IS NULL").dropDuplicates(["text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
