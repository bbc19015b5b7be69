"""Readers of records and truth, and views of the test tables as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.text import normalize_text

RECORDS = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("business_name", T.StringType()), T.StructField("business_address", T.StringType()), T.StructField("country", T.StringType())])
TRUTH = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("matched_entity_ids", T.StringType())])
IDS = T.StructType([T.StructField("source1_entity_id", T.StringType())])

# Whole fields that the tab-separated form reads as missing.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, na: bool = True) -> DataFrame:
    """A tab-separated file with a header, in whichever order its columns stand.

    Quotes are doubled inside quoted fields, which may hold line breaks.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    columns = [F.col(f"`{f.name}`").cast(f.dataType) for f in schema]
    if na:
        columns = [F.when(~c.isin(*NA), c) for c in columns]
    return raw.select(*[c.alias(f.name) for c, f in zip(columns, schema, strict=True)])


def read_records(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Records from Parquet or tab-separated files, by the first path's ending."""
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith((".tsv", ".txt", ".tsv.gz")):
        out = read_tsv(spark, path, RECORDS)
    else:
        out = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*RECORDS.names)
    return out if limit is None else out.limit(limit)


def targets(*sources: DataFrame) -> DataFrame:
    """The bag union of target sources, with `src` counting from 2."""
    out = None
    for k, s in enumerate(sources):
        one = s.select(*RECORDS.names, F.lit(k + 2).alias("src"))
        out = one if out is None else out.unionByName(one)
    return out


def unique_by_id(records: DataFrame) -> DataFrame:
    """One record an id: that of the highest source and then the largest fields."""
    rest = [c for c in ("src", "business_name", "business_address", "country") if c in records.columns]
    best = records.groupBy("entity_id").agg(F.max(F.struct(*rest)).alias("r"))
    return best.select("entity_id", *[F.col("r")[c].alias(c) for c in rest])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def spread(docs: DataFrame) -> DataFrame:
    """`docs` dealt out evenly where they are read in fewer parts than twice the cores: a file's row groups may be few and large."""
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(least, "doc_id") if docs.rdd.getNumPartitions() < least else docs


def fixture(spark: SparkSession, sf_dir: str, address_words: int | None = None, evenly: bool = False) -> DataFrame:
    """`documents` as records of three sources, with `tail` for the truth.

    The first six words are the name, all words after them the address; or so many
    of them, where the queries score addresses as the short fields that they are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = spread(docs) if evenly else docs
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    docs = docs.select("doc_id", "lang", (F.substring("source", 4, 9).cast("int") % 3 + 1).alias("src"), w.alias("w"), normalize_text(F.col("text")).alias("norm"))
    return docs.select(
        F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.array_join(F.slice("w", 1, 6), " ").alias("business_name"),
        F.array_join(F.slice("w", F.lit(7), F.greatest(F.size("w") - 6, F.lit(0)) if address_words is None else F.lit(address_words)), " ").alias("business_address"),
        F.col("lang").alias("country"), "src",
        last_words(F.col("norm")).alias("tail"),
    )


def last_words(normal: Column) -> Column:
    """The last 12 words of a normalised text."""
    w = F.split(normal, " ")
    return F.array_join(F.slice(w, F.greatest(F.size(w) - 11, F.lit(1)), F.lit(12)), " ")


def of_whole(derived: DataFrame) -> DataFrame:
    """`derived` with the tail from the normalised name and address, which hold all of the text's words, instead of normalising the text again."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return derived.withColumn("tail", last_words(F.concat_ws(" ", some("old_name"), some("old_address"))))


def true_counts(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(sid, n_true) of every record, by the targets that share its tail; ids must be distinct."""
    n = targets.groupBy("tail").agg(F.count(F.lit(1)).alias("n_true"))
    return s1.select(F.col("entity_id").alias("sid"), "tail").join(n, "tail", "left").select("sid", F.coalesce("n_true", F.lit(0)).alias("n_true"))


def marked(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds whether a candidate is a true pair: `true`, by its tails; ids must be distinct."""
    a = s1.select(F.col("entity_id").alias("sid"), F.col("tail").alias("__a"))
    b = targets.select(F.col("entity_id").alias("tid"), F.col("tail").alias("__b"))
    return candidates.join(a, "sid").join(b, "tid").withColumn("true", F.col("__a") == F.col("__b")).drop("__a", "__b")


def fixture_pairs(records: DataFrame) -> DataFrame:
    """True pairs (sid, tid) of the fixture: equal tails."""
    s = records.filter("src = 1").select("tail", F.col("entity_id").alias("sid"))
    t = records.filter("src > 1").select("tail", F.col("entity_id").alias("tid"))
    return s.join(t, "tail").select("sid", "tid")


def packed_truth(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edge form: each source 1 id and its comma-packed sorted matches."""
    ids = pairs.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("tid")), ",").alias("m"))
    return s1.select(F.col("entity_id").alias("sid")).join(ids, "sid", "left").select(F.col("sid").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
