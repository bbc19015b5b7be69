"""Derived columns of records, and their blocking keys as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.config import ErConfig
from kinloom.functions import text as X

CONSTANT = ("exact", "core", "addr")
TOKENS = ("ntok", "atok")
GRAMS = ("ngram", "agram")
KINDS = CONSTANT + TOKENS + GRAMS


def derive(records: DataFrame, cfg: ErConfig) -> DataFrame:
    """Normalised and canonical texts beside the record's other columns."""
    normal = records.withColumns({"old_name": X.normalize_text(F.col("business_name")), "old_address": X.normalize_text(F.col("business_address"))})
    return normal.withColumns({"core_name": X.core_name(F.col("old_name")), "strong_address": X.strong_address(F.col("old_address"), cfg.long_addresses)})


def blocking_keys(derived: DataFrame, cfg: ErConfig, kinds: tuple[str, ...] = KINDS, also: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, country, <also>, kind, key): every key of a record, in one pass.

    Empty keys don't block, except the exact name where the configuration says
    so. Records without a country have no keys.
    """
    one = lambda c: F.array(F.col(c))
    of = {
        "exact": one("old_name"), "core": one("core_name"), "addr": one("strong_address"),
        "ntok": X.tokens(F.col("old_name")), "atok": X.tokens(F.col("old_address")),
        "ngram": X.char_grams(F.col("core_name")), "agram": X.char_grams(F.col("strong_address")),
    }

    def of_kind(kind: str):
        return F.transform(of[kind], lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    rows = F.flatten(F.array(*map(of_kind, kinds)))
    out = derived.filter("country IS NOT NULL").select("entity_id", "country", *also, F.explode(rows).alias("k")).select("entity_id", "country", *also, "k.kind", "k.key")
    empty = (F.col("key") != "") | ((F.col("kind") == "exact") & F.lit(cfg.allow_empty_exact_name))
    return out.filter(empty)
