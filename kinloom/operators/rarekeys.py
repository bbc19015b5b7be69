"""Words and grams of records, counted and filtered in batches: frequent keys are never rows.

Most rows of keys are of keys beyond the limits, and these are too many to be broadcast.
So a task counts its keys before they are rows, and the keys within the limits go into a table
of bits, by a hash: only keys that hit one become rows. The table has one size at every input.
A key may hit another's bit, so what passes is a superset, and a join with the counts follows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .derive import GRAMS, TOKENS

#: Bits of a key's hash that are its place in the table: 2^27 bits are 16 MB.
BITS = 27
#: Bytes of one column's texts that are handled at once; a longer text is handled alone.
BYTES = 4 << 20
#: The text of each kind.
TEXT = {"ntok": "old_name", "atok": "old_address", "ngram": "core_name", "agram": "strong_address"}
COUNTED = "kind string, country string, key string, n long"
PASSED = "entity_id string, country string, kind string, key string"


def _texts(derived: DataFrame, *also: str) -> DataFrame:
    """Texts with only their words (split by spaces) or only letters, digits and spaces, of records with a country."""
    words = [F.regexp_replace(TEXT[k], r"[^\p{L}\p{N}_ ]+", " ").alias(k) for k in TOKENS]
    letters = [F.regexp_replace(TEXT[k], r"[^\p{L}\p{N} ]+", "").alias(k) for k in GRAMS]
    return derived.filter("country IS NOT NULL").select(*also, "country", *words, *letters)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most `BYTES` of a column."""
    for batch in batches:
        sizes = np.max([pc.binary_length(batch[k]).to_numpy(zero_copy_only=False) for k in TEXT], axis=0) if len(batch) else np.zeros(0)
        total, at = np.cumsum(sizes), 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows, each row's words as places among the different ones, and these."""
    split = pc.split_pattern(texts, " ")
    of = split.flatten().dictionary_encode()
    row, code = pc.list_parent_indices(split).to_numpy(), of.indices.to_numpy()
    some = pc.not_equal(of.dictionary, "").to_numpy(zero_copy_only=False)[code]
    return row[some], code[some], of.dictionary


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Likewise of windows of three characters but spaces: 21 bits each, so a window is one number."""
    char = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    some = char != 32
    char, row = char[some].astype(np.int64), row[some]
    inside = row[:-2] == row[2:]
    of = pa.array(((char[:-2] << 42) | (char[1:-1] << 21) | char[2:])[inside]).dictionary_encode()
    gram = of.dictionary.to_numpy()
    text = np.stack([gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return row[:-2][inside], of.indices.to_numpy(), pa.array([text[k : k + 3] for k in range(0, len(text), 3)], pa.string())


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """By kind, each row's set of keys: rows, places among the different keys, and these."""
    for kind in TEXT:
        row, code, keys = (_words if kind in TOKENS else _grams)(batch[kind])
        if len(row):
            both = np.sort(row.astype(np.int64) * len(keys) + code)
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            yield kind, both // len(keys), both % len(keys), keys


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and each number's place among them."""
    of = pa.array(x).dictionary_encode()
    return of.dictionary.to_numpy(), of.indices.to_numpy()


def _countries(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    of = batch["country"].dictionary_encode()
    return of.indices.to_numpy().astype(np.int64), of.dictionary


def counted(targets: DataFrame) -> DataFrame:
    """(kind, country, key, df): how many records have each word and gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            place, countries = _countries(batch)
            for kind, row, code, keys in _sets(batch):
                at, of = _different(place[row] * len(keys) + code)
                columns = [pa.repeat(kind, len(at)), countries.take(pa.array(at // len(keys))), keys.take(pa.array(at % len(keys))), pa.array(np.bincount(of))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "country", "key", "n"])

    return _texts(targets).mapInArrow(run, COUNTED).groupBy("kind", "country", "key").agg(F.sum("n").alias("df"))


def _seed(kind: str, country: str) -> int:
    return zlib.crc32(f"{kind}\0{country}\0".encode())


def bits(keys: DataFrame) -> np.ndarray:
    """The table of bits of `keys` (kind, country, key)."""
    place = F.shiftright(F.crc32(F.concat("kind", F.lit("\0"), "country", F.lit("\0"), "key").cast("binary")), 32 - BITS)
    rows = keys.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    some = rows.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.uint64)
    table[some["word"].to_numpy()] = some["bits"].to_numpy().view(np.uint64)
    return table


def passed(derived: DataFrame, table: np.ndarray) -> DataFrame:
    """(entity_id, country, kind, key): the words and grams of records whose bit is set."""
    shift, seed = 32 - BITS, _seed

    def hit(kind: str, countries: list[str], at: np.ndarray, keys: pa.Array) -> np.ndarray:
        text = [k.encode() for k in keys.to_pylist()]
        seeds = [seed(kind, c) for c in countries]
        found = [zlib.crc32(text[k], seeds[c]) for c, k in zip((at // len(text)).tolist(), (at % len(text)).tolist(), strict=True)]
        place = np.array(found, np.int64) >> shift
        return (table[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            place, countries = _countries(batch)
            for kind, row, code, keys in _sets(batch):
                at, of = _different(place[row] * len(keys) + code)
                some = hit(kind, countries.to_pylist(), at, keys)[of]
                row, code = row[some], code[some]
                columns = [batch["entity_id"].take(pa.array(row)), batch["country"].take(pa.array(row)), pa.repeat(kind, len(row)), keys.take(pa.array(code))]
                yield pa.RecordBatch.from_arrays(columns, names=["entity_id", "country", "kind", "key"])

    return _texts(derived, "entity_id").mapInArrow(run, PASSED)
