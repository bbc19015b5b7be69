"""Arrow batches in and out of a function over whole texts.

A batch is cut up so that the texts handled at once stay below a number of
bytes; a longer text is handled alone, so memory follows the longest text.

Spark takes the size of the batches that it sends from the session only. Where the
session doesn't set it, `sent_small` sets it to batches that two workers can hold
beside a small executor's heap; what a session sets itself stays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BYTES = 1_000_000
#: Rows and bytes of a batch.
SENT = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def sent_small(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    for key, value in SENT.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df


#: What a process does when it turns to another operator's tasks: by module, functions that drop its tables.
_forget: dict[str, Callable[[], None]] = {}


def kept_until_left(module: str, forget: Callable[[], None]) -> None:
    """Registers what drops the tables that `module` keeps in a process from task to task."""
    _forget[module] = forget


def enter(module: str) -> None:
    """Drops other modules' tables: Python workers are used again by later stages, and would hold them."""
    others = [m for m in _forget if m != module]
    for other in others:
        _forget.pop(other)()
    if others and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)  # glibc keeps what was freed, else


def pieces(sizes: np.ndarray, most: int = BYTES) -> Iterator[np.ndarray]:
    """Row numbers, smallest size first, in runs of at most `most` together."""
    order = np.argsort(sizes, kind="stable")
    total, at = np.cumsum(sizes[order]), 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield order[at:end]
        at = end


def parts(batches: Iterator[pa.RecordBatch], place: int, most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts of bounded size, each with its texts (null read as empty) of column `place`."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for some in pieces(sizes, most):
            part = batch.take(pa.array(some))
            yield part, [t or "" for t in part.column(place).to_pylist()]
        del batch, sizes
        pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[tuple]]], added: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs`, then those in the DDL string `added`, from the text.

    `make()` is called once in a task; what it returns maps a list of texts (null
    read as empty) to a list of rows of the added columns. Kept columns that have
    an added column's name are left out.
    """
    new = StructType.fromDDL(added)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    inner = [f"k{k}" for k in range(len(keep))]  # kept names may hold dots, which mapInArrow doesn't take
    schema = StructType([StructField(k, docs.schema[c].dataType) for k, c in zip(inner, keep, strict=True)] + new.fields)
    sent = [F.col(f"`{c}`").alias(k) for k, c in zip(inner, keep, strict=True)] + ([] if text in keep else [F.col(text).alias("__text")])
    place = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        enter(make.__module__)
        kinds, f = to_arrow_schema(new), make()
        for part, texts in parts(batches, place):
            made = [pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*f(texts), strict=True))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*inner, *new.names])

    return sent_small(docs.select(*sent)).mapInArrow(run, schema).toDF(*keep, *new.names)
