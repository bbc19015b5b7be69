"""Source 1 records as a stream of files, linked against a stored target corpus.

Each micro-batch is ranked on its own, in `foreachBatch`, since a record's top-K
needs all of its candidates; the batch is one write under its number, so a
batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinloom.config import ErConfig
from kinloom.operators.derive import derive
from kinloom.plans.pipeline import linear
from kinloom.sources.records import RECORDS


def link_stream(spark: SparkSession, source: str, corpus: DataFrame, out: str, checkpoint: str, cfg: ErConfig, files_per_batch: int = 100) -> StreamingQuery:
    """Starts the query; it ends when all present files are linked.

    corpus: derived target records. Each batch is a folder batch=<number> of `out`.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = derive(batch.dropDuplicates(["entity_id"]), cfg)
        linear(new, corpus, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    arriving = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
