"""Extraction from a stream of chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vereda.operators import extraction

#: Columns of a chunk file; `ord` orders the triples of equal keys.
SCHEMA = "id string, doc_id string, titulo string, secao string, texto string, ord long"


def read_chunks(spark: SparkSession, path: str, kind: str = "json", files: int = 64) -> DataFrame:
    """New files of a folder, at most `files` of them in a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).format(kind).load(path)


def extract_stream(chunks: DataFrame, lex: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch's triples to a folder of its own, batch=<number>.

    A triple's key holds its chunk, so a chunk that arrives once gives no repeats across batches. A batch that is run
    again after a failure overwrites its own folder, so each triple is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        extraction.extract(batch, lex).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
