"""Sharding by a two-pass external shuffle.

Pass one scatters the records over memory-sized buckets by a seeded hash of the whole record; pass two brings each
bucket into a fixed order, applies a Fisher-Yates shuffle seeded by the bucket's number, and numbers its records after
those of the buckets before. Record number i goes to shard i mod n at slot i div n, so shard counts differ by at most
one (the law `rows`). The number of buckets follows the bytes, so a bucket stays in memory at any size of input.

Defined cases: a null text counts 0 bytes (size 1) and has the checksum of an empty text; repeated rows are placed as
separate records, all in one bucket, whose memory they need (op10's ids are unique); records that differ in a map or
variant column alone stand in no fixed order; an empty table gives no rows; extra columns are carried along unless a name is one of the result's,
in which case the result's column replaces it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vereda.llm._work import free

BUCKET_BYTES, SEED, MOST_BROADCAST = 8 << 20, 20240607, 500_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1 by n-1 exchanges, each with a uniformly drawn earlier position."""
    order = list(range(n))
    draw = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draw[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shard(docs: DataFrame, n_shards: int = 8, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All columns of docs with size, text_crc32, shard and slot added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    bucket_no, order_no, before_no, tie = (free(docs.columns, c) for c in ("_bucket", "_order", "_before", "_tie"))
    told = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    total = docs.select(F.sum(F.octet_length(text) + F.lit(1).cast("long"))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    placed = docs.withColumn(bucket_no, F.pmod(key, F.lit(n)).cast("int"))
    counts = placed.groupBy(bucket_no).agg(F.count("*").alias("n"))
    before = Window.orderBy(bucket_no).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(bucket_no, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(before_no))
    rows = placed.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary")), tie: F.xxhash64(*told)})

    def second_pass(bucket: pa.Table) -> pa.Table:
        fixed = bucket.sort_by([(c, "ascending") for c in ("doc_id", "text_crc32", "size", tie)])
        order = fisher_yates(len(fixed), seed ^ (fixed.column(bucket_no)[0].as_py() * 2654435761 + 1))
        return fixed.take(order).append_column(order_no, pa.array(np.arange(len(fixed))))

    schema = StructType([*rows.schema.fields, StructField(order_no, LongType())])
    shuffled = rows.repartition(n, bucket_no).groupBy(bucket_no).applyInArrow(second_pass, schema)
    at = F.col(order_no) + F.col(before_no)
    numbered = shuffled.join(F.broadcast(offsets) if n <= MOST_BROADCAST else offsets, bucket_no)
    return numbered.withColumns({"shard": F.pmod(at, F.lit(n_shards)).cast("int"), "slot": F.floor(at / n_shards).cast("long")}).drop(bucket_no, before_no, order_no, tie)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard to a folder of its own, its records in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
