"""Tables that a job writes for itself, so that an expensive result is computed once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset a new local one, in local mode alone.

    On a cluster a local folder would hold each executor's part on its own disk, so a missing setting is an error there.
    """
    got = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = f"file://{tempfile.mkdtemp(prefix='vereda-')}"
        spark.sparkContext.setCheckpointDir(got)
    return got


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile Python functions get at most so many rows at once, so that both sides hold few texts; then the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def sifted(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a join whose smaller side is a stored table with a filter passes its keys, as a Bloom filter, to the other side before that is dealt.

    Spark does so by itself for inputs of 10 GB; the filter lets every row with a partner through, so the join's rows are the same.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    ours = {f"{name}enabled": "true", f"{name}applicationSideScanSizeThreshold": "0", f"{name}creationSideThreshold": "1t"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read back: cuts the lineage. batch: rows that a Python function gets at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vereda-{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch) if batch else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, added: str) -> StructType:
    """The schema of df with more columns, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
