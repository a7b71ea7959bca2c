"""A corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes what each returns to
the shared folder and reads it for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vereda.llm import decontaminate, mixing, near_dup, queries, sharding, toxicity
from vereda.llm._work import free, table, written

#: The stages fit models, search and compare sketches, which SQL does not express; tests hold them against plain versions.
ORACLE_SQL = None


def unless(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], verdict: str, added: list[str]) -> DataFrame:
    """The rows of docs that judge() does not give the verdict; columns named like those it adds are set aside meanwhile."""
    aside = {c: free([*docs.columns, *added], f"_{c}") for c in docs.columns if c.lower() in added}
    left = judge(docs.withColumnsRenamed(aside)).where(~F.col(verdict))
    return left.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any severity above 0 is under the threshold stay."""
    model = toxicity.train(docs, queries.grades(table(spark, sf_dir, "labels")))
    return unless(docs, lambda d: toxicity.score(d, model), "toxic", [x.split()[0] for x in toxicity.ADDED.split(", ")])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, chosen by doc_id and a digest of the text; texts without words all stay."""
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    digest = free(docs.columns, "_digest")
    kept = near_dup.representatives(docs.select("doc_id", "text")).toDF("kept_id", "kept_digest")
    some = docs.where(worded).withColumn(digest, F.md5(F.col("text").cast("binary")))
    some = some.join(kept, some["doc_id"].eqNullSafe(kept["kept_id"]) & (some[digest] == kept["kept_digest"]), "left_semi")
    return some.dropDuplicates(["doc_id", digest]).drop(digest).unionByName(docs.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay."""
    passages = table(spark, sf_dir, "benchmark")
    return unless(docs, lambda d: decontaminate.match(d, passages), "contaminated", decontaminate.ADDED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: its taken words over its size, rounded by a seeded draw."""
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED + 3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(1).cast("int")
    taken_id, n, copy = (free(docs.columns, c) for c in ("_taken_id", "_times", "_copy"))
    times = taken.select(F.col("doc_id").alias(taken_id), times.alias(n)).where(F.col(n) > 0)
    drawn = docs.join(times, docs["doc_id"].eqNullSafe(times[taken_id]))
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(taken_id, n, copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, shuffled and numbered in eight shards."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
