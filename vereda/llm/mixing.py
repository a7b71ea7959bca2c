"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets share `share` of all words by weight; a target stops at `cap` times its source's words and the excess goes to the
others by weight (a water level, found from prefix sums over the sources in order of cap to weight). The mix consists
of blocks of `block` words. Sources get whole blocks by the highest quotients target / (2k - 1); a source's blocks are
then apportioned in the same way to its shards, which are sized to hold about `shard_words` words. In each shard the
documents stand in a seeded order; each block of that line is taken as often as the quota allows, the remainder going
to blocks in a seeded order. A document's taken words are those of its share in the taken blocks.

Only ids, sources and sizes are shuffled, never texts. Windows run over one shard, or over sources and quotients.
Defined cases: null text has size 0 and takes nothing; a null source is a source of its own, last in order; repeated
rows each have their own place in line; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vereda.llm._work import written

WEIGHTS, SHARE, CAP, BLOCK, SHARD_WORDS, SHARDS_A_TASK, SEED = (3, 1, 2), 1.5, 2.0, 64, 1_000_000, 8, 20240608
NONSPACE = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size; one more than the runs of separators is the number of words, but for the text's edges."""
    parts = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    blank = lambda c: F.when(c == "", 1).otherwise(0)
    n = F.when((F.size("parts") == 1) & (F.col("parts")[0] == ""), 0).otherwise(F.size("parts") - blank(F.col("parts")[0]) - blank(F.element_at("parts", -1)))
    return docs.select("doc_id", "source", parts.alias("parts")).select("doc_id", "source", n.cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_no, source_size, target) for every source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_name)
    per = per.withColumn("source_no", no).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("double"))
    per = per.withColumns({"most": F.col("source_size") * F.lit(float(cap)), "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    rising = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    full = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("all") - full) / open_weight)
    level = F.max(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    return per.select("source", "source_no", "source_size", F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight"))).alias("target"))


def sainte_lague(df: DataFrame, group: list[str], key: list[str], population: str, seats: str) -> DataFrame:
    """df with `quota`: the seats of each group dealt to its keys by the highest quotients population / (2k - 1).

    A key surely gets its proportional share less a margin for the rounding of all others; only the quotients around
    that share are listed and ranked, about four for each key, however many the seats.
    """
    whole = Window.partitionBy(*group)
    df = df.withColumns({"_all": F.sum(population).over(whole), "_n": F.count("*").over(whole)})
    exact = F.when(F.col("_all") > 0, F.col(population) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    margin = F.ceil(F.when(F.col(seats) > 0, exact * F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0))) + 1
    df = df.withColumn("_margin", margin).withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.floor(exact) - F.col("_margin")))
    df = df.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    near = df.where((F.col(population) > 0) & (F.col(seats) > 0)).select(
        *group, *key, population, "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_sure") + 2 * F.col("_margin") + 2)).alias("_k")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col(population) / (2 * F.col("_k") - 1)), *key, "_k"))
    won = near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).groupBy(*group, *key).agg(F.count("*").alias("_won"))
    return df.join(won, [*group, *key], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_n", "_margin", "_sure", "_left", "_won")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words taken from it, repeats counted."""
    sizes = written(sized(docs), "sizes")
    sources = targets(sizes, weights, share, cap)
    n_shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))
    rows = sizes.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), n_shards))
    line = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), "doc_id", "size")
    rows = rows.withColumns({"place": F.row_number().over(line), "end": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))})
    rows = written(rows.select("doc_id", "size", "source_no", "source_size", "target", "shard", "place", "end"), "lines")

    by_source = rows.groupBy("source_no").agg(F.first("target").alias("target"))
    by_source = by_source.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")).withColumn("world", F.lit(1))
    source_quota = sainte_lague(by_source, ["world"], ["source_no"], "target", "blocks").select("source_no", F.col("quota").alias("seats"))
    cells = rows.groupBy("source_no", "shard").agg(F.sum("size").alias("words")).join(source_quota, "source_no")
    cells = sainte_lague(cells, ["source_no"], ["shard"], "words", "seats").where("words > 0")
    cells = cells.withColumn("n_blocks", F.ceil(F.col("words") / block))

    # Dealt by shard before its blocks are listed, a task for every few shards: the number follows the words.
    tasks = 1 + (rows.agg(F.sum("size")).first()[0] or 0) // (SHARDS_A_TASK * shard_words)
    cells = cells.repartition(tasks, "source_no", "shard")
    blocks = cells.select("source_no", "shard", "quota", "words", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    short = (F.col("block") + 1) * block > F.col("words")
    order = Window.partitionBy("source_no", "shard").orderBy(short, F.xxhash64(F.lit(seed + 2), F.col("source_no"), F.col("shard"), F.col("block")), "block")
    times = F.least(F.lit(int(cap)).cast("long"), F.floor(F.col("quota") / F.col("n_blocks")) + F.when(F.row_number().over(order) <= F.col("quota") % F.col("n_blocks"), 1).otherwise(0))
    blocks = blocks.withColumn("times", times).where("times > 0").select("source_no", "shard", "block", "times")

    start = F.col("end") - F.col("size")
    pieces = rows.where("size > 0").select("source_no", "shard", "place", "size", "end", F.explode(F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    part = F.least(F.col("end"), (F.col("block") + 1) * block) - F.greatest(start, F.col("block") * block)
    # Spark takes the listed blocks for as small as the cells that they come from and would send all of them to every executor.
    taken = pieces.join(blocks.hint("merge"), ["source_no", "shard", "block"]).groupBy("source_no", "shard", "place").agg(F.sum(F.col("times") * part).cast("long").alias("taken"))
    return rows.join(taken, ["source_no", "shard", "place"], "left").select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
