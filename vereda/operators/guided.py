"""Retrievers over scored lists: one list alone, the fusion of several, and fusion guided by the graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vereda.operators import graph as gr
from vereda.operators import lexicon as lx
from vereda.operators import retrieval as rt


@dataclass(frozen=True)
class Settings:
    """Sizes and weights of retrieval; the defaults are fixed values."""

    top_k: int = 8
    hops: int = 3
    rrf_k: int = 60
    weight_dense: float = 1.0
    weight_bm25: float = 1.0
    weight_graph: float = 1.0

    @property
    def depth(self) -> int:
        """Places of each list that enter the fusion."""
        return 3 * self.top_k


@dataclass(frozen=True)
class Guided:
    """rows (query_id, key, rank, score, provenance, appended), findings of each query's pairs if asked for, nodes (query_id, id) walked."""

    rows: DataFrame
    findings: DataFrame | None
    nodes: DataFrame


def joined_lists(lists: list[tuple[str, float, DataFrame]], key: str) -> DataFrame:
    """(query_id, key, rank, list, list_no, w) of (name, weight, (query_id, key, rank)) in their order."""
    out = None
    for no, (name, w, df) in enumerate(lists):
        one = df.select("query_id", key, "rank", F.lit(name).alias("list"), F.lit(no).alias("list_no"), F.lit(float(w)).alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


def label(lists: Column) -> Column:
    """Names of (list_no, list) structs, in the order of the lists."""
    return F.array_join(F.transform(F.array_sort(lists), lambda x: x["list"]), "+")


def fused(rankings: DataFrame, key: str, k: int, rrf_k: int = rt.RRF_K, digits: int = 12) -> DataFrame:
    """(query_id, key, rank, score, provenance): the k best by the sum of w / (rrf_k + rank).

    Of equal sums the one that comes first in an earlier list is better: by its first list, then its rank there.
    """
    scored = rankings.groupBy("query_id", key).agg(
        F.sum(F.col("w") / (rrf_k + F.col("rank"))).alias("score"), label(F.collect_set(F.struct("list_no", "list"))).alias("provenance"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "_first", key)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", key, "rank", "score", "provenance")


def walked(edge_rows: DataFrame, mention_rows: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(query_id, id): the nodes within `hops` steps of a query's anchors. Anchors that the graph does not hold lead nowhere."""
    known = edge_rows.select(F.col("src").alias("id")).unionAll(edge_rows.select("dst")).unionAll(mention_rows.select("id")).distinct()
    seeds = anchors.select(F.col("query_id").alias("seed"), "id").distinct().join(known, "id", "left_semi")
    return gr.neighbourhood(edge_rows, seeds, hops).select(F.col("seed").alias("query_id"), "id")


def candidates(nodes: DataFrame, mention_rows: DataFrame, key: str, n: int) -> DataFrame:
    """(query_id, key, score, rank): the n keys of each query that mention most of its nodes; ties go to the lesser key."""
    touched = mention_rows.select(key, "id").distinct().join(nodes, "id").groupBy("query_id", key).agg(F.count("*").alias("score"))
    return rt.top_k(touched, n, key)


def anchor_findings(edge_rows: DataFrame, anchors: DataFrame, pair_kind: str) -> DataFrame:
    """Findings of all pairs of a query's anchors of one kind, with the places of both: query_id, p, q, FINDING, hops, rank.

    A pair is analysed once for all queries, the lesser node as its first, so findings do not hang on who asks.
    """
    own = anchors.where(F.col("kind") == pair_kind).groupBy("query_id", "id").agg(F.min("place").alias("place"))
    item = own.select("query_id", F.struct("id", "place").alias("item"), F.struct("place", "id").alias("place"))
    asked = lx.pairs_in_order(item, "query_id", "item", "place")
    asked = asked.select("query_id", F.least("first.id", "second.id").alias("a"), F.greatest("first.id", "second.id").alias("b"), F.col("first.place").alias("p"), F.col("second.place").alias("q"))
    return gr.pair_findings(edge_rows, asked.select("a", "b").distinct()).join(asked, ["a", "b"])


def guided(lists: list[tuple[str, float, DataFrame]], mention_rows: DataFrame, edge_rows: DataFrame, anchors: DataFrame, key: str,
           pair_kind: str | None = None, settings: Settings | None = None) -> Guided:
    """Fusion of text lists with the keys that mention most of the walked nodes, then the evidence of pair findings.

    lists: (name, weight, (query_id, key, rank)); mention_rows: (key, id); edge_rows without mentions, as pair analysis takes
    them if pair_kind is given; anchors: (query_id, kind, id, place). A key that the walk touches has `graph` in its
    provenance even where it is not among the best of the graph's list; evidence that no list holds has `graph` alone.
    """
    settings = settings or Settings()
    nodes = walked(edge_rows, mention_rows, anchors, settings.hops)
    text = joined_lists(lists, key)
    every = text.unionByName(joined_lists([("graph", settings.weight_graph, candidates(nodes, mention_rows, key, settings.depth))], key).withColumn("list_no", F.lit(len(lists))))
    best = fused(every, key, settings.top_k, settings.rrf_k)
    if pair_kind is None:
        findings = None
        ranked = best.select("query_id", key, "rank", F.lit(False).alias("appended"))
    else:
        findings = anchor_findings(edge_rows, anchors, pair_kind)
        shown = findings.select("query_id", "p", "q", "rank", F.posexplode("chunks").alias("at", key)).where(F.col(key).isNotNull())
        ranked = rt.append_evidence(best, shown.select("query_id", key, F.struct("p", "q", "rank", "at").alias("ord")), key)
    names = text.groupBy("query_id", key).agg(label(F.collect_set(F.struct("list_no", "list"))).alias("_text"))
    touched = ranked.select("query_id", key).join(mention_rows.select(key, "id"), key).join(nodes, ["query_id", "id"], "left_semi").select("query_id", key, F.lit("graph").alias("_graph")).distinct()
    rows = ranked.join(best.select("query_id", key, "score"), ["query_id", key], "left").join(names, ["query_id", key], "left").join(touched, ["query_id", key], "left")
    by_graph = F.when(F.col("_text").isNull(), F.lit("graph")).otherwise(F.col("_graph"))
    return Guided(rows.select("query_id", key, "rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.concat_ws("+", "_text", by_graph).alias("provenance"), "appended"), findings, nodes)


def retrievers(dense: DataFrame, bm25: DataFrame, mention_rows: DataFrame, edge_rows: DataFrame, anchors: DataFrame, key: str,
               pair_kind: str | None = None, settings: Settings | None = None) -> dict[str, Callable[[], DataFrame]]:
    """Name -> function that gives (query_id, key, rank, score, provenance). dense, bm25: scored (query_id, key, score)."""
    settings = settings or Settings()
    columns = ["query_id", key, "rank", "score", "provenance"]
    weight = {"dense": settings.weight_dense, "bm25": settings.weight_bm25}
    scored = {"dense": dense, "bm25": bm25}

    def alone(name: str) -> Callable[[], DataFrame]:
        return lambda: rt.top_k(scored[name], settings.top_k, key).withColumn("provenance", F.lit(name)).select(*columns)

    deep = [(name, weight[name], rt.top_k(df, settings.depth, key)) for name, df in scored.items()]
    return {
        "dense": alone("dense"),
        "bm25": alone("bm25"),
        "hybrid": lambda: fused(joined_lists(deep, key), key, settings.top_k, settings.rrf_k),
        "guided": lambda: guided(deep, mention_rows, edge_rows, anchors, key, pair_kind, settings).rows.select(*columns),
    }
