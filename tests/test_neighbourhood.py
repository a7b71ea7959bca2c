from collections import defaultdict

from vereda.operators import graph
from vereda.plans import catalogue


def walked(edges, seeds, hops):
    """(seed, id, hop) by a plain walk from each seed."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = set()
    for seed in {s for s, _ in seeds}:
        level = {i for s, i in seeds if s == seed}
        seen = set(level)
        out |= {(seed, i, 0) for i in level}
        for hop in range(1, hops + 1):
            level = {y for x in level for y in near[x]} - seen
            seen |= level
            out |= {(seed, i, hop) for i in level}
    return out


def test_more_seeds_than_a_word_has_bits(spark, monkeypatch):
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 200}") for i in range(200)] + [("hub", f"n{i}") for i in range(0, 200, 40)] + [("n1", "n1")]
    seeds = [(f"s{i}", f"n{i}") for i in range(150)] + [("s0", "n9"), ("far", "nowhere")]
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "seed string, id string")
    want = sorted(walked(edges, seeds, 3))
    assert sorted(map(tuple, graph.neighbourhood(e, s, 3).collect())) == want
    monkeypatch.setattr(graph, "MOST_SENT", 0)
    assert sorted(map(tuple, graph.neighbourhood(e, s, 3).collect())) == want


def test_no_row_for_each_seed_and_node_is_stored(spark, monkeypatch):
    rows = []
    for name in ("stored", "tabled"):
        monkeypatch.setattr(graph, name, lambda df, f=getattr(graph, name): (out := f(df), rows.append(out.count()))[0])
    edges = spark.createDataFrame([("hub", f"s{i}") for i in range(60)] + [("hub", f"x{i}") for i in range(100)], "src string, dst string")
    seeds = spark.createDataFrame([(f"s{i}", f"s{i}") for i in range(60)], "seed string, id string")
    assert graph.neighbourhood(edges, seeds, 2).count() == 60 * 161 and max(rows) <= 320


def test_ends_alone_are_those_of_the_edges(spark):
    d = "/root/testdata/sf0.001"
    pairs = lambda df: {tuple(r) for r in df.select("src", "dst").collect()}
    got = pairs(graph.ends(graph.valid(catalogue.triples(spark, d, ends=True), catalogue.signatures(spark))))
    assert got == pairs(graph.edges(catalogue.clean_triples(spark, d)))


def test_edges_are_dealt_once_for_all_hops(spark, monkeypatch):
    """No hop deals the edges, nor names of nodes; nodes with equal bits are told apart by another salt."""
    plans, tabled = [], graph.tabled
    monkeypatch.setattr(graph, "tabled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), tabled(df))[1])
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 50}") for i in range(50)]
    seeds = [(f"s{i}", f"n{i}") for i in range(0, 50, 9)] + [("far", "nowhere")]
    e, s = spark.createDataFrame([*edges, ("n1", None), (None, "n2")], "src string, dst string"), spark.createDataFrame(seeds, "seed string, id string")
    before, plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), graph.node
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(graph, "node", lambda salt, column: plain(salt, column) if salt else plain(salt, column) % 7)
    try:
        got = sorted(map(tuple, graph.neighbourhood(e, s, 3).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(walked(edges, seeds, 3))
    hops = [p for p in plans if "SortMergeJoin" in p]
    assert len(hops) == 3 and all("Bucketed: true" in p for p in hops)
