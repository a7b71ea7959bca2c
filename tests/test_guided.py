import random

import pytest

from vereda.operators import guided as gd


def plain_walk(edges, seeds, hops):
    seen = set(seeds)
    front = set(seeds)
    for _ in range(hops):
        front = {b for s, d in edges for a, b in ((s, d), (d, s)) if a in front} - seen
        seen |= front
    return seen


def plain_guided(lists, mentions, edges, seeds, top, depth, hops, k=60):
    nodes = plain_walk(edges, [s for s in seeds if any(s in e for e in edges) or any(s == i for _, i in mentions)], hops)
    touched = {}
    for key, i in set(mentions):
        if i in nodes:
            touched[key] = touched.get(key, 0) + 1
    walk = sorted(touched, key=lambda c: (-touched[c], c))[:depth]
    score = {}
    for ranking in [*lists, walk]:
        for place, c in enumerate(ranking, 1):
            score[c] = score.get(c, 0) + 1 / (k + place)
    best = sorted(score, key=lambda c: -round(score[c], 12))[:top]  # stable: the order of first appearance
    names = [[n for n, r in zip(("dense", "bm25"), lists, strict=True) if c in r] + ["graph"] * (c in touched) for c in best]
    return [(c, place, round(score[c], 9), "+".join(n)) for place, (c, n) in enumerate(zip(best, names, strict=True), 1)], nodes


@pytest.mark.parametrize("hops", [0, 1, 2])
def test_guided_equals_plain_version(spark, hops):
    rnd = random.Random(5)
    ids, keys = [f"n{i}" for i in range(14)], [f"c{i:02}" for i in range(25)]
    edges = [(rnd.choice(ids[:10]), rnd.choice(ids[:10])) for _ in range(7)]
    mentions = [(rnd.choice(keys), rnd.choice(ids)) for _ in range(40)]
    settings = gd.Settings(top_k=4, hops=hops)
    seeds = {q: rnd.sample([*ids, "unknown"], 2) for q in range(6)}
    scored = {name: [(q, c, float(rnd.randint(1, 9))) for q in seeds for c in rnd.sample(keys, 15)] for name in ("dense", "bm25")}
    frames = {n: spark.createDataFrame(r, "query_id int, key string, score double") for n, r in scored.items()}
    anchors = spark.createDataFrame([(q, "x", i, p) for q, s in seeds.items() for p, i in enumerate(s)], "query_id int, kind string, id string, place int")
    all_of = gd.retrievers(frames["dense"], frames["bm25"], spark.createDataFrame(mentions, "key string, id string"), spark.createDataFrame(edges, "src string, dst string"), anchors, "key", settings=settings)
    got = {}
    for r in all_of["guided"]().collect():
        got.setdefault(r.query_id, []).append((r.key, r["rank"], round(r.score, 9), r.provenance))
    lists = {q: [[c for _, c, _ in sorted((x for x in scored[n] if x[0] == q), key=lambda x: (-x[2], x[1]))][:12] for n in ("dense", "bm25")] for q in seeds}
    for q, s in seeds.items():
        want, _ = plain_guided(lists[q], mentions, edges, s, 4, 12, hops)
        assert sorted(got[q], key=lambda x: x[1]) == want
    if hops == 0:
        hybrid = {(r.query_id, r["rank"]): r.key for r in all_of["hybrid"]().collect()}
        alone = {(r.query_id, r["rank"]): r.key for r in all_of["dense"]().collect()}
        for q in seeds:
            score = {}
            for ranking in lists[q]:
                for place, c in enumerate(ranking, 1):
                    score[c] = score.get(c, 0) + 1 / (60 + place)
            best = sorted(score, key=lambda c: -round(score[c], 12))[:4]
            assert [hybrid[q, p] for p in range(1, 5)] == best and [alone[q, p] for p in range(1, 5)] == lists[q][0][:4]


def test_evidence_of_findings_follows_the_best(spark):
    form = "src string, dst string, relation string, origin string, severity string, rule string, mediator string, chunk_id string, ord long"
    edges = spark.createDataFrame(
        [
            ("a", "b", "INTERAGE_COM", "asserted", "grave", None, None, "e1", 1),
            ("a", "K", "INTERAGE_COM_CLASSE", "asserted", "leve", None, None, "e2", 2),
            ("b", "K", "E_DA_CLASSE", "asserted", None, None, None, "e3", 3),
        ],
        form,
    )
    ranked = spark.createDataFrame([(1, "t1", 1), (1, "e3", 2), (2, "t1", 1)], "query_id int, key string, rank int")
    anchors = spark.createDataFrame([(1, "drug", "b", 0), (1, "drug", "a", 7), (2, "drug", "a", 0), (2, "class", "K", 3)], "query_id int, kind string, id string, place int")
    mentions = spark.createDataFrame([("t1", "a"), ("e1", "zz")], "key string, id string")
    got = gd.guided([("bm25", 1.0, ranked)], mentions, edges, anchors, "key", "drug", gd.Settings(top_k=3, hops=1))
    rows = sorted((r.query_id, r["rank"], r.key, r.provenance, r.appended) for r in got.rows.collect())
    assert rows == [(1, 1, "t1", "bm25+graph", False), (1, 2, "e3", "bm25", False), (1, 3, "e1", "graph", True), (1, 4, "e2", "graph", True), (2, 1, "t1", "bm25+graph", False)]
    assert [(r.query_id, r.kind, r.severity) for r in got.findings.orderBy("rank").collect()] == [(1, "direct", "grave"), (1, "class", "leve")]
    assert {r.id for r in got.nodes.where("query_id = 2").collect()} == {"a", "b", "K"}
