import glob
import os

import duckdb
import pytest

from vereda.functions import text as tx
from vereda.operators import graph as g
from vereda.operators import retrieval as rt
from vereda.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["bm25_topk", "rrf_provenance", "lexicon_mentions", "graph_stats", "khop_neighborhood", "mediator_inference", "pair_findings_ranked", "pair_mechanism", "inferred_edge_evidence", "ir_metrics_at_k", "answer_compose", "evidence_append", "guided_retrieval"]


def plain(value):
    return "" if value is None or value != value else str(round(float(value), 6)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert a == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("Ácido  Acetil-Salicílico (AAS) ªß",)], "t string").select(tx.squeeze(F.col("t")).alias("s"), tx.slug(F.col("t")).alias("g"), tx.tokens(F.col("t"), ["aas"]).alias("w")).first()
    assert row.s == "acido acetil-salicilico (aas) a" and row.g == "acido-acetil-salicilico-aas-a" and row.w == ["acido", "acetil", "salicilico"]
    lists = spark.createDataFrame([(["a", "", "b", "c"],), (["x"],), ([],)], "l array<string>").select(tx.listed(F.col("l"))).collect()
    assert [r[0] for r in lists] == ["a, b e c", "x", ""]


def test_rules(spark):
    mods = spark.createDataFrame([("a", "e", "INIBE", "forte", False), ("i", "e", "INDUZ", "moderada", False), ("x", "e", "INIBE", "moderada", True)], "a string, m string, relation_a string, intensity_a string, special boolean")
    tgts = spark.createDataFrame([("b", "e", "SUBSTRATO_DE", "sensivel"), ("p", "e", "ATIVADO_POR", "moderada"), ("a", "e", "SUBSTRATO_DE", "moderada")], "b string, m string, relation_b string, intensity_b string")
    got = {(r.a, r.b): (r.rule, r.severity) for r in g.mediated(mods, tgts).collect()}
    assert got == {("a", "b"): ("R1", "contraindicado"), ("a", "p"): ("R3", "contraindicado"), ("x", "b"): ("R4", "contraindicado"), ("x", "p"): ("R4", "contraindicado"), ("x", "a"): ("R4", "contraindicado")}


EDGE = "src string, dst string, relation string, origin string, severity string, rule string, mediator string, chunk_id string, ord long"


def edge(src, dst, relation, severity=None, chunk=None, ord_=0, origin="asserted", rule=None, mediator=None):
    return (src, dst, relation, origin, severity, rule, mediator, chunk, ord_)


def test_pair_findings_with_paths_and_evidence(spark):
    rows = [
        edge("a", "b", "INTERAGE_COM", "leve", "k2", 2), edge("a", "b", "INTERAGE_COM", "leve", "k1", 1), edge("b", "a", "INTERAGE_COM", "leve", "k0", 0),
        edge("a", "b", "INTERAGE_COM", "grave", None, 9, "inferred", "R1", "e"), edge("a", "e", "INIBE", None, "m2"), edge("a", "e", "INIBE", None, "m1"), edge("b", "e", "SUBSTRATO_DE", None, "m1"),
        edge("b", "cb", "E_DA_CLASSE", None, "f2"), edge("a", "ca", "E_DA_CLASSE", None, "f1"), edge("a", "cb", "INTERAGE_COM_CLASSE", "grave", "g1", 3),
        edge("cb", "ca", "INTERAGE_COM_CLASSE", "contraindicado", "h1", 4), edge("a", "x", "MENCIONA", None, "f1"), edge("x", "b", "INTERAGE_COM", None, "k9"),
    ]
    edges = spark.createDataFrame(rows, EDGE)
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "x"), ("a", "missing"), (None, "b")], "a string, b string")
    got = [(r.a, r.b, r["rank"], r.kind, r.rule, r.severity, r.path, r.chunks) for r in g.pair_findings(edges, pairs).orderBy("a", "b", "rank").collect()]
    assert got == [
        ("a", "b", 1, "class_class", None, "contraindicado", ["a", "ca", "cb", "b"], ["h1", "f1", "f2"]),
        ("a", "b", 2, "mechanism", "R1", "grave", ["a", "e", "b"], ["m1", "m2"]),
        ("a", "b", 3, "class", None, "grave", ["a", "cb", "b"], ["g1", "f2"]),
        ("a", "b", 4, "direct", None, "leve", ["a", "b"], ["k1"]),
        ("b", "x", 1, "direct", None, "moderada", ["x", "b"], ["k9"]),
    ]
    assert g.pair_findings(edges.limit(0), pairs).count() == 0


def test_rrf_and_mrr(spark):
    lists = spark.createDataFrame([(1, "v", 7, 1, 1.0), (1, "b", 7, 3, 1.0), (1, "b", 8, 1, 1.0)], "query_id int, list string, k int, rank int, w double")
    got = {r.k: (round(r.score, 6), r.provenance) for r in rt.rrf(lists, "k").collect()}
    assert got == {7: (round(1 / 61 + 1 / 63, 6), "b+v"), 8: (round(1 / 61, 6), "b")}


def test_lsa_equals_exact_svd(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    texts = [[f"t{k}" for k in (rnd.zipf(1.3, 40) % 6000)] for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, words array<string>")
    got = {r.doc_id: np.array(r.vector) for r in rt.lsa_vectors(docs, "doc_id", "words").collect()}
    terms = sorted({x for t in texts for x in t})
    tf = np.array([[t.count(x) for x in terms] for t in texts])
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    u, s, _ = np.linalg.svd(a / np.linalg.norm(a, axis=1, keepdims=True), full_matrices=False)
    exact = (u * s)[:, :128]
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    mine = np.stack([got[i] for i in range(len(texts))])
    assert mine.shape == exact.shape
    top = [np.argsort(-(x @ x.T - 2 * np.eye(len(x))), axis=1)[:, :5] for x in (mine, exact)]
    recall = np.mean([len(set(p) & set(q)) / 5 for p, q in zip(*top, strict=True)])
    assert recall >= 0.95, recall


def test_mediated_counts_equal_the_edges_without_making_them(spark):
    """Repeated, shared, null and equal ids; no join of the plan pairs modulators with targets by the mediator alone."""
    from pyspark.sql import functions as F

    mods = spark.createDataFrame(
        [(i % 9 if i % 11 else None, i % 3 if i % 13 else None, "INDUZ" if i % 4 == 0 else "INIBE", ("forte", "moderada", "fraca")[i % 3 - i % 2], i % 3 == 1) for i in range(40)],
        "a long, m long, relation_a string, intensity_a string, special boolean",
    )
    aims = spark.createDataFrame(
        [(i % 14 if i % 10 else None, i % 4, "ATIVADO_POR" if i % 3 else "SUBSTRATO_DE", "sensivel" if i % 5 else "moderada") for i in range(70)] + [(5, 7, "ATIVADO_POR", "sensivel")],
        "b long, m long, relation_b string, intensity_b string",
    )
    lone = spark.createDataFrame([(5, 7, "INIBE", "forte", False)], mods.schema)  # its only partner is itself
    mods = mods.union(lone)
    want = g.mediated(mods, aims).groupBy("m", "rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("a").alias("n_sources"), F.countDistinct("b").alias("n_targets"))
    got = g.mediated_counts(mods, aims).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    # 600 x 600 ends at one mediator: 360,000 edges, and no more rows than ends and classes are made here
    many = spark.range(600).select(F.col("id").alias("a"), F.lit(1).alias("m"), F.lit("INIBE").alias("relation_a"), F.lit("forte").alias("intensity_a"), F.lit(False).alias("special"))
    reach = spark.range(600).select(F.col("id").alias("b"), F.lit(1).alias("m"), F.lit("X").alias("relation_b"), F.lit("sensivel").alias("intensity_b"))
    row = g.mediated_counts(many, reach).first()
    assert (row.n, row.n_sources, row.n_targets) == (600 * 599, 600, 600)


def test_nearest_equals_every_pair(spark, monkeypatch):
    """Equal, null and zero vectors, in packs that are smaller than the table; ties go to the lesser key."""
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    monkeypatch.setattr(rt, "CELLS", 64)
    rows = np.random.default_rng(3).standard_normal((300, 5)).astype(np.float32).tolist()
    rows[40:90] = [rows[0]] * 50
    rows[100] = rows[120] = None
    rows[140] = [0.0] * 5
    v = spark.createDataFrame([(i, x, 1) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(7)
    con = duckdb.connect()
    con.register("embeddings", v.toArrow())
    want = con.sql(catalogue.oracle_sql()["embed_cosine_topk"]).fetchall()
    found = rt.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10)
    assert found.count() <= 15 * 10 * 7  # k rows for each query and pack, not one for each pair
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    got = found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "vec_id", "rank", F.round("score", 6)).collect()
    assert sorted(tuple(map(str, r[:3])) + (plain(r[3]),) for r in got) == sorted(tuple(map(str, r[:3])) + (plain(r[3]),) for r in want)


def test_small_lexicon_is_searched_with_the_rows_of_the_gram_join(spark, monkeypatch):
    """Both ways agree on odd boundaries, and the search deals no word of a text to another task: one exchange, of what is found."""
    from vereda.operators import lexicon as lx

    lex = lx.lexicon(spark.createDataFrame([(s, k, c, i) for i, (s, k, c) in enumerate(catalogue.SURFACES)], "surface string, kind string, canonical string, ord int"))
    texts = ["Of  the rings", "of-the in", "in, mit", "MIT License 2.0.", "apache license-2.0", "apáche\nlicense 12.0", "the", "breathe", "", None, "in_the der", "ofé the", "of . the"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "der")], "doc_id long, text string")
    found = lx.mentions(docs, lex, "doc_id")
    got = sorted(map(tuple, found.collect()))
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(lx, "LARGEST_SEARCHED", 0)
    assert got == sorted(map(tuple, lx.mentions(docs, lex, "doc_id").collect())) and len(got) > 10


def test_tokens_pass_over_stop_words(spark):
    """The one search gives what filtering all runs gives."""
    from pyspark.sql import functions as F

    texts = ["a de deve dever x 12 e3 the_then de2 2de", "ção DE, dé-de; ofof of", "", None, "aa" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    runs = F.filter(F.regexp_extract_all(tx.fold(F.col("t")), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*map(F.lit, catalogue.STOP)), w))
    for r in df.select(tx.tokens(F.col("t"), catalogue.STOP).alias("got"), runs.alias("want")).collect():
        assert r.got == r.want


def test_best_terms_by_blocks_make_no_row_for_each_term(spark, monkeypatch):
    """Several blocks, ties, a repeated, an empty and a null key, against plain counting; the plan explodes nothing."""
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(rt, "BLOCK", 5)
    rnd = random.Random(5)
    rows = [(i % 37 if i % 19 else None, [rnd.choice("abcdefghij") + rnd.choice(["", "x", "yz"]) for _ in range(i % 12)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>")
    best = rt.best_terms(docs, "doc_id", "words", 3)
    assert "Generate" not in best._jdf.queryExecution().optimizedPlan().toString()
    bags = {}
    for key, words in rows:
        bags.setdefault(key, Counter()).update([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
    df = Counter(t for bag in bags.values() for t in bag)
    want = {}
    for key, bag in bags.items():
        w = {t: (1 + math.log(c)) * (math.log(61 / (1 + df[t])) + 1) for t, c in bag.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if key is not None and w:
            want[key] = sorted((-round(x / norm, 6), t) for t, x in w.items())[:3]
    got = {}
    for r in best.collect():
        got.setdefault(r.doc_id, []).append((-round(r.weight, 6), r.term))
    assert {k: sorted(v)[:3] for k, v in got.items()} == want


def test_lsa_with_pairs_of_words_equals_exact_svd_where_values_fall_slowly(spark):
    """Values that lie close together, terms of many, few and one document, a null key, documents without words; no row for each term of a document is dealt."""
    import numpy as np

    rnd = np.random.default_rng(5)
    texts = [[f"w{k}" for k in rnd.integers(0, 400, 40)] + [f"own{i}"] for i in range(1200)]
    docs = spark.createDataFrame([*enumerate(texts), (None, ["w1", "w2"]), (5000, []), (5001, None)], "doc_id long, words array<string>")
    frame = rt.lsa_vectors(docs, "doc_id", "words", pairs=True)
    got = {r.doc_id: np.array(r.vector) for r in frame.collect()}
    assert sorted(got) == list(range(1200))
    bags = [[*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))] for t in texts]
    at = {x: i for i, x in enumerate(sorted({x for t in bags for x in t}))}
    tf = np.zeros((len(bags), len(at)))
    for i, t in enumerate(bags):
        np.add.at(tf, (i, [at[x] for x in t]), 1)
    n = len(texts) + 2  # documents without words count, those without a key don't
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + n) / (1 + (tf > 0).sum(0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    values, turn = np.linalg.eigh(a @ a.T)
    exact = turn[:, ::-1][:, :128] * np.sqrt(values[::-1][:128])
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    mine = np.stack([got[i] for i in range(len(texts))])
    top = [np.argsort(-(x @ x.T - 2 * np.eye(len(x))), axis=1)[:, :5] for x in (mine, exact)]
    recall = np.mean([len(set(p) & set(q)) / 5 for p, q in zip(*top, strict=True)])
    assert mine.shape == exact.shape and recall >= 0.98, recall
    assert rt.lsa_vectors(docs.limit(0), "doc_id", "words").count() == 0
