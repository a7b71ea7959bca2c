import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vereda.llm import chat_format, decontaminate, mixing, near_dup, sharding, toxicity
from vereda.llm._work import free, shared_dir

#: Names that operators and stages use for their own columns.
CLASHING = ["grade", "toxic", "item_id", "contaminated", "bucket", "_bucket", "_id", "_digest", "_times", "params", "severity", "node", "size_", "words"]


def text_of(rnd, n=70):
    return " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with planted cases, and what each stage should do with them."""
    rnd, folder = random.Random(21), tmp_path_factory.mktemp("corpus")
    passage = text_of(rnd, 30)
    rows = [(i, text_of(rnd), "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, text_of(rnd) + " vile awful", "a") for i in range(30)]
    rows += [(200, rows[0][1], "b"), (200, text_of(rnd), None), (201, f"{text_of(rnd)} {passage} {text_of(rnd)}", "b")]
    rows += [(300, None, "a"), (301, "", "a"), (None, text_of(rnd), "b"), (None, text_of(rnd), "b"), (302, rows[1][1], "b"), (302, rows[1][1], "b")]
    docs = spark.createDataFrame([(*r, *[c.upper() for c in CLASHING]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(17, passage), (18, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, rows


def texts(df):
    assert df.where(" or ".join(f"not ({c} <=> '{c.upper()}')" for c in CLASHING)).count() == 0
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_stages_drop_what_they_should_and_keep_the_rest(spark, corpus):
    folder, docs, rows = corpus
    pairs = [(i, t) for i, t, _ in rows]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    want = [p for p in pairs if "vile" not in (p[1] or "")]
    assert texts(clean) == sorted(want, key=str) and clean.columns == docs.columns
    single = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    seen, left = set(), []
    for p in sorted(want, key=lambda p: (p[0] is None, p[0] or 0)):
        if not p[1] or p[1] not in seen:
            left.append(p)
            seen.add(p[1])
    assert texts(single) == sorted(left, key=str) and single.columns == docs.columns
    safe = corpus_pipeline.drop_contaminated(spark, single, folder)
    left = [p for p in left if p[0] != 201]
    assert texts(safe) == sorted(left, key=str) and safe.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, safe, folder)
    assert set(texts(mixed)) <= set(left) and mixed.columns == docs.columns
    sharded = corpus_pipeline.shard(spark, mixed, folder)
    assert texts(sharded) == texts(mixed)


def test_run_gives_the_shards_of_what_is_left_and_reruns_agree(spark, corpus):
    folder = corpus[0]
    key = lambda df: sorted([(r.doc_id, r.text, r.shard, r.slot) for r in df.collect()], key=str)
    assert key(corpus_pipeline.run(spark, folder)) == key(corpus_pipeline.run(spark, folder))


def test_stages_take_empty_tables(spark, corpus):
    docs = corpus[1].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0, name


def test_operators_carry_or_ignore_clashing_columns(spark, corpus):
    folder, docs, rows = corpus
    graded = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(30)], "doc_id long, grade int")
    model = toxicity.train(docs, graded)
    assert toxicity.score(docs, model).where("toxic").count() == 30
    out = sharding.shard(docs)
    assert set(docs.columns) < set(out.columns) and out.where("bucket <> 'BUCKET' or _bucket <> '_BUCKET'").count() == 0
    assert mixing.mix(docs).count() == near_dup.classes(docs).count() == len(rows)
    turns = spark.createDataFrame([(1, 1, "user", "a", "x", "y"), (1, 2, "assistant", "b", "x", "y")], "conv_id long, turn int, role string, text string, params string, call_id string")
    assert chat_format.link(chat_format.from_turns(turns), chat_format.schema_table(spark)).where("kind in ('call', 'result') and valid").count() == 2


def test_passages_may_have_text_identifiers(spark, corpus):
    _, docs, rows = corpus
    hit = next(t for i, t, _ in rows if i == 201).split()[70:100]
    bench = spark.createDataFrame([("mmlu/17", " ".join(hit)), ("a", "nothing that is found in any of these texts")], "item_id string, text string")
    got = decontaminate.match(docs, bench).where("contaminated").select("doc_id", "items", "item_id").collect()
    assert [tuple(r) for r in got] == [(201, ["mmlu/17"], "mmlu/17")]
    blocks = decontaminate.match(docs, bench, block=1).where("contaminated").select("doc_id", "items", "item_id").collect()
    assert blocks == got


def test_shards_of_records_that_differ_in_other_columns_do_not_hang_on_arrival(spark):
    docs = spark.createDataFrame([(i % 5, "same", i) for i in range(200)], "doc_id long, text string, n int")
    a, b = (sorted(map(tuple, sharding.shard(d).select("n", "shard", "slot").collect())) for d in (docs, docs.orderBy(F.desc("n")).repartition(6)))
    assert a == b


def test_free_names():
    assert free(["_A", "x"], "_a") == "__a" and free(["x"], "_a") == "_a"


def test_no_silent_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_mixing_deals_blocks_by_shard(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    few = mixing.mix(docs, shard_words=500)
    total = few.agg(F.sum("taken")).first()[0]
    assert abs(total - 30000) <= 64 * 41 and few.where("taken > 2 * size").count() == 0
