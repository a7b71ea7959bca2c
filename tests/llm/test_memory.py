import re

import pyarrow as pa

from vereda.llm import _text, _work, mixing, near_dup

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sizes(df):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return df.mapInArrow(run, "n long")


def test_python_functions_get_few_rows_at_once(spark):
    before = spark.conf.get(NAME)
    assert max(r.n for r in near_dup.written(sizes(spark.range(0, 5000, 1, 1)), "sizes").collect()) <= 1000
    assert spark.conf.get(NAME) == before
    try:
        for held, most in (("0", 700), ("300", 300)):
            spark.conf.set(NAME, held)
            got = [r.n for r in _work.written(sizes(spark.range(0, 5000, 1, 1)), "sizes", 700).collect()]
            assert max(got) <= most and sum(got) == 5000 and spark.conf.get(NAME) == held
    finally:
        spark.conf.set(NAME, before)


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_a_worker_gives_back_memory_after_its_task():
    def run(batches):
        for _ in batches:
            _text.powers(1 << 22)
            yield anonymous_mb()

    before = anonymous_mb()
    (during,) = _text.lean(run)([None])
    assert during - before > 50 and anonymous_mb() - before < 20


def test_classes_do_not_hang_on_batch_and_step(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 3 * 7 + j) % 97}" for j in range(30)) + (" x" if i % 3 else "")) for i in range(90)], "doc_id long, text string")
    want = sorted(near_dup.classes(docs).collect())
    monkeypatch.setattr(near_dup, "BATCH", 7)
    monkeypatch.setattr(near_dup, "STEP", 5)
    assert sorted(near_dup.classes(docs).collect()) == want and max(r.class_size for r in want) > 1


def test_near_duplicates_deal_only_texts_and_profiles_with_a_partner(spark, monkeypatch):
    """The joins with texts and with profiles sift them before they are dealt; the classes are those of joins without sifting."""
    from contextlib import nullcontext

    from vereda.llm import _work, near_dup

    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)]
    texts = [*base, *base[:6], *(t.replace("x30", "y") for t in base[:10])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, plans, plain = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}, _work.written
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    held = spark.conf.get(name)

    def written(df, name, batch=None):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString().count("might_contain"))
        return plain(df, name, batch)

    monkeypatch.setattr(_work, "written", written)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(near_dup.classes(docs.repartition(3)).collect())
        docs.write.mode("overwrite").parquet(path := f"{_work.shared_dir(spark)}/sifted-docs")
        stored = sorted(near_dup.classes(spark.read.parquet(path)).collect())
        assert plans["profiles"][-1] and plans["pivots"][-1] and plans["close"][-1]
        monkeypatch.setattr(_work, "sifted", lambda spark: nullcontext())
        plans.clear()
        assert sorted(near_dup.classes(spark.read.parquet(path)).collect()) == got == stored
        assert not sum(sum(x) for x in plans.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.conf.get(name) == held


def test_mixing_sends_no_list_of_blocks_to_every_executor(spark):
    """The blocks grow with the words; a join that broadcasts them holds them all in the driver."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * 50), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block=1, shard_words=5000)
    assert sum(r.taken for r in got.collect()) == 22_500
    joins = re.findall(r"\w+Join \[source_no#\d+, shard#\d+L?, block#\d+L?\]", got._jdf.queryExecution().executedPlan().toString())
    assert joins and not any("Broadcast" in x for x in joins), joins
