import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vereda.llm import chat_format, decontaminate, license_scan, line_dedup, mixing, near_dup, sharding, toxicity

EDGE = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "\n \t", ""), (3, None, "b"), (4, "word " * 3000, "a"), (5, "under the MIT license", "b"), (5, "under the MIT license", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x", 9) for r in EDGE], "doc_id long, text string, source string, bytes string, size int")


def test_edge_rows_survive(spark, edge):
    for run in (license_scan.scan, mixing.mix, sharding.shard, line_dedup.remove_lines, near_dup.classes):
        assert run(edge).count() == len(EDGE), run
        assert run(edge.limit(0)).count() == 0, run
    bench = spark.createDataFrame([(1, "short"), (2, None), (None, "x")], "item_id long, text string")
    assert decontaminate.match(edge, bench).where("contaminated").count() == 0
    assert decontaminate.match(edge, bench.limit(0)).count() == len(EDGE)
    assert toxicity.score(edge, None).where("toxic or severity > 0").count() == 0
    assert toxicity.train(edge, spark.createDataFrame([(1, 0)], "doc_id long, grade int")) is None


def test_license_scan_places(spark):
    texts = ["Released UNDER the MIT-License, under the mit license", "Apache License, Version 2.0", "under the mit. no license", "CC BY-NC 4.0 cc by nc",
             "licensed under the new gnu general public license version 3"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].n_words) == (2, 1, 5, "mit", 9)
    assert (got[1].base_labels, got[1].first_word, got[1].score) == ("apache-2", 0, 1.0)
    assert (got[2].n_base, got[2].base_labels, got[2].first_word) == (0, "", None)
    assert (got[3].n_base, got[3].labels) == (2, "cc-by-nc")
    assert got[4].n_base == 0 and got[4].labels == "gpl-3" and 0.6 <= got[4].score < 1


def test_license_labels_of_alike_templates(spark):
    notice = "licensed under the GNU {} public license {}"
    texts = [notice.format("general", x) for x in ("version 2", "version 3", "")] + [notice.format("lesser general", "version 3"), "K\u0130T \u212a under the MIT license"]
    texts += [" filler ".join([notice.format("general", "version 2"), "word " * 70, notice.format("lesser general", "")])]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["gpl-2", "gpl-3", "gpl", "lgpl", "mit", "gpl-2,lgpl"]
    assert got[4].n_words == 6


def test_license_texts_never_get_base_places_by_chance(spark):
    rnd = random.Random(2)
    words = "under the mit license apache version 2 cc by nc".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    got = {r.doc_id: r.n_base for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, x in enumerate(texts):
        w = x.split()
        want = sum(w[j : j + len(p)] == p for p in (["under", "the", "mit", "license"], ["apache", "license", "version", "2"], ["cc", "by", "nc"]) for j in range(len(w)))
        assert got[i] == want


def test_mixing_targets_and_quotas(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 300), rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(9999, "x " * 5000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    order = [s for s in sorted(k for k in size if k is not None)] + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.size == len(rows[r.doc_id][1].split() if r.doc_id < 600 else ["x"] * 5000)
        assert r.target == pytest.approx(target[of[r.doc_id]]) and r.source_size == size[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK + 0.02 * target[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_sainte_lague_is_highest_quotients(spark):
    rnd = random.Random(8)
    for seats in (1, 7, 50):
        votes = [rnd.randint(0, 1000) for _ in range(9)]
        df = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, k int, p double, s long")
        got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], ["k"], "p", "s").collect()}
        top = sorted(((-v / (2 * n - 1), i) for i, v in enumerate(votes) if v for n in range(1, seats + 1)))[:seats]
        want = Counter(i for _, i in top)
        assert got == {i: want[i] for i in range(9)}


def test_sharding_law_and_determinism(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 50), i) for i in range(501)], "doc_id long, text string, slot int")
    a = sharding.shard(docs, 8, 2000).select("doc_id", "size", "shard", "slot").collect()
    b = sharding.shard(docs.repartition(7), 8, 2000).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(a) == sorted(b)
    count = Counter(r.shard for r in a)
    assert max(count.values()) - min(count.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in a if r.shard == s) == list(range(count[s]))
    assert all(r["size"] == 2 * (r.doc_id % 50) + 1 for r in a)
    assert sorted(sharding.fisher_yates(20, 1)) == list(range(20))


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(60, 200))] for _ in range(30)]
    texts = []
    for b in base:
        for _ in range(rnd.randint(1, 6)):
            w = list(b)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 9999)}"
            texts.append(" ".join(w))
    texts += ["one two", "One, two!", "", None, "a b c d e f " * 9, "a b c d e f " * 10]
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bags = []
    for x in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    number = {}
    ids = [{number.setdefault(k, len(number)): v for k, v in b.items()} for b in bags]
    for i in range(len(texts)):
        for j in range(i):
            common = ids[i].keys() & ids[j].keys()
            jp = sum(1 / sum(max(ids[i].get(e, 0) / ids[i][d], ids[j].get(e, 0) / ids[j][d]) for e in ids[i].keys() | ids[j].keys()) for d in common)
            if common:
                assert near_dup.probability_jaccard(ids[i], ids[j]) == pytest.approx(jp)
            if jp >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    rnd = random.Random(15)
    a, b, c, e, f = (" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(80)) for _ in range(5))
    rows = [(2, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c + " more"), (7, e), (7, f), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = {(2, a), (5, b), (7, e), (7, f), (8, ""), (9, None)}
    rest = [x for x in got if x not in want]
    assert len(got) == len(set(got)) == 7 and want <= set(got) and rest[0] in [(None, c), (None, c + " more")]


def test_probminhash_estimates_similarity():
    rnd = np.random.default_rng(1)
    gram = rnd.integers(0, 2**63, 300).astype(np.uint64)
    both = np.concatenate([gram[:240], gram[60:]])
    sig = near_dup.signatures(both, np.repeat([0, 1], 240), np.ones(480, np.int64), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 180 / 300) < 0.04


def test_line_dedup_keeps_the_first(spark):
    line = "This is a rather long line that repeats"
    docs = spark.createDataFrame([(3, f"{line}\nown words here é"), (1, f"x\n{line.upper()}!\n"), (2, f"a. {line}. {line}")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in line_dedup.remove_lines(docs).collect()}
    assert not got[1] and len(got[2]) == 2 and len(got[3]) == 1
    assert line_dedup.kept_text(f"{line}\nown words here é".encode(), [s.asDict() for s in got[3]]).decode() == "own words here é"


def test_line_dedup_takes_whole_lines_before_sentences(spark):
    short = "Menu one. Menu two. Menu three."
    shared = "these six words come in both"
    texts = [f"{short}\nnew. {shared}. tail", f"head here\n{short}\nother. {shared}. end", f"{short} more. {shared}"]
    got = {r.doc_id: r.spans for r in line_dedup.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kept = [line_dedup.kept_text(x.encode(), [s.asDict() for s in got[i]]).decode() for i, x in enumerate(texts)]
    assert kept == [texts[0], "head here\nother. end", f"{short} more. "]


def test_line_dedup_equals_plain_version(spark):
    import random
    import re

    rnd = random.Random(5)
    sentence = lambda: " ".join(rnd.choice("a b Ab é 1 x-y".split()) for _ in range(rnd.choice((2, 3, 6)))) + rnd.choice((".", "!", ""))
    pool = [sentence() for _ in range(12)]
    texts = ["\n".join(" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 5))) for _ in range(60)]
    words = lambda x: tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate({c: c + 32 for c in range(65, 91)})))
    want, seen, rest = {}, set(), []
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            w, size = words(line), len(line.encode())
            if len(w) >= 4 and w in seen:
                want.setdefault(i, []).append(at)
            else:
                rest.append((i, at, line))
                seen |= {w} if len(w) >= 4 else set()
            at += size + 1
    seen = set()
    for i, at, line in rest:
        for part in re.split(r"(?<=[.!?]) ", line):
            w = words(part)
            if len(w) >= 4 and w in seen:
                want.setdefault(i, []).append(at)
            seen |= {w} if len(w) >= 4 else set()
            at += len(part.encode()) + 1
    rows = line_dedup.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    assert {r.doc_id: [s.start for s in r.spans] for r in rows if r.spans} == {k: sorted(v) for k, v in want.items()}


def test_decontamination_finds_paraphrases(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(30)] + [(77, " ".join(passage))], "item_id long, text string")
    loose = [w for i, w in enumerate(passage) if i % 8 != 3]
    filler = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = [filler(100) + passage + filler(100), filler(30) + loose + filler(90), filler(200), passage[:15] + filler(60)]
    got = {r.doc_id: r for r in decontaminate.match(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string"), bench).collect()}
    assert got[0]["items"] == [77] and got[0].overlap == 1.0 and got[1]["items"] == [77]
    assert not got[2].contaminated and not got[3].contaminated
    assert decontaminate.lcs(np.array([1, 2, 3, 4]), np.array([2, 9, 3, 1, 4])) == 3


def test_decontamination_finds_what_the_cosine_misses(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(6, 30))] for _ in range(200)]
    texts = []
    for p in passages[:40]:
        p = list(p)
        for _ in range(rnd.choice([0, 0, len(p) // 5])):
            p[rnd.randrange(len(p))] = "other"
        host = [rnd.choice(words) for _ in range(rnd.choice([0, 40, 120, 700]))]
        at = rnd.randint(0, len(host))
        texts.append(host[:at] + p + host[at:])
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in decontaminate.match(docs, bench, rank=32).collect()}
    number = {w: i for i, w in enumerate([*words, "other"])}
    passages, texts = ([np.array([number[w] for w in x]) for x in y] for y in (passages, texts))
    for i, x in enumerate(texts):
        want = set()
        for k, p in enumerate(passages):
            tail, span = decontaminate.answer_length(" ".join(map(str, p)), len(p)), int(1.3 * len(p)) + 2
            inside = np.append(0, np.cumsum(np.isin(x, p)))
            for a in range(max(1, len(x) - span + 1)):
                y = x[a : a + span]
                if inside[min(len(x), a + span)] - inside[a] >= 0.6 * len(p) and (share := decontaminate.lcs(p, y) / len(p)) >= 0.6:
                    if share >= 0.8 or decontaminate.lcs(p[-tail:], y) >= 0.8 * tail:
                        want.add(k)
                        break
        assert want <= got[i], (i, want - got[i])
        for k in got[i] - want:  # six words more than a stretch are allowed
            assert decontaminate.lcs(passages[k], x) >= 0.6 * len(passages[k])


def test_toxicity_held_out(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        grade = rnd.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join([f"v{rnd.randint(0, 300)}" for _ in range(40)] + rnd.sample(["vile", "nasty", "foul"], 2) * (grade > 0) + ["horrid", "ghastly"] * (grade > 1)), grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade0 int")
    model = toxicity.train(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.col("grade0").alias("grade")))
    got = toxicity.score(docs.where("doc_id % 2 = 1"), model).collect()
    assert np.mean([r.toxic == (r.grade0 > 0) for r in got]) > 0.97
    mean = [np.mean([r.severity for r in got if r.grade0 == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.2 < mean[1] < mean[2]
    assert model.thresholds[0] < model.thresholds[1]


def test_chat_links_json_calls(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id":"c1","content":"early"}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"c1","name":"add","arguments":"{\\"b\\":2,\\"a\\":1}"},{"id":"c2","name":"add","arguments":"{\\"a\\":\\"x\\",\\"z\\":0}"}]}'),
        (1, 3, "tool", '{"tool_call_id":"c2","content":"3"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"3"}'), (None, None, None, None),
    ]
    messages = chat_format.from_json_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    schema = chat_format.schema_table(spark, {"add": {"a": ("BIGINT", True), "b": ("BIGINT", True)}})
    got = sorted(chat_format.link(messages, schema).where("conv_id = 1").collect(), key=lambda r: r.position)
    assert [(r.kind, r.call_id) for r in got] == [("message", None), ("call", "1:c1"), ("call", "1:c2"), ("result", "1:c1"), ("result", "1:c2"), ("orphan", "1:zz")]
    assert got[1].valid and '"arguments":{"a":1,"b":2}' in got[1].json
    assert got[2].faults == "missing b; type a; unknown z"


def test_chat_identifiers_are_those_of_their_conversation(spark):
    rows = [(c, t, r, f"{c} {t}", 1) for c in (None, "null", "a:1", "a") for t, r in ((1, "user"), (2, "assistant"))]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, params int")
    schema = chat_format.schema_table(spark)
    linked = chat_format.link(chat_format.from_turns(turns).withColumn("params", F.lit(1)), schema).collect()
    assert sorted((r.kind, r.linked_turn, r.position) for r in linked) == [("call", 2, 0)] * 4 + [("result", 1, 1)] * 4
    assert chat_format.link(chat_format.from_turns(turns.limit(0)), schema).count() == 0


def test_large_group_of_near_copies_loses_no_link(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(200):
        w = list(base)
        for _ in range(rnd.randint(3, 9)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 99999)}"
        texts.append(" ".join(w + (w[:40] if rnd.random() < 0.3 else [])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    number = {}
    bags = [Counter(number.setdefault(tuple(w[i : i + 5]), len(number)) for i in range(len(w) - 4)) for w in (x.split() for x in texts)]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and near_dup.probability_jaccard(bags[i], bags[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert len(set(got.values())) > 20
    assert got == {i: find(i) for i in range(len(texts))}


def test_bound_never_drops_a_pair_that_reaches_the_similarity(spark):
    rnd = random.Random(4)
    texts, passage = [], [f"p{i}" for i in range(40)]
    for _ in range(60):
        w = [f"w{rnd.randint(0, 60 if rnd.random() < 0.5 else 9999)}" for _ in range(rnd.randint(5, 400))]
        w += passage * rnd.choice([0, 0, 6])
        v = [x if rnd.random() > rnd.choice([0.002, 0.02]) else "z" for x in w] + passage * rnd.choice([0, 0, 1])
        texts += [" ".join(w), " ".join(v)]
    sides = [near_dup.features(*near_dup.t.column_bytes(near_dup.pa.array([x.encode()]))) for x in texts]
    bags = [dict(zip(g.tolist(), c.tolist(), strict=True)) for g, _, c in sides]
    known = np.concatenate([near_dup.sketch(g, r, c, 1) for g, r, c in sides])
    reach = 0
    for similarity in (0.5, 0.7, 0.8, 0.9):
        for i, ok in enumerate(near_dup.may_reach(known[::2], known[1::2], similarity)):
            close = near_dup.probability_jaccard(bags[2 * i], bags[2 * i + 1]) >= similarity
            reach += close
            assert ok or not close
    assert reach > 60


def test_blocks_and_star_steps_give_the_same_classes(spark, monkeypatch):
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 99999)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(near_dup.classes(docs).collect())
    monkeypatch.setattr(near_dup, "SPAN", 7)
    monkeypatch.setattr(near_dup, "STEP", 50)
    monkeypatch.setattr(near_dup.connected, "__defaults__", (0,))
    assert sorted(near_dup.classes(docs).collect()) == want
    assert 1 < len({r.class_id for r in want}) < 90
