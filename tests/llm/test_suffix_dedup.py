import hashlib
import random
from collections import Counter

import numpy as np

from vereda.llm import suffix_dedup as s


def brute(texts, length):
    data = [(x or "").encode() for x in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_blind_trie_sorts():
    rnd = random.Random(3)
    for _ in range(300):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 12))]
        order, shared = s.blind_trie(strings)
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            assert shared[k] == s.common_prefix(strings[order[k - 1]], strings[order[k]])
        group = np.array([rnd.randint(0, 2) for _ in strings])
        order, shared = s.deep_shallow(strings, group, 8)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))


def test_equals_brute_force(spark):
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdé \n") for _ in range(400))
    for crowd in (20_000, 0):
        texts = [None, "", "x" * 90, "é" * 30, base, base, base[100:300], base[:150] + "Q" + base[150:], "ab" * 60, base[37:]]
        for _ in range(60):
            a, b = rnd.randint(0, 350), rnd.randint(0, 350)
            texts.append("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 50))) + base[a : a + rnd.randint(20, 90)] + rnd.choice("xyz") + base[b : b + rnd.randint(20, 90)])
        docs = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "doc_id long, text string, key string")
        got = {r.doc_id: tuple(r)[1:] for r in s.digests(s.remove_repeats(docs, 40, 10, crowd)).collect()}
        want = brute(texts, 40)
        for i, w in enumerate(want):
            assert got[i] == w, (i, texts[i])
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "abcdefghij" * 3 + "klmnop"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "0123456789" * 2), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in s.digests(s.remove_repeats(docs, 20, 5)).collect())
    assert got == [(0, 0, 0), (0, 20, 0), (1, 36, 36), (1, 36, 36)]
