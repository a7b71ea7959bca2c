import random

import numpy as np

from vereda.llm import _text as t
from vereda.llm import quality


def brute(words, least=5):
    out = {}
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            out[i] = best
    return out


def test_longest_repeats_equal_brute_force():
    rnd = random.Random(5)
    for trial in range(60):
        rows = [[rnd.choice("ab" if trial % 3 else "abcdefgh") for _ in range(rnd.randint(0, 60))] for _ in range(4)]
        rows.append(["x"] * rnd.randint(0, 40))
        rows.append([f"w{i % 17}" for i in range(rnd.randint(0, 80))])
        first = np.append(0, np.cumsum([len(r) for r in rows]))
        flat = [w for r in rows for w in r]
        h = t.mix(np.array([abs(hash(w)) % 2**60 for w in flat], dtype=np.uint64))
        if not flat:
            continue
        at, length = quality.longest_repeats(h, t.rows_of(first))
        want = {first[k] + i: n for k, r in enumerate(rows) for i, n in brute(r).items()}
        assert dict(zip(at.tolist(), length.tolist(), strict=True)) == want


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if any(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x))]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_equal_plain_version(spark):
    rnd = random.Random(1)
    texts = [None, "", " ", "\n\n", "a\na\n a\na", "é ü\tx\x0b#*é", " ".join(f"é{i % 7}" for i in range(200)), "one " * 9, "one two three four five six seven eight nine ten eleven"]
    texts += ["\n".join(" ".join(rnd.choice("a b ç <d> x%".split()) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, x in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(x), x
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert got[8].kept and not got[7].kept
    assert quality.judge(docs.limit(0)).count() == 0
