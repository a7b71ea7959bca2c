"""Benchmark decontamination by latent semantic retrieval.

The benchmark passages' TF-IDF matrix (document frequencies counted over all documents) gets a randomised singular
value decomposition: random start, then power steps Z <- A'(A Z), each a pass of Spark tasks that add up partial
products, and a Rayleigh-Ritz step. Every window of `window` words of every document is projected to that space; pairs
of a window and a passage with a cosine of `cosine` or more are candidates. In the densest stretch of a candidate's
surroundings the longest common subsequence with the passage is taken: a document is contaminated by a passage if it
covers `strong` of the passage's words, or `weak` of them and `answer` of the passage's last sentence.

What the cosine misses is found exactly. A stretch that covers a share of n words leaves out the rest of them at most, so
it holds one of any set of more words than that: of the rarest ones. Every piece of a document with such a word of a
passage, and with words for `weak` of it, is searched at each place dense enough. Only a passage spread over more than
1.3 times its length is out of reach.

Documents are read twice and never shuffled. Passages are handled in blocks of `block`, so what a task holds has a fixed
bound. Defined cases: passages of under `least` words match nothing; null and empty texts match nothing; a table
without passages gives clean documents; identifiers of passages are text or integers; repeated rows are judged alike; extra columns are carried along, or replaced
where they have a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vereda.llm import _text as t
from vereda.llm._work import widened

RANK, WINDOW, COSINE, STRONG, WEAK, ANSWER, LEAST, BLOCK, POWER, SEED = 96, 64, 0.6, 0.8, 0.6, 0.8, 6, 4096, 2, 20240610
#: Words between the starts of two pieces at least; piece x word flags and pairs or words of pairs held at a time.
PIECE, FLAGS, HELD = 256, 1 << 24, 1 << 20
ADDED = ["n_items", "items", "item_id", "cosine", "overlap", "contaminated"]


def added(id_type: str) -> str:
    return f"n_items long, items array<{id_type}>, item_id {id_type}, cosine double, overlap double, contaminated boolean"


def tokens(texts: list[str]) -> list[np.ndarray]:
    out = []
    for low, high, buf, offs in t.slices(pa.array([x.encode() for x in texts], pa.binary())):
        starts, ends, first = t.words(buf, offs, t.ALNUM)
        h = t.range_hash(t.prefix_hash(buf, lower=True), starts, ends)
        out += [h[first[i] : first[i + 1]] for i in range(high - low)]
    return out


def answer_length(text: str, n: int) -> int:
    """Words of the last sentence; a third of the passage if it has one sentence."""
    parts = [x for x in text.replace("\n", ". ").split(". ") if any(c.isalnum() for c in x)]
    last = len(tokens([parts[-1]])[0]) if len(parts) > 1 else 0
    return min(n, last if last >= 3 else max(3, n // 3))


def look_up(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary, or -1."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each vocabulary word occurs, and the number of documents."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, buf, offs in t.slices(batch.column(0)):
                starts, ends, first = t.words(buf, offs, t.ALNUM)
                at = look_up(vocabulary, t.range_hash(t.prefix_hash(buf, lower=True), starts, ends))
                known = at >= 0
                df += np.bincount(np.unique(t.rows_of(first)[known] * np.int64(size) + at[known]) % size, minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["word", "df"])

    got = docs.select(F.col("text").cast("binary")).mapInArrow(t.lean(run), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    word, count = got.column(0).to_numpy(), got.column(1).to_numpy()
    df = np.zeros(size, np.int64)
    df[word[word >= 0]] = count[word >= 0]
    return df, int(count[word < 0].sum())


def tfidf(rows: list[np.ndarray], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for r in rows:
        word, tf = np.unique(r, return_counts=True)
        w = tf * idf[word]
        out.append((word, w / max(np.linalg.norm(w), 1e-12)))
    return out


def latent_basis(spark, rows: list[tuple[np.ndarray, np.ndarray]], size: int, rank: int = RANK, power: int = POWER, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors (size x rank) of the sparse rows, by a randomised range finder over Spark tasks."""
    rank = min(rank, len(rows), size)
    data = [(w.astype(np.int64).tobytes(), v.astype(np.float64).tobytes()) for w, v in rows]
    matrix = spark.createDataFrame(data, "words binary, weights binary").repartition(max(1, min(64, len(rows) // 64)))
    strip = 2048

    def product(z: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(z)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, total, some = held.value, np.zeros(held.value.shape), False
            for batch in batches:
                for words, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w, v = np.frombuffer(words, np.int64), np.frombuffer(weights, np.float64)
                    total[w] += v[:, None] * (v @ z[w])[None, :]
                    some = True
            for k in range(0, len(z), strip) if some else ():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + strip].tobytes()])], ["strip", "part"])

        def add(parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in parts.column("part").to_pylist())
            return pa.table({"strip": parts.column("strip").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

        got = matrix.mapInArrow(t.lean(run), "strip long, part binary").groupBy("strip").applyInArrow(add, "strip long, part binary").toArrow()
        out = np.zeros(z.shape)
        for k, part in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
            x = np.frombuffer(part, np.float64).reshape(-1, z.shape[1])
            out[k : k + len(x)] = x
        held.destroy()
        return out

    z = np.random.default_rng(seed).standard_normal((size, min(size, rank + 16)))
    for _ in range(power):
        z = np.linalg.qr(product(np.linalg.qr(z)[0]))[0]
    values, turn = np.linalg.eigh(z.T @ product(z))
    return (z @ turn[:, np.argsort(-values)])[:, :rank]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel in the shorter side."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rarest(own: np.ndarray, df: np.ndarray, share: float) -> np.ndarray:
    """The rarest of the passage's words, so many that any text that covers the share of it holds one of them."""
    need = max(1, int(np.ceil(share * len(own) - 1e-9)))
    return own[np.argsort(df[own], kind="stable")[: len(own) - need + 1]]


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices begin, begin + 1, ... of each run of `count`."""
    return np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)


def match(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, window: int = WINDOW, cosine: float = COSINE, strong: float = STRONG, weak: float = WEAK,
          answer: float = ANSWER, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """All columns of docs with the passages that contaminate each: n_items, items, and of the best one id, cosine, overlap."""
    names = ADDED
    docs = docs.drop(*names)
    id_type = "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "bigint"
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast(id_type).alias("item_id"), F.col("text").alias("passage"))
    n = items.count()
    out = docs
    if n > block:
        numbered = items.withColumn("part", F.floor((F.row_number().over(Window.orderBy("item_id", "passage")) - 1) / block))
        groups = [numbered.where(F.col("part") == k) for k in range(-(-n // block))]
    else:
        groups = [items]
    for k, group in enumerate(groups):
        searched = _search(out, docs if k else out, group, rank, window, cosine, strong, weak, answer, least)
        if k:
            a, b = searched, names
            both = F.array_distinct(F.concat("items", "_items"))
            better = F.struct("overlap", "cosine", F.lit(1)) >= F.struct("_overlap", "_cosine", F.lit(0))
            a = a.withColumn("items", both).withColumns({c: F.when(better, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("item_id", "cosine", "overlap")})
            searched = a.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.size("items") > 0}).drop(*[f"_{c}" for c in b])
        out = searched
        if k + 1 < len(groups):
            out = out.withColumnsRenamed({c: f"_{c}" for c in names})
    return out


def _search(docs: DataFrame, corpus: DataFrame, items: DataFrame, rank, window, cosine, strong, weak, answer, least) -> DataFrame:
    rows = sorted((r.item_id, r.passage) for r in items.collect())
    hashes = tokens([text for _, text in rows])
    kept = [i for i, h in enumerate(hashes) if len(h) >= least]
    ids = [rows[i][0] for i in kept]
    schema = widened(docs, added(items.schema["item_id"].dataType.simpleString()))
    id_type = pa.string() if items.schema["item_id"].dataType.simpleString() == "string" else pa.int64()
    hashes, tails = [hashes[i] for i in kept], [answer_length(rows[i][1], len(hashes[i])) for i in kept]
    place, half = docs.columns.index("text"), window // 2
    if kept:
        vocabulary = np.unique(np.concatenate(hashes))
        df, total = document_frequencies(corpus, vocabulary)
        idf = np.log((1 + total) / (1 + df)) + 1
        words = [look_up(vocabulary, h) for h in hashes]
        known_words = [np.unique(w) for w in words]
        weighted = tfidf(words, idf)
        basis = latent_basis(docs.sparkSession, weighted, len(vocabulary), rank)
        latent = np.stack([v @ basis[w] for w, v in weighted])
        latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        loads = (basis * idf[:, None]).astype(np.float32)
        signs = [np.union1d(rarest(w, df, strong), min(rarest(w, df, weak), rarest(w[-k:], df, answer), key=lambda x: df[x].sum())) for w, k in zip(words, tails, strict=True)]
        sign = np.concatenate(signs)
        signed = np.repeat(np.arange(len(words)), [len(x) for x in signs])[np.argsort(sign, kind="stable")]
        signed_at = np.append(0, np.cumsum(np.bincount(sign, minlength=len(vocabulary))))
        length = np.array([len(w) for w in words])
        every, every_at = np.concatenate(words), np.append(0, np.cumsum(length))
        piece = max(PIECE, int(1.3 * length.max()) + 8)

    def covered(own: np.ndarray, i: int, stretch: np.ndarray) -> float | None:
        """Share of passage i that the stretch has in order, if that contaminates."""
        share = lcs(own, stretch) / len(own)
        if share >= strong or share >= weak and lcs(own[-tails[i] :], stretch) >= answer * tails[i]:
            return share
        return None

    def density(region: np.ndarray, i: int) -> tuple[np.ndarray, int]:
        """Words of passage i in the stretch from each place on, and the length of a stretch."""
        inside = np.zeros(len(region) + 1, np.int64)
        np.cumsum(look_up(known_words[i], region) >= 0, out=inside[1:])
        span = min(len(region), int(1.3 * len(words[i])) + 2)
        return inside[span:] - inside[:-span], span

    def judge(region: np.ndarray, i: int) -> float | None:
        """Share of passage i that the densest stretch of the region has in order, if that contaminates."""
        own = words[i]
        dense, span = density(region, i)
        at = int(dense.argmax())
        if dense[at] < weak * len(own):
            return None
        return covered(own, i, region[max(0, at - 3) : at + span + 3])

    def judge_all(region: np.ndarray, i: int) -> float | None:
        """The same at every place that is dense enough: six words more make a stretch hold those of the next six places."""
        dense, span = density(region, i)
        best, after = None, 0
        for at in np.flatnonzero(dense >= weak * len(words[i])).tolist():
            if at >= after:
                after = at + 7
                share = covered(words[i], i, region[at : at + span + 6])
                best = share if best is None else max(best, share or 0.0)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(max(FLAGS, len(vocabulary)) if kept else 0, bool)
        for batch in batches:
            for low, high, buf, offs in t.slices(batch.column(place), 1 << 18):
                found: list[dict[int, tuple[float, float]]] = [{} for _ in range(high - low)]
                if kept:
                    starts, ends, first = t.words(buf, offs, t.ALNUM)
                    word = look_up(vocabulary, t.range_hash(t.prefix_hash(buf, lower=True), starts, ends))
                    near, offset = similar(word, first)
                    for row, i, cos, a, b in candidates(near, offset, first):
                        if (share := judge(word[a:b], i)) is not None:
                            found[row][i] = max(found[row].get(i, (0.0, 0.0)), (round(share, 6), round(float(cos), 4)))
                    missed: dict[tuple[int, int], float] = {}
                    for row, i, a, b in sharing(word, first, flags):
                        if i not in found[row] and (share := judge_all(word[a:b], i)) is not None:
                            missed[row, i] = max(missed.get((row, i), 0.0), share)
                    for (row, i), share in missed.items():
                        found[row][i] = round(share, 6), round(float(near[offset[row] : offset[row + 1], i].max()), 4)
                best = [max(((*v, -i) for i, v in f.items()), default=None) for f in found]
                columns = [
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([[ids[i] for i in sorted(f)] for f in found], pa.list_(id_type)),
                    pa.array([None if x is None else ids[-x[2]] for x in best], id_type),
                    pa.array([0.0 if x is None else x[1] for x in best], pa.float64()),
                    pa.array([0.0 if x is None else x[0] for x in best], pa.float64()),
                    pa.array([bool(f) for f in found], pa.bool_()),
                ]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *ADDED])

    def sharing(word: np.ndarray, first: np.ndarray, flags: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, passage, start, end) of the pieces that hold a sign of the passage and words for the weak share of it."""
        size, row = len(vocabulary), t.rows_of(first)
        many = np.maximum(1, -(-np.diff(first) // piece) - 1)
        offset = np.append(0, np.cumsum(many))
        known = np.flatnonzero(word >= 0)
        step, of = (known - first[row[known]]) // piece, row[known]
        here, before = step < many[of], step > 0
        key = np.unique(np.concatenate([(offset[of] + step)[here] * size + word[known[here]], (offset[of] + step - 1)[before] * size + word[known[before]]]))
        p, w = key // size, key % size
        hits = np.diff(signed_at)[w]
        total = np.append(0, np.cumsum(hits))
        a = 0
        while a < len(p):
            full = int(np.searchsorted(total, total[a] + HELD, "right")) - 1
            limit = min(p[a] + max(1, FLAGS // size), max(p[a] + 1, p[full] if full < len(p) else offset[-1]))
            b, base = int(np.searchsorted(p, limit)), p[a]
            pair = np.unique(np.repeat(p[a:b], hits[a:b]) * len(words) + signed[spread(signed_at[w[a:b]], hits[a:b])])
            held = (p[a:b] - base) * size + w[a:b]
            flags[held] = True
            ends = np.append(0, np.cumsum(length[pair % len(words)]))
            c = 0
            while c < len(pair):
                d = max(c + 1, int(np.searchsorted(ends, ends[c] + HELD, "right")) - 1)
                q, i = np.divmod(pair[c:d], len(words))
                there = flags[np.repeat((q - base) * size, length[i]) + every[spread(every_at[i], length[i])]]
                enough = np.add.reduceat(there, ends[c:d] - ends[c], dtype=np.int64) >= weak * length[i]
                for x, k in zip(q[enough].tolist(), i[enough].tolist(), strict=True):
                    r = int(np.searchsorted(offset, x, "right")) - 1
                    start = int(first[r] + (x - offset[r]) * piece)
                    yield r, k, start, min(int(first[r + 1]), start + 2 * piece)
                c = d
            flags[held] = False
            a = b

    def similar(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each window with each passage, and the index of each row's first window: two half windows, at each half window."""
        row = t.rows_of(first)
        known = np.flatnonzero(word >= 0)
        step = (np.arange(len(word)) - first[row]) // half
        offset = np.append(0, np.cumsum(np.diff(first) // half + 1))
        cell = (offset[row] + step)[known]
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        sums = np.zeros((offset[-1] + 1, loads.shape[1]), np.float32)
        if len(known):
            sums[cell[edge]] = np.add.reduceat(loads[word[known]], edge, axis=0)
        last = offset[1:] - 1
        both = sums[:-1].copy()
        inner = np.ones(len(both), bool)
        inner[last] = False
        both[inner] += sums[1:][inner]
        both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-12)
        return both @ latent.T, offset

    def candidates(near: np.ndarray, offset: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, passage, cosine, start, end of the surroundings) of the windows near a passage."""
        at, i = np.nonzero(near >= cosine)
        if not len(at):
            return
        own = np.searchsorted(offset, at, "right") - 1
        order = np.lexsort((at, i, own))
        at, i, own = at[order], i[order], own[order]
        new = np.append(True, (own[1:] != own[:-1]) | (i[1:] != i[:-1]) | (at[1:] > at[:-1] + 2))
        for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)), strict=True):
            r, k = int(own[a]), int(i[a])
            wide = len(words[k])
            start, end = first[r] + (at[a] - offset[r]) * half - wide, first[r] + (at[b - 1] - offset[r]) * half + window + wide
            yield r, k, float(near[at[a:b], k].max()), max(int(first[r]), int(start)), min(int(first[r + 1]), int(end))

    return docs.mapInArrow(t.lean(run), schema)
