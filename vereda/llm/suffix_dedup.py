"""Exact removal of repeated 400-byte strings, from deep-shallow sorted suffixes.

Every window of `length` bytes is named by an anchor: the position in it whose `gram` bytes have the least hash. Equal
windows have equal anchors at equal places, so only anchors whose hash occurs twice or more in the corpus can stand in a
repeated window; all others are settled by one count. A run of windows with one anchor is a segment. If all segments
of an anchor hash are equal, they are repeats as they stand. Otherwise the distinct segments of the hash meet in one
task, which sorts the suffixes from their anchors on, and the reversed beginnings before their anchors, deep-shallow:
multikey quicksort, in 8-byte letters, to `SHALLOW` bytes, then a blind trie for each group with a longer common prefix.
The common prefixes give, for each place of the anchor in the window, classes of equal right and of equal left parts;
windows that share both are equal bytes. A hash with more than `crowd` distinct segments is not gathered: its windows
are counted one by one, which needs no group in one task.

Two passes over the texts and two shuffles of them; other shuffles hold anchors, or the bytes of segments in question.
Defined cases: null is empty; texts under `length` bytes lose nothing; repeated rows are repeats of one another and lose
all bytes of their windows; ties cannot occur, as all occurrences are removed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vereda.llm import _text as t
from vereda.llm._work import written

LENGTH, GRAM, SHALLOW, CROWD = 400, 100, 160, 20_000
CHUNK, BATCH = 1 << 22, 20_000
U64 = np.uint64


def anchors(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, position, first window, last window, hash of the segment's bytes) of each segment of one text."""
    outs = []
    for at in range(0, len(buf) - length + 1, CHUNK):
        part = buf[at : at + CHUNK + length - 1]
        prefix = t.prefix_hash(part)
        n = len(part) - gram + 1
        h = t.range_hash(prefix, np.arange(n), np.arange(gram, n + gram))
        place = U64(24)
        least = t.sliding_min((h >> place << place) | np.arange(n, dtype=U64), length - gram + 1)
        pos = (least & U64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(pos)) - 1
        pos = pos[first]
        outs.append((h[pos], pos + at, first + at, last + at, t.range_hash(prefix, first, last + length)))
    if not outs:
        return (np.zeros(0, U64),) * 5
    return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings and the common prefix of each with the one before.

    Inner nodes are [depth, {byte: child}], a leaf a list of equal strings' indices; an ended string's byte is -1. To
    insert, follow the bytes at the nodes' depths without looking between, compare once with any string below, and split
    the path where they differ.
    """
    root: list = [0]
    for i, s in enumerate(strings):
        if i == 0:
            continue
        n, node, path = len(s), root, []
        while node and isinstance(node[-1], dict):
            path.append(node)
            b = s[node[0]] if node[0] < n else -1
            nxt = node[1].get(b)
            if nxt is None:
                nxt = next(iter(node[1].values()))
                node = nxt
                while isinstance(node[-1], dict):
                    node = next(iter(node[1].values()))
                break
            node = nxt
        other = strings[node[0]]
        d = common_prefix(s, other)
        if d == n == len(other):
            node.append(i)
            continue
        parent = None
        for p in path:
            if p[0] >= d:
                break
            parent = p
        mine = s[d] if d < n else -1
        if parent is None:
            below, holder = root, None
        else:
            holder = parent[1]
            key = s[parent[0]] if parent[0] < n else -1
            below = holder.get(key)
        if below is not None and isinstance(below[-1], dict) and below[0] == d:
            below[1][mine] = [i]
        else:
            node = [d, {mine: [i], (other[d] if d < len(other) else -1): below}]
            if holder is None:
                root = node
            else:
                holder[key] = node
    order, shared, depth = [], [], 0
    stack: list = [(0, root)]
    while stack:
        depth, node = stack.pop()
        if isinstance(node[-1], dict):
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(node[0], c) for c in reversed(children[1:])] + [(depth, children[0])]
        else:
            order += node
            shared += [depth] + [len(strings[node[0]])] * (len(node) - 1)
    return order, shared


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and the common prefix of each string with the one before (0 at a group's first)."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    letters = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), np.uint8).reshape(n, shallow)
    wide = letters.view(">u8").astype(U64).reshape(n, shallow // 8)
    order = np.lexsort((np.minimum(sizes, shallow), group))
    part = np.append(True, group[order][1:] != group[order][:-1])
    for depth in range(wide.shape[1]):
        open_ = ~(part & np.append(part[1:], True))
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        head = np.maximum.accumulate(np.where(part, np.arange(n), 0))[at]
        turn = np.lexsort((wide[order[at], depth], head))
        order[at] = order[at[turn]]
        w = wide[order[at], depth]
        part[at[1:]] |= (w[1:] != w[:-1]) & (at[1:] == at[:-1] + 1)
    shared = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    differ = letters[a] != letters[b]
    shared[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), shallow), np.minimum(sizes[a], sizes[b]))
    shared[1:][group[a] != group[b]] = 0
    edge = np.flatnonzero(part)
    for low, high in zip(edge, np.append(edge[1:], n), strict=True):
        if high - low > 1:
            own = order[low:high]
            deep, lcp = blind_trie([strings[i] for i in own])
            order[low:high] = own[deep]
            shared[low + 1 : high] = lcp[1:]
    return order, shared


def repeated_windows(segments: list[bytes], group: np.ndarray, before: np.ndarray, low: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each segment and each place of the anchor in a window, whether another segment has the same window.

    before: bytes of the segment ahead of its anchor, so a window with the anchor at place l exists for low <= l <= before.
    """
    n = len(segments)
    right, right_lcp = deep_shallow([s[b:] for s, b in zip(segments, before.tolist(), strict=True)], group)
    left, left_lcp = deep_shallow([s[:b][::-1] for s, b in zip(segments, before.tolist(), strict=True)], group)
    fresh = [np.append(True, group[o][1:] != group[o][:-1]) for o in (right, left)]
    twice = np.zeros((n, length - gram + 1), bool)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for place in range(length - gram + 1):
        a[right] = np.cumsum(fresh[0] | (right_lcp < length - place))
        b[left] = np.cumsum(fresh[1] | (left_lcp < place))
        here = np.flatnonzero((low <= place) & (place <= before))
        key = a[here] * (n + 1) + b[here]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice[here[order[1:][same]], place] = True
        twice[here[order[:-1][same]], place] = True
    return twice


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = t.column_bytes(batch.column(2))
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, rows = [], 0
            for i in np.flatnonzero(np.diff(offs) >= length):
                got = anchors(buf[offs[i] : offs[i + 1]], length, gram)
                held.append((np.full(len(got[0]), r1[i]), np.full(len(got[0]), r2[i]), *got))
                rows += len(got[0])
                if rows > 50_000:
                    yield pack(held)
                    held, rows = [], 0
            if held:
                yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        r1, r2, key, pos, low, high, seg = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = [r1, r2, key.view(np.int64), seg.view(np.int64), pos, (pos - low).astype(np.int16), (pos - high).astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["r1", "r2", "key", "seg", "pos", "most", "least"])

    return docs.select("r1", "r2", "text").mapInArrow(run, "r1 long, r2 long, key long, seg long, pos long, most short, least short")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments (r1, r2, want: array of key, pos, most, least, n), cut from their texts."""
    joined = docs.select("r1", "r2", "text").join(wanted, ["r1", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                want = batch.column(3)[i].values.flatten()
                key, pos, most, least, n, crowded = (np.asarray(x) for x in want)
                for at in range(0, len(key), 4096):
                    s = slice(at, at + 4096)
                    cut = [text.slice(p - m, m - low + length).to_pybytes() for p, m, low in zip(pos[s].tolist(), most[s].tolist(), least[s].tolist(), strict=True)]
                    k = len(cut)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, x)) for x in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())] + [pa.array(x[s]) for x in (key, pos, most, least, n, crowded)] + [pa.array(cut, pa.binary())],
                        ["r1", "r2", "key", "pos", "most", "least", "n", "crowded", "bytes"],
                    )

    return joined.mapInArrow(run, "r1 long, r2 long, key long, pos long, most short, least short, n long, crowded boolean, bytes binary")


def _sorted_spans(segments: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (r1, r2, start, end) of single segments that share windows with others of their key."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        key, pos, most, least, n = (rows.column(c).to_numpy() for c in ("key", "pos", "most", "least", "n"))
        most, least = most.astype(np.int64), least.astype(np.int64)
        group = np.cumsum(np.append(True, key[1:] != key[:-1]))
        twice = repeated_windows(rows.column("bytes").to_pylist(), group, most, least, length, gram)
        twice[n > 1] = False  # equal segments elsewhere: settled already
        padded = np.zeros((len(key), twice.shape[1] + 2), bool)
        padded[:, 1:-1] = twice
        row, first = np.nonzero(padded[:, 1:-1] & ~padded[:, :-2])
        _, last = np.nonzero(padded[:, 1:-1] & ~padded[:, 2:])
        out = [rows.column("r1").to_numpy()[row], rows.column("r2").to_numpy()[row], pos[row] - last, pos[row] - first + length]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["r1", "r2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # keys come sorted; the last may go on
                if cut:
                    yield solve(whole.slice(0, cut).to_batches())
                    held = whole.slice(cut).to_batches()
        if held:
            yield solve(held)

    return segments.repartition("key").sortWithinPartitions("key").mapInArrow(run, "r1 long, r2 long, start long, end long")


def _counted_spans(segments: DataFrame, length: int) -> DataFrame:
    """The same for crowded keys, by counting each window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r1, r2, _, pos, most, _, n, _, data = (c[i].as_py() for c in batch.columns)
                buf = np.frombuffer(data, np.uint8)
                at = np.arange(len(buf) - length + 1)
                h1 = t.range_hash(t.prefix_hash(buf), at, at + length)
                h2 = t.range_hash(t.prefix_hash(buf[::-1] ^ 0x5A), len(buf) - length - at, len(buf) - at)
                k = len(at)
                columns = [np.full(k, r1), np.full(k, r2), h1.view(np.int64), h2.view(np.int64), at + pos - most, np.full(k, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["r1", "r2", "h1", "h2", "start", "n"])

    windows = segments.mapInArrow(run, "r1 long, r2 long, h1 long, h2 long, start long, n long")
    often = windows.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h1", "h2")
    return windows.where("n = 1").join(often, ["h1", "h2"]).select("r1", "r2", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes), spans (removed [start, end) of the input), and counts."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(7), "doc_id").alias("r2"), text.alias("text"))
    found = _anchor_rows(docs, length, gram)
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("seg").alias("seg_low"), F.max("seg").alias("seg_high")).where("n > 1")
    again = written(found.join(keys.select("key", (F.col("seg_low") == F.col("seg_high")).alias("alike")), "key"), "anchors")

    different = again.where("not alike").groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("r1", "r2", "pos", "most", "least")).alias("one"))
    different = written(different, "segments")
    crowded = different.groupBy("key").agg((F.count("*") > crowd).alias("crowded"))
    wanted = different.join(crowded, "key").select("one.r1", "one.r2", F.struct("key", "one.pos", "one.most", "one.least", "n", "crowded").alias("w"))
    segments = written(_cut(docs, wanted.groupBy("r1", "r2").agg(F.collect_list("w").alias("want")), length), "bytes")

    whole = again.where("alike").select("r1", "r2", "pos", "most", "least").union(
        again.where("not alike").join(different.where("n > 1").select("key", "seg"), ["key", "seg"]).select("r1", "r2", "pos", "most", "least")
    )
    whole = whole.select("r1", "r2", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + length).alias("end"))
    spans = whole.union(_sorted_spans(segments.where("not crowded"), length, gram)).union(_counted_spans(segments.where("crowded"), length))
    spans = spans.groupBy("r1", "r2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = batch.column(1), batch.column(2), batch.column(3)
            kept, removed = [], []
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                spans = []
                if starts[i].is_valid:
                    s, e = np.asarray(starts[i].values), np.asarray(ends[i].values)
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > reach[:-1])
                    spans = list(zip(s[new].tolist(), reach[np.append(new[1:], True)].tolist(), strict=True))
                    edges = [0, *(x for span in spans for x in span), len(data)]
                    data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(data)
                removed.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(spans, ["r1", "r2"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, spans array<struct<start:long,end:long>>")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.withColumn("n_removed", gone).select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

