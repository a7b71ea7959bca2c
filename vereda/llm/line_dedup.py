"""Removal of repeated lines, and of repeated sentences in the lines that stay, by global hashing.

Units are normalised to their words in lower case; those of at least `min_words` words are grouped over all documents by a
128-bit digest of that form. The earliest occurrence, by doc_id (null last) and place, stays; all others are removed with
the separator after them, and their byte offsets in the original text are kept. Lines are grouped first. As many texts
are not wrapped, and a repeated passage then lies inside a longer line, the lines that stay are cut after a sentence's
end before a space, and their sentences are grouped in the same way.

Digests and places are shuffled, never texts; a group is reduced to its first occurrence before the shuffle, so a line
that a third of all documents share costs a row for each task. Defined cases: null and empty texts have no units;
repeated rows (same id and text) are one document, treated alike; ties of doc_id go by a digest of the row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vereda.llm import _text as t
from vereda.llm._work import widened, written

MIN_WORDS = 6
UNIT = "h1 array<long>, h2 array<long>, starts array<int>, ends array<int>, line array<int>"
UNITS = f"n_bytes long, n_units long, {', '.join('l_' + x for x in UNIT.split(', '))}, {', '.join('s_' + x for x in UNIT.split(', '))}"


def cut_units(buf: np.ndarray, offs: np.ndarray, sentences: bool, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, end, first word, last word + 1, line in the row) of the lines, or the sentences in them, that have a word."""
    feed = buf == 10
    separator = feed.copy()
    if sentences:
        inner = np.zeros(len(buf) + 1, bool)
        inner[offs] = True
        separator[1:] |= (buf[1:] == 32) & np.isin(buf[:-1], list(b".!?")) & ~inner[1:-1]
    begin = np.union1d(offs[:-1], np.flatnonzero(separator) + 1)
    begin = begin[begin < len(buf)]
    end = np.append(begin[1:], len(buf))
    end = np.where(separator[end - 1] & (end > begin), end - 1, end) if len(begin) else end[:0]
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    some = b > a
    begin, end, a, b = begin[some], end[some], a[some], b[some]
    row = np.searchsorted(offs, begin, "right") - 1
    feeds = np.append(0, np.cumsum(feed))
    return row, begin, end, a, b, feeds[begin] - feeds[offs[row]]


def sequence_prefix(h: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * t.powers(len(h))[0], out=prefix[1:])
    return prefix


def unit_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each document with the digests, byte places and line numbers of its lines (l_) and sentences (s_) of min_words or more."""
    names = [x.split()[0] for x in UNITS.split(", ")]
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", F.lit(7), "doc_id").alias("r2"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in t.slices(batch.column(3)):
                n = high - low
                starts, ends, _ = t.words(buf, offs, t.ALNUM)
                # Two hashes of each word from sums over different byte tables, so equal digests need equal words.
                sums = [sequence_prefix(t.range_hash(t.prefix_hash(buf ^ flip, lower=not flip), starts, ends)) for buf, flip in ((buf, 0), (t._LOWER[buf], 255))]
                columns = []
                for sentences in (False, True):
                    row, begin, end, a, b, line = cut_units(buf, offs, sentences, starts)
                    count = np.bincount(row, minlength=n)
                    long = b - a >= min_words
                    row, begin, end, a, b, line = (x[long] for x in (row, begin, end, a, b, line))
                    h1, h2 = (t.range_hash(x, a, b) for x in sums)
                    edge = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32))
                    lists = [h1.view(np.int64), h2.view(np.int64), *[x.astype(np.int32) for x in (begin - offs[row], end - offs[row], line)]]
                    columns += [pa.ListArray.from_arrays(edge, pa.array(x)) for x in lists]
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(offs)), pa.array(count), *columns], ["doc_id", "r1", "r2", *names])

    return rows.mapInArrow(run, widened(rows.drop("text"), UNITS))


def later_units(rows: DataFrame, level: str, without: str | None = None) -> DataFrame:
    """(r1, r2, line, span) of the units of a level that occur earlier; `without` names an array of lines left out."""
    zipped = F.arrays_zip(*[F.col(f"{level}_{x.split()[0]}").alias(x.split()[0]) for x in UNIT.split(", ")])
    if without:
        zipped = F.when(F.col(without).isNull(), zipped).otherwise(F.filter(zipped, lambda u: ~F.array_contains(F.col(without), u["line"])))
    units = rows.select("doc_id", "r1", "r2", "n_bytes", F.explode(zipped).alias("u")).select("doc_id", "r1", "r2", "n_bytes", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r1", "r2", F.col("starts").alias("start"))
    first = units.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("h1", "h2", "first")
    gone = units.join(first, ["h1", "h2"]).where(rank != F.col("first"))
    return gone.select("r1", "r2", "line", F.struct(F.col("starts").cast("long").alias("start"), F.least(F.col("ends").cast("long") + 1, "n_bytes").alias("end")).alias("span")).distinct()


def remove_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_units and the removed spans (start, end: bytes, separator included)."""
    rows = written(unit_rows(docs, min_words), "units")
    lines = later_units(rows, "l").groupBy("r1", "r2").agg(F.collect_list("line").alias("gone"), F.collect_list("span").alias("line_spans"))
    rows = written(rows.select("doc_id", "r1", "r2", "n_bytes", "n_units", *[c for c in rows.columns if c.startswith("s_")]).join(lines, ["r1", "r2"], "left"), "lines")
    spans = later_units(rows, "s", "gone").groupBy("r1", "r2").agg(F.collect_list("span").alias("sentence_spans"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    both = F.array_sort(F.concat(F.coalesce("line_spans", none), F.coalesce("sentence_spans", none)))
    return rows.select("doc_id", "r1", "r2", "n_bytes", "n_units", "line_spans").join(spans, ["r1", "r2"], "left").select("doc_id", "n_bytes", "n_units", both.alias("spans"))


def kept_text(text: bytes, spans: list) -> bytes:
    """The text without its removed spans."""
    at, out = 0, []
    for span in spans:
        out.append(text[at : span["start"]])
        at = span["end"]
    return b"".join([*out, text[at:]])


def digests(removed: DataFrame) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return removed.select("doc_id", "n_bytes", "n_units", F.size("spans").cast("long").alias("n_removed"), length.alias("removed_bytes"), listed.alias("removed"))


def oracle(min_words: int = MIN_WORDS) -> str:
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    later = "row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id NULLS LAST, r, pos) > 1"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(strlen(text), 0) AS n_bytes FROM documents),
l0 AS (SELECT r, doc_id, n_bytes, unnest(list_zip(range(1, len(p) + 1), p)) AS z FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS p FROM d)),
l AS (SELECT r, doc_id, n_bytes, z[1] AS i, z[2] AS line, strlen(z[2]) AS size, sum(strlen(z[2]) + 1) OVER (PARTITION BY r ORDER BY z[1]) - strlen(z[2]) - 1 AS pos, {words.format("z[2]")} AS words FROM l0),
lg AS (SELECT r, i, pos, size, n_bytes FROM (SELECT *, {later} AS gone FROM l WHERE len(words) >= {min_words}) WHERE gone),
s0 AS (SELECT r, i, doc_id, n_bytes, pos AS base, unnest(list_zip(range(1, len(p) + 1), p)) AS z FROM (SELECT *, string_split(regexp_replace(line, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS p FROM l)),
s AS (SELECT r, i, doc_id, n_bytes, strlen(z[2]) AS size, base + sum(strlen(z[2]) + 1) OVER (PARTITION BY r, i ORDER BY z[1]) - strlen(z[2]) - 1 AS pos, {words.format("z[2]")} AS words FROM s0),
sg AS (SELECT r, i, pos, size, n_bytes FROM (SELECT *, {later} AS gone FROM s ANTI JOIN lg USING (r, i) WHERE len(words) >= {min_words}) WHERE gone),
g AS (SELECT r, count(*) AS n_removed, sum(least(pos + size + 1, n_bytes) - pos) AS removed_bytes, string_agg(pos::BIGINT || '-' || least(pos + size + 1, n_bytes)::BIGINT, ',' ORDER BY pos) AS removed FROM (SELECT * FROM lg UNION ALL SELECT * FROM sg) GROUP BY r),
c AS (SELECT r, count(*) AS n_units FROM s WHERE len(words) > 0 GROUP BY r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_bytes, 0)::BIGINT AS removed_bytes, coalesce(removed, '') AS removed
FROM d LEFT JOIN g USING (r) LEFT JOIN c USING (r)"""
