"""Quality rules on repetition inside a text, from a suffix array of its words.

The suffixes of a text that begin with a repeated five-word window are sorted by prefix doubling (windows of 5, 10, 20, ...
words are ranked, a window's rank being that of its two halves); neighbours in that order give the longest common
prefixes. Each suffix's longest common prefix with a neighbour is the longest repeat that starts there, and the
intervals of these values are the maximal repeats; their spans are united per text. A text is rejected if repeats of
at least `min_repeat` words cover more than `max_covered` of its words, or if the longest is over `max_longest` words.

Texts are independent, so there is no shuffle; memory follows the longest text.
Defined cases: null and empty texts have no words, fail the base rule and are not kept; ties and repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vereda.llm import _text as t

WINDOW, MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 10, 0.3, 400
SCHEMA = (
    "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered double, longest_repeat long, n_repeats long"
)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_POINT = (np.arange(256) & 0xC0) != 0x80


def longest_repeats(h: np.ndarray, row: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, length): for each word position of a row that starts a repeat of `least` words or more, its longest.

    h: word hashes of all rows, row: their row. The suffix array holds the positions whose first `least` words repeat in
    their row. They are ranked by those words; while any share a rank, the ranked window doubles: the rank at its end
    orders them. The ranks of all window lengths then give the longest common prefix of neighbours in the array.
    """
    none, n = np.zeros(0, np.int64), len(h)
    if n < least:
        return none, none
    first = np.searchsorted(row, np.arange(row[-1] + 2))
    gram, whole = t.ngrams(h, first, least)
    at = np.flatnonzero(whole)
    key = t.mix(gram[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by_key = np.argsort(key)
    same = key[by_key][1:] == key[by_key][:-1]
    twin = np.zeros(len(at), bool)
    twin[by_key[1:]] |= same
    twin[by_key[:-1]] |= same
    at = at[twin]
    if not len(at):
        return none, none
    end = first[row + 1]
    # A window that repeats is followed, if not by the row's end, by a position `least` words after one that repeats.
    after = at + least
    listed = np.union1d(at, after[after < end[at]])
    shown = [np.where(listed + k < end[listed], h[np.minimum(listed + k, n - 1)], np.uint64(0)) for k in range(least)]
    order = np.lexsort([*shown[::-1], row[listed]])
    differs = np.zeros(len(listed), bool)
    differs[0] = True
    for x in (row[listed], *shown):
        differs[1:] |= x[order][1:] != x[order][:-1]
    ranks = np.full(n + 1, -1, np.int64)
    ranks[listed[order]] = np.maximum.accumulate(np.where(differs, np.arange(len(order)), 0))
    single = differs & np.append(differs[1:], True)
    tied, levels, size = listed[order][~single], [(least, ranks.copy())], least
    while len(tied):
        head = ranks[tied]
        then = np.where(tied + size < end[tied], ranks[np.minimum(tied + size, n)], -1)
        order = np.lexsort((then, head))
        tied, head, then = tied[order], head[order], then[order]
        group = np.append(True, head[1:] != head[:-1])
        part = group | np.append(True, then[1:] != then[:-1])
        i = np.arange(len(tied))
        ranks[tied] = head + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        tied = tied[~(part & np.append(part[1:], True))]
        size *= 2
        levels.append((size, ranks.copy()))
    pos = at[np.argsort(ranks[at])]
    a, b = pos[:-1], pos[1:]
    got = np.zeros(len(a), np.int64)
    for size, level in reversed(levels):
        x, y = np.minimum(a + got, n), np.minimum(b + got, n)
        got += np.where((level[x] >= 0) & (level[x] == level[y]) & (a + got < end[a]) & (b + got < end[b]), size, 0)
    for _ in range(least - 1):
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        got += (got > 0) & (got % least == _) & (a + got < end[a]) & (b + got < end[b]) & (h[x] == h[y])
    got[row[a] != row[b]] = 0
    longest = np.zeros(n, np.int64)
    longest[pos] = np.maximum(np.append(0, got), np.append(got, 0))
    return at, longest[at]


def union_length(start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Positions covered by spans, for each row; spans sorted by start lie within their row."""
    out = np.zeros(rows, np.int64)
    if len(start):
        reach = np.maximum.accumulate(end)
        before = np.append(0, reach[:-1])
        np.add.at(out, row, np.maximum(0, end - np.maximum(start, before)))
    return out


def measure(buf: np.ndarray, offs: np.ndarray, min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    rows = len(offs) - 1
    starts, ends, first = t.words(buf, offs, t.NONSPACE)
    row, n_words = t.rows_of(first), np.diff(first)
    prefix = t.prefix_hash(buf)
    count = lambda flag: np.diff(np.append(0, np.cumsum(flag))[offs])
    cut = lambda flag: count(flag).astype(np.int64)
    out = {"n_words": n_words, "word_chars": cut(t.NONSPACE[buf] & _POINT[buf]), "n_symbols": cut(_SYMBOL[buf])}

    newline = np.zeros(len(buf) + 1, bool)
    newline[:-1] = buf == 10
    line_start = np.unique(np.concatenate([offs[:-1], np.flatnonzero(newline) + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    line_end = np.where(newline[np.maximum(line_end - 1, 0)] & (line_end > line_start), line_end - 1, line_end)
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has], line_end[has]
    line_row = np.searchsorted(offs, line_start, "right") - 1
    key = t.range_hash(prefix, line_start, line_end) ^ t.mix(line_row.astype(np.uint64))
    seen = np.ones(len(key), bool)
    seen[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(line_row[seen], minlength=rows).astype(np.int64)

    h = t.range_hash(prefix, starts, ends)
    at, length = longest_repeats(h, row) if len(h) else (np.zeros(0, np.int64),) * 2
    out["n_repeat_words"] = union_length(at, at + WINDOW, row[at], rows)
    wide = length >= min_repeat
    covered = union_length(at[wide], (at + length)[wide], row[at[wide]], rows)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[at], length)
    out["covered"] = np.round(covered / np.maximum(1, n_words), 6)
    out["longest_repeat"] = longest
    out["n_repeats"] = np.bincount(row[at[wide]], minlength=rows).astype(np.int64)
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    out["kept"] = ~out["base_failed"] & (covered <= max_covered * n_words) & (longest <= max_longest)
    return out


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document with its measures, the base verdict and the verdict on repetition."""
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low, high, buf, offs in t.slices(part.column(1)):
                got = measure(buf, offs, min_repeat, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(low, high - low), *[pa.array(got[k]) for k in names[1:]]], names)

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
