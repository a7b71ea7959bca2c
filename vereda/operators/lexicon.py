"""Lexicon matching: which surfaces a text mentions, and what a term stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vereda.functions import text as tx

#: Surfaces that are sent to every executor, and surfaces that are searched one by one in each text.
LARGEST_BROADCAST, LARGEST_SEARCHED = 20_000, 64


def lexicon(rows: DataFrame) -> DataFrame:
    """(surface folded, kind, canonical, ord): of equal surfaces of a kind the last one counts."""
    folded = rows.select(tx.squeeze(F.col("surface")).alias("surface"), "kind", "canonical", "ord").where("surface <> ''")
    return folded.groupBy("surface", "kind").agg(F.max_by("canonical", "ord").alias("canonical"), F.max("ord").alias("ord"))


def _grams(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def _searched(texts: DataFrame, surfaces: list[Row], lex: DataFrame, key: str, text: str) -> DataFrame:
    """mentions() of few surfaces: each is a fixed pattern."""
    folded = texts.select(key, tx.squeeze(F.col(text)).alias("_t"))
    cast = lambda r, c: F.lit(r[c]).cast(lex.schema[c].dataType).alias(c)
    hits = [F.when(tx.bounded(F.col("_t"), F.lit(r["surface"])), F.struct(cast(r, "kind"), cast(r, "canonical"))) for r in surfaces]
    if not hits:
        return folded.select(key, F.lit("").alias("kind"), F.lit("").alias("canonical")).limit(0)
    found = folded.select(key, F.explode(F.array_compact(F.array(*hits))).alias("_m"))
    return found.select(key, "_m.kind", "_m.canonical").distinct()


def mentions(texts: DataFrame, lex: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, canonical) once each. A small lexicon is searched surface by surface, in one pass over the texts.

    Of a larger one, surfaces of word characters only join on word n-grams; others are searched. The n-grams of a text number its words times the longest surface's words, so the join is an equi-join for any size of
    lexicon; the search is for the few surfaces with punctuation, against a broadcast of a checked size.
    """
    few = lex.limit(LARGEST_SEARCHED + 1).collect()
    if len(few) <= LARGEST_SEARCHED:
        return _searched(texts, few, lex, key, text)
    marked = lex.withColumn("plain", F.col("surface").rlike(r"^[\w-]+( [\w-]+)*$"))
    plain, other = marked.where("plain"), marked.where("not plain")
    longest = plain.select(F.max(F.size(F.split("surface", " ")))).first()[0]
    folded = texts.select(key, tx.squeeze(F.col(text)).alias("_t"))
    parts = []
    if longest:
        # Words may only be joined where one space lies between them, so other punctuation cuts a run.
        runs = folded.select(key, F.explode(F.split("_t", r"[^\w -]+")).alias("_r")).select(key, F.filter(F.split(F.trim("_r"), " +"), lambda w: w != "").alias("_w")).where(F.size("_w") > 0)
        grams = None
        for n in range(1, longest + 1):
            part = runs.where(F.size("_w") >= n).select(key, F.explode(_grams(F.col("_w"), n)).alias("surface"))
            grams = part if grams is None else grams.unionAll(part)
        plain = F.broadcast(plain) if plain.count() <= LARGEST_BROADCAST else plain
        parts.append(grams.join(plain, "surface").select(key, "kind", "canonical"))
    n_other = other.count()
    if n_other:
        side = F.broadcast(other) if n_other <= LARGEST_BROADCAST else other
        parts.append(folded.join(side, tx.bounded(F.col("_t"), F.col("surface"))).select(key, "kind", "canonical"))
    if not parts:
        return folded.select(key, F.lit("").alias("kind"), F.lit("").alias("canonical")).limit(0)
    out = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return out.distinct()


def resolve(terms: DataFrame, lex: DataFrame, priority: list[str], term: str = "term") -> DataFrame:
    """terms with the canonical name of the first kind, by priority, that has the term as a surface; null if none has."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("kind"))
    best = lex.withColumn("_o", order).where("_o > 0").groupBy("surface").agg(F.min_by(F.struct("kind", "canonical"), "_o").alias("_b"))
    joined = terms.join(best, tx.squeeze(F.col(term)) == F.col("surface"), "left")
    return joined.select(*[terms[c] for c in terms.columns], F.col("_b.kind").alias("kind"), F.col("_b.canonical").alias("canonical"))


def pairs_in_order(found: DataFrame, key: str, item: str, place: str) -> DataFrame:
    """All pairs (first, second) of a key's items, first before second by place."""
    a = found.select(key, F.col(item).alias("first"), F.col(place).alias("_p"))
    b = found.select(key, F.col(item).alias("second"), F.col(place).alias("_q"))
    return a.join(b, key).where("_p < _q").select(key, "first", "second")


def severity(text: Column, cascade: list[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern that the text matches."""
    out = F
    for pattern, value in cascade:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(default)
