"""License scans by diagonal voting, in DataFrame operations only.

Every k consecutive words of a text are hashed and joined to the same k-grams of license templates. A hit of template
word t at text word p votes for the diagonal p - t. A diagonal with a vote for each of its template's k-grams is a
verbatim place; neighbouring diagonals (a word added or left out in between) are merged, and the merged span counts if
it covers enough of the template without being stretched. Templates that differ in few words all find the same place, so
of overlapping spans with different labels only that with the largest covered share, then the most votes, counts.

Templates are a fixed list, so the broadcast side has a proven bound; texts are never shuffled. The votes are written
once, as base places and spans both read them.

Defined cases: null or empty text has no words; a text with fewer words than k has no hit; repeated rows (same id and
text) each get the same result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vereda.llm._work import written

#: Fixed values: (label, phrase, whether its verbatim places are the base count). Wording of public license notices.
TEMPLATES = [
    ("mit", "under the mit license", True),
    ("apache-2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", True),
    ("gpl-3", "licensed under the gnu general public license version 3", False),
    ("gpl-2", "licensed under the gnu general public license version 2", False),
    ("gpl", "licensed under the gnu general public license", False),
    ("lgpl", "licensed under the gnu lesser general public license", False),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", False),
    ("apache-2", "you may not use this file except in compliance with the license", False),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", False),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, BAND, COVERED, STRETCH = 3, 3, 0.6, 1.5
#: Words of a stretch of text in which overlapping spans meet.
CELL = 64
#: The only characters outside ASCII whose lower case holds an ASCII letter; another non-ASCII letter stands for them.
FOLDED_TO_ASCII = ["\u0130", "\u212a"]


def _words(text: Column) -> Column:
    """Words that compare with templates as if A-Z alone were folded."""
    text = F.coalesce(text, F.lit(""))
    for c in FOLDED_TO_ASCII:
        text = F.replace(text, F.lit(c), F.lit("\u00e9"))
    return F.split(F.lower(text), SEPARATORS)


def _count(words: Column) -> Column:
    """Words in a split text; it may begin or end with an empty string."""
    blank = lambda c: F.when(c == "", 1).otherwise(0)
    return F.when((F.size(words) == 1) & (words[0] == ""), 0).otherwise(F.size(words) - blank(words[0]) - blank(F.element_at(words, -1)))


def template_grams(spark, templates=None, k: int = K) -> DataFrame:
    rows = []
    for number, (label, phrase, base) in enumerate(templates or TEMPLATES):
        words = phrase.split()
        rows += [(number, label, base, len(words) - k + 1, at, *words[at : at + k]) for at in range(len(words) - k + 1)]
    names = ", ".join(f"g{j} string" for j in range(k))
    grams = spark.createDataFrame(rows, f"template int, label string, base boolean, n_grams int, at int, {names}")
    return grams.withColumn("gram", F.xxhash64(*[f"g{j}" for j in range(k)]))


def diagonals(docs: DataFrame, grams: DataFrame, k: int = K) -> DataFrame:
    """(k1, k2, template, label, base, n_grams, diagonal, votes, low, high): votes of each diagonal that has any."""
    words = docs.select(
        F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), _words(F.col("text")).alias("w")
    ).where(F.size("w") >= k)
    at = words.select("k1", "k2", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
    gram = at.withColumn("gram", F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(k)]))
    same = [F.get(gram.w, gram.i + j) == grams[f"g{j}"] for j in range(k)]
    hits = gram.join(F.broadcast(grams), [gram.gram == grams.gram, *same]).select(
        "k1", "k2", "template", "label", "base", "n_grams", "at", (F.col("i") - F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)).alias("pos")
    )
    return (
        hits.distinct().withColumn("diagonal", F.col("pos") - F.col("at"))
        .groupBy("k1", "k2", "template", "label", "base", "n_grams", "diagonal")
        .agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )


def spans(votes: DataFrame, k: int = K, band: int = BAND, covered: float = COVERED, stretch: float = STRETCH) -> DataFrame:
    """Merged neighbouring diagonals of a text and template that pass the check, with the covered share of the template.

    A diagonal with few votes belongs to the run of diagonals that lie at most `band` apart. One text may hold a
    template often; the windows are over the diagonals of one text and template, at most as many as the text has words.
    """
    own = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    run = votes.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= band, 0).otherwise(1)).withColumn("run", F.sum("new").over(own))
    merged = run.groupBy("k1", "k2", "template", "label", "n_grams", "run").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("first"), (F.max("high") + k - 1).alias("last"), F.max("base").alias("base")
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    return merged.withColumn("share", share).where((share >= covered) & (F.col("last") - F.col("first") + 1 <= stretch * (F.col("n_grams") + k - 1)))


def unbeaten(found: DataFrame, cell: int = CELL) -> DataFrame:
    """Spans that no overlapping span of another label beats by covered share, then votes.

    Spans meet in stretches of `cell` words, so a group holds at most the spans of one stretch: a few for each template,
    however long the text.
    """
    at = F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))).alias("cell")
    keys = ["template", "run", "label", "first", "last", "share", "votes"]
    met = found.select("k1", "k2", at, F.struct(*keys).alias("s")).groupBy("k1", "k2", "cell").agg(F.collect_list("s").alias("all"))

    def beats(o: Column, s: Column) -> Column:
        better = (o["share"] > s["share"]) | ((o["share"] == s["share"]) & (o["votes"] > s["votes"]))
        return (o["label"] != s["label"]) & (o["first"] <= s["last"]) & (o["last"] >= s["first"]) & better

    judged = met.select("k1", "k2", F.explode("all").alias("s"), "all").select("k1", "k2", "s.*", F.exists("all", lambda o: beats(o, F.col("s"))).alias("beaten"))
    return judged.groupBy("k1", "k2", *keys).agg(F.max("beaten").alias("beaten")).where("not beaten").drop("beaten")


def scan(docs: DataFrame, templates=None, k: int = K) -> DataFrame:
    """One row per document: n_words, base places and their range, labels and a score (largest covered share)."""
    grams = template_grams(docs.sparkSession, templates, k)
    votes = written(diagonals(docs, grams, k), "votes")
    base = votes.where(F.col("base") & (F.col("votes") == F.col("n_grams"))).groupBy("k1", "k2").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    found = unbeaten(spans(votes, k)).groupBy("k1", "k2").agg(F.max("share").alias("best"), F.collect_set("label").alias("label_set"), F.count("*").alias("n_spans"))
    per = base.join(found, ["k1", "k2"], "full")
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), _count(_words(F.col("text"))).cast("long").alias("n_words")
    )
    base_set, label_set = F.coalesce("base_set", none), F.coalesce("label_set", none)
    return rows.join(per, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, label_set)), ",").alias("labels"),
        F.round(F.when(F.coalesce("n_base", F.lit(0)) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))), 6).alias("score"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def oracle(templates=None, k: int = K, band: int = BAND, covered: float = COVERED, stretch: float = STRETCH) -> str:
    """The same result in DuckDB, joined on the words themselves."""
    grams = []
    for number, (label, phrase, base) in enumerate(templates or TEMPLATES):
        words = phrase.split()
        grams += [f"({number}, '{label}', {str(base).lower()}, {len(words) - k + 1}, {at}, '{' '.join(words[at : at + k])}')" for at in range(len(words) - k + 1)]
    return f"""
WITH grams(template, label, base, n_grams, pos0, gram) AS (VALUES {", ".join(grams)}),
w AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
p AS (SELECT r, unnest(range(0, len(w) - {k - 1})) AS pos, w FROM w WHERE len(w) >= {k}),
hits AS (SELECT r, pos, g.* FROM p JOIN grams g ON g.gram = {" || ' ' || ".join(f"w[pos + {j + 1}]" for j in range(k))}),
votes AS (SELECT r, template, label, base, n_grams, pos - pos0 AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high FROM hits GROUP BY ALL),
b AS (SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base_set FROM votes WHERE base AND votes = n_grams GROUP BY r),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {band} THEN 0 ELSE 1 END AS fresh FROM votes)),
merged AS (SELECT r, template, label, n_grams, run, least(1.0, sum(votes)::DOUBLE / n_grams) AS share, sum(votes) AS v, min(low) AS lo, max(high) + {k - 1} AS hi FROM runs GROUP BY r, template, label, n_grams, run),
passed AS (SELECT r, template, run, label, share, v, lo, hi FROM merged WHERE share >= {covered} AND hi - lo + 1 <= {stretch} * (n_grams + {k - 1})),
found AS (SELECT r, max(share) AS best, list(DISTINCT label) AS label_set, count(*) AS n_spans FROM passed s WHERE NOT EXISTS (SELECT 1 FROM passed o
  WHERE o.r = s.r AND o.label <> s.label AND o.lo <= s.hi AND o.hi >= s.lo AND (o.share > s.share OR (o.share = s.share AND o.v > s.v))) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(label_set, [])))), ','), '') AS labels,
  round(CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE, 6) AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM w LEFT JOIN b USING (r) LEFT JOIN found USING (r)"""
