"""Triples, the typed multigraph, rule inference, neighbourhoods and the paths between pairs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the severities.
WEIGHT = {"contraindicado": 4, "grave": 3, "moderada": 2, "leve": 1}


def weight(column):
    out = F
    for name, value in WEIGHT.items():
        out = out.when(column == name, value)
    return out.otherwise(0)


def _signed(triples: DataFrame, signatures: DataFrame, how: str) -> DataFrame:
    return triples.join(signatures, ["subject_kind", "relation", "object_kind"], how)


def valid(triples: DataFrame, signatures: DataFrame) -> DataFrame:
    """Triples with an allowed signature, names on both sides, and evidence if asserted."""
    named = triples.where("trim(subject) <> '' and trim(object) <> '' and (origin <> 'asserted' or chunk_id is not null)")
    return _signed(named, signatures, "left_semi").select(*triples.columns)


def violations(triples: DataFrame, signatures: DataFrame) -> DataFrame:
    return _signed(triples, signatures, "left_anti").select(*triples.columns)


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order: an aggregate that combines before the shuffle, not a window."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_f")).select("_f.*")


def nodes(triples: DataFrame) -> DataFrame:
    """(id, kind, name): the first spelling of each node by ord."""
    sides = [triples.select(F.concat(f"{s}_kind", F.lit("::"), F.lower(F.trim(s))).alias("id"), F.col(f"{s}_kind").alias("kind"), F.col(s).alias("name"), "ord") for s in ("subject", "object")]
    return sides[0].unionAll(sides[1]).groupBy("id", "kind").agg(F.min_by("name", "ord").alias("name"))


def ends(triples: DataFrame, *more) -> DataFrame:
    """(src, dst, more) of each triple."""
    return triples.select(
        F.concat("subject_kind", F.lit("::"), F.lower(F.trim("subject"))).alias("src"), F.concat("object_kind", F.lit("::"), F.lower(F.trim("object"))).alias("dst"), *more
    )


def edges(triples: DataFrame) -> DataFrame:
    """(src, dst, key, relation, origin): of equal keys the last by ord counts."""
    out = ends(
        triples,
        F.concat("relation", F.lit("|"), F.coalesce("chunk_id", "origin")).alias("key"), "relation", "origin", "ord",
    )
    return out.groupBy("src", "dst", "key", "relation").agg(F.max_by("origin", "ord").alias("origin"))


def statistics(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(what, name, n): totals and counts by kind and relation, in one pass over each table."""
    by_kind = node_rows.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("g"))
    by_relation = edge_rows.groupingSets([["relation"], []], "relation").agg(F.count("*").alias("n"), F.count_if(F.col("origin") == "inferred").alias("inferred"), F.grouping("relation").alias("g"))
    total = by_relation.where("g = 1").select(F.lit("inferred").alias("what"), F.lit("").alias("name"), F.col("inferred").alias("n"))
    return (
        by_kind.select(F.when(F.col("g") == 1, "nodes").otherwise("kind").alias("what"), F.when(F.col("g") == 1, "").otherwise(F.col("kind")).alias("name"), "n")
        .unionAll(by_relation.select(F.when(F.col("g") == 1, "edges").otherwise("relation").alias("what"), F.when(F.col("g") == 1, "").otherwise(F.col("relation")).alias("name"), "n"))
        .unionAll(total)
    )


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='vereda-')}")
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from the session's checkpoint folder, so that later steps neither repeat its plan nor carry its lineage."""
    _folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """As stored(), as a compressed table: for many or wide rows."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/vereda-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """The different rows of df as a stored table, dealt by a column once: joins by that column deal the other side alone."""
    spark, name = df.sparkSession, f"vereda_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, column).distinct()
    rows.write.bucketBy(buckets, column).sortBy(column).option("path", f"{_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def numbered_nodes(ids: DataFrame, column: str = "id") -> tuple[DataFrame, int]:
    """(id, node) of the different ids, and the salt with which node(salt, id) tells all of them apart."""
    ids, salt = ids.distinct(), 0
    while True:
        names = tabled(ids.select(column, node(salt, column).alias("node")))
        if names.groupBy("node").count().where("count > 1").isEmpty():
            return names, salt
        salt += 1


def node(salt: int, column: str):
    """64 bits for a node's id."""
    return F.xxhash64(F.lit(salt), F.col(column))


#: Seeds whose names are sent to every executor.
MOST_SENT = 100_000


def neighbourhood(edge_rows: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, hop): nodes within `hops` undirected steps, with the least number. seeds: (seed, id). edge_rows: (src, dst), both given.

    Seeds are numbered and a node has a row for each 64 of them, with a bit for each, so no step deals a row for each seed
    and node; the pairs are made at the end, without another shuffle. Nodes are told apart by 64 bits, their names stored
    once; edges are dealt once, for all hops. Each frontier is stored, so hop n does not repeat the hops before it; an
    empty frontier ends the walk.
    """
    edges = tabled(edge_rows.select("src", "dst").where("src is not null and dst is not null"))
    numbered = stored(seeds.select("seed", "id").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("seed")) - 1).select("seed", "id", F.floor(F.col("n") / 64).cast("int").alias("word"), (F.col("n") % 64).alias("bit")))
    seed_names = numbered.groupBy("word").agg(F.collect_set(F.struct("bit", "seed")).alias("names"))
    names, salt = numbered_nodes(edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).unionAll(numbered.select("id")))
    steps = edges.select(node(salt, "src").alias("src"), node(salt, "dst").alias("dst"))
    both = bucketed(steps.unionAll(steps.select("dst", "src")), "src")
    frontier = tabled(numbered.groupBy(node(salt, "id").alias("node"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    found, seen = frontier.withColumn("hop", F.lit(0)), frontier
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node"), "word", "bits").groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")
        frontier = tabled(step.join(old, ["node", "word"], "left").select("node", "word", fresh).where("bits <> 0"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        found = found.unionByName(frontier.withColumn("hop", F.lit(hop)))
    named = found.join(names, "node").join(F.broadcast(seed_names) if numbered.count() <= MOST_SENT else seed_names, "word")
    return named.select(F.explode(F.expr("filter(names, x -> getbit(bits, x.bit) = 1)")).alias("x"), "id", "hop").select("x.seed", "id", "hop")


def induced(edge_rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen ids."""
    ends = chosen.select("id").distinct()
    return edge_rows.join(ends, edge_rows["src"] == ends["id"], "left_semi").join(ends, edge_rows["dst"] == ends["id"], "left_semi")


def strong(modulators: DataFrame) -> DataFrame:
    """The modulators that can infer an edge."""
    return modulators.where("intensity_a in ('forte', 'moderada') and (relation_a <> 'INDUZ' or intensity_a = 'forte')")


def mediated(modulators: DataFrame, targets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Edges inferred from a shared mediator: (a, relation_a, intensity_a, m) x (b, relation_b, intensity_b, m).

    Strong or moderate modulators only, induction only if strong; rules R1-R4 and their severities as one CASE each.
    With pairs (a, b) only their edges are made, so a mediator that all share costs no more rows than there are pairs.
    """
    mods = strong(modulators)
    both = (mods.join(targets, "m") if pairs is None else pairs.select("a", "b").distinct().join(mods, "a").join(targets, ["b", "m"])).where("a <> b")
    return ruled(both)


def ruled(both: DataFrame) -> DataFrame:
    """Pairs of a modulator's and a target's columns with their rule and severity."""
    rule = F.when(F.col("relation_a") == "INDUZ", "R2").when(F.col("special"), "R4").when(F.col("relation_b") == "ATIVADO_POR", "R3").otherwise("R1")
    by_role = (
        F.when(F.col("relation_b") == "ATIVADO_POR", F.when(F.col("intensity_a") == "forte", "contraindicado").otherwise("grave"))
        .when((F.col("intensity_a") == "forte") & (F.col("intensity_b") == "sensivel"), "contraindicado")
        .when((F.col("intensity_a") == "forte") | (F.col("intensity_b") == "sensivel"), "grave").otherwise("moderada")
    )
    return both.withColumn("rule", rule).withColumn("severity", F.when(F.col("rule") == "R4", "contraindicado").otherwise(by_role))


def mediated_counts(modulators: DataFrame, targets: DataFrame) -> DataFrame:
    """(m, rule, severity, n, n_sources, n_targets) of mediated(), without a row for each of its edges.

    Rule and severity hang on the classes of both ends alone, so each end meets the other side's classes at its mediator,
    with their sizes less its own rows (a <> b); rows grow with the ends and not with their products.
    """
    kind_a, kind_b = ["m", "relation_a", "intensity_a", "special"], ["m", "relation_b", "intensity_b"]
    mods = strong(modulators).where("a is not null").groupBy("a", *kind_a).agg(F.count("*").alias("times"))
    aims = targets.where("b is not null").groupBy("b", *kind_b).agg(F.count("*").alias("times"))
    by = ["m", "rule", "severity"]

    def met(ends: DataFrame, others: DataFrame, end: str, other: str, kinds: list[str]) -> DataFrame:
        sizes = others.groupBy(*kinds).agg(F.sum("times").alias("size"))
        own = others.select(F.col(other).alias(end), *[F.col(c).alias(f"_{c}") for c in kinds], F.col("times").alias("own"))
        both = ends.join(sizes, "m").alias("x")
        same = F.col(f"x.{end}") == own[end]
        for c in kinds:
            same &= F.col(f"x.{c}").eqNullSafe(own[f"_{c}"])
        met = ruled(both.join(own, same, "left").select("x.*", (F.col("size") - F.coalesce("own", F.lit(0))).alias("partners")))
        return met.where("partners > 0").groupBy(*by, end).agg(F.sum(F.col("times") * F.col("partners")).alias("n"))

    sources = met(mods, aims, "a", "b", kind_b).groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))
    reached = met(aims, mods, "b", "a", kind_a).groupBy(*by).agg(F.count("*").alias("n_targets"))
    return sources.join(reached, by)


#: Order of the kinds of findings.
KIND_RANK = {"direct": 0, "mechanism": 1, "class": 2, "class_class": 3}


def evidence(inferred: DataFrame, edge_rows: DataFrame, ends: tuple[str, str] = ("a", "b"), mediator: str = "mediator") -> DataFrame:
    """inferred (ends, mediator, ...) with `evidence`: the sorted set of chunk ids of any edge from an end to the mediator."""
    hubs = edge_rows.select(F.col("mediator").alias("dst")) if "mediator" in edge_rows.columns else inferred.select(F.col(mediator).alias("dst"))
    to = edge_rows.where("chunk_id is not null").select("src", "dst", "chunk_id").join(hubs.where("dst is not null").distinct(), "dst", "left_semi")
    to = to.groupBy("src", "dst").agg(F.collect_set("chunk_id").alias("ch"))
    out = inferred
    for side in ends:
        out = out.join(to.select(F.col("src").alias(side), F.col("dst").alias(mediator), F.col("ch").alias(f"_{side}")), [side, mediator], "left")
    none = F.array().cast("array<string>")
    found = F.array_union(*[F.coalesce(f"_{side}", none) for side in ends])
    return out.withColumn("evidence", F.array_sort(found)).select(*inferred.columns, "evidence")


#: The relations that pair analysis walks.
DIRECT, MEMBER, TO_CLASS = "INTERAGE_COM", "E_DA_CLASSE", "INTERAGE_COM_CLASSE"
FINDING = ["a", "b", "kind", "rule", "severity", "path", "chunks", "ord"]


def pair_legs(edge_rows: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The ways that link the nodes of each requested pair (a, b): leg -> (a, b, kind, rule, severity, path, chunks, ord).

    edge_rows: src, dst, relation, origin, severity, rule, mediator, chunk_id, ord. Legs: `direct` edges in both directions,
    asserted (kind direct) or inferred (kind mechanism, through the mediator, with its evidence where the edge has no chunk);
    `class`: one node to a class of the other; `class_class`: a class of one to a class of the other.

    Of parallel edges that give the same finding only the first by ord can count, so they are reduced to it before any join
    with pairs. Null severities count as moderada.
    """
    severity = F.coalesce("severity", F.lit("moderada")).alias("severity")
    links = edge_rows.where(F.col("relation").isin(DIRECT, TO_CLASS)).groupBy("src", "dst", "relation", "origin", severity, "rule", "mediator")
    links = links.agg(F.min(F.struct("ord", "chunk_id")).alias("_first")).select("src", "dst", "relation", "origin", "severity", "rule", "mediator", "_first.*")
    member = edge_rows.where(F.col("relation") == MEMBER).groupBy("src", F.col("dst").alias("cls")).agg(F.min("ord").alias("cls_ord"), F.array_sort(F.collect_set("chunk_id")).alias("ch"))
    asked = pairs.select("a", "b").distinct()
    turned = asked.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("turn")).unionByName(asked.select("a", "b", F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1).alias("turn")))
    own = F.filter(F.array("chunk_id"), lambda c: c.isNotNull())
    place = lambda leg, x=0, y=0: F.struct(F.lit(leg).alias("leg"), "turn", *[(F.lit(c) if c == 0 else F.col(c)).cast("long").alias(n) for n, c in (("x", x), ("y", y))], F.col("ord").cast("long").alias("e")).alias("ord")

    joined = turned.join(links.where(F.col("relation") == DIRECT), (F.col("u") == F.col("src")) & (F.col("v") == F.col("dst")))
    asserted = joined.where("origin <> 'inferred'").select("a", "b", F.lit("direct").alias("kind"), "rule", "severity", F.array("u", "v").alias("path"), own.alias("chunks"), place(0))
    through = evidence(joined.where("origin = 'inferred'"), edge_rows, ("u", "v"))
    path = F.when(F.col("mediator").isNull(), F.array("u", "v")).otherwise(F.array("u", "mediator", "v"))
    chunks = F.when(F.col("chunk_id").isNotNull(), own).otherwise(F.col("evidence"))
    through = through.select("a", "b", F.lit("mechanism").alias("kind"), "rule", "severity", path.alias("path"), chunks.alias("chunks"), place(0))

    to_class = links.where(F.col("relation") == TO_CLASS)
    bridge = turned.join(member, F.col("v") == F.col("src")).drop("src").join(to_class, (F.col("u") == F.col("src")) & (F.col("cls") == F.col("dst")))
    bridge = bridge.select("a", "b", F.lit("class").alias("kind"), "rule", "severity", F.array("u", "cls", "v").alias("path"), F.concat(own, "ch").alias("chunks"), place(1, "cls_ord"))

    sides = [member.select(F.col("src").alias(n), F.col("cls").alias(f"c{n}"), F.col("cls_ord").alias(f"o{n}"), F.col("ch").alias(f"h{n}")) for n in ("a", "b")]
    classes = asked.join(sides[0], "a").join(sides[1], "b")
    ends = [to_class.withColumns({"ca": F.col(x), "cb": F.col(y), "turn": F.lit(t)}) for t, (x, y) in enumerate((("src", "dst"), ("dst", "src")))]
    both = classes.join(ends[0].unionByName(ends[1]), ["ca", "cb"])
    both = both.select("a", "b", F.lit("class_class").alias("kind"), "rule", "severity", F.array("a", "ca", "cb", "b").alias("path"), F.concat(own, "ha", "hb").alias("chunks"), place(2, "oa", "ob"))
    return {"direct": asserted, "mechanism": through, "class": bridge, "class_class": both}


def pair_findings(edge_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings of all legs for each pair (a, b), once for each kind, rule and severity, ranked: FINDING, hops, rank."""
    legs = list(pair_legs(edge_rows, pairs).values())
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    return ranked_findings(every.withColumn("hops", F.size("path") - 1))


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Findings once for each (kind, rule, unordered pair, severity), ranked in their pair by severity, hops and kind.

    findings: kind, rule, a, b, severity, hops, ord.
    """
    pair = findings.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    once = first_of(pair, ["kind", "rule", "low", "high", "severity"], "ord")
    kind = F
    for name, value in KIND_RANK.items():
        kind = kind.when(F.col("kind") == name, value)
    order = Window.partitionBy("low", "high").orderBy(F.desc(weight(F.col("severity"))), "hops", kind.otherwise(9), "ord")
    return once.withColumn("rank", F.row_number().over(order).cast("long"))
