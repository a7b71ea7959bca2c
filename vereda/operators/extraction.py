"""Rule extraction: typed triples from the chunks of the leaflet corpus.

Lists are cut by one projection over all sections, sentences and targets are resolved by equi-joins with the lexicon,
and every step works on one chunk at a time, so the extraction holds for a stream of chunks too, up to the removal of
repeated triples.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vereda.functions import text as tx
from vereda.functions.leaflet import by_key
from vereda.operators import graph as g
from vereda.operators import lexicon as lx
from vereda.sources.seed import Seed

# Kinds, allowed signatures, and the wordings that the rules look for.
DRUG, CLASS, ENZYME, BRAND, CONDITION, EFFECT, CHUNK = "Medicamento", "Classe", "Enzima", "Marca", "Condicao", "Efeito", "Chunk"
SIGNATURES = [
    (DRUG, "E_DA_CLASSE", CLASS), (DRUG, "TEM_MARCA", BRAND), (DRUG, "INIBE", ENZYME), (DRUG, "INDUZ", ENZYME), (DRUG, "SUBSTRATO_DE", ENZYME),
    (DRUG, "ATIVADO_POR", ENZYME), (DRUG, "INTERAGE_COM", DRUG), (DRUG, "INTERAGE_COM_CLASSE", CLASS), (CLASS, "INTERAGE_COM_CLASSE", CLASS),
    (DRUG, "INDICADO_PARA", CONDITION), (DRUG, "CONTRAINDICADO_EM", CONDITION), (DRUG, "CAUSA", EFFECT), ("Interacao", "EVIDENCIADA_POR", CHUNK),
    (CHUNK, "MENCIONA", DRUG), (CHUNK, "MENCIONA", CLASS), (CHUNK, "MENCIONA", ENZYME),
]
#: section -> (relation, kind of object, capture of the list, where it is cut)
LISTS = {
    "Identificação": ("TEM_MARCA", BRAND, r"sob os nomes (.+?)\.", r",| e "),
    "Indicações": ("INDICADO_PARA", CONDITION, r"indicado para (.+?)\.", r",| e "),
    "Contraindicações": ("CONTRAINDICADO_EM", CONDITION, r"situações:\s*(.+?)\.$", r",| e (?![^(]*\))"),
    "Reações adversas": ("CAUSA", EFFECT, r"relatadas são (.+?)\.", r",| e "),
}
CLASS_OF = r"Classe farmacológica:\s*(.+?)\."
CLASS_TARGET = r"uso concomitante com medicamentos da classe dos (.+?)\."
DRUG_TARGET = r"uso concomitante com (?!medicamentos da classe)(.+?)\."
SEVERITIES = [("associacao e contraindicada", "contraindicado"), ("gravidade alta", "grave"), ("gravidade moderada", "moderada"), ("gravidade leve", "leve")]
EVIDENCE = r"nivel de evidencia:\s*(alta|moderada|baixa)"
FIELDS = {
    "mecanismo": r"(?s)Mecanismo:\s*(.+?)\s*Consequência clínica:",
    "efeito": r"(?s)Consequência clínica:\s*(.+?)\s*Conduta:",
    "manejo": r"(?s)Conduta:\s*(.+?)\s*Nível de evidência:",
}
OWNERS = "^(bula:|monografia:classe:|monografia:enzima:)"
ROLES = [("e um inibidor", "INIBE"), ("e um indutor", "INDUZ"), ("e um pro-farmaco|bioativado", "ATIVADO_POR"), ("metabolizado|substrato", "SUBSTRATO_DE")]


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "subject_kind string, relation string, object_kind string")


def seed_lexicon(seed: Seed) -> DataFrame:
    """Surfaces of drugs (names, synonyms, brands), classes (wherever the seed names one) and enzymes (id and name)."""
    row = lambda df, surface, kind, canonical, stage: df.select(
        surface.alias("surface"), F.lit(kind).alias("kind"), canonical.alias("canonical"), F.struct(F.lit(stage[0]).alias("t"), F.col("ord"), F.lit(stage[1]).alias("s"), stage[2].alias("i")).alias("ord")
    )
    zero, drugs = F.lit(0), seed["drugs"]
    several = lambda c: drugs.select("ord", "principio_ativo", F.posexplode(c).alias("i", "x"))
    name = F.col("principio_ativo")
    parts = [
        row(drugs, name, DRUG, name, (0, 0, zero)),
        row(several("sinonimos"), F.col("x"), DRUG, name, (0, 1, F.col("i"))),
        row(several("nomes_comerciais"), F.col("x"), DRUG, name, (0, 2, F.col("i"))),
        row(drugs, F.col("classe"), CLASS, F.col("classe"), (0, 0, zero)),
        row(seed["drug_class"], F.col("classe"), CLASS, F.col("classe"), (1, 0, zero)),
        row(seed["class_class"], F.col("classe_a"), CLASS, F.col("classe_a"), (2, 0, zero)),
        row(seed["class_class"], F.col("classe_b"), CLASS, F.col("classe_b"), (2, 1, zero)),
        row(seed["enzymes"], F.col("id"), ENZYME, F.col("id"), (0, 0, zero)),
        row(seed["enzymes"], F.col("nome"), ENZYME, F.col("id"), (0, 1, zero)),
    ]
    return lx.lexicon(reduce(DataFrame.unionAll, parts))


def _captured(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def owned(chunks: DataFrame, lex: DataFrame) -> DataFrame:
    """Chunks with owner_kind and owner: what the title names after its dash; null if the lexicon does not know it."""
    title = F.when(F.col("doc_id").rlike(OWNERS), F.trim(F.element_at(F.split("titulo", "—", 2), -1)))
    return lx.resolve(chunks.withColumn("_owner", title), lex, [DRUG, CLASS, ENZYME], "_owner").withColumnsRenamed({"kind": "owner_kind", "canonical": "owner"}).drop("_owner")


def interaction_attributes(text: Column) -> Column:
    folded = tx.squeeze(text)
    evidence = F.coalesce(_captured(folded, EVIDENCE), F.lit("moderada"))
    pairs = [F.lit("severidade"), lx.severity(folded, SEVERITIES, "moderada"), F.lit("evidencia"), evidence]
    for name, pattern in FIELDS.items():
        pairs += [F.lit(name), F.trim(F.regexp_extract(text, pattern, 1))]
    return F.create_map(*pairs)


def _triples(df: DataFrame, subject: Column, subject_kind: Column, relation: Column, obj: Column, object_kind: Column, branch: int, place: Column, attributes: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return df.select(
        subject.alias("subject"), subject_kind.alias("subject_kind"), relation.alias("relation"), obj.alias("object"), object_kind.alias("object_kind"), F.col("id").alias("chunk_id"),
        F.lit("asserted").alias("origin"), F.struct(F.col("ord").alias("c"), F.lit(branch).alias("b"), place.cast("long").alias("p")).alias("ord"), (none if attributes is None else attributes).alias("attributes"),
    )


def candidates(chunks: DataFrame, lex: DataFrame) -> DataFrame:
    """All triples that the rules read from the chunks, before validation; chunks: id, doc_id, titulo, secao, texto, ord."""
    lit, col = F.lit, F.col
    own = owned(chunks, lex).where("owner_kind is not null")
    drug, section, text = own.where(col("owner_kind") == DRUG), col("secao"), col("texto")
    owner, owner_kind = col("owner"), col("owner_kind")

    seen = chunks.select("id", "ord").join(lx.mentions(chunks, lex, "id", "texto"), "id")
    said = _triples(seen, col("id"), lit(CHUNK), lit("MENCIONA"), col("canonical"), col("kind"), 0, lit(0))

    cut = by_key(section, {k: tx.items(F.regexp_extract(F.trim(text), pattern, 1), where) for k, (_, _, pattern, where) in LISTS.items()})
    items = drug.where(section.isin(*LISTS)).select("id", "ord", "owner", "owner_kind", "secao", F.posexplode(cut).alias("i", "x"))
    listed = _triples(items, owner, owner_kind, by_key(section, {k: v[0] for k, v in LISTS.items()}), col("x"), by_key(section, {k: v[1] for k, v in LISTS.items()}), 2, col("i"))

    classed = lx.resolve(drug.where(section == "Identificação").withColumn("term", _captured(text, CLASS_OF)), lex, [DRUG, CLASS, ENZYME]).where("canonical is not null")
    member = _triples(classed, owner, owner_kind, lit("E_DA_CLASSE"), col("canonical"), lit(CLASS), 1, lit(0))

    sentences = drug.where(section == "Metabolismo").select("id", "ord", "owner", "owner_kind", F.posexplode(tx.sentences(text)).alias("i", "x"))
    sentences = sentences.withColumn("sid", F.concat("id", lit("/"), col("i")))
    folded = tx.squeeze(col("x"))
    role = F
    for pattern, name in ROLES:
        role = role.when(folded.rlike(pattern), name)
    strength = F.coalesce(_captured(folded, r"intensidade (\w+)"), F.when(folded.rlike(r"sensibilidade (\w+)"), "sensivel"), lit("moderada"))
    found = lx.mentions(sentences, lex.where(col("kind") == ENZYME), "sid", "x").select("sid", "canonical")
    told = sentences.withColumns({"role": role, "strength": strength}).where("role is not null").join(found, "sid")
    metabolised = _triples(told, owner, owner_kind, col("role"), col("canonical"), lit(ENZYME), 3, col("i"), F.create_map(lit("intensidade"), col("strength")))

    pairs = own.where(section.isin("Interações medicamentosas", "Interações de classe"))
    pairs = lx.resolve(pairs.withColumn("term", _captured(text, CLASS_TARGET)), lex, [DRUG, CLASS, ENZYME]).withColumnRenamed("canonical", "as_class").drop("kind", "term")
    pairs = lx.resolve(pairs.withColumn("term", F.when(col("as_class").isNull(), _captured(text, DRUG_TARGET))), lex, [DRUG, CLASS, ENZYME])
    pairs = pairs.where((col("as_class").isNotNull()) | ((col("kind") == DRUG) & (owner_kind == DRUG)))
    to_class = col("as_class").isNotNull()
    asserted = _triples(
        pairs, owner, owner_kind, F.when(to_class, "INTERAGE_COM_CLASSE").otherwise("INTERAGE_COM"), F.coalesce("as_class", "canonical"), F.when(to_class, CLASS).otherwise(DRUG), 4, lit(0), interaction_attributes(text)
    )
    return reduce(DataFrame.unionByName, [said, listed, member, metabolised, asserted])


def extract(chunks: DataFrame, lex: DataFrame) -> DataFrame:
    """Valid triples, once for each subject, relation, object and chunk: the first by ord."""
    return g.first_of(g.valid(candidates(chunks, lex), signatures(chunks.sparkSession)), ["subject", "relation", "object", "chunk_id"], "ord")


#: Fixed value: the enzyme of rule R4.
SPECIAL_ENZYME = "xo"


def infer(triples: DataFrame) -> DataFrame:
    """Interactions that two drugs' roles on one enzyme imply: a, b, m, rule, severity, evidence (sorted chunk ids)."""
    side = lambda relations, p, q: triples.where(F.col("relation").isin(*relations)).groupBy(
        F.col("subject").alias(p), F.col("object").alias("m"), F.col("relation").alias(f"relation_{p}"), F.coalesce(F.col("attributes")["intensidade"], F.lit("moderada")).alias(f"intensity_{p}")
    ).agg(F.collect_set("chunk_id").alias(q))
    mods = side(["INIBE", "INDUZ"], "a", "chunks_a").withColumn("special", F.lower("m") == SPECIAL_ENZYME)
    rows = g.mediated(mods, side(["SUBSTRATO_DE", "ATIVADO_POR"], "b", "chunks_b"))
    return rows.select("a", "b", "m", "relation_a", "relation_b", "rule", "severity", F.array_sort(F.array_union("chunks_a", "chunks_b")).alias("evidence"))


def quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of (subject, relation, object), over the relations that gold holds; 0 for 0/0."""
    keys = ["subject", "relation", "object"]
    got = predicted.join(gold.select("relation").distinct(), "relation", "left_semi").select(*keys).distinct().withColumn("p", F.lit(1))
    both = got.join(gold.select(*keys).distinct().withColumn("w", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.expr("p = 1 and w = 1")).alias("tp"), F.count_if(F.expr("w is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, p, r = F.col("tp"), F.col("precision"), F.col("recall")
    n = n.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))})
    return n.withColumn("f1", ratio(2 * p * r, p + r)).withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})
