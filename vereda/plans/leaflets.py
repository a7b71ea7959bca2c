"""The leaflet corpus: a seed's tables as chunks of text, each with the facts that it states.

All chunks of one kind come from one projection; lists per drug or class are grouped on that key, never over a whole
table, and `ord` is a struct that sorts as the corpus does, so no global numbering is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vereda.functions import leaflet as lf
from vereda.functions import text as tx
from vereda.sources.seed import Seed


def _ord(group: int, place, name, section: int, n) -> Column:
    """Leaflets by place of the drug, then class monographs by name, then enzymes by place."""
    return F.struct(F.lit(group).alias("g"), place.cast("long").alias("p"), name.cast("string").alias("name"), F.lit(section).alias("s"), n.cast("long").alias("n"))


def _drug(df: DataFrame, tail: str | Column, section: str, text: Column, facts: Column, place: int, n: Column | None = None) -> DataFrame:
    """Chunks of drug leaflets; df has ord, id and principio_ativo of the drug."""
    tail = F.lit(tail) if isinstance(tail, str) else tail
    return df.select(
        F.concat("id", F.lit("#"), tail).alias("id"), F.concat(F.lit("bula:"), "id").alias("doc_id"), F.concat(F.lit("Bula — "), "principio_ativo").alias("titulo"),
        F.lit(section).alias("secao"), text.alias("texto"), facts.alias("fatos"), _ord(0, F.col("ord"), F.lit(""), place, F.lit(0) if n is None else n).alias("ord"),
    )


def _class(df: DataFrame, tail: Column, section: str, text: Column, facts: Column, place: int, n: Column) -> DataFrame:
    slug = tx.slug(F.col("classe"))
    return df.select(
        F.concat(F.lit("classe-"), slug, F.lit("#"), tail).alias("id"), F.concat(F.lit("monografia:classe:"), slug).alias("doc_id"),
        F.concat(F.lit("Monografia de classe — "), "classe").alias("titulo"), F.lit(section).alias("secao"), text.alias("texto"), facts.alias("fatos"),
        _ord(1, F.lit(0), F.col("classe"), place, n).alias("ord"),
    )


def _interaction(opening: Column, target: Column) -> Column:
    fields = {k: k for k in ("mecanismo", "efeito", "manejo", "evidencia")}
    return lf.fill(lf.INTERACTION, abertura=opening, alvo=target, gravidade=lf.by_key(F.col("severidade"), lf.SEVERITIES), **fields)


def metabolism(seed: Seed) -> DataFrame:
    """One chunk for each drug with a role: its sentences in the order of the seed."""
    strength = F.regexp_replace("intensidade", "sensivel", "sensível")
    sentence = lf.by_key(F.col("papel"), {k: lf.fill(v, intensidade=strength, enzima="enzima", nome="nome") for k, v in lf.ROLES.items()})
    fact = F.concat_ws(":", F.lit("metabolismo"), "medicamento", "papel", "enzima")
    roles = seed["roles"].join(seed["enzymes"].select(F.col("id").alias("enzima"), "nome"), "enzima")
    per = roles.groupBy("medicamento").agg(F.array_sort(F.collect_list(F.struct("ord", sentence.alias("t"), fact.alias("f")))).alias("_r"))
    told = seed["drugs"].join(per.withColumnRenamed("medicamento", "principio_ativo"), "principio_ativo")
    return _drug(told, "metabolismo", "Metabolismo", lf.fill(lf.METABOLISM, pa="principio_ativo", frases=F.array_join("_r.t", " ")), F.col("_r.f"), 5)


def leaflet_interactions(seed: Seed) -> DataFrame:
    """Interactions that a drug's own leaflet documents, numbered: with drugs first, then with classes."""
    pairs = seed["drug_drug"].select("*", F.when(F.col("a") == F.col("documentado_em"), F.col("b")).otherwise(F.col("a")).alias("alvo"), F.lit("ddi").alias("how"), F.lit(0).alias("first"))
    classes = seed["drug_class"].select("*", lf.fill(lf.OF_CLASS, alvo="classe").alias("alvo"), F.lit("dci").alias("how"), F.lit(1).alias("first"))
    both = pairs.drop("a", "b").unionByName(classes.drop("medicamento", "classe"))
    both = both.withColumnsRenamed({"id": "iid", "ord": "place"}).withColumnRenamed("documentado_em", "principio_ativo")
    told = both.join(seed["drugs"].select("ord", "id", "principio_ativo"), "principio_ativo")
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("first", "place")))
    opening = lf.fill("Interações medicamentosas de {pa}.", pa="principio_ativo")
    return _drug(told, F.concat(F.lit("interacao-"), "n"), "Interações medicamentosas", _interaction(opening, F.col("alvo")), F.array(F.concat_ws(":", "how", "iid")), 6, F.col("n"))


def class_monographs(seed: Seed) -> DataFrame:
    """The members of each class, and the class interactions that its monograph documents."""
    members = seed["drugs"].groupBy("classe").agg(F.array_sort(F.collect_list("principio_ativo")).alias("_m"))
    lists = _class(members, F.lit("membros"), "Composição da classe", lf.fill(lf.MEMBERS, classe="classe", itens=tx.listed(F.col("_m"))), F.array(F.concat(F.lit("membros_classe:"), "classe")), 0, F.lit(0))
    told = seed["class_class"].where("documentado_em like 'classe:%'").withColumn("classe", F.expr("substring(documentado_em, 8)")).join(members.select("classe"), "classe", "left_semi")
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("classe").orderBy("ord")))
    other = F.when(F.col("classe_a") == F.col("classe"), F.col("classe_b")).otherwise(F.col("classe_a"))
    text = _interaction(lf.fill("Interações da classe {c}.", c="classe"), lf.fill(lf.OF_CLASS, alvo=other))
    return lists.unionByName(_class(told, F.concat(F.lit("interacao-"), "n"), "Interações de classe", text, F.array(F.concat(F.lit("cci:"), "id")), 1, F.col("n")))


def pathways(seed: Seed) -> DataFrame:
    slug = tx.slug(F.col("id"))
    return seed["enzymes"].select(
        F.concat(F.lit("enzima-"), slug, F.lit("#descricao")).alias("id"), F.concat(F.lit("monografia:enzima:"), slug).alias("doc_id"),
        F.concat(F.lit("Monografia de via metabólica — "), "id").alias("titulo"), F.lit("Descrição").alias("secao"),
        lf.fill(lf.PATHWAY, id="id", nome="nome", tipo="tipo", nota="nota").alias("texto"), F.array(F.concat(F.lit("enzima:"), "id")).alias("fatos"),
        _ord(2, F.col("ord"), F.lit(""), 0, F.lit(0)).alias("ord"),
    )


def chunks(seed: Seed) -> DataFrame:
    """id, doc_id, titulo, secao, texto, fatos, ord (sorts as the corpus)."""
    names = F.coalesce("nomes_comerciais", F.array().cast("array<string>"))
    # In a column of its own: within the projection of a chunk, "id" in a lambda would mean the chunk's id.
    drugs = seed["drugs"].withColumn("_brands", F.transform(names, lambda b: F.concat(F.lit("marca:"), F.col("id"), F.lit(":"), b)))
    listed = lambda c: tx.listed(F.coalesce(F.col(c), F.array().cast("array<string>")))
    pa, fact = "principio_ativo", lambda kind: F.array(F.concat(F.lit(f"{kind}:"), "id"))
    synonyms = listed("sinonimos")
    identity = F.concat(
        lf.fill(lf.IDENTIFICATION, pa=pa, classe="classe", atc="atc", marcas=listed("nomes_comerciais")), F.when(synonyms != "", lf.fill(lf.SYNONYMS, sinonimos=synonyms)).otherwise("")
    )
    parts = [
        _drug(drugs, "identificacao", "Identificação", identity, F.concat(fact("classe"), "_brands"), 0),
        _drug(drugs, "indicacoes", "Indicações", lf.fill(lf.INDICATIONS, pa=pa, itens=listed("indicacoes")), fact("indicacao"), 1),
        _drug(drugs, "contraindicacoes", "Contraindicações", lf.fill(lf.CONTRAINDICATIONS, pa=pa, itens=listed("contraindicacoes")), fact("contraindicacao"), 2),
        _drug(drugs, "reacoes", "Reações adversas", lf.fill(lf.REACTIONS, pa=pa, itens=listed("reacoes_comuns")), fact("reacao"), 3),
        _drug(drugs, "conservacao", "Conservação", lf.fill(lf.STORAGE, pa=pa), F.array().cast("array<string>"), 4),
        metabolism(seed), leaflet_interactions(seed), class_monographs(seed), pathways(seed),
    ]
    return reduce(DataFrame.unionByName, parts)


def undocumented(seed: Seed, corpus: DataFrame) -> DataFrame:
    """Interactions of the seed (fact) that no chunk states: empty for a sound corpus."""
    kinds = {"ddi": "drug_drug", "dci": "drug_class", "cci": "class_class"}
    wanted = reduce(DataFrame.unionAll, [seed[t].select(F.concat(F.lit(f"{k}:"), "id").alias("fact")) for k, t in kinds.items()])
    return wanted.join(corpus.select(F.explode("fatos").alias("fact")), "fact", "left_anti")


def gold_triples(seed: Seed) -> DataFrame:
    """(subject, relation, object) that the structural relations of the seed imply, once each."""
    other = lambda a, b, own: F.when(F.col(a) == own, F.col(b)).otherwise(F.col(a)).alias("object")
    row = lambda df, s, r, o: df.select(s.alias("subject"), (F.lit(r) if isinstance(r, str) else r).alias("relation"), o.alias("object"))
    documented, drug = F.col("documentado_em"), F.col("principio_ativo")
    owner = F.regexp_replace("documentado_em", "^classe:", "")
    relation = lf.by_key(F.col("papel"), {"inibidor": "INIBE", "indutor": "INDUZ", "substrato": "SUBSTRATO_DE", "pro_farmaco": "ATIVADO_POR"})
    parts = [
        row(seed["drugs"], drug, "E_DA_CLASSE", F.col("classe")),
        row(seed["drugs"].select("principio_ativo", F.explode("nomes_comerciais").alias("b")), drug, "TEM_MARCA", F.col("b")),
        row(seed["roles"], F.col("medicamento"), relation, F.col("enzima")),
        row(seed["drug_drug"], documented, "INTERAGE_COM", other("a", "b", documented)),
        row(seed["drug_class"].where("documentado_em not like 'classe:%'"), documented, "INTERAGE_COM_CLASSE", F.col("classe")),
        row(seed["class_class"], owner, "INTERAGE_COM_CLASSE", other("classe_a", "classe_b", owner)),
    ]
    return reduce(DataFrame.unionAll, parts).distinct()
