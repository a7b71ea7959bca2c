"""The curated seed (two JSON documents) as flat tables, and the artefacts that a build keeps.

A seed document is one JSON object with nested lists; each list becomes a table whose `ord` is the place in the list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lists of both seed documents, the table each becomes, and the fields of their items.
DRUG_LISTS = {
    "medicamentos": ("drugs", "id string, principio_ativo string, sinonimos array<string>, nomes_comerciais array<string>, classe string, atc string, "
                     "indicacoes array<string>, contraindicacoes array<string>, reacoes_comuns array<string>"),
}
_FINDING = "severidade string, mecanismo string, efeito string, manejo string, evidencia string, documentado_em string"
KNOWLEDGE_LISTS = {
    "enzimas": ("enzymes", "id string, nome string, tipo string, nota string"),
    "metabolismo": ("roles", "medicamento string, enzima string, papel string, intensidade string"),
    "regras_mecanismo": ("rules", "id string, condicao string, efeito string, severidade_base string, severidade_se_intensidade_forte_e_substrato_sensivel string"),
    "interacoes_farmaco_farmaco": ("drug_drug", f"id string, a string, b string, {_FINDING}"),
    "interacoes_farmaco_classe": ("drug_class", f"id string, medicamento string, classe string, {_FINDING}"),
    "interacoes_classe_classe": ("class_class", f"id string, classe_a string, classe_b string, {_FINDING}"),
}

Seed = dict[str, DataFrame]


def _lists(spark: SparkSession, path: str, lists: dict[str, tuple[str, str]]) -> Seed:
    schema = ", ".join(f"{name} array<struct<{fields}>>" for name, (_, fields) in lists.items())
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return {table: doc.select(F.posexplode(name).alias("ord", "_x")).select(F.col("ord").cast("long"), "_x.*") for name, (table, _) in lists.items()}


def read_seed(spark: SparkSession, drugs: str, knowledge: str) -> Seed:
    """Tables drugs, enzymes, roles, rules, drug_drug, drug_class and class_class; absent lists are empty tables."""
    return _lists(spark, drugs, DRUG_LISTS) | _lists(spark, knowledge, KNOWLEDGE_LISTS)


def save(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """Replaces an artefact; `by` names a column to partition on, so that filters on it prune folders."""
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(by) if by else writer).save(path)


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def load_triples(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Triples with the defaults of fields that older files lack: asserted, and no attributes."""
    got = load(spark, path, kind)
    origin = F.coalesce("origin", F.lit("asserted")) if "origin" in got.columns else F.lit("asserted")
    none = F.create_map().cast("map<string,string>")
    attributes = F.coalesce("attributes", none) if "attributes" in got.columns else none
    return got.withColumns({"origin": origin, "attributes": attributes})


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], kind: str = "parquet") -> DataFrame:
    """The artefact at the path; built and saved there first if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        save(build(), path, kind)
    return load(spark, path, kind)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON string a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
