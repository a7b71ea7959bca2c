import json

import pytest

from vereda.operators import extraction as ex
from vereda.plans import leaflets as lv
from vereda.sources import seed as sd
from vereda.streaming import chunks as stream


def drug(i, name, family, brands, synonyms=()):
    return {"id": i, "principio_ativo": name, "sinonimos": list(synonyms), "nomes_comerciais": brands, "classe": family, "atc": "X01", "indicacoes": ["dor", "febre"],
            "contraindicacoes": ["gravidez (primeiro e segundo trimestres)", "alergia"], "reacoes_comuns": ["náusea", "tontura", "sono"]}


FOUND = {"severidade": "grave", "mecanismo": "Soma de efeitos.", "efeito": "Risco maior.", "manejo": "Evitar.", "evidencia": "alta"}


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("seed")
    drugs = [drug("alfa", "alfanol", "alfanóis", ["Alfex", "Alfort"], ["ácido álfico"]), drug("beta", "betanol", "betanóis", ["Betex"]), drug("gama", "gamanol", "betanóis", ["Gamex"]), drug("delta", "deltanol", "alfanóis", [])]
    knowledge = {
        "enzimas": [{"id": "ENZ1", "nome": "Enzima Um", "tipo": "hepática", "nota": "Nota."}],
        "metabolismo": [{"medicamento": m, "enzima": "ENZ1", "papel": p, "intensidade": i} for m, p, i in [("alfanol", "inibidor", "forte"), ("betanol", "substrato", "sensivel"), ("gamanol", "pro_farmaco", "moderada"), ("deltanol", "indutor", "moderada")]],
        "interacoes_farmaco_farmaco": [{"id": "d1", "a": "betanol", "b": "alfanol", "documentado_em": "alfanol"} | FOUND],
        "interacoes_farmaco_classe": [{"id": "c1", "medicamento": "alfanol", "classe": "betanóis", "documentado_em": "alfanol"} | FOUND],
        "interacoes_classe_classe": [{"id": "k1", "classe_a": "alfanóis", "classe_b": "betanóis", "documentado_em": "classe:betanóis"} | FOUND | {"severidade": "contraindicado", "evidencia": "baixa"}],
    }
    (at / "m.json").write_text(json.dumps({"versao": "0", "medicamentos": drugs}, indent=1))
    (at / "k.json").write_text(json.dumps(knowledge, indent=1))
    return sd.read_seed(spark, str(at / "m.json"), str(at / "k.json"))


@pytest.fixture(scope="module")
def corpus(seed):
    return lv.chunks(seed).cache()


@pytest.fixture(scope="module")
def triples(seed, corpus):
    return ex.extract(corpus, ex.seed_lexicon(seed).cache()).cache()


def test_chunks_in_corpus_order(seed, corpus):
    rows = corpus.orderBy("ord").collect()
    assert [r.id for r in rows if r.id.startswith("alfa#")] == [f"alfa#{s}" for s in ("identificacao", "indicacoes", "contraindicacoes", "reacoes", "conservacao", "metabolismo", "interacao-1", "interacao-2")]
    assert [r.id for r in rows][-4:] == ["classe-alfanois#membros", "classe-betanois#membros", "classe-betanois#interacao-1", "enzima-enz1#descricao"]
    text = {r.id: r.texto for r in rows}
    assert text["alfa#identificacao"].endswith("sob os nomes Alfex e Alfort. Também referido como ácido álfico.")
    assert text["delta#identificacao"].endswith("sob os nomes .")
    assert "substrato de sensibilidade sensível" in text["beta#metabolismo"]
    assert text["alfa#interacao-1"].startswith("Interações medicamentosas de alfanol. Interação: o uso concomitante com betanol. Esta é uma interação de gravidade ALTA.")
    assert "medicamentos da classe dos alfanóis. Esta associação é CONTRAINDICADA." in text["classe-betanois#interacao-1"]
    facts = {r.id: r.fatos for r in rows}
    assert facts["alfa#identificacao"] == ["classe:alfa", "marca:alfa:Alfex", "marca:alfa:Alfort"] and facts["alfa#conservacao"] == []
    assert lv.undocumented(seed, corpus).count() == 0
    assert [r.fact for r in lv.undocumented(seed, corpus.where("id <> 'alfa#interacao-2'")).collect()] == ["dci:c1"]


def test_extraction_finds_the_gold_triples(seed, triples):
    row = ex.quality(triples, lv.gold_triples(seed)).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (lv.gold_triples(seed).count(), 0, 0, 1.0)
    conditions = {r.object for r in triples.where("relation = 'CONTRAINDICADO_EM' and subject = 'alfanol'").collect()}
    assert conditions == {"gravidez (primeiro e segundo trimestres)", "alergia"}
    attributes = triples.where("relation = 'INTERAGE_COM_CLASSE' and subject = 'betanóis'").first().attributes
    assert attributes == {"severidade": "contraindicado", "evidencia": "baixa", "mecanismo": "Soma de efeitos.", "efeito": "Risco maior.", "manejo": "Evitar."}
    strengths = {r.subject: r.attributes["intensidade"] for r in triples.where("object_kind = 'Enzima' and relation <> 'MENCIONA'").collect()}
    assert strengths == {"alfanol": "forte", "betanol": "sensivel", "gamanol": "moderada", "deltanol": "moderada"}
    assert ex.quality(triples.where("relation = 'CAUSA'"), lv.gold_triples(seed)).first().f1 == 0.0


def test_inference_over_extracted_roles(triples):
    got = {(r.a, r.b): (r.rule, r.severity, r.evidence) for r in ex.infer(triples).collect()}
    assert got == {
        ("alfanol", "betanol"): ("R1", "contraindicado", ["alfa#metabolismo", "beta#metabolismo"]),
        ("alfanol", "gamanol"): ("R3", "contraindicado", ["alfa#metabolismo", "gama#metabolismo"]),
    }


def test_artefacts_round_trip(spark, triples, tmp_path):
    sd.save(triples, str(tmp_path / "t"), by="relation")
    assert sd.load_triples(spark, str(tmp_path / "t")).where("relation = 'CAUSA'").count() == triples.where("relation = 'CAUSA'").count()
    old = triples.select("subject", "object")
    sd.save(old, str(tmp_path / "j"), "json")
    assert {(r.origin, str(r.attributes)) for r in sd.load_triples(spark, str(tmp_path / "j"), "json").collect()} == {("asserted", "{}")}
    builds = []

    def build():
        builds.append(1)
        return old

    for _ in range(2):
        assert sd.load_or_build(spark, str(tmp_path / "b"), build).count() == old.count()
    assert len(builds) == 1 and '"subject":' in sd.as_json(old).first().json


def test_stream_gives_the_triples_of_the_batch(spark, seed, corpus, triples, tmp_path):
    flat = corpus.selectExpr("id", "doc_id", "titulo", "secao", "texto", "xxhash64(id) as ord")
    flat.repartition(5).write.json(str(tmp_path / "in"))
    source = stream.read_chunks(spark, str(tmp_path / "in"), files=2)
    stream.extract_stream(source, ex.seed_lexicon(seed), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    keys = ["subject", "relation", "object", "chunk_id"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*keys).collect()))
    assert got == sorted(map(tuple, triples.select(*keys).collect()))
