"""Templates of the leaflet corpus, and a function that fills one with columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wordings of the corpus. The extraction patterns and published results depend on every word.
IDENTIFICATION = (
    "Bula de {pa}. Princípio ativo: {pa}. Classe farmacológica: {classe}. Código ATC: {atc}. Comercializado no Brasil sob os nomes {marcas}."
)
SYNONYMS = " Também referido como {sinonimos}."
INDICATIONS = "Indicações de {pa}. Este medicamento é indicado para {itens}. A prescrição deve considerar o quadro clínico completo do paciente."
CONTRAINDICATIONS = "Contraindicações de {pa}. O uso é contraindicado nas seguintes situações: {itens}."
REACTIONS = (
    "Reações adversas de {pa}. As reações mais frequentemente relatadas são {itens}. "
    "Reações raras e graves devem ser notificadas ao sistema de farmacovigilância."
)
STORAGE = (
    "Conservação e armazenamento de {pa}. Conservar em temperatura ambiente, entre 15 °C e 30 °C, protegido da luz e da umidade. "
    "Manter na embalagem original e fora do alcance de crianças. Não utilizar o medicamento após a data de validade impressa na embalagem. "
    "Descarte o medicamento vencido em ponto de coleta apropriado."
)
METABOLISM = "Metabolismo e vias de eliminação de {pa}. {frases}"
ROLES = {
    "inibidor": "É um inibidor de intensidade {intensidade} da {enzima} ({nome}). Ao reduzir a atividade dessa enzima, pode elevar a concentração "
    "plasmática de fármacos que dependem dela para sua eliminação.",
    "indutor": "É um indutor de intensidade {intensidade} da {enzima} ({nome}). Ao acelerar a atividade dessa enzima, pode reduzir a concentração "
    "plasmática e a eficácia de fármacos que dependem dela para sua eliminação.",
    "substrato": "É metabolizado pela {enzima} ({nome}), da qual é substrato de sensibilidade {intensidade}. Fármacos que inibam ou induzam essa "
    "enzima podem alterar de forma clinicamente relevante sua concentração plasmática.",
    "pro_farmaco": "É um pró-fármaco: precisa ser bioativado pela {enzima} ({nome}) para gerar seu metabólito ativo. A inibição dessa enzima bloqueia "
    "a bioativação e leva à perda de efeito terapêutico, ainda que o paciente esteja tomando o comprimido corretamente.",
}
INTERACTION = (
    "{abertura} Interação: o uso concomitante com {alvo}. {gravidade} Mecanismo: {mecanismo} Consequência clínica: {efeito} "
    "Conduta: {manejo} Nível de evidência: {evidencia}."
)
OF_CLASS = "medicamentos da classe dos {alvo}"
SEVERITIES = {
    "contraindicado": "Esta associação é CONTRAINDICADA.",
    "grave": "Esta é uma interação de gravidade ALTA.",
    "moderada": "Esta é uma interação de gravidade MODERADA.",
    "leve": "Esta é uma interação de gravidade LEVE.",
}
MEMBERS = (
    "Monografia da classe {classe}. Pertencem a esta classe farmacológica os seguintes princípios ativos disponíveis no Brasil: {itens}. "
    "Fármacos de uma mesma classe compartilham mecanismo de ação e, em regra, o mesmo perfil de interações medicamentosas."
)
PATHWAY = (
    "Via metabólica {id} — {nome}. Trata-se de uma enzima {tipo}. {nota} A inibição desta via reduz a depuração de seus substratos e eleva a "
    "concentração plasmática deles; a indução produz o efeito oposto. Quando o substrato é um pró-fármaco, a inibição da via impede sua ativação "
    "e causa perda de eficácia."
)


def fill(template: str, **values: Column | str) -> Column:
    """The template with columns (or names of columns) in place of its {names}; a null counts as empty."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(F.coalesce(F.col(values[part]) if isinstance(values[part], str) else values[part], F.lit("")))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out)


def by_key(key: Column, texts: dict[str, Column | str]) -> Column:
    """The text of the key; null for other keys."""
    out = F
    for name, text in texts.items():
        out = out.when(key == name, F.lit(text) if isinstance(text, str) else text)
    return out
