"""Facets of a text in ten dimensions, from a vocabulary that is a table of patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.periods import periods
from evidora.functions.text import fold

DIMENSIONS = ("indicator", "region", "period", "unit", "scale", "sector", "source", "basis", "coverage", "kind")
#: (dimension, id, pattern on folded text); fixed values of the domain vocabulary.
VOCABULARY = (
    ("indicator", "desocupacao", r"desocupacao|desemprego"),
    ("indicator", "ocupacao", r"(?<!des)ocupacao|pessoal ocupado|ocupados"),
    ("indicator", "pib", r"\bpib\b|produto interno bruto"),
    ("indicator", "exportacao", r"exporta\w*"),
    ("indicator", "importacao", r"importa\w*"),
    ("indicator", "saldo", r"\bsaldo\b"),
    ("indicator", "rendimento", r"rendimento|salario|\brenda\b"),
    ("indicator", "producao", r"producao"),
    ("indicator", "emprego", r"(?<!des)emprego\w*|postos de trabalho"),
    ("indicator", "inflacao", r"inflacao|\bipca\b"),
    ("indicator", "participacao", r"participacao"),
    ("unit", "percentual", r"%|por cento|percentual"),
    ("unit", "pp", r"p\.\s*p\.|pontos? percentuais?"),
    ("unit", "real", r"r\$|reais"),
    ("unit", "dolar", r"us\$|dolares"),
    ("unit", "pessoa", r"pessoas|trabalhadores|habitantes"),
    ("unit", "tonelada", r"toneladas?"),
    ("scale", "mil", r"\bmil\b|milhares"),
    ("scale", "milhao", r"milhao|milhoes"),
    ("scale", "bilhao", r"bilhao|bilhoes"),
    ("sector", "industria", r"industria|industrial"),
    ("sector", "comercio", r"comercio|comercial"),
    ("sector", "servicos", r"servicos"),
    ("sector", "agropecuaria", r"agropecuaria|agricultura"),
    ("sector", "construcao", r"construcao"),
    ("sector", "industria_transformacao", r"industria de transformacao"),
    ("sector", "industria_extrativa", r"industria extrativa"),
    ("source", "caged", r"\bcaged\b"),
    ("source", "pnadc", r"\bpnad\w*\b"),
    ("source", "rais", r"\brais\b"),
    ("source", "seade", r"\bseade\b"),
    ("source", "ibge", r"\bibge\b"),
    ("region", "brasil", r"\bbrasil\b|\bbrasileir\w*|\bnacional\b"),
    ("region", "rmsp", r"\brmsp\b|regiao metropolitana de sao paulo"),
    ("region", "interior_sp", r"interior (?:de sao paulo|paulista)"),
    ("region", "municipio_sp", r"(?:municipio|cidade|capital) (?:de )?sao paulo|capital paulista"),
    ("region", "estado_sp", r"estado (?:de )?(?:sao paulo|sp)\b|\buf\s*:?\s*sp\b"),
    ("basis", "real", r"\breal\b|deflacionad"),
    ("basis", "nominal", r"nominal"),
    ("basis", "dessazonalizado", r"dessazonalizad|ajuste sazonal"),
    ("coverage", "formal", r"(?<!in)\bforma(?:l|is)\b|com carteira"),
    ("coverage", "informal", r"\binforma(?:l|is)\b|sem carteira"),
    ("coverage", "total", r"\btota(?:l|is)\b"),
    ("kind", "estoque", r"estoque"),
    ("kind", "saldo", r"saldo"),
    ("kind", "fluxo", r"admissoes|desligamentos|fluxo"),
    ("kind", "taxa", r"taxa"),
    ("kind", "variacao", r"variacao|crescimento|recuo|aumento|queda"),
)
SECTOR_PARENTS = {"industria_transformacao": "industria", "industria_extrativa": "industria"}
PUBLICATION = r"\b(publicacao|publicado|edicao|divulgacao|divulgado|atualizacao|atualizado)\b"


def reference_text(c: Column) -> Column:
    """The folded text without source lines and lines about publication."""
    return F.array_join(F.filter(F.split(fold(c), "\n"), lambda x: ~x.rlike(rf"^fonte:|{PUBLICATION}")), "\n")


def _occurs(folded: Column, pattern: str) -> Column:
    """Whether a pattern occurs; alternatives that are plain words are searched as bytes, without a regular expression."""
    plain = [p.replace("\\$", "$") for p in pattern.split("|")]
    if all(re.fullmatch(r"[a-z0-9 %$]+", p) for p in plain):
        return reduce(lambda a, b: a | b, (F.contains(folded, F.lit(p)) for p in plain))
    return folded.rlike(pattern)


def found(folded: Column, dimension: str, vocabulary=VOCABULARY) -> Column:
    """Sorted ids of a dimension whose pattern occurs in the folded text."""
    return F.array_compact(F.array(*(F.when(_occurs(folded, p), F.lit(i)) for d, i, p in sorted(vocabulary) if d == dimension)))


def facets(folded: Column) -> Column:
    """Struct of ten sorted arrays of a reference text; an unknown dimension is empty.  A sector hides the sector it belongs to."""
    parts = {d: periods(folded) if d == "period" else found(folded, d) for d in DIMENSIONS}
    for child, parent in SECTOR_PARENTS.items():
        parts["sector"] = F.when(F.array_contains(parts["sector"], child), F.array_remove(parts["sector"], parent)).otherwise(parts["sector"])
    return F.struct(*(F.coalesce(v, F.array().cast("array<string>")).alias(d) for d, v in parts.items()))


def with_facets(df: DataFrame, text_col: str, name: str = "dims") -> DataFrame:
    """Adds the facets of a text.  The reference text is a projection of its own: every pattern reads it, none folds again."""
    return df.withColumn("_reference", reference_text(F.col(text_col))).withColumn(name, facets(F.col("_reference"))).drop("_reference")


def stored_facets(json: Column) -> Column:
    """Facets kept as JSON text; unknown dimensions and unreadable texts are empty arrays."""
    read = F.from_json(json, ", ".join(f"{d} array<string>" for d in DIMENSIONS))
    return F.struct(*(F.coalesce(read[d], F.array().cast("array<string>")).alias(d) for d in DIMENSIONS))
