"""Values in different units and scales, brought to the common unit of their quantity.

The distinct phrases of cells and table descriptions become spellings of units.  Spellings meet the known names through an
inverted index of character bigrams, a weighted edit distance verifies each meeting, and the resulting dictionary
(phrase, unit, scale) is joined to all rows.  All arithmetic is decimal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols and other names of units, fixed values beside the labels of the registry.
SYMBOLS = {
    "real": ("R$", "reais", "valores em R$", "valores em reais"),
    "dolar": ("US$", "dólares", "valores em US$"),
    "quilograma": ("kg", "quilos", "quilogramas"),
    "tonelada": ("t", "ton", "toneladas"),
    "saca_60kg": ("sacas de 60 kg", "sacas (60 kg)", "sc 60 kg", "sacas"),
    "arroba": ("@", "arrobas"),
    "metro_quadrado": ("m²", "metros quadrados"),
    "hectare": ("ha", "hectares"),
    "alqueire_paulista": ("alqueires paulistas", "alq. paulistas"),
    "quilometro_quadrado": ("km²", "quilômetros quadrados"),
    "quilowatt_hora": ("kWh", "quilowatts-hora"),
    "megawatt_hora": ("MWh", "megawatts-hora"),
    "gigawatt_hora": ("GWh", "gigawatts-hora"),
    "litro": ("L", "litros"),
    "hectolitro": ("hL", "hectolitros"),
    "metro_cubico": ("m³", "metros cúbicos"),
    "pessoa": ("pessoas", "número de pessoas", "habitantes"),
    "ponto_base": ("pontos-base", "p.b.", "bps"),
    "percentual": ("%", "por cento", "percentual", "porcentagem"),
    "por_mil": ("‰", "por mil (‰)", "por mil"),
    "fracao": ("fração da unidade", "fração"),
}
#: Names of scales, folded; fixed values.
SCALES = {
    1_000: ("mil", "milhar de", "milhares de", "1.000", "1 000", "1000"),
    1_000_000: ("mi", "milhao de", "milhoes de", "milhao", "milhoes", "1.000.000", "1 000 000", "1000000"),
    1_000_000_000: ("bi", "bilhao de", "bilhoes de", "bilhao", "bilhoes", "1.000.000.000", "1 000 000 000", "1000000000"),
}
FACET_SCALES = {"mil": 1_000, "milhao": 1_000_000, "bilhao": 1_000_000_000}
_BLANK = "[ \\u00a0\\u202f\\u2009]"
NUMBER = rf"[-−]?(?:[0-9]{{1,3}}(?:(?:\.|{_BLANK})[0-9]{{3}})+(?![0-9])|[0-9]+)(?:,[0-9]+)?(?:[eE][+-]?[0-9]{{1,2}}(?![0-9]))?"
#: A count that selects what is measured, such as places with more than so many inhabitants.
_SELECTION = re.compile(r"(?:com|de|a partir de|acima de|abaixo de)?\s*(?:mais|menos|acima|abaixo|a partir|entre)?\s*(?:de )?[0-9][0-9.,]*(?: mil| milh\w+| a [0-9]\S*)* (?:habitantes|moradores|pessoas|empregados)")
_SCALE_BY_NAME = {n: s for s, names in SCALES.items() for n in names}
_SCALE_FIRST = re.compile("^(" + "|".join(re.escape(n) for n in sorted(_SCALE_BY_NAME, key=len, reverse=True)) + r")(?=\s|$)\s*(?:de )?")
_SCALE_LAST = re.compile(r"(?:^|(?<=\s))(" + "|".join(re.escape(n) for n in sorted(_SCALE_BY_NAME, key=len, reverse=True)) + r")$")


def folded(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip().lower()


def _bare(text: str) -> str:
    """Without the words and brackets around a unit."""
    text = text.strip(" .,;:")
    while len(text) > 2 and text[0] == "(" and text[-1] == ")":
        text = text[1:-1].strip()
    if text.count("(") < text.count(")") and text.endswith(")"):
        text = text[:-1].strip()
    if text.count("(") > text.count(")") and text.startswith("("):
        text = text[1:].strip()
    return re.sub(r"^(?:em|unidade:?|unidades?:?)\s+", "", text)


def spellings(phrase: str, longest: int = 7) -> list[tuple[int, str, int]]:
    """(rank, spelling, scale) to look up for a phrase, the best first: its ends, the longest first, with and without a scale."""
    flat = _SELECTION.sub(" | ", folded(phrase))
    words = flat.split()
    out: list[tuple[int, str, int]] = []
    seen = set()
    for k in range(min(longest, len(words)), 0, -1):
        tail = " ".join(words[-k:])
        if "|" in tail:
            continue
        whole = _bare(tail)
        forms = [(whole, 1)]
        if m := _SCALE_FIRST.match(whole):
            forms.append((_bare(whole[m.end() :]), _SCALE_BY_NAME[m[1]]))
        if m := _SCALE_LAST.search(whole):
            forms.append((_bare(whole[: m.start()]), _SCALE_BY_NAME[m[1]]))
        for spelling, scale in forms:
            if spelling and (spelling, scale) not in seen:
                seen.add((spelling, scale))
                out.append((len(out), spelling, scale))
    return out


def weighted_distance(a: str, b: str, most: float) -> float:
    """Edit distance where plural endings, blanks and hyphens are cheap and digits dear; more than `most` ends early."""

    def cost(c: str, s: str, i: int) -> float:
        if c in " -_.,()":
            return 0.2
        if c in "es" and (i + 1 == len(s) or s[i + 1] in " -_.,()s"):
            return 0.3
        return 2.0 if c.isdigit() else 1.0

    last = [0.0]
    for j, c in enumerate(b):
        last.append(last[-1] + cost(c, b, j))
    for i, c in enumerate(a):
        row = [last[0] + cost(c, a, i)]
        for j, d in enumerate(b):
            swap = 0.0 if c == d else 0.2 if c in " -_.,()" and d in " -_.,()" else 2.0 if c.isdigit() or d.isdigit() else 1.0
            row.append(min(last[j] + swap, last[j + 1] + cost(c, a, i), row[j] + cost(d, b, j)))
        if min(row) > most:
            return most + 1
        last = row
    return last[-1]


def _bigrams(c: Column) -> Column:
    padded = F.concat(F.lit("#"), c, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: padded.substr(i, F.lit(2))))


def unit_aliases(registry: DataFrame) -> DataFrame:
    """(alias, unit_id): folded labels, identifiers and symbols of the units in the registry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(folded(a), u) for u, label in zip(f.unit_id, f.label, strict=True) for a in (u.replace("_", " "), label or u, *SYMBOLS.get(u, ()))}
            yield pd.DataFrame(sorted(rows), columns=["alias", "unit_id"])

    return registry.select("unit_id", "label").where("unit_id is not null").mapInPandas(run, "alias string, unit_id string").distinct()


def alias_dictionary(phrases: DataFrame, registry: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """(phrase, unit_id, scale) for each distinct phrase that names a unit of the registry; the others are left out.

    A spelling is accepted within `tolerance` of its length in weighted edits, if no other unit is as near.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *x) for p in f.phrase for x in spellings(p)], columns=["phrase", "rank", "spelling", "scale"])

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            most = [max(0.31, tolerance * max(len(a), len(b))) if len(b) > 3 else 0.01 for a, b in zip(f.spelling, f.alias, strict=True)]
            f["cost"] = [weighted_distance(a, b, m) for a, b, m in zip(f.spelling, f.alias, most, strict=True)]
            yield f[f.cost <= most][["spelling", "unit_id", "cost"]]

    cuts = phrases.select("phrase").where("phrase is not null").distinct().mapInPandas(cut, "phrase string, rank int, spelling string, scale long")
    aliases = unit_aliases(registry).withColumn("grams", _bigrams(F.col("alias")))
    known = aliases.select("alias", "unit_id", F.size("grams").alias("alias_grams"), F.explode("grams").alias("gram"))
    asked = cuts.select("spelling").distinct().withColumn("grams", _bigrams(F.col("spelling")))
    asked = asked.select("spelling", F.size("grams").alias("own_grams"), F.explode("grams").alias("gram"))
    met = asked.join(known, "gram").groupBy("spelling", "alias", "unit_id", "own_grams", "alias_grams").agg(F.count("*").alias("common"))
    met = met.where(F.col("common") * 2 >= F.greatest("own_grams", "alias_grams"))
    close = met.mapInPandas(near, "spelling string, unit_id string, cost double").groupBy("spelling", "unit_id").agg(F.min("cost").alias("cost"))
    best = close.groupBy("spelling").agg(F.min_by("unit_id", "cost").alias("unit_id"), F.sort_array(F.collect_list("cost")).alias("costs"))
    best = best.where((F.size("costs") == 1) | (F.try_element_at("costs", F.lit(2)) > F.col("costs")[0])).select("spelling", "unit_id")
    return cuts.join(best, "spelling").groupBy("phrase").agg(F.min_by(F.struct("unit_id", "scale"), "rank").alias("x")).select("phrase", "x.unit_id", "x.scale")


def number_of(text: Column) -> Column:
    """The first number of a text in Brazilian notation, as a decimal; null without one."""
    n = F.regexp_extract(text, NUMBER, 0)
    plain = F.replace(F.replace(F.regexp_replace(n, rf"\.|{_BLANK}", ""), F.lit(","), F.lit(".")), F.lit("−"), F.lit("-"))
    mantissa, exponent = F.regexp_extract(plain, r"^(-?[0-9]+(?:\.[0-9]+)?)", 1), F.regexp_extract(plain, r"[eE]([+-]?[0-9]+)$", 1)
    power = F.coalesce(F.replace(exponent, F.lit("+"), F.lit("")).try_cast("int"), F.lit(0))
    tens = lambda p: F.rpad(F.lit("1"), p + 1, "0").try_cast("decimal(20,0)")
    value = mantissa.try_cast("decimal(28,8)")
    up = (value * F.when(power >= 0, tens(F.least(power, F.lit(18)))).otherwise(1)).cast("decimal(38,10)")
    return F.when(power >= 0, up).otherwise((value / tens(F.least(-power, F.lit(18)))).cast("decimal(38,10)"))


def common_values(rows: DataFrame, registry: DataFrame, id_col: str, cell: Column, description: Column, facets: Column) -> DataFrame:
    """(id, value, unit_id, scale, common_unit, common_value) of each row with a value and a unit.

    Unit and scale come from the first of cell, description and facets that states a unit.  Rows without a number or a unit
    are left out; common_unit and common_value are null for units that are not convertible.
    """
    cell = F.trim(cell)
    facet = F.from_json(facets, "unit array<string>, scale array<string>")
    scale = F.element_at(F.create_map(*(F.lit(x) for kv in FACET_SCALES.items() for x in kv)), F.coalesce(F.try_element_at(facet["scale"], F.lit(1)), F.lit("")))
    rows = rows.select(
        F.col(id_col).alias("id"),
        number_of(cell).alias("value"),
        F.trim(F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(cell, "^(.*?)" + NUMBER, "$1 ")), r"\s+", " ")).alias("cell_phrase"),
        F.coalesce(F.regexp_replace(description, r"^Tabela de \S+ com ", ""), F.lit("")).alias("table_phrase"),
        F.try_element_at(facet["unit"], F.lit(1)).alias("facet_unit"),
        F.coalesce(scale, F.lit(1)).cast("long").alias("facet_scale"),
    ).where("value is not null")
    phrases = rows.select(F.explode(F.array("cell_phrase", "table_phrase")).alias("phrase")).where("phrase <> ''").distinct()
    known = alias_dictionary(phrases, registry)
    side = lambda x: known.select(F.col("phrase").alias(f"{x}_phrase"), F.struct("unit_id", "scale").alias(f"{x}_unit"))
    rows = rows.join(side("cell"), "cell_phrase", "left").join(side("table"), "table_phrase", "left")
    facet_unit = F.when(F.col("facet_unit").isNotNull(), F.struct(F.col("facet_unit").alias("unit_id"), F.col("facet_scale").alias("scale")))
    stated = rows.select("id", "value", F.coalesce("cell_unit", "table_unit", facet_unit).alias("u")).where("u is not null").select("id", "value", "u.unit_id", "u.scale")
    out = stated.join(registry.select("unit_id", "common_unit", "factor"), "unit_id", "left")
    return out.select(F.col("id").alias(id_col), "value", "unit_id", "scale", F.when(F.col("factor").isNotNull(), F.col("common_unit")).alias("common_unit"), F.round((F.col("value") * (F.col("scale") * F.col("factor")).cast("decimal(18,0)")).cast("decimal(38,4)")).try_cast("long").alias("common_value"))
