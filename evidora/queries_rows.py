"""Queries of the general data-cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators import bad_rows, units
from evidora.scratch import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.row_errors(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "layouts")).select("raw_id", "reason")


def p5_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, layouts = table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "layouts")
    return bad_rows.typed_rows(raw, layouts, 1).withColumn("valor", F.col("valor").cast("double"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, layouts = table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "layouts")
    return bad_rows.typed_values(raw, layouts).withColumn("number", F.col("number").cast("double"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nodes").where("chunk_strategy = 'row_per_chunk'")
    registry = table(spark, sf_dir, "unit_registry")
    out = units.common_values(rows, registry, "node_id", F.try_element_at("metadata.cells", F.lit(-1)), F.col("metadata.table_descricao"), F.col("metadata.ontology_facets"))
    changed = (F.col("scale") != 1) | (F.col("unit_id") != F.col("common_unit"))
    return out.where(F.col("common_value").isNotNull() & changed).select("node_id", "common_unit", "common_value").distinct()


_FIELDS = " UNION ALL ".join(
    f"""SELECT raw_id, layout_id, regexp_full_match(cells, '({f})({x}({f}))*', 's') AS ok, regexp_extract_all({q} || cells, '{x}({f})', 1) AS fields
        FROM r WHERE delimiter = {q}"""
    for q, x in (("';'", ";"), ("','", ","), ("chr(9)", "\\t"), ("'|'", "\\|"))
    for f in (f'"(?:[^"]|"")*"|[^"{x}]*',)
)
_PARSED = f"""
    WITH w AS (SELECT layout_id, min(delimiter) AS delimiter, count(*) AS n FROM layouts GROUP BY 1),
    r AS (SELECT raw_id, raw_rows.layout_id, metadata.cells AS cells, delimiter FROM raw_rows JOIN w ON w.layout_id = raw_rows.layout_id),
    p AS ({_FIELDS}),
    c AS (SELECT p.raw_id, p.layout_id, i AS pos, trim(CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS v
          FROM (SELECT *, unnest(fields) AS f, generate_subscripts(fields, 1) AS i FROM p JOIN w USING (layout_id) WHERE ok AND len(fields) = n) p),
    bad AS (SELECT DISTINCT raw_id FROM c JOIN layouts l ON l.layout_id = c.layout_id AND l.pos = c.pos
            WHERE CASE WHEN v = '' THEN required
                  WHEN kind IN ('decimal_virgula', 'decimal_ponto') AND v IN ('...', '-', 'NA', 'x') THEN false
                  WHEN kind = 'codigo' THEN NOT regexp_full_match(v, '[0-9]{{7}}')
                  WHEN kind = 'ano' THEN NOT regexp_full_match(v, '199[0-9]|20[0-2][0-9]')
                  WHEN kind = 'trimestre' THEN NOT regexp_full_match(v, '[1-4]º?')
                  WHEN kind = 'inteiro' THEN NOT regexp_full_match(v, '-?[0-9]+')
                  WHEN kind = 'decimal_virgula' THEN NOT regexp_full_match(v, '-?([0-9]+|[0-9]{{1,3}}(\\.[0-9]{{3}})+)(,[0-9]+)?')
                  WHEN kind = 'decimal_ponto' THEN NOT regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?')
                  WHEN kind = 'data' THEN CASE WHEN regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime(v, '%d/%m/%Y') IS NULL
                       WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(v, '%Y-%m-%d') IS NULL ELSE true END
                  ELSE false END)"""

#: (unit, names as a pattern) on text whose brackets and commas are blanks; the order matters where names contain others.
_UNITS = (
    ("saca_60kg", "sacas de 60 kg|sacas 60 kg"), ("por_mil", "‰|por mil"), ("percentual", "%|por cento|percentual"), ("fracao", "fração da unidade"), ("ponto_base", "pontos-base"), ("dolar", "us\\$|dólares"), ("real", "r\\$|reais"),
    ("quilograma", "kg|quilogramas"), ("tonelada", "t|toneladas"), ("arroba", "@|arrobas"), ("quilometro_quadrado", "km²|km2|quilômetros quadrados"), ("metro_quadrado", "m²|m2|metros quadrados"), ("hectare", "ha|hectares"),
    ("alqueire_paulista", "alqueires paulistas"), ("quilowatt_hora", "kwh"), ("megawatt_hora", "mwh"), ("gigawatt_hora", "gwh|gigawatts-hora"), ("hectolitro", "hl|hectolitros"), ("litro", "l|litros"), ("metro_cubico", "m³|m3|metros cúbicos"), ("pessoa", "pessoas"),
)


def _unit_sql(text: str, name: str) -> str:
    """Unit and scale of a phrase in SQL, name by name: an independent reading of what the alias dictionary finds."""
    flat = f"(' ' || regexp_replace(regexp_replace(lower({text}), 'com mais de [0-9]+ mil habitantes', '', 'g'), 'unidade:|[\\s(),;:]+', ' ', 'g') || ' ')"
    unit = "CASE " + " ".join(f"WHEN regexp_matches({flat}, ' ({p}) ') THEN '{u}'" for u, p in _UNITS) + " END"
    scale = f"""CASE WHEN regexp_matches({flat}, ' (por mil|‰) ') THEN 1 WHEN regexp_matches({flat}, ' (mil|milhares|1.000) ') THEN 1000 WHEN regexp_matches({flat}, ' (milhões|mi|1.000.000) ') THEN 1000000
        WHEN regexp_matches({flat}, ' (bilhões|bi) ') THEN 1000000000 ELSE 1 END"""
    return f"{unit} AS {name}_unit, {scale} AS {name}_scale"


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_typed, p5_values)}
SQL = {
    "p5_found": f"""{_PARSED}
    SELECT raw_rows.raw_id, CASE WHEN NOT coalesce(ok, true) THEN 'quoting' WHEN fields IS NULL OR len(fields) <> n THEN 'column_count' ELSE 'invalid_value' END AS reason
    FROM raw_rows LEFT JOIN p ON p.raw_id = raw_rows.raw_id LEFT JOIN w ON w.layout_id = raw_rows.layout_id LEFT JOIN bad ON bad.raw_id = raw_rows.raw_id
    WHERE NOT coalesce(ok, true) OR fields IS NULL OR len(fields) <> n OR bad.raw_id IS NOT NULL""",
    "p5_typed": f"""{_PARSED},
    g AS (SELECT raw_id, max(CASE WHEN pos = 1 THEN v END) AS a, max(CASE WHEN pos = 2 THEN v END) AS b, max(CASE WHEN pos = 3 THEN v END) AS c3,
                 max(CASE WHEN pos = 4 THEN v END) AS d, max(CASE WHEN pos = 5 THEN v END) AS e, max(CASE WHEN pos = 6 THEN v END) AS f
          FROM c WHERE layout_id = 1 AND raw_id NOT IN (SELECT raw_id FROM bad) GROUP BY 1)
    SELECT raw_id, nullif(a, '') AS municipio, nullif(b, '') AS cod_municipio, CAST(c3 AS INTEGER) AS ano, CAST(replace(d, 'º', '') AS INTEGER) AS trimestre,
           CAST(TRY_CAST(replace(replace(e, '.', ''), ',', '.') AS DECIMAL(38,6)) AS DOUBLE) AS valor,
           CAST(coalesce(try_strptime(f, '%d/%m/%Y'), try_strptime(f, '%Y-%m-%d')) AS DATE) AS publicado_em
    FROM g""",
    "p5_values": f"""{_PARSED}
    SELECT c.raw_id, c.layout_id, column_name, CASE WHEN kind IN ('texto', 'codigo') THEN nullif(v, '') END AS text,
           CASE WHEN kind IN ('ano', 'trimestre', 'inteiro') THEN TRY_CAST(replace(v, 'º', '') AS BIGINT) END AS whole,
           CAST(CASE kind WHEN 'decimal_virgula' THEN TRY_CAST(replace(replace(v, '.', ''), ',', '.') AS DECIMAL(38,6)) WHEN 'decimal_ponto' THEN TRY_CAST(v AS DECIMAL(38,6)) END AS DOUBLE) AS number,
           CASE WHEN kind = 'data' THEN CAST(coalesce(try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%Y-%m-%d')) AS DATE) END AS day
    FROM c JOIN layouts l ON l.layout_id = c.layout_id AND l.pos = c.pos WHERE c.raw_id NOT IN (SELECT raw_id FROM bad)""",
    "p3_found": f"""
    WITH n AS (SELECT DISTINCT node_id, trim(list_last(metadata.cells)) AS cell, regexp_replace(coalesce(metadata.table_descricao, ''), '^Tabela de \\S+ com ', '') AS d,
                      from_json(metadata.ontology_facets, '{{"unit":["VARCHAR"],"scale":["VARCHAR"]}}') AS f FROM nodes WHERE chunk_strategy = 'row_per_chunk'),
    v AS (SELECT *, regexp_extract(cell, '-?[0-9][0-9. \\x{{a0}}]*(?:,[0-9]+)?(?:E[+-]?[0-9]+)?') AS x FROM n),
    u AS (SELECT node_id, TRY_CAST(replace(replace(replace(replace(x, '.', ''), ' ', ''), chr(160), ''), ',', '.') AS DOUBLE) AS value, {_unit_sql("replace(cell, x, ' ')", "c")}, {_unit_sql("d", "t")},
                 f.unit[1] AS f_unit, CASE f.scale[1] WHEN 'mil' THEN 1000 WHEN 'milhao' THEN 1000000 WHEN 'bilhao' THEN 1000000000 ELSE 1 END AS f_scale FROM v WHERE x <> ''),
    s AS (SELECT node_id, value, coalesce(c_unit, t_unit, f_unit) AS unit, CASE WHEN c_unit IS NOT NULL THEN c_scale WHEN t_unit IS NOT NULL THEN t_scale ELSE f_scale END AS scale FROM u)
    SELECT DISTINCT node_id, common_unit, CAST(round(value * scale * factor) AS BIGINT) AS common_value FROM s JOIN unit_registry r ON r.unit_id = s.unit
    WHERE factor IS NOT NULL AND (scale <> 1 OR s.unit <> common_unit)""",
}
