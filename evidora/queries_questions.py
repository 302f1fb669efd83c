"""Queries on questions: their scope, routes, rewrites, and the registry they are matched with."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions import facets as fc
from evidora.functions import periods as pe
from evidora.functions import questions as qu
from evidora.functions import text as tx
from evidora.operators import registry as rg
from evidora.queries_corpus import _ONCE, _facet, nodes_once
from evidora.scratch import table

_RELATIONS = ("CAUSA", "ASSOCIADO_A", "CRESCEU_EM", "RECUOU_EM")


def _questions(spark, d):
    q = table(spark, d, "test_items").where("pergunta is not null").select("item_id", "pergunta", "resposta_esperada")
    return fc.with_facets(q, "pergunta", "dims")


def question_scope(spark, d):
    c = qu.constraints(F.col("pergunta"), F.col("dims"))
    return _questions(spark, d).select("item_id", c.alias("c")).select("item_id", F.array_join("c.region", ",").alias("region"), "c.ambiguous")


def question_hierarchy(spark, d):
    """Of documents, whose texts name more territories than the questions do."""
    docs = fc.with_facets(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", "dims")
    h = docs.select("doc_id", qu.hierarchy_scope(F.col("text"), F.col("dims")).alias("h"))
    return h.select("doc_id", F.array_join("h.region", ",").alias("region"), "h.region_asked", F.array_join("h.sector", ",").alias("sector"), "h.sector_asked")


def question_expansion(spark, d):
    return _questions(spark, d).select("item_id", qu.expanded(F.col("pergunta"), F.col("dims")).alias("question"))


def question_routes(spark, d):
    return _questions(spark, d).select("item_id", qu.routes(F.col("pergunta")).alias("r")).select("item_id", "r.*")


def clarifications(spark, d):
    return _questions(spark, d).select("item_id", F.coalesce(qu.clarification(F.col("pergunta"), F.col("dims")), F.lit("none")).alias("ask"))


def preserved_rewrites(spark, d):
    """Whether the expected answer would keep the scope of its question."""
    both = fc.with_facets(_questions(spark, d).where("resposta_esperada is not null"), "resposta_esperada", "after")
    return both.select("item_id", qu.preserved(F.col("dims"), F.col("after")).alias("kept"))


def relation_claims(spark, d):
    n = nodes_once(spark, d).where("type = 'text' and text is not null").select("node_id", "text", F.explode(F.array(*(F.lit(r) for r in _RELATIONS))).alias("relation"))
    out = n.select("node_id", "relation", rg.relation_attributes(F.col("relation"), F.col("text")).alias("r"))
    return out.select("node_id", "relation", "r.polarity", "r.kind", "r.modality", F.coalesce("r.refused", F.lit("")).alias("refused"))


def canonical_names(spark, d):
    names = table(spark, d, "documents").where("title is not null").select(F.col("title").alias("name"), F.lit("Setor").alias("type"))
    sectors = [(i, "Setor", p) for x, i, p in fc.VOCABULARY if x == "sector"]
    registry = table(spark, d, "region").limit(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("id"), F.lit(b).alias("type"), F.lit(c).alias("pattern")) for a, b, c in sectors))))
    return rg.canonical_entities(names, registry).groupBy("entity").agg(F.count("*").alias("n"))


def extension_problems(spark, d):
    r = table(spark, d, "unit_registry")
    proposed = r.select(F.col("unit_id").alias("id"), "label", F.lower("label").alias("pattern"), F.col("common_unit").alias("parent"))
    return rg.extension_problems(proposed, r.where("factor is null").select(F.col("unit_id").alias("id"))).select("id", F.coalesce("problem", F.lit("fine")).alias("problem"))


QUERIES = {f.__name__: f for f in (question_scope, question_hierarchy, question_expansion, question_routes, clarifications, preserved_rewrites, relation_claims, canonical_names, extension_problems)}


def let(name: str, value: str, body: str) -> str:
    """An expression in which `name` stands for `value`."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def periods_sql(text: str) -> str:
    """Sorted distinct periods of a folded text, tier by tier."""
    every = lambda t, p: f"regexp_extract_all({t}, '{p}')"
    blank = lambda t, p: f"regexp_replace({t}, '{p}', ' # ', 'g')"
    group = lambda p, k: f"regexp_extract(x, '{p}', {k})"
    months = ", ".join(f"'{m[:3]}'" for m in pe.MONTHS)
    body = f"""list_sort(list_distinct(list_filter(list_concat(
        list_transform({every('t0', pe.DAY_ISO)}, lambda x: strftime(try_strptime(x, '%Y-%m-%d'), '%Y-%m-%d')),
        list_transform({every('t1', pe.DAY)}, lambda x: strftime(try_strptime(replace(x, '-', '/'), '%d/%m/%Y'), '%Y-%m-%d')),
        {every('t2', pe.MONTH_ISO)},
        list_transform({every('t3', pe.MONTH)}, lambda x: {group(pe.MONTH, 2)} || '-' || lpad({group(pe.MONTH, 1)}, 2, '0')),
        list_transform({every('t4', pe.QUARTER)}, lambda x: {group(pe.QUARTER, 2)} || '-Q' || x[1]),
        list_transform({every('t5', pe.NAMED)}, lambda x: {group(pe.NAMED, 2)} || '-' || lpad(CAST(list_position([{months}], x[:3]) AS VARCHAR), 2, '0')),
        {every('t6', pe.YEAR)}), lambda x: x IS NOT NULL)))"""
    for k, p in reversed(list(enumerate((pe.DAY_ISO, pe.DAY, pe.MONTH_ISO, pe.MONTH, pe.QUARTER, pe.NAMED), 1))):
        body = let(f"t{k}", blank(f"t{k - 1}", p), body)
    return let("t0", text, body)


def facet_sql(dimension: str, text: str) -> str:
    """The sorted ids of a dimension that a text names."""
    reference = f"array_to_string(list_filter(string_split(strip_accents(lower({text})), chr(10)), lambda x: NOT regexp_matches(x, '^fonte:|{fc.PUBLICATION}')), chr(10))"
    if dimension == "period":
        return let("raw", reference, periods_sql("raw"))
    listed = _facet(dimension).rpartition(" AS ")[0]
    split = f"list_filter(string_split({listed}, ','), lambda x: x <> '')"
    return f"coalesce({let('raw', reference, split)}, [])"


_Q = "SELECT item_id, pergunta, resposta_esperada, strip_accents(lower(pergunta)) AS t FROM test_items WHERE pergunta IS NOT NULL"
_BLANKED = "t"
for _d, _, _p in fc.VOCABULARY:
    if _d == "region":
        _BLANKED = f"regexp_replace({_BLANKED}, '{_p}', ' # ', 'g')"
_STATE = f"(regexp_matches(t, '{qu.STATE_SERIES}') AND len(region) = 0)"
_SCOPED = f"SELECT *, {facet_sql('region', 'pergunta')} AS region, {facet_sql('indicator', 'pergunta')} AS indicator FROM ({_Q})"
_has = lambda p, t="t": f"regexp_matches({t}, '{p}')"
_VALUE = f"({_has(qu.PIB)} AND {_has(qu.PIB_POINT)} AND NOT {_has(qu.PIB_CONCEPT)})"
_LABELS = ", ".join(
    [f"CASE WHEN list_contains(indicator, '{i}') AND NOT contains(t, strip_accents(lower('{x}'))) THEN '{x}' END" for i, x in qu.INDICATOR_LABELS.items()]
    + [f"CASE WHEN list_contains(region, '{i}') AND NOT contains(t, strip_accents(lower('{x}'))) THEN '{x}' END" for i, x, _, _ in qu.TERRITORIES]
)
_KEPT = " AND ".join(f"{facet_sql(x, 'pergunta')} = {facet_sql(x, 'resposta_esperada')}" for x in fc.DIMENSIONS if x != "source")
_BELOW = {"brasil": ["estado_sp", "municipio_sp", "rmsp", "interior_sp"], "estado_sp": ["municipio_sp", "rmsp", "interior_sp"]}


def _below_sql(only: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v if x in only)}]::VARCHAR[]" for k, v in _BELOW.items())
    return f"list_sort(list_distinct(flatten(list_transform(region, lambda r: CASE r {cases} ELSE []::VARCHAR[] END))))"


_H = f"""WITH f AS (SELECT doc_id, strip_accents(lower(text)) AS t, {facet_sql('region', 'text')} AS region, {facet_sql('sector', 'text')} AS sector FROM documents WHERE text IS NOT NULL),
    g AS (SELECT *, len(region) > 0 AND {_has(qu.MANY_PLACES)} AS ra, len(sector) > 0 AND {_has(qu.MANY_SECTORS)} AS sa FROM f)
    SELECT doc_id, CASE WHEN NOT ra THEN '' ELSE array_to_string(CASE WHEN {_has(qu.MANY_TOWNS)} THEN {_below_sql(('municipio_sp',))} WHEN {_has(qu.MANY_REGIONS)} THEN {_below_sql(('rmsp', 'interior_sp'))}
        ELSE {_below_sql(('estado_sp', 'municipio_sp', 'rmsp', 'interior_sp'))} END, ',') END AS region, ra AS region_asked,
        CASE WHEN sa AND list_contains(sector, 'industria') THEN 'industria_extrativa,industria_transformacao' ELSE '' END AS sector, sa AS sector_asked FROM g"""

SQL = {
    "question_scope": f"SELECT item_id, CASE WHEN {_STATE} THEN 'estado_sp' ELSE array_to_string(region, ',') END AS region, {_has(qu.BARE_NAME, _BLANKED)} AND NOT {_STATE} AS ambiguous FROM ({_SCOPED})",
    "question_hierarchy": _H,
    "question_expansion": f"SELECT item_id, CASE WHEN len(x) > 0 THEN pergunta || chr(10) || 'Termos equivalentes para busca: ' || array_to_string(x[:4], '; ') ELSE pergunta END AS question FROM (SELECT *, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS x FROM ({_SCOPED}))",
    "question_routes": f"""SELECT item_id, {_VALUE} AS value, {_has(qu.STRUCTURED)} AS structured, {_has(qu.DEFINITIONAL)} AS definitional, {_has(qu.RATE)} AND {_has(qu.YEAR)} AND NOT {_has(qu.SEQUENCE)} AS point,
        {_has(qu.CORPUS)} AND {_has(qu.OVERVIEW)} AS overview, {' OR '.join(_has(p) for p in qu.SOURCES)} AS sources FROM ({_Q})""",
    "clarifications": f"""SELECT item_id, CASE WHEN {_has(qu.ASKS_RATE)} AND {_has(qu.GROWTH)} AND {_has(qu.SERVICES)} AND NOT {_has(qu.NEAR_PERIOD)} AND NOT {_has(qu.CONCEPT)} THEN 'services_scope'
        WHEN {_has(qu.BARE_NAME, _BLANKED)} AND NOT {_STATE} AND len(indicator) > 0 THEN 'region' WHEN {_VALUE} AND NOT {_has(qu.RECENT)} THEN 'period' ELSE 'none' END AS ask FROM ({_SCOPED})""",
    "preserved_rewrites": f"SELECT item_id, {_KEPT} AS kept FROM ({_Q}) WHERE resposta_esperada IS NOT NULL",
    "relation_claims": f"""WITH {_ONCE}, t AS (SELECT node_id, strip_accents(lower(text)) AS t, unnest([{', '.join(repr(r) for r in _RELATIONS)}]) AS relation FROM once WHERE type = 'text' AND text IS NOT NULL)
        SELECT node_id, relation, CASE WHEN {_has(rg.NEGATION, f"regexp_replace(t, '{rg.NOT_NEGATION}', '', 'g')")} THEN 'negated' ELSE 'affirmed' END AS polarity,
        CASE relation WHEN 'CAUSA' THEN 'causal_claim' WHEN 'ASSOCIADO_A' THEN 'association' ELSE 'typed_relation' END AS kind,
        CASE WHEN regexp_matches(t, '(^|[^-\\w])se\\b|\\bcaso\\b') THEN 'conditional' WHEN {_has(rg.UNCERTAIN)} THEN 'uncertain' ELSE 'asserted' END AS modality,
        CASE WHEN relation = 'CAUSA' AND (NOT {_has(rg.CAUSE)} OR {_has(rg.ASSOCIATION)}) THEN 'no_cause' WHEN relation = 'ASSOCIADO_A' AND NOT {_has(rg.ASSOCIATION)} THEN 'no_association'
             WHEN relation = 'CRESCEU_EM' AND NOT {_has(rg.GREW)} THEN 'no_growth' WHEN relation = 'RECUOU_EM' AND NOT {_has(rg.FELL)} THEN 'no_fall' ELSE '' END AS refused FROM t""",
    "canonical_names": f"""WITH t AS (SELECT title, strip_accents(lower(title)) AS t FROM documents WHERE title IS NOT NULL),
        m AS (SELECT title, list_filter([{', '.join(f"CASE WHEN {_has(p)} THEN '{i}' END" for x, i, p in fc.VOCABULARY if x == 'sector')}], lambda x: x IS NOT NULL) AS m FROM t)
        SELECT CASE WHEN len(m) = 1 THEN m[1] ELSE title END AS entity, count(*) AS n FROM m GROUP BY 1""",
    "extension_problems": """SELECT unit_id AS id, CASE WHEN NOT regexp_full_match(unit_id, '[a-z][a-z0-9_]{1,59}') OR factor IS NULL OR count(*) OVER (PARTITION BY unit_id) > 1 THEN 'id' WHEN trim(coalesce(label, '')) = '' THEN 'label'
        WHEN strip_accents(lower(label)) <> lower(label) THEN 'pattern' WHEN common_unit IS NOT NULL AND common_unit NOT IN (SELECT unit_id FROM unit_registry) THEN 'parent' ELSE 'fine' END AS problem FROM unit_registry""",
}
