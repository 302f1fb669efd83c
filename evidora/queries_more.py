"""Queries of observations, the registry, routing and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions import facets as fc
from evidora.functions import numbers as nm
from evidora.functions import text as tx
from evidora.operators import graph as gr
from evidora.operators import observations as ob
from evidora.operators import registry as rg
from evidora.queries_corpus import _CELL, _DIMS, _LABEL_STOP, _ONCE, _facet, _literal, nodes_once
from evidora.queries_search import _mentioned
from evidora.scratch import table

SKILLS = (("mercado de trabalho", "emprego formal", 2), ("mercado de trabalho", "desocupacao", 2), ("mercado de trabalho", "postos", 2), ("contas", "produto interno bruto", 1), ("contas", "valor adicionado", 1), ("comercio", "exportacao", 1), ("comercio", "importacao", 1), ("precos", "cesta basica", 3), ("precos", "inflacao", 3))
ENGLISH = ("the", "and", "while", "growth", "fell", "rose", "held", "costs", "abroad", "demand")


def table_observations(spark, d):
    n = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'")
    out = ob.table_observations(n, F.col("metadata.ontology_facets"), "table_title", nm.literal_decimal(F.try_element_at("metadata.cells", F.lit(-1))))
    return out.select("node_id", F.col("value").cast("double").alias("value"), F.array_join("dims.indicator", ",").alias("indicator"), F.array_join("dims.unit", ",").alias("unit"), F.array_join("issues", ",").alias("issues"), "status")


def narrative_observations(spark, d):
    n = nodes_once(spark, d).where("type = 'text'")
    return ob.narrative_observations(n, "node_id", "text").groupBy(F.array_join("dims.indicator", ",").alias("indicator"), F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"))


def comparison_issues(spark, d):
    n = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk' and table_key is not null").select("table_key", fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    return ob.comparison_issues(n, "table_key").select("table_key", F.array_join("issues", ",").alias("issues"))


def missing_values(spark, d):
    obs = nodes_once(spark, d).where("type = 'table'").select(fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    q = fc.with_facets(table(spark, d, "documents").select("doc_id", "title"), "title").select("doc_id", F.explode("dims.indicator").alias("indicator"), F.regexp_extract_all("title", F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0)).alias("p"))
    return ob.missing_values(q.select("doc_id", "indicator", F.explode("p").alias("period")), obs, "doc_id")


def relation_rules(spark, d):
    kinds = sorted({t for pair in rg.RELATIONS.values() for side in pair for t in side} | set(rg.TYPE_PARENTS) | set(rg.FAMILIES))
    a = table(spark, d, "region").limit(1).select(F.explode(F.array(*(F.lit(k) for k in kinds))).alias("subject_type"))
    a = a.withColumn("object_type", F.explode(F.array(*(F.lit(k) for k in kinds)))).withColumn("relation", F.explode(F.array(*(F.lit(r) for r in [*rg.RELATIONS, "PARTE_DE"]))))
    return rg.valid_relations(a).where("valid").select("subject_type", "relation", "object_type")


def round_robin_sample(spark, d):
    n = nodes_once(spark, d).where("source_file is not null and type is not null")
    return rg.round_robin(n, ["source_file", "type"], ["chunk_id", "node_id"], 12).select("node_id", "turn")


def skill_scores(spark, d):
    skills = table(spark, d, "region").limit(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("skill"), F.lit(b).alias("keyword"), F.lit(p).alias("priority")) for a, b, p in SKILLS))))
    return rg.keyword_scores(table(spark, d, "documents"), skills, "doc_id", "title")


def output_quality(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", "[^�]", "")).alias("lost"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    english = F.size(F.filter("w", lambda x: x.isin(*ENGLISH)))
    return doc.select("doc_id", "lost", english.alias("english"), ((english >= 3) & (english * 100 >= 8 * F.size("w"))).alias("mixed"))


def vector_validity(spark, d):
    v = table(spark, d, "chunk_vectors")
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    why = F.when(F.col("vector").isNull(), "null").when(F.size("vector") != 64, "length").when(bad, "not_finite").when(norm == 0, "zero").when(F.abs(F.sqrt(norm) - 1) > 1e-4, "not_normalised").otherwise("fine")
    return v.select("vec_id", why.alias("state"))


def text_segments(spark, d):
    doc = table(spark, d, "documents").where("length(text) > 0")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int")))
    return doc.select("doc_id", at.alias("segment"), "text").select("doc_id", "segment", F.md5(F.substring(F.col("text"), F.col("segment") * 2000 + 1, F.lit(2000))).alias("part"))


def scope_terms(spark, d):
    n = nodes_once(spark, d).where("text is not null and source_file is not null")
    w = Window.partitionBy("source_file")
    t = n.select("source_file", "node_id", F.explode(tx.rare_terms(F.col("text"))).alias("term")).groupBy("source_file", "term").agg(F.count("*").alias("df"))
    size = n.groupBy("source_file").agg(F.count("*").alias("nodes"))
    j = t.join(size, "source_file").withColumn("weight", F.log(F.col("nodes") / F.col("df")))
    return j.withColumn("top", F.max("weight").over(w)).groupBy("source_file").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 3).alias("weight"), F.round(F.max("top"), 5).alias("top"))


def parent_groups(spark, d):
    n = table(spark, d, "nodes").where("parent_id is not null").select("parent_id", "node_id").distinct()
    return n.groupBy("parent_id").agg(F.count("*").alias("children"), F.min("node_id").alias("first"))


def chunk_neighbours(spark, d):
    w = Window.partitionBy("source_file", "page", "type").orderBy("chunk_id", "node_id")
    n = nodes_once(spark, d).where("type = 'text'")
    return n.select("node_id", F.coalesce(F.lag("node_id").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("node_id").over(w), F.lit("")).alias("after"))


def marker_scores(spark, d):
    i = table(spark, d, "test_items").where("size(pontos_obrigatorios) > 0 and resposta_esperada is not null")
    hit = F.size(F.filter("pontos_obrigatorios", lambda p: F.contains(tx.fold(F.col("resposta_esperada")), tx.fold(p))))
    return i.select("item_id", hit.alias("met"), F.size("pontos_obrigatorios").alias("asked"), F.round(hit / F.size("pontos_obrigatorios"), 6).alias("score"))


def blind_labels(spark, d):
    i = table(spark, d, "test_items")
    return i.select("item_id", F.when(F.substring(F.sha2(F.concat(F.lit("blind:"), F.col("item_id").cast("string")), 256), 1, 1).isin(*"01234567"), "A").otherwise("B").alias("label"))


def category_report(spark, d):
    i = table(spark, d, "test_items")
    return i.groupBy("split", F.coalesce("categoria", F.lit("")).alias("categoria")).agg(F.count("*").alias("items"), F.round(F.avg(F.length("pergunta")), 6).alias("mean_chars"), F.round(F.median(F.length("resposta_esperada")), 6).alias("median_chars"))


def repeated_questions(spark, d):
    i = table(spark, d, "test_items").where("pergunta is not null")
    return i.groupBy(F.md5(tx.fold(F.trim("pergunta"))).alias("question")).agg(F.count("*").alias("items"), F.count_distinct("split").alias("splits")).where("items > 1")


def comparison_graph(spark, d):
    o = table(spark, d, "orders").select(F.concat_ws("|", F.lit("percent_change"), "o_custkey").alias("plan_id"), F.lit("percent_change").alias("operation"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("operand_no"), F.col("o_orderkey").cast("string").alias("cell_id"))
    return gr.comparison_graph(o.where("operand_no <= 2"))


def entity_communities(spark, d):
    return gr.communities(gr.cooccurrence(_mentioned(spark, d)))


def open_sessions(spark, d):
    e = table(spark, d, "events")
    done = e.where("event_type = 'purchase'").select("user_id").distinct()
    failed = e.where("event_type = 'error'").select("user_id").distinct()
    return e.select("user_id").distinct().join(done.join(failed, "user_id", "left_anti"), "user_id", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        table_observations, narrative_observations, comparison_issues, missing_values, relation_rules, round_robin_sample, skill_scores, output_quality, vector_validity, text_segments, scope_terms,
        parent_groups, chunk_neighbours, marker_scores, blind_labels, category_report, repeated_questions, comparison_graph, entity_communities, open_sessions,
    )
}

_T = "strip_accents(lower({c}))"
_RULES = ", ".join(f"('{r}', '{a}', '{b}')" for r, (x, y) in rg.RELATIONS.items() for a in x for b in y) + ", " + ", ".join(f"('PARTE_DE', '{f}', '{f}')" for f in rg.FAMILIES)
_KINDS = sorted({t for pair in rg.RELATIONS.values() for side in pair for t in side} | set(rg.TYPE_PARENTS) | set(rg.FAMILIES))
_CLOSURE = ", ".join(f"('{k}', '{k}')" for k in _KINDS) + ", " + ", ".join(f"('{a}', '{b}')" for a, b in rg.TYPE_PARENTS.items())


def _either(x: str) -> str:
    return f"CASE WHEN len(f.{x}) > 0 THEN f.{x} ELSE t_{x} END AS {x}"


def _listed(x: str) -> str:
    return f"string_split(nullif({_facet(x).rpartition(' AS ')[0]}, ''), ',') AS t_{x}"


SQL = {
    "table_observations": f"""WITH {_ONCE}, r0 AS (SELECT node_id, {_literal(_CELL)} AS value, {_DIMS} AS f, coalesce({_T.format(c='table_title')}, '') AS raw0 FROM once WHERE chunk_strategy = 'row_per_chunk'),
        r1 AS (SELECT *, array_to_string(list_filter(string_split(raw0, chr(10)), lambda x: NOT regexp_matches(x, '^fonte:|{fc.PUBLICATION}')), chr(10)) AS raw FROM r0),
        r2 AS (SELECT node_id, value, f, {_listed('indicator')}, {_listed('unit')}, list_distinct(regexp_extract_all(raw, '\\b(?:19|20)[0-9]{{2}}\\b')) AS t_period, {_listed('region')} FROM r1),
        r3 AS (SELECT node_id, value, {', '.join(_either(x) for x in ('indicator', 'unit', 'period', 'region'))} FROM r2 WHERE value IS NOT NULL),
        r4 AS (SELECT *, array_to_string(list_filter([CASE WHEN coalesce(len(indicator), 0) <> 1 THEN 'indicator' END, CASE WHEN coalesce(len(region), 0) <> 1 THEN 'region' END, CASE WHEN coalesce(len(period), 0) <> 1 THEN 'period' END, CASE WHEN coalesce(len(unit), 0) <> 1 THEN 'unit' END], lambda x: x IS NOT NULL), ',') AS issues FROM r3 WHERE len(indicator) > 0)
        SELECT node_id, CAST(value AS DOUBLE) AS value, array_to_string(indicator, ',') AS indicator, coalesce(array_to_string(unit, ','), '') AS unit, issues, CASE WHEN issues = '' THEN 'structured_candidate' ELSE 'requires_review' END AS status FROM r4""",
    "comparison_issues": f"""WITH {_ONCE}, f AS (SELECT table_key, {', '.join(f"coalesce({_DIMS}.{x}, []) AS {x}" for x in ('indicator', 'unit', 'scale', 'sector', 'period'))} FROM once WHERE chunk_strategy = 'row_per_chunk' AND table_key IS NOT NULL)
        SELECT table_key, array_to_string(list_filter([CASE WHEN count(DISTINCT indicator) > 1 OR bool_or(len(indicator) <> 1) THEN 'indicator' END, CASE WHEN count(DISTINCT unit) > 1 OR bool_or(len(unit) <> 1) THEN 'unit' END,
            CASE WHEN count(DISTINCT scale) > 1 THEN 'scale' END, CASE WHEN count(DISTINCT sector) > 1 THEN 'sector' END, CASE WHEN bool_or(len(period) <> 1) OR count(DISTINCT period) < count(*) THEN 'period' END], lambda x: x IS NOT NULL), ',') AS issues FROM f GROUP BY 1""",
    "missing_values": f"""WITH {_ONCE}, f AS (SELECT {_DIMS} AS f FROM once WHERE type = 'table'), h0 AS (SELECT unnest(f.indicator) AS indicator, f.period AS p FROM f), h AS (SELECT DISTINCT indicator, unnest(p) AS period FROM h0),
        q0 AS (SELECT doc_id, title, array_to_string(list_filter(string_split({_T.format(c='title')}, chr(10)), lambda x: NOT regexp_matches(x, '^fonte:|{fc.PUBLICATION}')), chr(10)) AS raw FROM documents WHERE title IS NOT NULL),
        q1 AS (SELECT doc_id, title, unnest({_listed('indicator').rpartition(' AS ')[0]}) AS indicator FROM q0), q AS (SELECT DISTINCT doc_id, indicator, unnest(regexp_extract_all(title, '\\b(?:19|20)[0-9]{{2}}\\b')) AS period FROM q1)
        SELECT q.doc_id, q.indicator, q.period FROM q ANTI JOIN h ON h.indicator = q.indicator AND h.period = q.period""",
    "relation_rules": f"WITH c(k, o) AS (VALUES {_CLOSURE}), r(relation, a, b) AS (VALUES {_RULES}) SELECT DISTINCT x.k AS subject_type, relation, y.k AS object_type FROM r JOIN c x ON x.o = a JOIN c y ON y.o = b",
    "round_robin_sample": f"""WITH {_ONCE}, t AS (SELECT node_id, source_file, type, row_number() OVER (PARTITION BY source_file, type ORDER BY chunk_id NULLS FIRST, node_id) AS turn FROM once WHERE source_file IS NOT NULL AND type IS NOT NULL)
        SELECT node_id, turn FROM t ORDER BY turn, source_file, type LIMIT 12""",
    "skill_scores": f"""WITH k(skill, keyword, priority) AS (VALUES {', '.join(f"('{a}', '{b}', {p})" for a, b, p in SKILLS)}), t AS (SELECT doc_id, ' ' || regexp_replace({_T.format(c='title')}, '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents),
        s AS (SELECT doc_id AS id, skill, priority, sum(1 + length(keyword) - length(replace(keyword, ' ', ''))) AS score FROM t JOIN k ON contains(t, ' ' || keyword || ' ') GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, priority DESC, skill) AS position FROM s) SELECT id, skill, CAST(score AS BIGINT) AS score, position FROM p WHERE position <= 2""",
    "output_quality": f"""WITH w AS (SELECT doc_id, length(regexp_replace(text, '[^�]', '', 'g')) AS lost, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), e AS (SELECT *, len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in ENGLISH)}))) AS english FROM w)
        SELECT doc_id, lost, english, english >= 3 AND english * 100 >= 8 * len(w) AS mixed FROM e""",
    "vector_validity": """WITH v AS (SELECT vec_id, vector, list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM chunk_vectors)
        SELECT vec_id, CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 64 THEN 'length' WHEN len(list_filter(vector, lambda x: NOT isfinite(x))) > 0 THEN 'not_finite' WHEN n = 0 THEN 'zero' WHEN abs(sqrt(n) - 1) > 1e-4 THEN 'not_normalised' ELSE 'fine' END AS state FROM v""",
    "text_segments": "WITH s AS (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 2000 + 1)) AS segment FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(segment AS INTEGER) AS segment, md5(text[segment * 2000 + 1:segment * 2000 + 2000]) AS part FROM s",
    "parent_groups": "SELECT parent_id, count(DISTINCT node_id) AS children, min(node_id) AS first FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1",
    "chunk_neighbours": f"""WITH {_ONCE} SELECT node_id, coalesce(lag(node_id) OVER w, '') AS before, coalesce(lead(node_id) OVER w, '') AS after FROM once WHERE type = 'text' WINDOW w AS (PARTITION BY source_file, page, type ORDER BY chunk_id NULLS FIRST, node_id)""",
    "marker_scores": f"""WITH m AS (SELECT item_id, len(list_filter(pontos_obrigatorios, lambda p: contains({_T.format(c='resposta_esperada')}, {_T.format(c='p')}))) AS met, len(pontos_obrigatorios) AS asked FROM test_items WHERE len(pontos_obrigatorios) > 0 AND resposta_esperada IS NOT NULL)
        SELECT item_id, met, asked, round(met / asked, 6) AS score FROM m""",
    "blind_labels": "SELECT item_id, CASE WHEN sha256('blind:' || item_id)[1] IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 'A' ELSE 'B' END AS label FROM test_items",
    "category_report": "SELECT split, coalesce(categoria, '') AS categoria, count(*) AS items, round(avg(length(pergunta)), 6) AS mean_chars, round(median(length(resposta_esperada)), 6) AS median_chars FROM test_items GROUP BY 1, 2",
    "repeated_questions": f"SELECT md5({_T.format(c='trim(pergunta)')}) AS question, count(*) AS items, count(DISTINCT split) AS splits FROM test_items WHERE pergunta IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "comparison_graph": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
        SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE n WHEN 1 THEN 'BASE_DE' ELSE 'FINAL_DE' END AS label, 'percent_change|' || o_custkey AS target_id FROM o WHERE n <= 2""",
    "open_sessions": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') OR user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "scope_terms": f"""WITH {_ONCE}, n AS (SELECT source_file, node_id, list_distinct(list_filter(regexp_extract_all({_T.format(c='text')}, '[0-9]+(?:[.,/-][0-9]+)*[a-z]?|[a-z]{{3,}}'), lambda x: x NOT IN ({_LABEL_STOP}))) AS t FROM once WHERE text IS NOT NULL AND source_file IS NOT NULL),
        s AS (SELECT source_file, count(*) AS nodes FROM n GROUP BY 1), u AS (SELECT source_file, unnest(t) AS term FROM n), df AS (SELECT source_file, term, count(*) AS df FROM u GROUP BY ALL)
        SELECT source_file, count(*) AS terms, round(sum(ln(nodes / df)), 3) AS weight, round(max(ln(nodes / df)), 5) AS top FROM df JOIN s USING (source_file) GROUP BY 1""",
}
