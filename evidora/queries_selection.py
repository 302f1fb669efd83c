"""Queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions import facets as fc
from evidora.functions import text as tx
from evidora.operators import ranking as rk
from evidora.operators import selection as se
from evidora.queries_corpus import _DIMS, _ONCE, nodes_once
from evidora.queries_search import _COS, _FUSED, _fused
from evidora.scratch import table

_MARKERS = (("percent", r"[0-9]+,[0-9]%"), ("year", r"\b20[0-9]{2}\b"), ("amount", r"r\$ [0-9]"), ("edition", r"\bedicao\b"))
_EXPECTED = {"factual": 60, "numerica": 60, "integracao": 50, "sintese": 40, "limites": 30}


def cosine_subset(spark, d):
    e = table(spark, d, "embeddings")
    return rk.cosine_topk(e.where("vec_id % 100 = 0"), e.where("label < 5"), 5, "vec_id", "embedding").select("query_id", "id", F.round("score", 6).alias("score"))


def document_diversity(spark, d):
    return se.document_diversity(_fused(spark, d).withColumn("source", F.col("table_key").cast("string")), 15)


def context_packing(spark, d):
    f = _fused(spark, d).select("query_id", "id", "position", (100 + (F.col("id") * 37) % 400).alias("size"), F.array(F.concat(F.lit("m"), (F.col("id") % 7).cast("string"))).alias("carried"))
    return se.pack_context(f, f.select("query_id").distinct().withColumn("wanted", F.array(F.lit("m1"), F.lit("m3"))), 2000)


def observation_search(spark, d):
    obs = nodes_once(spark, d).where("type = 'table'").select(F.col("node_id").alias("id"), fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    want = {"indicator": ["producao", "exportacao"], "kind": ["taxa"], "unit": ["tonelada", "real"]}
    wanted = F.struct(*(F.array(*(F.lit(v) for v in want.get(x, []))).cast("array<string>").alias(x) for x in fc.DIMENSIONS))
    return se.ranked_observations(obs, wanted, 20).select("id", "conflicts", "matches", "position")


def gap_sources(spark, d):
    n = nodes_once(spark, d).where("type = 'table'").select(F.col("node_id").alias("id"), fc.stored_facets(F.col("metadata.ontology_facets")).alias("f"))
    carried = n.select("id", F.explode(F.concat(F.transform("f.indicator", lambda x: F.concat(F.lit("indicator:"), x)), F.transform("f.unit", lambda x: F.concat(F.lit("unit:"), x)))).alias("value"))
    missing = table(spark, d, "unit_registry").select(F.col("quantity").alias("query_id"), F.concat(F.lit("unit:"), "unit_id").alias("value"))
    return se.gap_sources(missing, carried)


def summary_batches(spark, d):
    n = nodes_once(spark, d).where("type = 'text' and text is not null and source_file is not null").select("node_id", "source_file", "page", "chunk_id", tx.packing_tokens(F.col("text")).alias("tokens"))
    return se.batches(n, "source_file", ["page", "chunk_id", "node_id"], "tokens", 1000).groupBy("source_file", "batch").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


def marker_counts(spark, d):
    return se.marker_counts(table(spark, d, "test_items"), list(_MARKERS), r"informacao insuficiente", "item_id", tx.fold(F.col("resposta_esperada")))


def category_problems(spark, d):
    return se.distribution_problems(table(spark, d, "test_items"), "categoria", _EXPECTED)


QUERIES = {f.__name__: f for f in (cosine_subset, document_diversity, context_packing, observation_search, gap_sources, summary_batches, marker_counts, category_problems)}
_W = {"indicator": "['producao', 'exportacao']", "kind": "['taxa']", "unit": "['tonelada', 'real']"}
_G = "coalesce(f.{x}, [])"
SQL = {
    "cosine_subset": f"""WITH {_COS}, l AS (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM cand d JOIN embeddings e ON e.vec_id = d.id AND e.label < 5) SELECT query_id, id, round(score, 6) AS score FROM l WHERE n <= 5""",
    "document_diversity": f"""WITH {_FUSED}, r AS (SELECT query_id, id, position, row_number() OVER (PARTITION BY query_id, table_key ORDER BY position) > 3 AS late FROM fused),
        p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY late, position) AS place FROM r) SELECT * FROM p WHERE place <= 15""",
    "observation_search": f"""WITH {_ONCE}, f AS (SELECT node_id AS id, {_DIMS} AS f FROM once WHERE type = 'table'),
        r AS (SELECT id, {' + '.join(f"CASE WHEN len({_G.format(x=x)}) > 0 AND NOT list_has_any(f.{x}, {w}) THEN 1 ELSE 0 END" for x, w in _W.items())} AS conflicts,
                     {' + '.join(f"CASE WHEN list_has_any({_G.format(x=x)}, {w}) THEN 1 ELSE 0 END" for x, w in _W.items())} AS matches
              FROM f WHERE list_has_any({_G.format(x='indicator')}, {_W['indicator']}) AND list_has_any({_G.format(x='unit')}, {_W['unit']})),
        p AS (SELECT *, row_number() OVER (ORDER BY conflicts, matches DESC, id) AS position FROM r) SELECT * FROM p WHERE position <= 20""",
    "gap_sources": f"""WITH {_ONCE}, f AS (SELECT node_id AS id, {_DIMS} AS f FROM once WHERE type = 'table'), c AS (SELECT id, 'unit:' || unnest(f.unit) AS value FROM f),
        m AS (SELECT quantity AS query_id, 'unit:' || unit_id AS value, c.id, row_number() OVER (PARTITION BY quantity, unit_id ORDER BY c.id) AS n FROM unit_registry JOIN c ON c.value = 'unit:' || unit_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, value, id) AS k FROM m WHERE n <= 2) SELECT query_id, id, value FROM k WHERE k <= 6""",
    "summary_batches": f"""WITH RECURSIVE {_ONCE}, b AS (SELECT source_file, (length(text) + 5) // 4 AS tokens, row_number() OVER (PARTITION BY source_file ORDER BY page NULLS FIRST, chunk_id NULLS FIRST, node_id) AS n FROM once WHERE type = 'text' AND text IS NOT NULL AND source_file IS NOT NULL),
        r AS (SELECT source_file, n, tokens, tokens AS used, 1 AS batch FROM b WHERE n = 1 UNION ALL
              SELECT b.source_file, b.n, b.tokens, CASE WHEN r.used + b.tokens > 1000 THEN b.tokens ELSE r.used + b.tokens END, r.batch + CASE WHEN r.used + b.tokens > 1000 THEN 1 ELSE 0 END FROM r JOIN b ON b.source_file = r.source_file AND b.n = r.n + 1)
        SELECT source_file, batch, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""",
    "marker_counts": "WITH t AS (SELECT item_id, coalesce(strip_accents(lower(resposta_esperada)), '') AS t FROM test_items) SELECT item_id, CASE WHEN regexp_matches(t, 'informacao insuficiente') THEN 0 ELSE " + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for _, p in _MARKERS) + f" END AS found, {len(_MARKERS)} AS asked FROM t",
    "category_problems": f"""WITH e(value, expected) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in _EXPECTED.items())}), h AS (SELECT coalesce(categoria, '') AS value, count(*) AS n FROM test_items GROUP BY 1)
        SELECT coalesce(e.value, h.value) AS value, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected FROM e FULL JOIN h ON h.value = e.value WHERE coalesce(n, 0) <> coalesce(expected, 0)""",
}
