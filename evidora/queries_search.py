"""Queries of search, fusion, graph, calculation, validation and evaluation operators.

Searches ask with every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.functions import facets as fc
from evidora.functions import numbers as nm
from evidora.functions import text as tx
from evidora.operators import calculations as ca
from evidora.operators import evaluation as ev
from evidora.operators import graph as gr
from evidora.operators import lookup as lk
from evidora.operators import ranking as rk
from evidora.operators import validation as va
from evidora.queries_corpus import _DIMS, _FROM, _LABEL_STOP, _ONCE, _STOP, _TO, nodes_once
from evidora.scratch import stored, table

_MENTIONS = ("indicator", "unit", "period")


def _cosine(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rk.cosine_topk(e.where("vec_id % 100 = 0"), e, k, "vec_id", "embedding")


def _second(spark: SparkSession, d: str) -> DataFrame:
    """A second list per query: the vectors of its label, by id."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").cast("long").alias("query_id"), "label")
    from pyspark.sql.window import Window

    both = q.join(e.withColumnRenamed("vec_id", "id"), "label").where("id <> query_id")
    return both.select("query_id", F.col("id").cast("long").alias("id"), F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("position")).where("position <= 30")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    dense = _cosine(spark, d, 30).select("query_id", F.lit("dense").alias("list"), "id", "position")
    return dense.union(_second(spark, d).select("query_id", F.lit("label").alias("list"), "id", "position"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("table_key"))
    return rk.rrf(_lists(spark, d)).withColumnRenamed("fused", "position").join(e, "id")


def cosine_search(spark, d):
    return _cosine(spark, d, 10).select("query_id", "id", F.round("score", 6).alias("score"), "position")


def rrf_fusion(spark, d):
    return rk.rrf(_lists(spark, d)).select("query_id", "id", F.round("score", 6).alias("score"), F.size("ranks").alias("lists"))


def rrf_after_filter(spark, d):
    return rk.rrf_filtered(_lists(spark, d), F.col("id") % 2 == 0).select("query_id", "id", F.round("score", 6).alias("score"))


def diversified(spark, d):
    return rk.diversify(_fused(spark, d), 10, 2).select("query_id", "id", "place")


def reranked(spark, d):
    return rk.reranked(_fused(spark, d), -F.col("id").cast("double"), 8).select("query_id", "id", "place")


def accepted_extras(spark, d):
    f = _fused(spark, d)
    return rk.accept_extras(f.where("position <= 8"), f.where("position > 8"), floor=0.0).select("query_id", "id", "place")


def packed_context(spark, d):
    f = _fused(spark, d).withColumn("tokens", 100 + (F.col("id") * 37) % 400)
    return rk.pack_first_fit(f, 1500).select("query_id", "id", "size")


def covered_first(spark, d):
    f = _fused(spark, d).select("query_id", "id", "position", F.col("table_key").cast("string").alias("source"), F.array(F.concat(F.lit("m"), (F.col("id") % 5).cast("string"))).alias("carried"))
    wanted = f.select("query_id").distinct().withColumn("wanted", F.array(F.lit("m1"), F.lit("m3"), F.lit("m4")))
    return ev.select_coverage(f, wanted, 12)


def same_text_once(spark, d):
    n = nodes_once(spark, d).where("type = 'text'").select(F.lit(1).alias("query_id"), F.col("node_id").alias("id"), "source_file", "page", "text", F.xxhash64("node_id").alias("position"))
    return rk.same_text_once(n, "source_file", "page", "text").groupBy("source_file").agg(F.count("*").alias("n"))


def contained_once(spark, d):
    n = nodes_once(spark, d).where("type = 'text' and text is not null").select(F.lit(1).alias("query_id"), F.col("node_id").alias("id"), "source_file", "page", "text", F.length("text").alias("size"))
    ranked = n.withColumn("position", F.struct(-F.col("size"), F.col("id")))
    return rk.contained_once(ranked, ["source_file", "page"], "text").groupBy("source_file").agg(F.count("*").alias("n"))


def bm25_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("tokens")).where("tokens is not null")
    q = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), tx.tokens(F.col("title")).alias("tokens"))
    return rk.bm25(q, docs, "tokens", 10).select("query_id", "id", F.round("score", 3).alias("score"))


def structural_edges(spark, d):
    return gr.structural_edges(nodes_once(spark, d))


def page_boundary_edges(spark, d):
    return gr.page_boundaries(nodes_once(spark, d))


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    n = nodes_once(spark, d).select("node_id", fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    return gr.mentions(n, F.col("dims"), dimensions=_MENTIONS)


def entity_mentions(spark, d):
    return _mentioned(spark, d).groupBy("entity").agg(F.count("*").alias("n"))


def entity_cooccurrence(spark, d):
    return gr.cooccurrence(_mentioned(spark, d))


def entity_expansion(spark, d):
    m = stored(_mentioned(spark, d), "mentions")
    total = nodes_once(spark, d).count()
    seeds = table(spark, d, "chunk_vectors").where("vec_id % 100 = 0 and node_id is not null").select(F.col("vec_id").alias("query_id"), F.col("node_id").alias("id"), F.lit(0).alias("rank"))
    return gr.entity_expansion(seeds, m, total, 8, share=0.1).select("query_id", "id", F.round("score", 4).alias("score"))


def context_reach(spark, d):
    edges = gr.structural_edges(nodes_once(spark, d)).where("label = 'NEXT_CHUNK'").union(gr.page_boundaries(nodes_once(spark, d)).select("source_id", F.lit("NEXT_CHUNK"), "target_id"))
    seeds = table(spark, d, "chunk_vectors").where("vec_id % 100 = 0 and node_id is not null").select(F.col("vec_id").alias("query_id"), F.col("node_id").alias("id"))
    return gr.reachable(edges, seeds, 2)


def text_chains(spark, d):
    n = nodes_once(spark, d)
    edges = gr.structural_edges(n).where("label = 'NEXT_CHUNK'").select("source_id", "target_id").union(gr.page_boundaries(n))
    return gr.components(edges, "source_id", "target_id").groupBy("component").agg(F.count("*").alias("n"))


_PLACED = ("node_id", "type", "source_file", "page", "chunk_id")


def personal_rank(spark, d):
    n = stored(nodes_once(spark, d).where("type = 'text'").select(*_PLACED), "nodes")
    edges = gr.structural_edges(n)
    seeds = table(spark, d, "chunk_vectors").where("vec_id % 100 = 0").join(n.select("node_id"), "node_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("node_id").alias("id"), F.lit(0).alias("rank"))
    out = gr.personalised_rank(edges, seeds, rounds=3)
    return out.select("query_id", "id", F.round("score", 6).alias("score")).where("score > 0")


def personal_rank_all(spark, d):
    """Over the whole graph and to the reference's tolerance: 28 rounds leave at most 0.6 ** 28 < 1e-6 of the mass unsettled."""
    n = stored(nodes_once(spark, d).select(*_PLACED), "nodes")
    seeds = table(spark, d, "chunk_vectors").where("vec_id % 100 = 0").join(n.select("node_id"), "node_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("node_id").alias("id"), F.lit(0).alias("rank"))
    out = gr.personalised_rank(gr.structural_edges(n), seeds, rounds=28)
    return out.where("score > 0").select("query_id", "id", F.round("score", 9).alias("score"))


def hierarchy(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("child"), F.col("n_regionkey").alias("k"))
    r = table(spark, d, "region")
    up = n.join(r, F.col("k") == F.col("r_regionkey")).select("child", F.col("r_name").alias("parent"))
    return gr.descendants(up.union(r.select("r_name", F.lit("WORLD"))))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Quantity of each region and year, in Brazilian notation."""
    l, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    g = joined.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("l_quantity").cast("decimal(20,2)")).alias("q"))
    return g.select(F.concat_ws(":", "r_name", "y").alias("cell_id"), nm.formatted(F.col("q")).alias("value"), F.lit("pessoa").alias("unit"), F.lit("pib").alias("indicator"), F.col("r_name").alias("region"), F.col("y").cast("string").alias("period"), "y")


def calculated(spark, d):
    cells = stored(_cells(spark, d), "cells")
    two = cells.select(F.explode(F.array(*(F.lit(x) for x in ("percent_change", "difference", "percentage_points", "sum", "mean", "power")))).alias("operation"), "cell_id", "region", "y")
    first = two.select(F.concat_ws("|", "operation", "cell_id").alias("plan_id"), "operation", F.lit(1).alias("operand_no"), "cell_id")
    second = two.select(F.concat_ws("|", "operation", "cell_id").alias("plan_id"), "operation", F.lit(2).alias("operand_no"), F.concat_ws(":", "region", F.col("y") + 1).alias("cell_id"))
    out = ca.calculate(first.union(second), cells.drop("y"))
    return out.select("plan_id", "operation", F.coalesce(F.col("result").cast("double"), F.lit(-1.0)).alias("result"), F.coalesce("refused", F.lit("")).alias("refused"))


def number_support(spark, d):
    answers = table(spark, d, "test_items").select(F.col("item_id").alias("answer_id"), F.col("resposta_esperada").alias("text"), "trecho")
    sources = answers.select(F.col("answer_id").alias("source_id"), F.col("trecho").alias("text"))
    return va.validate_numbers(answers, sources, answers.select("answer_id", F.col("answer_id").alias("source_id")))


def citation_check(spark, d):
    items = table(spark, d, "test_items").where("fonte_arquivo is not null")
    answers = items.select(F.col("item_id").alias("answer_id"), F.concat(F.lit("Ver ["), "fonte_arquivo", F.coalesce(F.concat(F.lit(", p. "), F.col("fonte_pagina")), F.lit("")), F.lit("].")).alias("text"))
    pages = table(spark, d, "pages").select(F.col("source_file").alias("source"), "page")
    return va.validate_citations(answers, pages).select("answer_id", "source", F.coalesce("page", F.lit(-1)).alias("page"), "known")


def claim_support(spark, d):
    items = table(spark, d, "test_items")
    answers = items.select(F.col("item_id").alias("answer_id"), F.col("resposta_esperada").alias("text"))
    sources = items.select(F.col("item_id").alias("source_id"), F.col("trecho").alias("text"))
    links = items.alias("a").join(items.alias("b"), F.col("a.familia") == F.col("b.familia")).select(F.col("a.item_id").alias("answer_id"), F.col("b.item_id").alias("source_id"))
    return va.claim_evidence(answers, sources, links)


def structured_lookup(spark, d):
    rows = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'").select(F.col("node_id").alias("id"), "source_file", "metadata.cells", F.get("metadata.cells", F.lit(1)).alias("code"), F.get("metadata.cells", F.lit(0)).alias("name"))
    q = table(spark, d, "test_items").select(F.col("item_id").alias("query_id"), F.col("pergunta").alias("question"))
    return lk.structured_lookup(q, rows)


def family_leakage(spark, d):
    return table(spark, d, "test_items").where("familia is not null").groupBy("familia").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("items")).where("splits > 1")


def paired_variants(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')")
    rows = o.select(F.col("o_custkey").alias("question"), F.col("o_orderstatus").alias("variant"), F.round(F.col("o_totalprice") / 1000).alias("score"))
    g = rows.groupBy("question", "variant").agg(F.count("*").alias("score"))
    return ev.paired(g, "F", "O").select("wins", "losses", "ties", F.col("difference").cast("double").alias("difference"))


def sign_tests(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.count_if(F.col("o_orderstatus") == "O").alias("losses"))
    o = o.select("o_orderpriority", "m", (F.col("wins") % 40).alias("wins"), (F.col("losses") % 40).alias("losses"))
    return o.select("o_orderpriority", "m", F.round(ev.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


def sign_tests_all(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.count_if(F.col("o_orderstatus") == "O").alias("losses"))
    return o.select("o_orderpriority", "m", "wins", "losses", F.round(ev.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


def bootstrap_intervals(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg((F.count_if(F.col("o_orderstatus") == "F") - F.count_if(F.col("o_orderstatus") == "O")).alias("x"))
    return ev.bootstrap(o, "o_orderpriority", "x")


def gold_coverage(spark, d):
    items = table(spark, d, "test_items").where("fonte_arquivo is not null")
    gold = items.select(F.col("item_id").alias("question"), F.col("fonte_arquivo").alias("file"), F.col("fonte_pagina").alias("page"), F.col("trecho").alias("passage"))
    n = nodes_once(spark, d).select(F.col("source_file").alias("file"), F.col("page").try_cast("int").alias("page"), "text")
    found = gold.select("question", "file").join(n, "file").where("page is not null")
    return ev.covered_references(found, gold)


QUERIES = {
    f.__name__: f
    for f in (
        cosine_search, rrf_fusion, rrf_after_filter, diversified, reranked, accepted_extras, packed_context, covered_first, same_text_once, contained_once, bm25_search, structural_edges, page_boundary_edges, entity_mentions,
        entity_cooccurrence, entity_expansion, context_reach, text_chains, personal_rank, personal_rank_all, hierarchy, calculated, number_support, citation_check, claim_support, structured_lookup, family_leakage, paired_variants, sign_tests, sign_tests_all,
        bootstrap_intervals, gold_coverage,
    )
}

_COS = """cand AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
        FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM cand)"""
_LISTS = f"""{_COS}, lab AS (SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) AS position FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    lists AS (SELECT query_id, 'dense' AS list, id, position FROM dense WHERE position <= 30 UNION ALL SELECT query_id, 'label', id, position FROM lab WHERE position <= 30)"""
_FUSED = f"""{_LISTS}, f0 AS (SELECT query_id, id, sum(1.0 / (60 + position)) AS score, count(*) AS lists, min({{'l': list, 'p': position}}) AS first FROM lists GROUP BY 1, 2),
    fused AS (SELECT f0.*, label AS table_key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS position FROM f0 JOIN embeddings e ON e.vec_id = f0.id)"""
_TOK = "list_filter(regexp_extract_all(translate(lower({c}), '" + _FROM + "', '" + _TO + "'), '[0-9]+(?:[.,/-][0-9]+)*|[a-z]+'), lambda x: x NOT IN ({s}))"
_EDGES = f"""{_ONCE}, nx AS (SELECT node_id, lead(node_id) OVER w AS n, chunk_id AS o, lead(chunk_id) OVER w AS p FROM once WINDOW w AS (PARTITION BY source_file, page, type ORDER BY chunk_id NULLS FIRST, node_id)),
    nxt AS (SELECT node_id AS source_id, n AS target_id FROM nx WHERE p = o + 1),
    pg AS (SELECT source_file, TRY_CAST(page AS INTEGER) AS p, max_by(node_id, {{'o': chunk_id, 'n': node_id}}) AS l, min_by(node_id, {{'o': chunk_id, 'n': node_id}}) AS f FROM once WHERE type = 'text' AND TRY_CAST(page AS INTEGER) IS NOT NULL GROUP BY 1, 2),
    bound AS (SELECT a.l AS source_id, b.f AS target_id FROM pg a JOIN pg b ON b.source_file = a.source_file AND b.p = a.p + 1)"""
_STRUCT = """all_edges AS (SELECT node_id AS source_id, 'CONTIDA_EM' AS label, concat_ws('::', source_file, page) AS target_id FROM once UNION ALL
    SELECT DISTINCT concat_ws('::', source_file, page), 'PERTENCE_A_DOC', source_file FROM once UNION ALL SELECT source_id, 'NEXT_CHUNK', target_id FROM nxt)"""
_MENT = f"""{_ONCE}, f AS (SELECT node_id, {_DIMS} AS f FROM once), m AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(f"SELECT node_id AS id, '{x}:' || unnest(f.{x}) AS entity FROM f" for x in _MENTIONS)}))"""

_RARE = "list_distinct(list_filter(regexp_extract_all(strip_accents(lower({c})), '[0-9]+(?:[.,/-][0-9]+)*[a-z]?|[a-z]{{3,}}'), lambda x: x NOT IN (" + _LABEL_STOP + ")))"

SQL = {
    "cosine_search": f"WITH {_COS} SELECT query_id, id, round(score, 6) AS score, position FROM dense WHERE position <= 10",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id, round(score, 6) AS score, lists FROM fused",
    "rrf_after_filter": f"""WITH {_LISTS}, k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, list ORDER BY position, id) AS position FROM lists WHERE id % 2 = 0)
        SELECT query_id, id, round(sum(1.0 / (60 + position)), 6) AS score FROM k GROUP BY 1, 2""",
    "diversified": f"""WITH {_FUSED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_key ORDER BY position) AS n FROM fused), p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM t WHERE n <= 2)
        SELECT * FROM p WHERE place <= 10""",
    "reranked": f"WITH {_FUSED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY position > 8, CASE WHEN position <= 8 THEN -id END DESC NULLS LAST, position) AS place FROM fused",
    "accepted_extras": f"""WITH {_FUSED}, i AS (SELECT * FROM fused WHERE position <= 8), u AS (SELECT query_id, table_key, count(*) AS used FROM i GROUP BY ALL), w AS (SELECT query_id, min(round(score, 9)) AS weakest FROM i GROUP BY 1),
        x AS (SELECT e.*, row_number() OVER (PARTITION BY e.query_id, e.table_key ORDER BY round(e.score, 9) DESC, e.id) + coalesce(used, 0) AS n FROM fused e JOIN w ON w.query_id = e.query_id LEFT JOIN u ON u.query_id = e.query_id AND u.table_key = e.table_key
              WHERE e.position > 8 AND round(e.score, 9) >= greatest(0.0, 0.25 * weakest)),
        y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM x WHERE n <= 2) SELECT * FROM y WHERE place <= 6""",
    "packed_context": f"""WITH RECURSIVE {_FUSED}, s AS (SELECT query_id, id, position, 100 + (id * 37) % 400 AS size FROM fused),
        r AS (SELECT query_id, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS size, false AS kept FROM (SELECT DISTINCT query_id FROM s)
              UNION ALL SELECT r.query_id, s.position, r.used + CASE WHEN r.used + s.size <= 1500 THEN s.size ELSE 0 END, s.id, s.size, r.used + s.size <= 1500 FROM r JOIN s ON s.query_id = r.query_id AND s.position = r.position + 1)
        SELECT query_id, id, size FROM r WHERE kept""",
    "same_text_once": f"""WITH {_ONCE} SELECT source_file, count(DISTINCT concat_ws(chr(1), coalesce(page, chr(2)), coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(2)))) AS n FROM once WHERE type = 'text' GROUP BY 1""",
    "contained_once": f"""WITH {_ONCE}, n AS (SELECT node_id, source_file, page, text, length(text) AS size FROM once WHERE type = 'text' AND text IS NOT NULL)
        SELECT source_file, count(*) AS n FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.source_file IS NOT DISTINCT FROM a.source_file AND b.page IS NOT DISTINCT FROM a.page AND length(a.text) >= 100
            AND (b.size > a.size OR (b.size = a.size AND b.node_id < a.node_id)) AND contains(b.text, a.text)) GROUP BY 1""",
    "bm25_search": f"""WITH d AS (SELECT doc_id AS id, {_TOK.format(c='text', s=_STOP)} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_size FROM d),
        p AS (SELECT id, len(t) AS size, unnest(t) AS term FROM d), tf AS (SELECT id, size, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
        q0 AS (SELECT doc_id AS query_id, unnest({_TOK.format(c='title', s=_STOP)}) AS term FROM documents WHERE doc_id % 100 = 0), q AS (SELECT query_id, term, count(*) AS times FROM q0 GROUP BY ALL),
        s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s WHERE score > 0) SELECT query_id, id, round(score, 3) AS score FROM k WHERE position <= 10""",
    "structural_edges": f"WITH {_EDGES}, {_STRUCT} SELECT * FROM all_edges",
    "page_boundary_edges": f"WITH {_EDGES} SELECT * FROM bound",
    "entity_mentions": f"WITH {_MENT} SELECT entity, count(*) AS n FROM m GROUP BY 1",
    "entity_cooccurrence": f"WITH {_MENT} SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM m x JOIN m y ON x.id = y.id AND x.entity < y.entity GROUP BY 1, 2",
    "entity_expansion": f"""WITH {_MENT}, t AS (SELECT count(*) AS total FROM once), c AS (SELECT entity, count(*) AS n FROM m GROUP BY 1 HAVING count(*) <= (SELECT greatest(50, CAST(floor(0.1 * total) AS BIGINT)) FROM t)),
        s AS (SELECT vec_id AS query_id, node_id AS id FROM chunk_vectors WHERE vec_id % 100 = 0 AND node_id IS NOT NULL),
        g AS (SELECT query_id, entity, sum(ln(1 + total / n)) AS gain FROM s JOIN m USING (id) JOIN c USING (entity), t GROUP BY 1, 2),
        r AS (SELECT query_id, m.id, round(sum(gain), 6) AS score FROM g JOIN m USING (entity) GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM r ANTI JOIN s ON s.query_id = r.query_id AND s.id = r.id) SELECT query_id, id, round(score, 4) AS score FROM k WHERE position <= 8""",
    "context_reach": f"""WITH {_EDGES}, e AS (SELECT * FROM nxt UNION ALL SELECT * FROM bound), b AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
        s AS (SELECT vec_id AS query_id, node_id AS id FROM chunk_vectors WHERE vec_id % 100 = 0 AND node_id IS NOT NULL), h1 AS (SELECT query_id, b.b AS id FROM s JOIN b ON b.a = s.id), h2 AS (SELECT query_id, b.b AS id FROM h1 JOIN b ON b.a = h1.id)
        SELECT query_id, id, min(h) AS hops FROM (SELECT *, 0 AS h FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2""",
    "text_chains": f"""WITH RECURSIVE {_EDGES}, e AS (SELECT * FROM nxt UNION ALL SELECT * FROM bound), b AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e),
        r AS (SELECT a AS id, a AS m FROM b UNION SELECT b.b, r.m FROM r JOIN b ON b.a = r.id AND b.b > r.m), c AS (SELECT id, min(m) AS component FROM r GROUP BY 1) SELECT component, count(*) AS n FROM c GROUP BY 1""",
    "personal_rank": f"""WITH {_EDGES.replace('FROM nodes QUALIFY', 'FROM nodes QUALIFY')}, tx AS (SELECT * FROM once WHERE type = 'text'),
        ed AS (SELECT node_id AS s, 1.0 AS w, concat_ws('::', source_file, page) AS t FROM tx UNION ALL SELECT DISTINCT concat_ws('::', source_file, page), 0.4, source_file FROM tx UNION ALL SELECT source_id, 1.0, target_id FROM nxt WHERE source_id IN (SELECT node_id FROM tx)),
        b AS (SELECT s AS a, t AS b, w FROM ed UNION ALL SELECT t, s, w FROM ed), dg AS (SELECT b, count(*) AS d FROM b GROUP BY 1), ww AS (SELECT a, b, sum(w / log2(d + 2)) AS w FROM b JOIN dg USING (b) GROUP BY 1, 2),
        sh AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM ww), st AS (SELECT vec_id AS query_id, node_id AS id FROM chunk_vectors WHERE vec_id % 100 = 0 AND node_id IN (SELECT node_id FROM tx)),
        r1 AS (SELECT query_id, id, sum(m) AS score FROM (SELECT query_id, b AS id, 0.6 * share AS m FROM st JOIN sh ON a = id UNION ALL SELECT query_id, id, 0.4 FROM st) GROUP BY 1, 2),
        r2 AS (SELECT query_id, id, sum(m) AS score FROM (SELECT query_id, b AS id, 0.6 * score * share AS m FROM r1 JOIN sh ON a = id UNION ALL SELECT query_id, id, 0.4 FROM st) GROUP BY 1, 2),
        r3 AS (SELECT query_id, id, sum(m) AS score FROM (SELECT query_id, b AS id, 0.6 * score * share AS m FROM r2 JOIN sh ON a = id UNION ALL SELECT query_id, id, 0.4 FROM st) GROUP BY 1, 2)
        SELECT query_id, id, round(score, 6) AS score FROM r3 WHERE round(score, 6) > 0""",
    "hierarchy": """WITH RECURSIVE l AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), e AS (SELECT c AS x FROM l UNION SELECT p FROM l),
        t AS (SELECT x AS ancestor, x AS descendant, 0 AS depth FROM e UNION ALL SELECT ancestor, l.c, depth + 1 FROM t JOIN l ON l.p = t.descendant) SELECT * FROM t""",
    "calculated": """WITH g AS (SELECT r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(CAST(l_quantity AS DECIMAL(20,2))), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
        p AS (SELECT unnest(['percent_change', 'difference', 'percentage_points', 'sum', 'mean', 'power']) AS operation, a.region, a.y, CAST(a.q AS DECIMAL(38,6)) AS x, CAST(b.q AS DECIMAL(38,6)) AS z FROM g a LEFT JOIN g b ON b.region = a.region AND b.y = a.y + 1)
        SELECT operation || '|' || region || ':' || y AS plan_id, operation, CASE WHEN operation = 'power' OR z IS NULL OR operation = 'percentage_points' THEN -1.0 WHEN operation = 'percent_change' THEN round(CAST((z - x) * 100 AS DOUBLE) / CAST(x AS DOUBLE), 6)
            WHEN operation = 'difference' THEN CAST(z - x AS DOUBLE) WHEN operation = 'sum' THEN CAST(x + z AS DOUBLE) ELSE CAST(x + z AS DOUBLE) / 2 END AS result,
            CASE WHEN operation = 'power' THEN 'unknown_operation' WHEN z IS NULL THEN 'missing_cell' WHEN operation = 'percentage_points' THEN 'percent_unit' ELSE '' END AS refused FROM p""",
    "citation_check": """SELECT DISTINCT item_id AS answer_id, fonte_arquivo AS source, coalesce(fonte_pagina, -1) AS page, CASE WHEN fonte_pagina IS NULL THEN fonte_arquivo IN (SELECT source_file FROM pages)
        ELSE EXISTS (SELECT 1 FROM pages p WHERE p.source_file = fonte_arquivo AND p.page = fonte_pagina) END AS known FROM test_items WHERE regexp_matches(fonte_arquivo, '\\.(pdf|csv|xlsx|xls|txt)$')""",
    "family_leakage": "SELECT familia, count(DISTINCT split) AS splits, count(*) AS items FROM test_items WHERE familia IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "paired_variants": """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING a > 0 AND b > 0)
        SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, CAST(sum(a - b) AS DOUBLE) AS difference FROM g""",
    "sign_tests": """WITH g AS (SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) FILTER (o_orderstatus = 'F') % 40 AS wins, count(*) FILTER (o_orderstatus = 'O') % 40 AS losses FROM orders GROUP BY 1, 2)
        SELECT o_orderpriority, m, CASE WHEN wins + losses = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: gamma(CAST(wins + losses + 1 AS DOUBLE)) / gamma(CAST(i + 1 AS DOUBLE)) / gamma(CAST(wins + losses - i + 1 AS DOUBLE)) / pow(2.0, wins + losses)))), 6) END AS p FROM g""",
    "gold_coverage": f"""WITH {_ONCE}, g AS (SELECT DISTINCT item_id AS question, fonte_arquivo AS file, fonte_pagina AS page, trecho AS passage FROM test_items WHERE fonte_arquivo IS NOT NULL),
        n AS (SELECT source_file, TRY_CAST(page AS INTEGER) AS page, text FROM once)
        SELECT question, count(*) AS gold, sum(CASE WHEN CASE WHEN page IS NOT NULL THEN EXISTS (SELECT 1 FROM n WHERE n.source_file = g.file AND n.page = g.page)
            ELSE passage IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.source_file = g.file AND n.page IS NOT NULL AND contains(n.text, g.passage)) END THEN 1 ELSE 0 END) AS covered FROM g GROUP BY 1""",
    "structured_lookup": f"""WITH {_ONCE}, r AS (SELECT node_id AS id, source_file, metadata.cells AS cells, metadata.cells[2] AS code, metadata.cells[1] AS name FROM once WHERE chunk_strategy = 'row_per_chunk'),
        rt AS (SELECT DISTINCT id, source_file, unnest({_RARE.format(c="array_to_string(cells, ' ')")}) AS term FROM r), q AS (SELECT item_id AS query_id, pergunta AS question, {_RARE.format(c='pergunta')} AS t FROM test_items),
        a AS (SELECT DISTINCT query_id, unnest(t) AS term FROM q), us AS (SELECT term FROM rt GROUP BY 1 HAVING count(*) <= greatest(100, CAST(floor(0.05 * (SELECT count(*) FROM r)) AS BIGINT))),
        m AS (SELECT query_id, id, source_file, count(*) AS terms FROM rt JOIN us USING (term) JOIN a USING (term) GROUP BY ALL),
        s AS (SELECT m.query_id, m.id, m.source_file, terms + CASE WHEN length(code) >= 4 AND contains(question, code) THEN 100 ELSE 0 END + CASE WHEN length(name) >= 4 AND contains(strip_accents(lower(question)), strip_accents(lower(name))) THEN 40 ELSE 0 END AS score
              FROM m JOIN r ON r.id = m.id JOIN q ON q.query_id = m.query_id),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY score DESC, id) AS n FROM s), p AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM f WHERE n <= 3)
        SELECT * FROM p WHERE position <= 8""",
    "covered_first": f"""WITH {_FUSED}, w AS (SELECT query_id, id, position, CAST(table_key AS VARCHAR) AS source, CASE WHEN id % 5 IN (1, 3, 4) THEN row_number() OVER (PARTITION BY query_id, CASE WHEN id % 5 IN (1, 3, 4) THEN id % 5 ELSE -1 END ORDER BY position) END AS n FROM fused),
        c AS (SELECT *, n = 1 AS chosen FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY coalesce(chosen, false) DESC, position) AS k FROM c),
        o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN chosen THEN 0 WHEN k <= 3 THEN 1 ELSE 2 END, position) AS place FROM r) SELECT * FROM o WHERE place <= 12""",
}
