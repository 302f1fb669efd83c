"""Queries of the expansion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions import text as tx
from evidora.operators import expansion as ex
from evidora.queries_corpus import _LABEL_STOP, _ONCE, nodes_once
from evidora.scratch import stored, table

_BOUNDS = (("piece_chars", 256, 8192), ("piece_overlap_chars", 0, 100), ("container_tokens", 1, 4096), ("near_dup_percent", 50, 55), ("neighbours_k", 1, 50))


def sentence_chunks(spark, d):
    return ex.chunked(table(spark, d, "documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


def parent_blocks(spark, d):
    return ex.parents_of(table(spark, d, "documents"), "doc_id", "text").select("parent_id", F.col("id").alias("doc_id"), "ordinal")


def expanded_parents(spark, d):
    n = nodes_once(spark, d).select("node_id").join(table(spark, d, "nodes").select("node_id", "parent_id").distinct(), "node_id")
    hits = n.select(F.lit(1).alias("query_id"), F.col("node_id").alias("id"), F.col("node_id").alias("position"), "parent_id")
    parents = n.where("parent_id is not null").select("parent_id").distinct().withColumn("text", F.repeat(F.lit("x"), F.length("parent_id") * (1 + F.ascii(F.substring("parent_id", -1, 1)) % 3)))
    return ex.expand_parents(hits, parents, 20).groupBy("children").agg(F.count("*").alias("n"))


def label_matches(spark, d):
    n = stored(nodes_once(spark, d).where("text is not null and source_file is not null").select("node_id", "source_file", "text"), "nodes")
    v = table(spark, d, "chunk_vectors").where("vec_id % 100 = 0").select("vec_id", "node_id").join(n, "node_id")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("text").alias("question"))
    seeds = v.select(F.col("vec_id").alias("query_id"), F.col("node_id").alias("id"), F.lit(0).alias("rank"))
    members = n.select(F.col("source_file").alias("scope"), F.col("node_id").alias("id"), "text")
    return ex.label_candidates(q, seeds, members).select("query_id", "id", F.round("score", 3).alias("score"))


def table_context(spark, d):
    n = nodes_once(spark, d)
    notes = table(spark, d, "nodes").select("node_id", "table_notes").distinct()
    t = n.where("type <> 'text'").join(notes, "node_id", "left").select(F.col("node_id").alias("id"), "source_file", "page", F.coalesce("table_title", "text").alias("title"), F.col("table_notes").alias("notes"))
    x = n.where("type = 'text'").select(F.col("node_id").alias("id"), "source_file", "page", "text")
    return ex.context_links(t, x).groupBy("label").agg(F.count("*").alias("n"))


def setting_problems(spark, d):
    s = table(spark, d, "limits").select("name", F.col("amount").cast("string").alias("value"))
    b = table(spark, d, "region").limit(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(z).alias("high")) for n, a, z in _BOUNDS))))
    return ex.settings_problems(s, b)


def node_audit(spark, d):
    return ex.rollup_counts(nodes_once(spark, d), ["type", "chunk_strategy", "section"])


def payload_check(spark, d):
    n = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'")
    names = F.array(*(F.lit(x) for x in ("a", "b", "c", "d")))
    return n.select(F.coalesce(ex.payload_problems(F.col("metadata.cells"), names, max_chars=24), F.lit("fine")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def citations_found(spark, d):
    i = table(spark, d, "test_items").where("fonte_arquivo is not null")
    a = i.select("item_id", F.concat(F.lit("["), "fonte_arquivo", F.lit(", p. "), F.coalesce("fonte_pagina", F.lit(1)), F.lit("-"), F.coalesce("fonte_pagina", F.lit(1)) + 2, F.lit("]")).alias("t"))
    return a.select("item_id", F.explode(tx.cited_pages(F.col("t"))).alias("c")).select("item_id", "c.source", F.array_join("c.pages", ",").alias("pages"))


QUERIES = {f.__name__: f for f in (sentence_chunks, parent_blocks, expanded_parents, label_matches, table_context, setting_problems, node_audit, payload_check, citations_found)}
_RARE = "list_distinct(list_filter(regexp_extract_all(strip_accents(lower({c})), '[0-9]+(?:[.,/-][0-9]+)*[a-z]?|[a-z]{{3,}}'), lambda x: x NOT IN (" + _LABEL_STOP + ")))"
SQL = {
    "label_matches": f"""WITH {_ONCE}, n AS (SELECT node_id, source_file, {_RARE.format(c='text')} AS t FROM once WHERE text IS NOT NULL AND source_file IS NOT NULL),
        v AS (SELECT vec_id AS query_id, n.node_id, n.source_file, t FROM chunk_vectors JOIN n ON n.node_id = chunk_vectors.node_id WHERE vec_id % 100 = 0), sz AS (SELECT source_file, count(*) AS size FROM n GROUP BY 1 HAVING count(*) >= 2),
        u AS (SELECT source_file, node_id, unnest(t) AS term FROM n), df AS (SELECT source_file, term, count(*) AS df FROM u GROUP BY 1, 2), w AS (SELECT source_file, term, ln(size / df) AS weight FROM df JOIN sz USING (source_file) WHERE size > df),
        a AS (SELECT query_id, source_file, unnest(t) AS term FROM v), s AS (SELECT query_id, u.node_id AS id, round(sum(weight), 6) AS score FROM a JOIN w USING (source_file, term) JOIN u USING (source_file, term) GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s ANTI JOIN v ON v.query_id = s.query_id AND v.node_id = s.id) SELECT query_id, id, round(score, 3) AS score FROM k WHERE position <= 8""",
    "expanded_parents": f"""WITH n AS (SELECT DISTINCT node_id, parent_id FROM nodes), p AS (SELECT DISTINCT parent_id, (length(parent_id) * (1 + ascii(right(parent_id, 1)) % 3) + 5) // 4 + 2 <= 20 AS fits FROM n WHERE parent_id IS NOT NULL),
        g AS (SELECT CASE WHEN fits THEN n.parent_id ELSE node_id END AS id, count(*) AS children FROM n LEFT JOIN p ON p.parent_id = n.parent_id GROUP BY 1) SELECT children, count(*) AS n FROM g GROUP BY 1""",
    "setting_problems": f"""WITH b(name, low, high) AS (VALUES {', '.join(f"('{n}', {a}, {z})" for n, a, z in _BOUNDS)}) SELECT l.name, CASE WHEN low IS NULL THEN 'unknown' ELSE 'out_of_bounds' END AS problem FROM limits l LEFT JOIN b ON b.name = l.name WHERE low IS NULL OR amount < low OR amount > high""",
    "node_audit": f"WITH {_ONCE} " + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '') AS value, count(*) AS n FROM once GROUP BY 2" for c in ("type", "chunk_strategy", "section")),
    "payload_check": f"WITH {_ONCE} SELECT CASE WHEN len(metadata.cells) <> 4 THEN 'arity' WHEN len(list_filter(metadata.cells, lambda x: length(x) > 24)) > 0 THEN 'cell_too_long' ELSE 'fine' END AS state, count(*) AS n FROM once WHERE chunk_strategy = 'row_per_chunk' GROUP BY 1",
    "citations_found": "SELECT item_id, fonte_arquivo AS source, concat_ws(',', coalesce(fonte_pagina, 1), coalesce(fonte_pagina, 1) + 1, coalesce(fonte_pagina, 1) + 2) AS pages FROM test_items WHERE regexp_matches(fonte_arquivo, '\\.(pdf|csv|xlsx|xls|txt)$')",
    "table_context": f"""WITH {_ONCE}, t0 AS (SELECT o.node_id AS id, source_file, page, coalesce(table_title, text) AS title, n.table_notes AS notes FROM once o LEFT JOIN (SELECT DISTINCT node_id, table_notes FROM nodes) n USING (node_id) WHERE type <> 'text'),
        l AS (SELECT id, source_file, page, 'TEM_TITULO' AS label, title AS lit FROM t0 UNION ALL SELECT id, source_file, page, 'TEM_NOTA', unnest(notes) FROM t0), a AS (SELECT id, source_file, page, label, trim(string_split(coalesce(lit, ''), chr(10))[1]) AS e FROM l),
        x AS (SELECT node_id AS tid, source_file, page, text FROM once WHERE type = 'text'),
        r AS (SELECT DISTINCT id, label, tid, e FROM a JOIN x ON x.source_file = a.source_file AND x.page = a.page AND length(e) >= 8 AND contains(text, e) UNION
              SELECT id, 'DESCRITA_EM', tid, regexp_extract(title, '(?i)^((?:tabela|quadro)\\s+[0-9]+)\\b', 1) AS e FROM t0 JOIN x ON x.source_file = t0.source_file AND x.page = t0.page
              WHERE e <> '' AND contains(' ' || regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(strip_accents(lower(e)), '[^a-z0-9]+', ' ', 'g') || ' ') AND NOT contains(text, trim(string_split(title, chr(10))[1])))
        SELECT label, count(*) AS n FROM r GROUP BY 1""",
}
