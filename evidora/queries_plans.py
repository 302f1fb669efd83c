"""Queries of whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.plans import indexing, retrieval
from evidora.queries_corpus import _ONCE, nodes_once
from evidora.queries_search import _STOP, _TOK
from evidora.scratch import table


def _inputs(spark, d):
    chunks = nodes_once(spark, d).where("text is not null").select(F.col("node_id").alias("id"), "text", "table_key")
    v = table(spark, d, "chunk_vectors").where("node_id is not null and size(vector) = 64 and not exists(vector, x -> isnan(x) or abs(x) = double('infinity'))")
    vectors = v.groupBy(F.col("node_id").alias("id")).agg(F.min_by("vector", "vec_id").alias("vector"))
    asked = v.where("vec_id % 100 = 0").groupBy(F.col("node_id").alias("id")).agg(F.min("vec_id").alias("v")).join(vectors, "id").join(chunks, "id")
    return asked.select(F.col("id").alias("query_id"), "text", "vector"), chunks, vectors


def shared_ranking(spark, d):
    q, chunks, vectors = _inputs(spark, d)
    return retrieval.initial_ranking(q, chunks, vectors, retrieval.Profile()).select("query_id", "id", F.round("score", 6).alias("score"), "position")


def packed_contexts(spark, d):
    q, chunks, vectors = _inputs(spark, d)
    p = retrieval.Profile()
    return retrieval.packed_contexts(retrieval.initial_ranking(q, chunks, vectors, p), chunks, p).select("query_id", F.md5("context").alias("context"), "passages", "tokens")


def text_index(spark, d):
    i = indexing.text_index(table(spark, d, "pages").select("source_file", "page", "text"))
    return i.groupBy("source_file").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.max(F.length("text")).alias("longest"))


def updated_index(spark, d):
    pages, m = table(spark, d, "pages").select("source_file", "page", "text"), table(spark, d, "manifest")
    i = indexing.updated_index(indexing.text_index(pages), m.where("snapshot = 'old'"), m.where("snapshot = 'new'"), pages)
    return i.groupBy("source_file").agg(F.count_distinct("page").alias("pages"))


QUERIES = {f.__name__: f for f in (shared_ranking, packed_contexts, text_index, updated_index)}
SQL = {
    "updated_index": """WITH s AS (SELECT path, bool_or(snapshot = 'old') AS was, bool_or(snapshot = 'new') AS is_now FROM manifest GROUP BY 1)
        SELECT p.source_file, count(DISTINCT page) AS pages FROM pages p LEFT JOIN s ON s.path = p.source_file WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', '', 'g')) <> '' AND (s.path IS NULL OR s.is_now) GROUP BY 1""",
    "shared_ranking": f"""
        WITH {_ONCE}, ch AS (SELECT node_id AS id, text, table_key FROM once WHERE text IS NOT NULL),
        v AS (SELECT vec_id, node_id, vector FROM chunk_vectors WHERE node_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0),
        vec AS (SELECT node_id AS id, CAST(min_by(vector, vec_id) AS DOUBLE[]) AS v FROM v GROUP BY 1), ok AS (SELECT * FROM vec WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
        q AS (SELECT DISTINCT node_id AS query_id FROM v WHERE vec_id % 100 = 0 AND node_id IN (SELECT id FROM ch)),
        c AS (SELECT q.query_id, b.id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM q JOIN ok a ON a.id = q.query_id JOIN ok b ON b.id <> q.query_id),
        dense AS (SELECT query_id, 'dense' AS list, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM c),
        d AS (SELECT id, {_TOK.format(c='text', s=_STOP)} AS t FROM ch), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_size FROM d), p AS (SELECT id, len(t) AS size, unnest(t) AS term FROM d),
        tf AS (SELECT id, size, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
        idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), a AS (SELECT query_id, p.term, count(*) AS times FROM q JOIN p ON p.id = q.query_id GROUP BY ALL),
        s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))), 6) AS score FROM tf JOIN a USING (term) JOIN idf USING (term), st GROUP BY ALL),
        lex AS (SELECT query_id, 'lexical' AS list, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s WHERE score > 0),
        l AS (SELECT * FROM dense WHERE position <= 30 UNION ALL SELECT * FROM lex WHERE position <= 30),
        f AS (SELECT query_id, id, sum(1.0 / (60 + position)) AS score, min({{'l': list, 'p': position}}) AS first FROM l WHERE id <> query_id GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, id) AS position FROM f),
        t AS (SELECT r.*, table_key, row_number() OVER (PARTITION BY query_id, table_key ORDER BY position) AS n FROM r JOIN ch ON ch.id = r.id),
        z AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position FROM t WHERE table_key IS NULL OR n <= 2) SELECT * FROM z WHERE position <= 10""",
}
