"""Queries of the text and vector operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.scratch import table


def limit(spark: SparkSession, sf_dir: str, name: str) -> int:
    """An amount of the fixed table of limits."""
    return table(spark, sf_dir, "limits").where(f"name = '{name}'").first()["amount"]


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec, field, source, text) of all texts and cells; the cells of a record are lines."""
    nodes, docs = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "documents")
    rec = F.col("node_id").alias("rec")
    text = nodes.select(F.lit("nodes").alias("tbl"), rec, F.lit("text").alias("field"), F.col("source_file").alias("source"), "text")
    cells = nodes.select(F.lit("nodes").alias("tbl"), rec, F.lit("cells").alias("field"), F.col("source_file").alias("source"), F.array_join("metadata.cells", "\n").alias("text"))
    docs = docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec"), F.lit("text").alias("field"), "source", "text")
    return text.union(cells).union(docs)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.encodings import garbled_fields

    return garbled_fields(text_fields(spark, sf_dir))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.encodings import repaired_fields

    return repaired_fields(text_fields(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.scans import page_defects

    return page_defects(table(spark, sf_dir, "pages"))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.scans import continuous_text

    return continuous_text(table(spark, sf_dir, "pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, sf_dir, "documents"), percent=limit(spark, sf_dir, "near_dup_percent"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"), percent=limit(spark, sf_dir, "near_dup_percent"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.vector_graph import neighbour_pairs

    return neighbour_pairs(table(spark, sf_dir, "chunk_vectors"), limit(spark, sf_dir, "neighbours_k"), limit(spark, sf_dir, "neighbour_floor_percent") / 100)


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k nearest vectors of those whose id is divisible by 100, by brute force, and whether the graph finds nine tenths of them."""
    from evidora.llm.vector_graph import nearest_vectors, valid_vectors
    from evidora.operators.ranking import cosine_topk

    k, floor = limit(spark, sf_dir, "neighbours_k"), limit(spark, sf_dir, "neighbour_floor_percent") / 100
    v = table(spark, sf_dir, "chunk_vectors")
    valid = valid_vectors(v, "vec_id", "vector", 64)
    exact = cosine_topk(valid.where("id % 100 = 0"), valid, k, "id", "v").where(F.col("score") >= floor)
    found = nearest_vectors(v, k, floor).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("neighbour").alias("id"), F.lit(1).alias("found"))
    both = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.splitting import oversized

    return oversized(table(spark, sf_dir, "pages"), limit(spark, sf_dir, "piece_chars"), limit(spark, sf_dir, "piece_overlap_chars"), "page_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.splitting import with_pieces

    pages = table(spark, sf_dir, "pages").select("page_id", "page", "text")
    pieces = with_pieces(pages, limit(spark, sf_dir, "piece_chars"), limit(spark, sf_dir, "piece_overlap_chars"))
    return pieces.select("page_id", "page", F.inline("pieces"))


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their pieces: nothing is lost, nothing is too long."""
    from evidora.llm.splitting import rebuilt

    return rebuilt(table(spark, sf_dir, "pages"), limit(spark, sf_dir, "piece_chars"), limit(spark, sf_dir, "piece_overlap_chars"), "page_id")


def tokenizer(spark: SparkSession) -> str:
    """The vocabulary file named by the setting evidora.tokenizer, or the public one of this installation."""
    return spark.conf.get("evidora.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.containers import packed

    return packed(table(spark, sf_dir, "documents"), limit(spark, sf_dir, "container_tokens"), tokenizer(spark))


def p8_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p8_containers, with containers that hold items of several buckets."""
    from evidora.llm.containers import packed

    return packed(table(spark, sf_dir, "documents"), limit(spark, sf_dir, "container_tokens"), tokenizer(spark), combine=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.leaks import leaked_items

    fields = ["pergunta", "resposta_esperada", "trecho"]
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"), fields, limit(spark, sf_dir, "leak_words"))


def p9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p9_found, with up to two other words between those of the item."""
    from evidora.llm.leaks import leaked_items

    fields = ["pergunta", "resposta_esperada", "trecho"]
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"), fields, limit(spark, sf_dir, "leak_words"), slack=2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.truncation import cut_texts

    return cut_texts(table(spark, sf_dir, "documents")).select("doc_id")


def p10_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that, without a mark at their end, are a strict prefix of a longer text."""
    from evidora.llm.truncation import prefixes_of_longer

    return prefixes_of_longer(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")).select(F.col("doc").alias("doc_id"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidora.llm.truncation import cut_rates

    return cut_rates(table(spark, sf_dir, "documents"), F.col("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_text, p4_found, p4_groups, p6_found, p6_recall, p7_found, p7_pieces, p7_rebuilt, p8_containers, p8_combined, p9_found, p9_proximity, p10_found, p10_prefixes, p10_rates)}
def _folded(column: str) -> str:
    """Folded words of a column in SQL: one-to-one decompositions as a table, vulgar fractions spelled out."""
    from evidora.functions.text import _letters

    a, b = (x.replace("'", "''") for x in _letters("NFKD"))
    text = column
    for sign, spelled in (("½", "1 2"), ("¼", "1 4"), ("¾", "3 4")):
        text = f"replace({text}, '{sign}', '{spelled}')"
    return f"regexp_extract_all(translate(lower({text}), '{a}', '{b}'), '[a-z0-9]+')"


_WINDOWS = "SELECT {id}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS s FROM ({rows}) WHERE len(w) >= {n}"
_DOC_WORDS = f"SELECT doc_id, {_folded('text')} AS w FROM documents WHERE text IS NOT NULL"
_ITEM_WORDS = " UNION ALL ".join(f"SELECT item_id, {_folded(c)} AS w FROM test_items WHERE {c} IS NOT NULL" for c in ("pergunta", "resposta_esperada", "trecho"))
SQL: dict[str, str] = {
    "p7_found": """
        SELECT page_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: length(x))) > lim THEN 'forced' ELSE 'natural' END AS cut
        FROM pages, (SELECT amount AS lim FROM limits WHERE name = 'piece_chars') WHERE length(text) > lim""",
    "p7_rebuilt": "SELECT page_id, md5(text) AS text_md5, true AS fits FROM pages WHERE text <> ''",
    "p4_found": f"""
        WITH s AS (SELECT DISTINCT * FROM ({_WINDOWS.format(id='doc_id', n=3, rows=_DOC_WORDS)})), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        j AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
        SELECT doc_a, doc_b FROM j JOIN z x ON x.doc_id = doc_a JOIN z y ON y.doc_id = doc_b, (SELECT amount FROM limits WHERE name = 'near_dup_percent')
        WHERE j.n * 100 >= amount * (x.n + y.n - j.n)""",
    "p4_groups": f"""
        WITH RECURSIVE s AS (SELECT DISTINCT * FROM ({_WINDOWS.format(id='doc_id', n=3, rows=_DOC_WORDS)})), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        w AS (SELECT doc_id, array_to_string(w, ' ') AS t FROM ({_DOC_WORDS}) WHERE len(w) >= 3), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id FROM w),
        j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT class_id FROM c) AND b.doc_id IN (SELECT class_id FROM c) GROUP BY 1, 2),
        p AS (SELECT a, b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b, (SELECT amount FROM limits WHERE name = 'near_dup_percent') WHERE j.n * 100 >= amount * (x.n + y.n - j.n)),
        r AS (SELECT class_id AS id, class_id AS m FROM c UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.id AND p.b > r.m), g AS (SELECT id, min(m) AS group_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
        SELECT c.doc_id, class_id, group_id, coalesce(links, 0) AS links FROM c JOIN g ON g.id = class_id LEFT JOIN k ON k.a = class_id""",
    "p9_found": f"""
        SELECT DISTINCT d.doc_id, i.item_id FROM ({_WINDOWS.format(id='doc_id', n=10, rows=_DOC_WORDS)}) d JOIN ({_WINDOWS.format(id='item_id', n=10, rows=_ITEM_WORDS)}) i ON d.s = i.s""",
    "p10_prefixes": r"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '(…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|-|[ \t\n\r\f\v])+$', '') AS t FROM documents)
        SELECT doc_id FROM t WHERE t <> '' AND EXISTS (SELECT 1 FROM t u WHERE starts_with(u.t, t.t) AND length(u.t) > length(t.t))""",
    "p6_recall": """
        WITH v AS (SELECT vec_id AS id, CAST(vector AS DOUBLE[]) AS v FROM chunk_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        c AS (SELECT a.id AS q, b.id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS n FROM c)
        SELECT count(*) AS neighbours, true AS enough FROM k, (SELECT amount AS most FROM limits WHERE name = 'neighbours_k'), (SELECT amount AS least FROM limits WHERE name = 'neighbour_floor_percent') WHERE n <= most AND s >= least / 100""",
    "p9_proximity": f"""
        WITH d AS ({_DOC_WORDS}), i AS ({_ITEM_WORDS}), w0 AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9])) AS w FROM i WHERE len(w) >= 10),
        w AS (SELECT *, w[1] AS a, w[10] AS z FROM w0), t AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
        c AS (SELECT DISTINCT x.doc_id, w.item_id, w.w, x.p, y.p AS q FROM w JOIN t x ON x.t = w.a JOIN t y ON y.doc_id = x.doc_id AND y.t = w.z AND y.p BETWEEN x.p + 9 AND x.p + 11),
        s AS (SELECT c.doc_id, item_id, c.w, d.w[p:q] AS x FROM c JOIN d USING (doc_id))
        SELECT DISTINCT doc_id, item_id FROM s WHERE list_reduce(list_prepend('0', x), lambda k, v: CASE WHEN w[CAST(k AS INTEGER) + 1] = v THEN CAST(CAST(k AS INTEGER) + 1 AS VARCHAR) ELSE k END) = '10'""",
}
