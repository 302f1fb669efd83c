"""Queries of the corpus operators: functions, chunks, facets, reports, index lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.functions import facets as fc
from evidora.functions import numbers as nm
from evidora.functions import periods as pe
from evidora.functions import text as tx
from evidora.operators import chunking as ch
from evidora.operators import index_lifecycle as ix
from evidora.operators import knowledge as kn
from evidora.scratch import table


def nodes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with its latest row."""
    n = table(spark, sf_dir, "nodes").select("node_id", "text", "type", "source_file", "page", "chunk_id", "section", "chunk_strategy", "table_key", "table_title", "metadata", "ingested_at")
    return ix.latest_rows(n, ["node_id"], "ingested_at")


_ONCE = "once AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) = 1)"


def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.fold(F.col("title"))).alias("folded"))


def bm25_tokens(spark, d):
    t = tx.tokens(F.col("pergunta"))
    return table(spark, d, "test_items").select("item_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


def rare_terms(spark, d):
    return table(spark, d, "test_items").select("item_id", F.array_join(F.array_sort(tx.rare_terms(F.col("resposta_esperada"))), " ").alias("terms"))


def control_chars(spark, d):
    return table(spark, d, "pages").where("text is not null").select("page_id", F.length(tx.without_control(F.col("text"))).alias("n"))


def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"), tx.packing_tokens(F.col("text")).alias("packing"))


def claim_split(spark, d):
    return table(spark, d, "test_items").select("item_id", F.explode(F.split("resposta_esperada", r"(?<=[!?;])\s+|\n+")).alias("claim")).select("item_id", F.trim("claim").alias("claim")).where("claim <> ''")


def section_titles(spark, d):
    t = tx.section_title(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("found")).where("found is not null")


def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.excerpt(F.col("text"), 4000, "…")).alias("excerpt"))


def ptbr_numbers(spark, d):
    cell = F.try_element_at("metadata.cells", F.lit(-1))
    return nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'").select("node_id", nm.normalized(cell).alias("plain"), nm.literal_decimal(cell).cast("double").alias("value"))


def number_format(spark, d):
    return table(spark, d, "lineitem").groupBy("l_shipdate").agg(nm.formatted(F.sum(F.col("l_quantity").cast("decimal(20,4)")) / 7).alias("shown"))


def periods_found(spark, d):
    return nodes_once(spark, d).where("type = 'text'").select("node_id", F.array_join(pe.periods(tx.fold(F.col("text"))), ",").alias("periods"))


def period_granularity(spark, d):
    cell = F.get("metadata.cells", F.lit(2))
    return nodes_once(spark, d).where("type = 'table'").where(cell.isNotNull()).select(pe.granularity(cell).alias("granularity"), F.length(cell).alias("size")).groupBy("granularity", "size").agg(F.count("*").alias("n"))


def facets_found(spark, d):
    docs = fc.with_facets(table(spark, d, "documents").where("lang = 'pt'").select("doc_id", "text"), "text", "f")
    return docs.select("doc_id", *(F.array_join(F.col("f")[x], ",").alias(x) for x in ("indicator", "unit", "scale", "sector", "basis", "kind")))


def facets_all(spark, d):
    docs = fc.with_facets(table(spark, d, "documents").select("doc_id", "text"), "text", "f")
    return docs.select("doc_id", *(F.array_join(F.col("f")[x], ",").alias(x) for x in fc.DIMENSIONS))


def dimension_histogram(spark, d):
    obs = nodes_once(spark, d).select(fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    return kn.dimension_histogram(obs)


def available_combinations(spark, d):
    obs = nodes_once(spark, d).where("type = 'table'").select(fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    return kn.combinations(obs, ("indicator", "period", "unit", "scale"), ("indicator", "period", "unit"))


def coverage_gaps(spark, d):
    obs = nodes_once(spark, d).where("type = 'table'").select(fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    wanted = {"indicator": ["pib", "producao", "exportacao", "rendimento"], "period": [str(y) for y in range(2000, 2026)]}
    return kn.gaps(obs, ("indicator", "period"), wanted)


def value_divergences(spark, d):
    place = F.get("metadata.cells", F.lit(0))
    obs = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'").select(F.col("node_id").alias("id"), place.alias("place"), nm.literal_decimal(F.try_element_at("metadata.cells", F.lit(-1))).alias("value"), fc.stored_facets(F.col("metadata.ontology_facets")).alias("dims"))
    out = kn.divergences(obs, core=("indicator", "period"), also=("place",))
    return out.select("indicator", "period", "unit", "scale", "place", "alternatives", "observations", F.col("lowest").cast("double").alias("lowest"), F.col("highest").cast("double").alias("highest"))


def candidate_filter(spark, d):
    obs = nodes_once(spark, d).select("node_id", fc.stored_facets(F.col("metadata.ontology_facets")).alias("given"))
    wanted = F.struct(*(F.array(*(F.lit(v) for v in {"indicator": ["producao"], "unit": ["tonelada", "saca_60kg"]}.get(x, []))).cast("array<string>").alias(x) for x in fc.DIMENSIONS))
    return kn.filter_candidates(obs.withColumn("wanted", wanted), F.col("wanted"), F.col("given")).select("node_id")


def observation_match(spark, d):
    obs = nodes_once(spark, d).select("node_id", fc.stored_facets(F.col("metadata.ontology_facets")).alias("given"))
    wanted = F.struct(*(F.array(*(F.lit(v) for v in {"indicator": ["producao"], "unit": ["tonelada", "saca_60kg"]}.get(x, []))).cast("array<string>").alias(x) for x in fc.DIMENSIONS))
    return obs.withColumn("wanted", wanted).where(kn.observation_matches(F.col("wanted"), F.col("given"))).select("node_id")


def deterministic_ids(spark, d):
    n = nodes_once(spark, d)
    return n.select("node_id", ch.deterministic_id(F.col("source_file"), F.col("page"), F.col("type"), F.col("chunk_id"), F.col("text")).alias("sha"))


def page_ordinals(spark, d):
    n = nodes_once(spark, d)
    return ch.page_ordinals(n, F.struct(F.coalesce("chunk_id", F.lit(-1)), "node_id")).select("node_id", "ordinal", "on_page")


def table_chunks(spark, d):
    n = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk' and table_key is not null").select("table_key", F.col("metadata.row").alias("row"), "text", "node_id")
    out = ch.table_chunks(n.withColumn("key", F.format_string("%08d %s", F.coalesce("row", F.lit(0)), F.col("node_id"))), "table_key", "key", "text", small=10)
    return out.select("table_key", "strategy", "ordinal", F.md5("text").alias("text"), "total_rows", "truncated")


def short_fragments(spark, d):
    n = nodes_once(spark, d).where("type = 'text'")
    out = ch.short_fragments_joined(n, 250, "source_file", ["page", "chunk_id", "node_id"])
    return out.select("source_file", "island", F.length("text").alias("n_chars"), "parts")


def small_tables(spark, d):
    n = nodes_once(spark, d).where("type = 'table'").withColumn("row", F.coalesce("metadata.row", F.lit(0)))
    out = ch.small_tables_merged(n, "table_key", "node_id", "text", ["row", "node_id"])
    return out.select("table_key", "id", F.md5("text").alias("text"), "rows")


def context_headers(spark, d):
    n = nodes_once(spark, d)
    return n.select("node_id", ch.context_header(F.col("source_file"), F.col("table_title"), F.col("metadata.table_descricao"), F.col("metadata.sheet"), F.col("section")).alias("header"))


def structured_rows(spark, d):
    n = nodes_once(spark, d).where("chunk_strategy = 'row_per_chunk'")
    names = F.array(*(F.lit(x) for x in ("municipio", "codigo", "periodo", "valor")))
    return n.select("node_id", ch.row_text(names, F.col("metadata.cells"), F.col("source_file")).alias("row_text"))


def chat_budget(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    return ch.chat_budget(e, 400, "user_id", "event_type", "props", "view").select("event_id", "kept_chars")


def snapshot_changes(spark, d):
    m = table(spark, d, "manifest")
    return ix.detect_changes(m.where("snapshot = 'old'"), m.where("snapshot = 'new'"))


def latest_nodes(spark, d):
    return nodes_once(spark, d).select("node_id", "source_file", "ingested_at")


def incremental_index(spark, d):
    n = nodes_once(spark, d).select("node_id", "source_file", F.lit("index").alias("origin"))
    changed = snapshot_changes(spark, d).select(F.col("path").alias("source_file"))
    fresh = n.join(changed, "source_file", "left_semi").withColumn("origin", F.lit("fresh"))
    return ix.incremental_merge(n, fresh, changed, "source_file", "node_id").groupBy("origin").agg(F.count("*").alias("n"))


def stale_vectors(spark, d):
    v, n = table(spark, d, "chunk_vectors"), table(spark, d, "nodes").select("node_id", "source_file").distinct()
    gone = snapshot_changes(spark, d).where("change <> 'added'").select(F.col("path").alias("source_file"))
    return v.select("vec_id", "node_id").join(n.join(gone, "source_file", "left_semi"), "node_id", "left_semi").select("vec_id")


def embedding_cache_misses(spark, d):
    texts = table(spark, d, "nodes").select("text", "node_id").where("text is not null")
    cached = texts.join(table(spark, d, "chunk_vectors").select("node_id").distinct(), "node_id", "left_semi").select(F.sha2("text", 256).alias("key")).distinct()
    return ix.cache_misses(texts, cached, F.sha2("text", 256)).select("key")


def files_by_type(spark, d):
    n = nodes_once(spark, d)
    return n.groupBy("source_file").agg(F.count_if(F.col('type') == 'text').alias("texts"), F.count_if(F.col('type') == 'table').alias("tables"), F.count_if(F.col('type') == 'image').alias("images"))


QUERIES = {
    f.__name__: f
    for f in (
        fold_text, bm25_tokens, rare_terms, control_chars, token_estimates, claim_split, section_titles, excerpts, ptbr_numbers, number_format, periods_found, period_granularity, facets_found, facets_all, dimension_histogram,
        available_combinations, coverage_gaps, value_divergences, candidate_filter, observation_match, deterministic_ids, page_ordinals, table_chunks, short_fragments, small_tables, context_headers, structured_rows,
        chat_budget, snapshot_changes, latest_nodes, incremental_index, stale_vectors, embedding_cache_misses, files_by_type,
    )
}

_FROM, _TO = (x.replace("'", "''") for x in tx._letters("NFKD"))
# the lists of the SQL are written out, not taken from the functions they are compared with
_STOP = """'a', 'ao', 'aos', 'as', 'com', 'da', 'das', 'de', 'do', 'dos', 'e', 'em', 'entre', 'foi', 'na', 'nas', 'no', 'nos', 'o', 'os', 'ou', 'para', 'pela', 'pelas', 'pelo', 'pelos',
    'por', 'qual', 'quais', 'que', 'se', 'sua', 'suas', 'seu', 'seus', 'um', 'uma'"""
_LABEL_STOP = """'com', 'das', 'dos', 'entre', 'foi', 'nas', 'nos', 'para', 'pela', 'pelas', 'pelo', 'pelos', 'por', 'qual', 'quais', 'que', 'sua', 'suas', 'seu', 'seus', 'uma', 'como', 'quanto', 'quanta',
    'quantos', 'quantas', 'onde', 'quando', 'sobre', 'segundo', 'valor'"""
_KEYS = ", ".join(f'"{x}":["VARCHAR"]' for x in fc.DIMENSIONS)
_DIMS = f"from_json(metadata.ontology_facets, '{{{_KEYS}}}')"
_CELL = "list_last(metadata.cells)"
_NUM = """trim(replace(replace(trim({c}), '%', ''), '−', '-'))"""


def _plain(c: str) -> str:
    s = _NUM.format(c=c)
    return f"CASE WHEN contains({s}, ',') THEN replace(replace({s}, '.', ''), ',', '.') WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}(\\.[0-9]{{3}})+') THEN replace({s}, '.', '') ELSE {s} END"


def _literal(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[-−]?([0-9]{{1,3}}(\\.[0-9]{{3}})+|[0-9]+)(,[0-9]+)?\\s*%?') THEN TRY_CAST({_plain(c)} AS DECIMAL(38,6)) END"


_CHANGES = """s AS (SELECT path, max(CASE WHEN snapshot = 'old' THEN sha256 END) AS o, max(CASE WHEN snapshot = 'new' THEN sha256 END) AS n,
       bool_or(snapshot = 'old') AS was, bool_or(snapshot = 'new') AS is_now FROM manifest GROUP BY path),
    changes AS (SELECT path, CASE WHEN NOT was THEN 'added' WHEN NOT is_now THEN 'removed' ELSE 'modified' END AS change FROM s
                WHERE NOT was OR NOT is_now OR o IS DISTINCT FROM n)"""
_WANTED = "(len({d}.indicator) = 0 OR list_has_any({d}.indicator, ['producao'])) AND (len({d}.unit) = 0 OR list_has_any({d}.unit, ['tonelada', 'saca_60kg']))"


def _facet(dimension: str) -> str:
    """The ids of a dimension by patterns RE2 can read: a look-behind becomes the removal of what must not precede."""
    parts = []
    for dim, i, p in sorted(fc.VOCABULARY):
        if dim == dimension:
            text = "raw"
            if p.startswith("(?<!des)"):
                p, text = p[len("(?<!des)"):], "replace(replace(raw, 'desocupacao', '#'), 'desemprego', '#')"
            parts.append(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{i}' END")
    out = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    if dimension == "sector":
        out = f"list_filter({out}, lambda x: NOT (x = 'industria' AND (regexp_matches(raw, 'industria de transformacao') OR regexp_matches(raw, 'industria extrativa'))))"
    return f"array_to_string({out}, ',') AS {dimension}"


SQL = {
    "fold_text": "SELECT doc_id, md5(strip_accents(lower(title))) AS folded FROM documents",
    "bm25_tokens": f"""SELECT item_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT item_id, list_filter(regexp_extract_all(
        translate(lower(pergunta), '{_FROM}', '{_TO}'), '[0-9]+(?:[.,/-][0-9]+)*|[a-z]+'), lambda x: x NOT IN ({_STOP})) AS t FROM test_items)""",
    "rare_terms": f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(strip_accents(lower(resposta_esperada)),
        '[0-9]+(?:[.,/-][0-9]+)*[a-z]?|[a-z]{{3,}}'), lambda x: x NOT IN ({_LABEL_STOP})))), ' ') AS terms FROM test_items""",
    "control_chars": "SELECT page_id, length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS n FROM pages WHERE text IS NOT NULL",
    "token_estimates": "SELECT doc_id, (length(text) + 3) // 4 AS tokens, (length(text) + 5) // 4 AS packing FROM documents",
    "claim_split": "SELECT item_id, trim(c) AS claim FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(resposta_esperada, '([!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS c FROM test_items) WHERE trim(c) <> ''",
    "excerpts": "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN text[:4000] || '…' ELSE text END) AS excerpt FROM documents",
    "ptbr_numbers": f"WITH {_ONCE} SELECT node_id, {_plain(_CELL)} AS plain, CAST({_literal(_CELL)} AS DOUBLE) AS value FROM once WHERE chunk_strategy = 'row_per_chunk'",
    "period_granularity": f"""WITH {_ONCE}, c AS (SELECT metadata.cells[3] AS c FROM once WHERE type = 'table' AND metadata.cells[3] IS NOT NULL)
        SELECT CASE WHEN regexp_full_match(c, '[0-9]{{4}}') THEN 'year' WHEN regexp_full_match(c, '[0-9]{{4}}-Q[1-4]') THEN 'quarter' WHEN regexp_full_match(c, '[0-9]{{4}}-[0-9]{{2}}') THEN 'month'
        WHEN regexp_full_match(c, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'day' ELSE 'unknown' END AS granularity, length(c) AS size, count(*) AS n FROM c GROUP BY ALL""",
    "facets_found": f"""WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^Fonte:')),
            lambda x: strip_accents(lower(x))), lambda x: NOT regexp_matches(x, '{fc.PUBLICATION}')), chr(10)) AS raw FROM documents WHERE lang = 'pt')
        SELECT doc_id, {', '.join(_facet(x) for x in ('indicator', 'unit', 'scale', 'sector', 'basis', 'kind'))} FROM t""",
    "dimension_histogram": f"WITH {_ONCE}, f AS (SELECT {_DIMS} AS f FROM once), x AS (" + " UNION ALL ".join(f"SELECT '{x}' AS dimension, unnest(f.{x}) AS value FROM f" for x in fc.DIMENSIONS) + ") SELECT dimension, value, count(*) AS n FROM x GROUP BY ALL",
    "available_combinations": f"""WITH {_ONCE}, f AS (SELECT {_DIMS} AS f FROM once WHERE type = 'table')
        SELECT array_to_string(f.indicator, ',') AS indicator, array_to_string(f.period, ',') AS period, array_to_string(f.unit, ',') AS unit, array_to_string(f.scale, ',') AS scale, count(*) AS n
        FROM f WHERE len(f.indicator) = 1 AND len(f.period) = 1 AND len(f.unit) = 1 GROUP BY ALL""",
    "coverage_gaps": f"""WITH {_ONCE}, f AS (SELECT {_DIMS} AS f FROM once WHERE type = 'table'), i AS (SELECT unnest(f.indicator) AS indicator, f.period AS p FROM f),
        h AS (SELECT DISTINCT indicator, unnest(p) AS period FROM i), w AS (SELECT unnest(['pib', 'producao', 'exportacao', 'rendimento']) AS indicator), y AS (SELECT CAST(unnest(range(2000, 2026)) AS VARCHAR) AS period)
        SELECT w.indicator, y.period FROM w CROSS JOIN y ANTI JOIN h ON h.indicator = w.indicator AND h.period = y.period ORDER BY 1, 2 LIMIT 100""",
    "value_divergences": f"""WITH {_ONCE}, f AS (SELECT {_DIMS} AS f, metadata.cells[1] AS place, {_literal(_CELL)} AS value FROM once WHERE chunk_strategy = 'row_per_chunk'),
        g AS (SELECT {', '.join(f"coalesce(array_to_string(f.{x}, ','), '') AS {x}" for x in fc.DIMENSIONS if x != 'source')}, place, count(DISTINCT value) AS alternatives, count(*) AS observations, min(value) AS lowest, max(value) AS highest
              FROM f WHERE value IS NOT NULL AND len(f.indicator) = 1 AND len(f.period) = 1 GROUP BY ALL)
        SELECT indicator, period, unit, scale, place, alternatives, observations, CAST(lowest AS DOUBLE) AS lowest, CAST(highest AS DOUBLE) AS highest FROM g WHERE alternatives >= 2""",
    "candidate_filter": f"WITH {_ONCE}, f AS (SELECT node_id, {_DIMS} AS f FROM once) SELECT node_id FROM f WHERE f IS NULL OR ({_WANTED.format(d='f')})",
    "observation_match": f"WITH {_ONCE}, f AS (SELECT node_id, {_DIMS} AS f FROM once) SELECT node_id FROM f WHERE list_has_any(f.indicator, ['producao']) AND list_has_any(f.unit, ['tonelada', 'saca_60kg'])",
    "deterministic_ids": f"""WITH {_ONCE} SELECT node_id, sha256(concat_ws('::', coalesce(source_file, ''), coalesce(page, ''), coalesce(type, ''), coalesce(CAST(chunk_id AS VARCHAR), ''), coalesce(text, '')))[:32] AS sha FROM once""",
    "page_ordinals": f"""WITH {_ONCE} SELECT node_id, row_number() OVER (PARTITION BY source_file, page ORDER BY coalesce(chunk_id, -1), node_id) AS ordinal, count(*) OVER (PARTITION BY source_file, page) AS on_page FROM once""",
    "table_chunks": f"""WITH {_ONCE}, r AS (SELECT table_key, text, node_id, row_number() OVER (PARTITION BY table_key ORDER BY coalesce(metadata.row, 0), node_id) AS ordinal, count(*) OVER (PARTITION BY table_key) AS total_rows
            FROM once WHERE chunk_strategy = 'row_per_chunk' AND table_key IS NOT NULL)
        SELECT table_key, 'full_table' AS strategy, 1 AS ordinal, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY ordinal)) AS text, total_rows, false AS truncated FROM r WHERE total_rows <= 10 GROUP BY table_key, total_rows
        UNION ALL SELECT table_key, 'row_per_chunk', ordinal, md5(text), total_rows, total_rows > 1000 FROM r WHERE total_rows > 10 AND ordinal <= 1000""",
    "short_fragments": f"""WITH {_ONCE}, r AS (SELECT source_file, text, sum(CASE WHEN length(text) >= 250 THEN 1 ELSE 0 END) OVER (PARTITION BY source_file ORDER BY page NULLS FIRST, chunk_id NULLS FIRST, node_id) AS island FROM once WHERE type = 'text')
        SELECT source_file, island, coalesce(sum(length(text)), 0) + greatest(count(text) - 1, 0) AS n_chars, count(*) AS parts FROM r GROUP BY source_file, island""",
    "small_tables": f"""WITH {_ONCE}, t AS (SELECT table_key, node_id, text, coalesce(metadata.row, 0) AS row FROM once WHERE type = 'table' AND table_key IS NOT NULL)
        SELECT table_key, first(node_id ORDER BY row, node_id) AS id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY row, node_id)) AS text, count(*) AS rows FROM t GROUP BY table_key
        HAVING count(*) BETWEEN 2 AND 30 AND sum(length(text)) <= 6000""",
    "context_headers": f"""WITH {_ONCE} SELECT node_id, concat_ws(' | ', source_file, coalesce(nullif(table_title, ''), nullif(metadata.table_descricao, '')),
        CASE WHEN table_title IS NULL AND metadata.table_descricao IS NULL THEN section END, metadata.sheet) AS header FROM once""",
    "structured_rows": f"""WITH {_ONCE} SELECT node_id, array_to_string(list_concat(list_filter([CASE WHEN trim(metadata.cells[1]) <> '' THEN 'municipio: ' || metadata.cells[1] END, CASE WHEN trim(metadata.cells[2]) <> '' THEN 'codigo: ' || metadata.cells[2] END,
        CASE WHEN trim(metadata.cells[3]) <> '' THEN 'periodo: ' || metadata.cells[3] END, CASE WHEN trim(metadata.cells[4]) <> '' THEN 'valor: ' || metadata.cells[4] END], lambda x: x IS NOT NULL), ['Fonte: ' || source_file]), chr(10)) AS row_text
        FROM once WHERE chunk_strategy = 'row_per_chunk'""",
    "chat_budget": """WITH b AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 0 ELSE length(props) END) OVER w AS fixed, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS many FROM events WINDOW w AS (PARTITION BY user_id))
        SELECT event_id, CASE WHEN event_type = 'view' THEN least(length(props), greatest(CAST(floor((400 - fixed) / greatest(many, 1)) AS BIGINT), 0)) ELSE length(props) END AS kept_chars FROM b""",
    "snapshot_changes": f"WITH {_CHANGES} SELECT * FROM changes",
    "latest_nodes": f"WITH {_ONCE} SELECT node_id, source_file, ingested_at FROM once",
    "incremental_index": f"WITH {_ONCE}, {_CHANGES} SELECT CASE WHEN source_file IN (SELECT path FROM changes) THEN 'fresh' ELSE 'index' END AS origin, count(*) AS n FROM once GROUP BY 1",
    "stale_vectors": f"WITH {_CHANGES} SELECT vec_id FROM chunk_vectors WHERE node_id IN (SELECT node_id FROM nodes WHERE source_file IN (SELECT path FROM changes WHERE change <> 'added'))",
    "embedding_cache_misses": "SELECT DISTINCT sha256(text) AS key FROM nodes WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM nodes WHERE text IS NOT NULL AND node_id IN (SELECT node_id FROM chunk_vectors WHERE node_id IS NOT NULL))",
    "files_by_type": f"WITH {_ONCE} SELECT source_file, count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'image') AS images FROM once GROUP BY 1",
    "number_format": "SELECT l_shipdate, replace(CAST(CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(20,4))) / 7 AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR), '.', ',') AS shown FROM lineitem GROUP BY 1",
    "section_titles": """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[:3] AS l FROM documents),
        f AS (SELECT doc_id, list_filter(l, lambda x: length(x) BETWEEN 5 AND 90 AND len(regexp_split_to_array(x, '\\s+')) <= 10 AND (regexp_matches(x, '^\\s*([0-9]+(\\.[0-9]+)*|[IVX]+)[\\.\\-\\)]\\s+.+')
            OR (length(regexp_replace(x, '[^\\pL]', '', 'g')) > 0 AND length(regexp_replace(x, '[^\\p{Lu}]', '', 'g')) > 0.6 * length(regexp_replace(x, '[^\\pL]', '', 'g')))
            OR (length(x) <= 60 AND regexp_matches(' ' || regexp_replace(strip_accents(lower(x)), '[^a-z0-9_]', ' ', 'g') || ' ', ' (introducao|panorama|conjuntura|mercado de trabalho|industria|comercio|servicos|agropecuaria|inflacao|pib|emprego|resultados|consideracoes) '))))[1] AS found FROM l)
        SELECT * FROM f WHERE found IS NOT NULL""",
    "periods_found": f"""WITH {_ONCE}, a AS (SELECT node_id, strip_accents(lower(text)) AS t0 FROM once WHERE type = 'text'),
        b AS (SELECT *, regexp_replace(t0, '{pe.DAY_ISO}', ' # ', 'g') AS t1 FROM a), c AS (SELECT *, regexp_replace(t1, '{pe.DAY}', ' # ', 'g') AS t2 FROM b), d AS (SELECT *, regexp_replace(t2, '{pe.MONTH_ISO}', ' # ', 'g') AS t3 FROM c),
        e AS (SELECT *, regexp_replace(t3, '{pe.MONTH}', ' # ', 'g') AS t4 FROM d), f AS (SELECT *, regexp_replace(t4, '{pe.QUARTER}', ' # ', 'g') AS t5 FROM e), g AS (SELECT *, regexp_replace(t5, '{pe.NAMED}', ' # ', 'g') AS t6 FROM f)
        SELECT node_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(
            list_transform(regexp_extract_all(t0, '{pe.DAY_ISO}'), lambda x: strftime(try_strptime(x, '%Y-%m-%d'), '%Y-%m-%d')),
            list_transform(regexp_extract_all(t1, '{pe.DAY}'), lambda x: strftime(try_strptime(replace(x, '-', '/'), '%d/%m/%Y'), '%Y-%m-%d')),
            regexp_extract_all(t2, '{pe.MONTH_ISO}'),
            list_transform(regexp_extract_all(t3, '{pe.MONTH}'), lambda x: regexp_extract(x, '{pe.MONTH}', 2) || '-' || lpad(regexp_extract(x, '{pe.MONTH}', 1), 2, '0')),
            list_transform(regexp_extract_all(t4, '{pe.QUARTER}'), lambda x: regexp_extract(x, '{pe.QUARTER}', 2) || '-Q' || x[1]),
            list_transform(regexp_extract_all(t5, '{pe.NAMED}'), lambda x: regexp_extract(x, '{pe.NAMED}', 2) || '-' || lpad(CAST(list_position([{', '.join(f"'{m[:3]}'" for m in pe.MONTHS)}], x[:3]) AS VARCHAR), 2, '0')),
            regexp_extract_all(t6, '{pe.YEAR}')), lambda x: x IS NOT NULL))), ',') AS periods FROM g""",
}
