"""Rankings per query: exact cosine, BM25, fusion, diversification, thresholds and packing.

Every operator works on many queries at once; ties are broken by position or id.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, EPSILON = 1.5, 0.75, 0.25


def unit_vector(v: Column) -> Column:
    """The vector in double precision with length one; null for vectors without direction."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.when(norm > 0, F.transform(x, lambda e: e / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str, vector_col: str, query_block: int = 4096, corpus_block: int = 16_384) -> DataFrame:
    """(query_id, id, score, position): exact cosine of every query with every other row, the k best; ties go to the smaller id.

    A stated query set meets all rows in blocks: a task multiplies one block of queries with one block of rows and keeps its k
    best per query, so its memory is bounded and only k rows per query and block leave it.  Vectors without direction take no part.
    """
    import numpy as np
    import pandas as pd

    unit = lambda df, name: df.select(F.col(id_col).cast(kind).alias(name), unit_vector(F.col(vector_col)).alias("u")).where("u is not null")
    kind = dict(corpus.dtypes)[id_col]
    kind = "bigint" if kind in ("int", "bigint", "smallint", "tinyint") else kind
    asked, rows = unit(queries, "query_id"), unit(corpus, "id")
    n_asked, n_rows = max(1, -(-asked.count() // query_block)), max(1, -(-rows.count() // corpus_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = asked.select("*", block("query_id", n_asked).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("cb"))
    rows = rows.select("*", block("id", n_rows).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("id")
        ids, ids_q = b["id"].to_numpy(), a["query_id"].to_numpy()
        m, q = np.array(b["u"].tolist()), np.array(a["u"].tolist())
        out = []
        for i in range(0, len(q), 512):
            s = np.round(q[i : i + 512] @ m.T, 9)
            s[ids_q[i : i + 512, None] == ids[None, :]] = -9
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, order, axis=1)
            out.append(pd.DataFrame({"query_id": np.repeat(ids_q[i : i + 512], order.shape[1]), "id": ids[order].ravel(), "score": top.ravel()}))
        f = pd.concat(out)
        return f[f.score > -9]

    found = asked.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInPandas(best, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def bm25(queries: DataFrame, docs: DataFrame, tokens_col: str, k: int, query_block: int = 2048, doc_block: int = 16_384) -> DataFrame:
    """(query_id, id, score, position) of the k best documents by Okapi BM25.

    queries has (query_id, tokens), docs (id, tokens).  A query term counts as often as it occurs.  Terms in more than half of
    the documents would weigh negatively: they weigh EPSILON of the mean weight.  Frequencies come from map-side combined
    counts; then blocks of weighted queries meet blocks of documents, each keeping its k best per query, so that common terms
    emit no rows.
    """
    import numpy as np
    import pandas as pd

    docs = docs.select("id", F.col(tokens_col).alias("tokens")).where("tokens is not null")
    stats = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0)).alias("mean_size")).first()
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", (F.log(stats["n_docs"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).join(idf, "term")
    n_q, n_d = max(1, -(-queries.count() // query_block)), max(1, -(-stats["n_docs"] // doc_block))
    mean_size = float(stats["mean_size"]) or 1.0
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), block("query_id", n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("db"))
    rows = docs.select("id", "tokens", block("id", n_d).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
        if not len(a) or not len(b):
            return empty
        names, at = np.unique(a["query_id"].to_numpy(), return_inverse=True)
        index = {t: (g["at"].to_numpy(), g["weight"].to_numpy()) for t, g in a.assign(at=at).groupby("term")}
        b = b.sort_values("id")
        ids = b["id"].to_numpy()
        best: list[pd.DataFrame] = []
        for i in range(0, len(b), 512):
            m = np.zeros((min(512, len(b) - i), len(names)))
            for j, tokens in enumerate(b["tokens"].iloc[i : i + 512]):
                long = K1 * (1 - B + B * len(tokens) / mean_size)
                for t, tf in Counter(tokens).items():
                    if (hit := index.get(t)) is not None:
                        m[j, hit[0]] += hit[1] * (tf * (K1 + 1) / (tf + long))
            m = np.round(m, 6)
            order = np.argsort(-m, axis=0, kind="stable")[:k]
            top = np.take_along_axis(m, order, axis=0)
            doc, q = np.nonzero(top > 0)
            best.append(pd.DataFrame({"query_id": names[q], "id": ids[i + order[doc, q]], "score": top[doc, q]}))
        return pd.concat(best).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)

    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["id"]
    found = asked.groupBy("qb", "db").cogroup(rows.groupBy("qb", "db")).applyInPandas(score, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, id, position): score, ranks by list, and the fused position."""
    fused = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("position"))).alias("score"), F.array_sort(F.collect_list(F.struct("list", "position"))).alias("ranks"), F.min(F.struct("list", "position")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", "id")
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "ranks", F.row_number().over(w).alias("fused"))


def rrf_filtered(lists: DataFrame, keep: Column, k: int = 60) -> DataFrame:
    """As rrf, but rows are filtered before they get their positions, and a list votes once for an id."""
    kept = lists.where(keep).groupBy("query_id", "list", "id").agg(F.min("position").alias("position"))
    w = Window.partitionBy("query_id", "list").orderBy("position", "id")
    return rrf(kept.withColumn("position", F.row_number().over(w)), k)


def diversify(ranked: DataFrame, limit: int, per_table: int, table_col: str = "table_key") -> DataFrame:
    """Keeps the order of `position` and at most `per_table` rows of a table (0: any number); rows without a table are free."""
    if per_table > 0:
        w = Window.partitionBy("query_id", table_col).orderBy("position", "id")
        ranked = ranked.withColumn("_n", F.when(F.col(table_col).isNotNull(), F.row_number().over(w))).where(F.col("_n").isNull() | (F.col("_n") <= per_table)).drop("_n")
    w = Window.partitionBy("query_id").orderBy("position", "id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def reranked(ranked: DataFrame, score: Column, head: int) -> DataFrame:
    """The first `head` rows sorted by another score, the tail after them in its old order."""
    rows = ranked.withColumn("_s", F.when(F.col("position") <= head, score))
    w = Window.partitionBy("query_id").orderBy(F.col("position") > head, F.desc("_s"), "position", "id")
    return rows.withColumn("place", F.row_number().over(w)).drop("_s")


def accept_extras(initial: DataFrame, extras: DataFrame, at_most: int = 6, per_table: int = 2, floor: float = 0.02, share: float = 0.25) -> DataFrame:
    """Extras (query_id, id, score, table_key) that reach a share of the weakest initial score; tables count initial rows too."""
    weakest = initial.groupBy("query_id").agg(F.min("score").alias("weakest"))
    used = initial.where("table_key is not null").groupBy("query_id", "table_key").agg(F.count("*").alias("used"))
    rows = extras.join(weakest, "query_id").where(F.col("score") >= F.greatest(F.lit(floor), share * F.col("weakest")))
    rows = rows.join(initial.select("query_id", "id"), ["query_id", "id"], "left_anti").join(used, ["query_id", "table_key"], "left")
    w = Window.partitionBy("query_id", "table_key").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("_n", F.row_number().over(w) + F.coalesce("used", F.lit(0))).where(F.col("table_key").isNull() | (F.col("_n") <= per_table))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= at_most).select("query_id", "id", "score", "table_key", "place")


def pack_first_fit(ranked: DataFrame, budget: int, size_col: str = "tokens") -> DataFrame:
    """In rank order, every row that still fits: rows that do not fit are skipped and later ones may enter."""
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", F.col(size_col).cast("long").alias("size")))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<position:int,id:bigint,size:bigint>>").alias("kept"))

    def step(a: Column, e: Column) -> Column:
        fits = a["used"] + e["size"] <= budget
        row = F.struct(e["position"].cast("int").alias("position"), e["id"].cast("long").alias("id"), e["size"].alias("size"))
        return F.struct((a["used"] + F.when(fits, e["size"]).otherwise(0)).alias("used"), F.when(fits, F.concat(a["kept"], F.array(row))).otherwise(a["kept"]).alias("kept"))

    return rows.select("query_id", F.inline(F.aggregate("x", start, step)["kept"]))


def same_text_once(ranked: DataFrame, source_col: str, page_col: str, text_col: str) -> DataFrame:
    """Of rows with the same source, page and text but for white space, the first in rank."""
    sign = F.xxhash64(source_col, page_col, F.trim(F.regexp_replace(text_col, r"\s+", " ")))
    w = Window.partitionBy("query_id", sign).orderBy("position", "id")
    return ranked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def contained_once(ranked: DataFrame, keys: list[str], text_col: str, least: int = 100) -> DataFrame:
    """Drops rows whose text of at least `least` characters lies inside the text of a better row with the same keys."""
    a, b = ranked.alias("a"), ranked.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ["query_id", *keys]]
    inside = F.col(f"b.{text_col}").contains(F.col(f"a.{text_col}")) & (F.length(f"a.{text_col}") >= least) & (F.col("b.position") < F.col("a.position"))
    cond = inside
    for s in same:
        cond = cond & s
    return a.join(b, cond, "left_anti")
