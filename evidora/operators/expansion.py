"""From the first hits to their surroundings: label matches, parents, context of tables, observations; and splitting by sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions.text import fold, packing_tokens, rare_terms
from evidora.scratch import stored

_END = re.compile(r"(?<=[.!?])\s+|\n+")


def sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Literal pieces of at most `size` characters made of whole sentences; the last sentences of a piece, up to `overlap`
    characters, begin the next.  Longer sentences are cut at the size."""
    ends = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    units: list[tuple[int, int]] = []
    for a, b in zip(ends, ends[1:], strict=False):
        units.extend((i, min(i + size, b)) for i in range(a, b, size))
    out, first = [], 0
    while first < len(units):
        last = first
        while last + 1 < len(units) and units[last + 1][1] - units[first][0] <= size:
            last += 1
        out.append(text[units[first][0] : units[last][1]])
        if last + 1 == len(units):
            break
        following = last + 1
        back = following
        while back - 1 > first and units[last][1] - units[back - 1][0] <= overlap and units[following][1] - units[back - 1][0] <= size:
            back -= 1
        first = back
    return [x for x in out if x.strip()]


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(id, ordinal, chunk) of each text; null and blank texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, c) for i, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) if t for k, c in enumerate(sentence_chunks(t, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "chunk"])

    return docs.select(id_col, text_col).mapInPandas(run, f"id {dict(docs.dtypes)[id_col]}, ordinal int, chunk string")


def parents_of(docs: DataFrame, id_col: str, text_col: str, size: int = 3200) -> DataFrame:
    """(parent_id, id, ordinal, text): blocks without overlap, named by the hash of where they stand and what they say."""
    blocks = chunked(docs, id_col, text_col, size, 0)
    name = F.concat(F.lit("parent:"), F.substring(F.sha2(F.concat_ws("::", F.col("id").cast("string"), F.col("ordinal").cast("string"), "chunk"), 256), 1, 32))
    return blocks.select(name.alias("parent_id"), "id", "ordinal", F.col("chunk").alias("text"))


def expand_parents(hits: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, position, children): hits (query_id, id, position, parent_id) with children of one parent replaced by it.

    The parent stands where its best child stood; a parent (parent_id, text) of more tokens than the budget stays out and its
    children stay.
    """
    fits = parents.where(packing_tokens(F.col("text")) + 2 <= budget).select("parent_id", F.lit(True).alias("fits"))
    rows = hits.join(fits, "parent_id", "left").withColumn("as", F.when(F.col("fits"), F.col("parent_id")).otherwise(F.col("id")))
    g = rows.groupBy("query_id", F.col("as").alias("id")).agg(F.min("position").alias("first"), F.count("*").alias("children"))
    w = Window.partitionBy("query_id").orderBy("first", "id")
    return g.select("query_id", "id", F.row_number().over(w).alias("position"), "children")


def _in_both(run):
    """Blocks on one side only have no rows; their kinds come from what the other blocks give."""

    def both(members: pa.Table, asked: pa.Table) -> pa.Table:
        if members.num_rows and asked.num_rows:
            return run(members, asked)
        return run(members.slice(0, 0), asked.slice(0, 0))

    return both


def _term_counts(members: pa.Table, asked: pa.Table) -> pa.Table:
    """(scope, term, df) of the asked terms in the members of a block."""
    terms = pc.unique(asked.column("term"))
    codes = pc.drop_null(pc.index_in(pc.list_flatten(members.column("terms")), value_set=terms)).to_numpy()
    df = np.bincount(codes, minlength=len(terms))
    have = np.flatnonzero(df)
    return pa.table({"scope": pa.repeat(asked.column("scope")[0], len(have)) if len(have) else asked.column("scope").slice(0, 0), "term": terms.take(pa.array(have)), "df": pa.array(df[have])})


def _label_scores(k: int):
    """(query_id, id, score): the k best members of a block for each query with terms in their scope, its seeds left out."""

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        coded = members.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        ids = coded.dictionary.take(pc.sort_indices(coded.dictionary, null_placement="at_start"))
        place = pc.index_in(members.column("id"), value_set=ids).to_numpy()
        terms, flat = pc.unique(asked.column("term").drop_null()), pc.list_flatten(members.column("terms"))
        found = pc.index_in(flat, value_set=terms)
        said = found.is_valid().to_numpy()
        code, who = found.drop_null().to_numpy(), place[pc.list_parent_indices(members.column("terms")).to_numpy()[said]]
        order = np.argsort(code, kind="stable")
        who, start = who[order], np.searchsorted(code[order], np.arange(len(terms) + 1))
        queries = pc.unique(asked.column("query_id"))
        query, term = pc.index_in(asked.column("query_id"), value_set=queries).to_numpy(), pc.fill_null(pc.index_in(asked.column("term"), value_set=terms, skip_nulls=True), -1).to_numpy()
        weight, own = pc.fill_null(asked.column("weight"), 0.0).to_numpy(), pc.fill_null(pc.index_in(asked.column("own"), value_set=ids, skip_nulls=True), -1).to_numpy()
        order = np.argsort(query, kind="stable")
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, rows in enumerate(np.split(order, np.searchsorted(query[order], np.arange(1, len(queries))))):
            lists = rows[term[rows] >= 0]
            if not len(lists):
                continue
            met = np.concatenate([who[start[t] : start[t + 1]] for t in term[lists]])
            score = np.bincount(met, np.repeat(weight[lists], start[term[lists] + 1] - start[term[lists]]), len(ids))
            score[own[rows[own[rows] >= 0]]] = 0
            some = np.flatnonzero(score > 0)
            best = some[np.lexsort((some, -np.round(score[some], 6)))[:k]]
            out.append((np.full(len(best), q), best, score[best]))
        q, best, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": queries.take(pa.array(q)), "id": ids.take(pa.array(best)), "score": pa.array(score)})

    return run


def label_candidates(questions: DataFrame, seeds: DataFrame, members: DataFrame, k: int = 8, block: int = 16384) -> DataFrame:
    """(query_id, id, score, position): members of the seeds' scopes that repeat terms of the question that are rare there.

    questions (query_id, question), seeds (query_id, id, rank from 0), members (scope, id, text).  A term weighs log(members / those
    with the term) in its scope; a scope counts for its best seed; a member keeps its best scope.

    Postings are not shuffled: the members of a scope are sent in blocks of about `block`, once to count the asked terms and once
    to score them, and only the k best of a block go on.
    """
    kinds = dict(members.dtypes) | {"query_id": dict(questions.dtypes)["query_id"]}
    hits = stored(seeds.join(members.select("scope", "id"), "id").select("query_id", "scope", "id", "rank"), "hits")
    scope = hits.groupBy("query_id", "scope").agg(F.min("rank").alias("rank"))
    size = members.groupBy("scope").agg(F.count("*").alias("size")).where("size >= 2").join(hits.select("scope").distinct(), "scope", "left_semi")
    size = stored(size.withColumn("parts", F.ceil(F.col("size") / block)), "sizes")
    placed = members.join(size, "scope").select("scope", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", F.coalesce(rare_terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    placed = stored(placed, "members")
    asked = questions.select("query_id", F.explode(rare_terms(F.col("question"))).alias("term"))
    asked = stored(scope.join(asked, "query_id").join(size, "scope").select("query_id", "scope", "rank", "term", "size", "parts"), "asked")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    terms = asked.select("scope", "term", "parts").distinct().select("scope", part, "term")
    counts = placed.groupBy("scope", "part").cogroup(terms.groupBy("scope", "part")).applyInArrow(_in_both(_term_counts), f"scope {kinds['scope']}, term string, df long")
    weight = stored(counts.groupBy("scope", "term").agg(F.sum("df").alias("df")).join(size, "scope").select("scope", "term", F.log(F.col("size") / F.col("df")).alias("weight")).where("weight > 0"), "weights")
    said = asked.join(weight, ["scope", "term"]).select("scope", "parts", "query_id", "term", (F.col("weight") / (F.col("rank") + 1)).alias("weight"), F.lit(None).cast(kinds["id"]).alias("own"))
    own = hits.join(size, "scope").select("scope", "parts", "query_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight"), F.col("id").alias("own"))
    right = said.union(own).select("scope", part, "query_id", "term", "weight", "own")
    best = placed.groupBy("scope", "part").cogroup(right.groupBy("scope", "part")).applyInArrow(_in_both(_label_scores(k)), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    scored = best.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def context_links(tables: DataFrame, texts: DataFrame, least: int = 8) -> DataFrame:
    """(source_id, label, target_id, evidence): texts of the same file and page that contain a table's title or a note literally,
    or name it ("Tabela 3") without its title.

    tables (id, source_file, page, title, notes), texts (id, source_file, page, text).
    """
    line = lambda c: F.trim(F.get(F.split(c, "\n"), F.lit(0)))
    each = F.concat(F.array(F.struct(F.lit("TEM_TITULO").alias("label"), F.coalesce("title", F.lit("")).alias("literal"))), F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.struct(F.lit("TEM_NOTA").alias("label"), F.coalesce(n, F.lit("")).alias("literal"))))
    said = tables.select(F.col("id").alias("source_id"), "source_file", "page", F.explode(each).alias("x")).select("source_id", "source_file", "page", "x.label", line(F.col("x.literal")).alias("evidence")).where(F.length("evidence") >= least)
    there = texts.select(F.col("id").alias("target_id"), "source_file", "page", "text")
    literal = said.join(there, ["source_file", "page"]).where(F.contains("text", F.col("evidence")))
    marker = F.regexp_extract("title", r"(?i)^((?:tabela|quadro)\s+[0-9]+)\b", 1)
    named = tables.select(F.col("id").alias("source_id"), "source_file", "page", "title", marker.alias("evidence")).where("evidence <> ''").join(there, ["source_file", "page"])
    whole = F.regexp_replace(fold(F.col("text")), r"[^a-z0-9]+", " ")
    named = named.where(F.contains(F.concat(F.lit(" "), whole, F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(fold(F.col("evidence")), r"[^a-z0-9]+", " "), F.lit(" "))) & ~F.contains("text", line(F.col("title"))))
    cols = ["source_id", "label", "target_id", "evidence"]
    return literal.select(cols).union(named.select("source_id", F.lit("DESCRITA_EM").alias("label"), "target_id", "evidence")).distinct()


def table_captions(tables: DataFrame, blocks: DataFrame, above: float = 90.0, below: float = 80.0) -> DataFrame:
    """(table_id, title, notes): the nearest caption above and up to four nearest notes below each table of the same page.

    tables (table_id, page, x0, y0, x1, y1), blocks (page, x0, y0, x1, y1, text); boxes must overlap horizontally.
    """
    t, b = tables.alias("t"), blocks.alias("b")
    over = F.least("t.x1", "b.x1") > F.greatest("t.x0", "b.x0")
    up, down = F.col("t.y0") - F.col("b.y1"), F.col("b.y0") - F.col("t.y1")
    kind = F.when(up.between(0, above) & fold(F.col("b.text")).rlike(r"^\s*(tabela|quadro)\s+[0-9]+"), "title").when(down.between(0, below) & fold(F.col("b.text")).rlike(r"^\s*(nota|fonte|obs)"), "note")
    near = t.join(b, (F.col("t.page") == F.col("b.page")) & over).select("t.table_id", kind.alias("kind"), F.least(F.abs(up), F.abs(down)).alias("far"), "b.text").where("kind is not null")
    w = Window.partitionBy("table_id", "kind").orderBy("far", "text")
    best = near.withColumn("n", F.row_number().over(w)).where("(kind = 'title' and n = 1) or (kind = 'note' and n <= 4)")
    got = best.groupBy("table_id").agg(F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "note", F.struct("n", "text")))), lambda x: x["text"]).alias("notes"))
    return tables.select("table_id").join(got, "table_id", "left")


def settings_problems(settings: DataFrame, limits: DataFrame) -> DataFrame:
    """(name, problem): settings (name, value) that are unknown, no whole number, or out of the bounds of limits (name, low, high)."""
    j = settings.join(limits, "name", "left").withColumn("v", F.col("value").try_cast("long"))
    why = F.when(F.col("low").isNull(), "unknown").when(F.col("v").isNull() | ~F.col("value").rlike(r"^-?[0-9]+$"), "not_an_integer").when((F.col("v") < F.col("low")) | (F.coalesce(F.col("v") > F.col("high"), F.lit(False))), "out_of_bounds")
    return j.select("name", why.alias("problem")).where("problem is not null")


def rollup_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counts of the values of several columns in one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))
    return df.select(F.explode(each).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def payload_problems(cells: Column, columns: Column, max_columns: int = 50, max_chars: int = 5000) -> Column:
    """Why a literal table row is refused: its width, its names, or an oversized cell; null if it is fine."""
    return F.when(F.size(columns) > max_columns, "too_many_columns").when(F.size(F.array_distinct(columns)) < F.size(columns), "repeated_column").when(F.size(cells) != F.size(columns), "arity").when(F.exists(cells, lambda c: F.length(c) > max_chars), "cell_too_long")
