"""Chunks, rows, pages and tables: structure given to texts and repaired where it was lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTE = r"^(nota|notas|fonte|obs|\([0-9]+\)|\*)"


def deterministic_id(source: Column, page: Column, kind: Column, ordinal: Column, content: Column, length: int = 32) -> Column:
    """The first characters of the SHA-256 of where a chunk stands and what it says; null parts are empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source, page, kind, ordinal, content)]
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, length)


def page_ordinals(chunks: DataFrame, order: Column, source_col: str = "source_file", page_col: str = "page") -> DataFrame:
    """Adds `ordinal`, the running number of a chunk on its page, and `on_page`, how many there are."""
    w = Window.partitionBy(source_col, page_col)
    return chunks.withColumn("ordinal", F.row_number().over(w.orderBy(order))).withColumn("on_page", F.count("*").over(w))


def markdown_rows(text: Column) -> Column:
    """Array of rows (arrays of cells) of a table in markdown: separator lines and rows of another width are dropped.

    Empty if the header has empty or repeated names.  A header of running integers gives way to the first row if that has words.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+\|$"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    width = F.size(F.try_element_at(rows, F.lit(1)))
    rows = F.filter(rows, lambda r: F.size(r) == width)
    head = F.try_element_at(rows, F.lit(1))
    counted = F.forall(head, lambda c: c.rlike("^[0-9]+$"))
    words = F.exists(F.try_element_at(rows, F.lit(2)), lambda c: ~c.rlike(r"^[-0-9.,%\s]*$"))
    rows = F.when(counted & F.coalesce(words, F.lit(False)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows)
    head = F.try_element_at(rows, F.lit(1))
    sound = F.coalesce((F.size(F.array_distinct(head)) == F.size(head)) & ~F.array_contains(head, ""), F.lit(False))
    return F.when(sound, rows).otherwise(F.array().cast("array<array<string>>"))


def row_text(columns: Column, cells: Column, source: Column) -> Column:
    """Lines `column: value` of the cells that are not blank, and the source."""
    lines = F.filter(F.zip_with(columns, cells, lambda c, v: F.when(F.trim(v) != "", F.concat(c, F.lit(": "), v))), lambda x: x.isNotNull())
    return F.array_join(F.concat(lines, F.array(F.concat(F.lit("Fonte: "), source))), "\n")


def table_chunks(rows: DataFrame, table_col: str, order_col: str, text_col: str, small: int = 10, at_most: int = 1000) -> DataFrame:
    """(table, strategy, ordinal, text, total_rows, truncated): a small table is one chunk, a larger one a chunk per row.

    `at_most` rows of a table are kept: the feature of the operator, told by truncated.
    """
    w = Window.partitionBy(table_col)
    ranked = rows.withColumn("total_rows", F.count("*").over(w)).withColumn("ordinal", F.row_number().over(w.orderBy(order_col, text_col)))
    whole = ranked.where(F.col("total_rows") <= small).groupBy(table_col, "total_rows").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text_col))), lambda x: x[text_col]), "\n---\n").alias("text"))
    each = ranked.where((F.col("total_rows") > small) & (F.col("ordinal") <= at_most))
    return whole.select(table_col, F.lit("full_table").alias("strategy"), F.lit(1).alias("ordinal"), "text", "total_rows", F.lit(False).alias("truncated")).union(
        each.select(table_col, F.lit("row_per_chunk"), "ordinal", text_col, "total_rows", F.col("total_rows") > at_most)
    )


def short_fragments_joined(chunks: DataFrame, least: int, source_col: str, order: list[str], text_col: str = "text") -> DataFrame:
    """(source, island, id, text, parts): each full chunk with the fragments of fewer than `least` characters that follow it.

    Fragments before the first full chunk of a source form an island of their own.
    """
    w = Window.partitionBy(source_col).orderBy(*order)
    rows = chunks.withColumn("_at", F.row_number().over(w)).withColumn("island", F.sum((F.length(text_col) >= least).cast("int")).over(w))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_at", text_col))), lambda x: x[text_col])
    return rows.groupBy(source_col, "island").agg(F.array_join(joined, "\n").alias("text"), F.count("*").alias("parts"))


def small_tables_merged(rows: DataFrame, table_col: str, id_col: str, text_col: str, order: list[str], max_rows: int = 30, max_chars: int = 6000) -> DataFrame:
    """(table, id, text, rows): tables of few and short rows become the text of their first row; others are left out."""
    sizes = rows.where(F.col(table_col).isNotNull()).groupBy(table_col).agg(F.count("*").alias("rows"), F.sum(F.length(text_col)).alias("chars")).where((F.col("rows") <= max_rows) & (F.col("chars") <= max_chars) & (F.col("rows") > 1))
    kept = rows.join(sizes.select(table_col, "rows"), table_col)  # bounded by max_rows and max_chars a table
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("_text"), F.col(id_col).alias("_id"))))
    got = kept.groupBy(table_col, "rows").agg(ordered.alias("x"))
    return got.select(table_col, F.col("x")[0]["_id"].alias("id"), F.array_join(F.transform("x", lambda e: e["_text"]), "\n---\n").alias("text"), "rows")


def footnotes(rows: DataFrame, table_col: str, cells_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Rows without footnotes, and (table, notes): rows with one filled cell that begins like a note."""
    filled = F.filter(cells_col, lambda c: F.trim(c) != "")
    note = (F.size(filled) == 1) & F.lower(F.trim(F.try_element_at(filled, F.lit(1)))).rlike(NOTE)
    notes = rows.where(note).select(table_col, order, F.trim(F.element_at(filled, 1)).alias("note"))
    found = notes.groupBy(table_col, "note").agg(F.min(order).alias("at")).groupBy(table_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]).alias("notes"))
    return rows.where(~F.coalesce(note, F.lit(False))), found


def context_header(source: Column, title: Column, description: Column, sheet: Column, section: Column) -> Column:
    """What a chunk is about, put before its text for search: document, table or section, and sheet."""
    return F.concat_ws(" | ", source, F.coalesce(F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))), F.when(title.isNull() & description.isNull(), section), sheet)


def chat_budget(messages: DataFrame, budget: int, conversation: str, role: str, text: str, cut_role: str) -> DataFrame:
    """Messages with `kept_chars`: those of the cut role share what the others leave of the budget evenly."""
    w = Window.partitionBy(conversation)
    cut = F.col(role) == cut_role
    fixed = F.sum(F.when(cut, 0).otherwise(F.length(text))).over(w)
    many = F.sum(cut.cast("int")).over(w)
    share = F.greatest(F.floor((budget - fixed) / F.greatest(many, F.lit(1))), F.lit(0))
    return messages.withColumn("kept_chars", F.when(cut, F.least(F.length(text).cast("long"), share)).otherwise(F.length(text).cast("long")))
