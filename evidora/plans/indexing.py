"""From page texts to an index of annotated chunks, and its update when files change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.facets import with_facets
from evidora.functions.text import section_title, without_control
from evidora.operators import chunking, expansion
from evidora.operators import index_lifecycle as ix


def text_index(pages: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """(node_id, source_file, page, ordinal, on_page, section, text, dims) of page texts (source_file, page, text).

    A page read twice counts once, with its longest text; chunks of a page share its section title.
    """
    once = pages.where("text is not null").groupBy("source_file", "page").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    titled = once.withColumn("section", section_title(F.col("text"))).withColumn("key", F.to_json(F.struct("source_file", "page")))
    parts = expansion.chunked(titled, "key", "text", size, overlap)
    rows = parts.join(titled.select("key", "source_file", "page", "section"), parts["id"] == F.col("key")).select("source_file", "page", "section", "ordinal", without_control(F.col("chunk")).alias("text"))
    placed = chunking.page_ordinals(rows.withColumnRenamed("ordinal", "at"), F.col("at"))
    name = chunking.deterministic_id(F.col("source_file"), F.col("page"), F.lit("text"), F.col("ordinal"), F.col("text"))
    return with_facets(placed.withColumn("node_id", name), "text").select("node_id", "source_file", "page", "ordinal", "on_page", "section", "text", "dims")


def updated_index(index: DataFrame, old: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """The index after files changed between two snapshots (path, sha256): only their pages are read again."""
    changes = ix.detect_changes(old, new)
    changed = changes.select(F.col("path").alias("source_file"))
    live = changes.where("change <> 'removed'").select(F.col("path").alias("source_file"))
    fresh = text_index(pages.join(live, "source_file", "left_semi"))
    return ix.incremental_merge(index, fresh, changed, "source_file", "node_id")
