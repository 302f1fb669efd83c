"""Rows that fail to parse: reasons for the failures, typed values for the rest.

Records are split by one possessive pattern per delimiter (no backtracking, whatever the length), the cells exploded to
(row, position, value), joined with the table of column rules and judged by built-in expressions.  Only failing cells
reach an aggregation; clean rows come from an anti-join with the errors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n "
#: Signs for a missing value in decimal columns; fixed values of the data description.
MISSING = ("...", "-", "NA", "x")
PATTERNS = {
    "codigo": r"^[0-9]{7}\z",
    "ano": r"^(199[0-9]|20[0-2][0-9])\z",
    "trimestre": r"^[1-4]º?\z",
    "inteiro": r"^-?[0-9]+\z",
    "decimal_virgula": r"^-?([0-9]++|[0-9]{1,3}(\.[0-9]{3})++)(,[0-9]+)?\z",
    "decimal_ponto": r"^-?[0-9]+(\.[0-9]+)?\z",
}


def _field(delimiter: str) -> str:
    d = re.escape(delimiter)
    return rf'"[^"]*+(?:""[^"]*+)*+"|(?!")[^"{d}]*+'


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def _day(v: Column) -> Column:
    return F.when(v.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), F.try_to_date(v, "dd/MM/yyyy")).when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(v, "yyyy-MM-dd"))


def _valid(kind: Column, v: Column) -> Column:
    """Whether a trimmed, non-empty value is of its kind; an unknown kind accepts anything."""
    out = F.when(kind == "data", _day(v).isNotNull())
    for k, p in PATTERNS.items():
        ok = v.rlike(p)
        out = out.when(kind == k, ok | v.isin(*MISSING) if k.startswith("decimal") else ok)
    return out.otherwise(True)


def parsed_rows(raw: DataFrame, layouts: DataFrame, id_col: str = "raw_id", record: str = "metadata.cells") -> DataFrame:
    """(id, layout_id, well_quoted, fields, columns): the fields of each record, unquoted, and the columns of its layout.

    fields is null where the quoting is broken, the record is null or the layout unknown; columns is 0 for an unknown layout.
    """
    widths = layouts.groupBy("layout_id").agg(F.min("delimiter").alias("delimiter"), F.count("*").alias("columns"))
    delimiters = sorted(r[0] for r in layouts.select("delimiter").where("delimiter is not null").distinct().collect())
    rows = raw.select(F.col(id_col).alias("id"), "layout_id", F.col(record).alias("record")).join(widths, "layout_id", "left")
    well = fields = F.lit(None)
    for d in delimiters:
        f, x = _field(d), re.escape(d)
        mine = F.col("delimiter") == d
        well = F.when(mine, F.col("record").rlike(rf"^(?:{f})(?:{x}(?:{f}))*+\z")).otherwise(well)
        fields = F.when(mine, F.regexp_extract_all(F.concat(F.lit(d), "record"), F.lit(f"{x}({f})"), 1)).otherwise(fields)
    unquoted = F.transform(fields.cast("array<string>"), lambda v: F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    rows = rows.withColumn("well_quoted", F.coalesce(well.cast("boolean"), F.lit(True)))
    return rows.select("id", "layout_id", "well_quoted", F.when(F.col("well_quoted") & F.col("record").isNotNull(), unquoted).alias("fields"), F.coalesce("columns", F.lit(0)).alias("columns"))


def row_errors(raw: DataFrame, layouts: DataFrame, id_col: str = "raw_id", record: str = "metadata.cells") -> DataFrame:
    """(id, reason, bad_columns) of the rows that fail, with the first reason that holds: quoting, column_count, invalid_value.

    A null record and a record of an unknown layout have no fields: column_count.  Repeated ids count as one row.
    """
    rows = parsed_rows(raw, layouts, id_col, record)
    fits = F.col("well_quoted") & F.col("fields").isNotNull() & (F.size("fields") == F.col("columns"))
    shape = rows.where(~fits).select("id", F.when(F.col("well_quoted"), "column_count").otherwise("quoting").alias("reason"), F.array().cast("array<string>").alias("bad_columns"))
    cells = rows.where(fits).select("id", "layout_id", F.posexplode("fields").alias("at", "value")).withColumn("pos", F.col("at") + 1)
    rules = layouts.select("layout_id", "pos", "column_name", "kind", "required")
    judged = cells.join(rules, ["layout_id", "pos"]).withColumn("value", _trimmed(F.col("value")))
    bad = F.when(F.col("value") == "", F.coalesce("required", F.lit(False))).otherwise(~_valid(F.col("kind"), F.col("value")))
    values = judged.where(bad).groupBy("id").agg(F.sort_array(F.collect_set("column_name")).alias("bad_columns"))
    values = values.select("id", F.lit("invalid_value").alias("reason"), "bad_columns")
    return shape.union(values).withColumnRenamed("id", id_col)


def clean_rows(raw: DataFrame, layouts: DataFrame, id_col: str = "raw_id", record: str = "metadata.cells") -> DataFrame:
    """(id, layout_id, fields) of the rows without errors, fields trimmed."""
    errors = row_errors(raw, layouts, id_col, record).select(F.col(id_col).alias("id"))
    rows = parsed_rows(raw, layouts, id_col, record).join(errors, "id", "left_anti")
    return rows.select(F.col("id").alias(id_col), "layout_id", F.transform("fields", _trimmed).alias("fields"))


def _typed(v: Column, kind: str) -> Column:
    """A clean value in the type of its kind; missing-value signs and empty fields are null."""
    v = F.when(~v.isin("", *(MISSING if kind.startswith("decimal") else ())), v)
    if kind == "data":
        return _day(v)
    if kind == "decimal_virgula":
        v = F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    if kind.startswith("decimal"):
        return v.try_cast("decimal(38,6)")
    if kind in ("ano", "trimestre"):
        return F.replace(v, F.lit("º"), F.lit("")).try_cast("int")
    return v.try_cast("long") if kind == "inteiro" else v


def typed_rows(raw: DataFrame, layouts: DataFrame, layout_id: int, id_col: str = "raw_id") -> DataFrame:
    """The clean rows of one layout with a typed column for each of its columns; missing-value signs and empty fields are null."""
    columns = layouts.where(F.col("layout_id") == layout_id).orderBy("pos").collect()
    rows = clean_rows(raw.where(F.col("layout_id") == layout_id), layouts, id_col)
    return rows.select(id_col, *(_typed(F.element_at("fields", r["pos"]), r["kind"]).alias(r["column_name"]) for r in columns))


def typed_values(raw: DataFrame, layouts: DataFrame, id_col: str = "raw_id") -> DataFrame:
    """(id, layout_id, column_name, text, whole, number, day) of the clean rows of all layouts: a row for each column, its value in the
    column of its type; all four are null for a missing-value sign or an empty field."""
    cells = clean_rows(raw, layouts, id_col).select(id_col, "layout_id", F.posexplode("fields").alias("at", "value")).withColumn("pos", F.col("at") + 1)
    cells = cells.join(layouts.select("layout_id", "pos", "column_name", "kind"), ["layout_id", "pos"])
    types = {"whole": ("ano", "trimestre", "inteiro"), "number": ("decimal_virgula", "decimal_ponto"), "day": ("data",)}
    others = ~F.coalesce(F.col("kind").isin(*(k for kinds in types.values() for k in kinds)), F.lit(False))
    out = {"text": F.when(others, _typed(F.col("value"), "texto"))}
    out |= {t: F.coalesce(*(F.when(F.col("kind") == k, _typed(F.col("value"), k)) for k in kinds)) for t, kinds in types.items()}
    return cells.select(id_col, "layout_id", "column_name", *(c.alias(t) for t, c in out.items()))
