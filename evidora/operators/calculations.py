"""Decimal calculations after a plan: a table of operations over cells, with reasons where a plan is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.numbers import formatted, operand

BINARY = ("difference", "percent_change", "percentage_points")
OPERATIONS = (*BINARY, "sum", "mean")


def calculate(plans: DataFrame, cells: DataFrame, max_operands: int = 100) -> DataFrame:
    """(plan_id, operation, result, shown, formula, operands, refused) of plans (plan_id, operation, operand_no, cell_id).

    cells: (cell_id, value, unit, indicator, region, period).  Refused, in this order: unknown_operation, operand_count,
    repeated_cell, missing_cell, not_a_number, unit, scope, base, percent_unit.  A refused plan has no result.
    """
    used = plans.join(cells, "cell_id", "left").withColumn("number", operand(F.col("value")))
    ordered = F.array_sort(F.collect_list(F.struct("operand_no", "number", "value")))
    g = used.groupBy("plan_id", "operation").agg(
        ordered.alias("x"),
        F.count("*").alias("operands"),
        F.count_distinct("cell_id").alias("cells"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(F.col("number").isNull()).alias("unread"),
        F.count_distinct(F.coalesce("unit", F.lit(""))).alias("units"),
        F.min(F.coalesce("unit", F.lit(""))).alias("unit"),
        F.count_distinct("indicator", "region").alias("scopes"),
    )
    a, b = F.get("x", F.lit(0))["number"], F.get("x", F.lit(1))["number"]
    op = F.col("operation")
    refused = (
        F.when(~op.isin(*OPERATIONS), "unknown_operation")
        .when((F.col("operands") > max_operands) | (op.isin(*BINARY) & (F.col("operands") != 2)), "operand_count")
        .when(F.col("cells") < F.col("operands"), "repeated_cell")
        .when(F.col("missing") > 0, "missing_cell")
        .when(F.col("unread") > 0, "not_a_number")
        .when((F.col("units") != 1) | (F.col("unit") == ""), "unit")
        .when(F.col("scopes") > 1, "scope")
        .when((op == "percent_change") & (a <= 0), "base")
        .when((op == "percentage_points") & (F.col("unit") != "percentual"), "percent_unit")
    )
    total = F.aggregate("x", F.lit(0).cast("decimal(38,6)"), lambda s, e: (s + e["number"]).cast("decimal(38,6)"))
    change = ((b - a) * 100).cast("decimal(38,8)") / F.when(a != 0, a).cast("decimal(38,6)")
    result = F.when(op.isin("difference", "percentage_points"), b - a).when(op == "percent_change", change.cast("decimal(38,6)")).when(op == "sum", total).when(op == "mean", (total / F.col("operands")).cast("decimal(38,6)"))
    result = F.when(refused.isNull(), result.cast("decimal(38,6)"))
    suffix = F.when(op == "percent_change", " %").when(op == "percentage_points", " p.p.").otherwise("")
    literal = F.transform("x", lambda e: e["value"])
    sign = F.when(op == "sum", " + ").when(op == "mean", " ; ").otherwise(" -> ")
    return g.select("plan_id", "operation", result.alias("result"), F.concat(formatted(result), suffix).alias("shown"), F.concat(op, F.lit("("), F.aggregate(F.slice(literal, 2, F.greatest(F.size(literal) - 1, F.lit(0))), F.coalesce(F.get(literal, F.lit(0)), F.lit("")), lambda s, e: F.concat(s, sign, F.coalesce(e, F.lit("")))), F.lit(")")).alias("formula"), "operands", refused.alias("refused"))
