"""Observations: single values with everything that says what they measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.facets import DIMENSIONS, stored_facets, with_facets
from evidora.functions.text import claims

UNIQUE = ("indicator", "region", "period", "unit")


def _filled(first: Column, second: Column) -> Column:
    return F.struct(*(F.when(F.size(first[d]) > 0, first[d]).otherwise(second[d]).alias(d) for d in DIMENSIONS))


def issues_of(dims: Column) -> Column:
    """Names of the dimensions that must be unique and are not."""
    return F.array_compact(F.array(*(F.when(F.size(dims[d]) != 1, F.lit(d)) for d in UNIQUE)))


def table_observations(rows: DataFrame, facets_json: Column, title_col: str, value: Column, id_col: str = "node_id") -> DataFrame:
    """(obs_id, node_id, value, dims, issues, status): the value of a table row with the facets of the row, where they are
    unknown those of the table's title.  Rows without an indicator give none."""
    staged = with_facets(rows.withColumn("_value", value).withColumn("_row", stored_facets(facets_json)), title_col, "_title")
    out = staged.select(F.col(id_col), F.col("_value").alias("value"), _filled(F.col("_row"), F.col("_title")).alias("dims")).where("value is not null and size(dims.indicator) > 0")
    sign = F.concat(F.lit("obs:"), F.substring(F.sha2(F.concat_ws("::", F.col(id_col), "value"), 256), 1, 24))
    issues = issues_of(F.col("dims"))
    return out.select(sign.alias("obs_id"), id_col, "value", "dims", issues.alias("issues"), F.when(F.size(issues) == 0, "structured_candidate").otherwise("requires_review").alias("status"))


def narrative_observations(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, claim_no, value, dims, issues): the numbers of each claim with the facets of the claim; claims without an indicator
    give none, years and parts of dates are no values."""
    number = r"(?<![\w.,/-])[-−]?[0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?(?![\w/º-])"
    each = texts.select(F.col(id_col).alias("id"), F.posexplode(claims(F.col(text_col))).alias("claim_no", "claim"))
    staged = with_facets(each, "claim", "dims").where("size(dims.indicator) > 0")
    found = staged.select("id", "claim_no", "dims", F.explode(F.filter(F.regexp_extract_all("claim", F.lit(number), F.lit(0)), lambda x: ~x.rlike(r"^(19|20)[0-9]{2}$"))).alias("value"))
    return found.select("id", "claim_no", "value", "dims", issues_of(F.col("dims")).alias("issues"))


def comparison_issues(observations: DataFrame, group: str, dims: str = "dims") -> DataFrame:
    """(group, issues): why the observations of a group cannot be compared.

    indicator and unit must be single and equal, scale and sector equal, periods single and distinct.
    """
    d = F.col(dims)
    aggs = []
    for x in ("indicator", "unit", "scale", "sector", "period"):
        aggs += [F.count_distinct(F.array_join(d[x], ",")).alias(f"n_{x}"), F.max(F.size(d[x]) != 1).alias(f"loose_{x}")]
    g = observations.groupBy(group).agg(F.count("*").alias("n"), *aggs)
    rules = [F.when((F.col(f"n_{x}") > 1) | F.col(f"loose_{x}"), x) for x in ("indicator", "unit")] + [F.when(F.col(f"n_{x}") > 1, x) for x in ("scale", "sector")]
    rules.append(F.when(F.col("loose_period") | (F.col("n_period") < F.col("n")), "period"))
    return g.select(group, F.array_compact(F.array(*rules)).alias("issues"))


def missing_values(wanted: DataFrame, observations: DataFrame, id_col: str, dims: str = "dims") -> DataFrame:
    """(id, indicator, period) wanted by a question that no single observation carries together."""
    have = observations.select(F.explode(F.col(dims)["indicator"]).alias("indicator"), F.col(dims)["period"].alias("p")).select("indicator", F.explode("p").alias("period")).distinct()
    return wanted.select(id_col, "indicator", "period").distinct().join(have, ["indicator", "period"], "left_anti")
