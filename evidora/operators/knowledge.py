"""Reports over observations: what the collection covers, where it has gaps, and where it contradicts itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.facets import DIMENSIONS

CONFLICT_DIMENSIONS = ("indicator", "region", "period", "unit", "scale", "sector")


def _each(dims: Column) -> Column:
    return F.array(*(F.struct(F.lit(d).alias("dimension"), dims[d].alias("found")) for d in DIMENSIONS))


def dimension_histogram(observations: DataFrame, dims: str = "dims") -> DataFrame:
    """(dimension, value, n): how many observations carry each value of each dimension."""
    rows = observations.select(F.explode(_each(F.col(dims))).alias("x")).select("x.dimension", F.explode("x.found").alias("value"))
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def combinations(observations: DataFrame, by: tuple[str, ...], single: tuple[str, ...], dims: str = "dims") -> DataFrame:
    """(by..., n): observations of each combination of values; the `single` dimensions must have exactly one value."""
    d = F.col(dims)
    rows = observations.select(*(d[x].alias(x) for x in by))
    for x in single:
        rows = rows.where(F.size(x) == 1)
    return rows.groupBy(*(F.array_join(x, ",").alias(x) for x in by)).agg(F.count("*").alias("n"))


def gaps(observations: DataFrame, by: tuple[str, ...], wanted: dict[str, list[str]], limit: int = 100, dims: str = "dims") -> DataFrame:
    """The wanted combinations that no observation carries, in order, at most `limit`: a report of requested values."""
    asked = observations.sparkSession.range(1).select()
    for x in by:
        asked = asked.withColumn(x, F.explode(F.array(*(F.lit(v) for v in wanted[x]))))
    have = observations.select(*(F.explode(F.col(dims)[by[0]]).alias(by[0]) if i == 0 else F.col(dims)[x].alias(x) for i, x in enumerate(by)))
    for x in by[1:]:
        have = have.withColumn(x, F.explode(x))
    return asked.join(have.distinct(), list(by), "left_anti").orderBy(*by).limit(limit)


def filter_candidates(candidates: DataFrame, wanted: Column, given: Column) -> DataFrame:
    """Drops a candidate if in some dimension both sides are known and share nothing; the unknown passes."""
    conflict = [(F.size(wanted[d]) > 0) & (F.size(given[d]) > 0) & ~F.arrays_overlap(wanted[d], given[d]) for d in CONFLICT_DIMENSIONS]
    out = conflict[0]
    for c in conflict[1:]:
        out = out | c
    return candidates.where(~out)


def observation_matches(wanted: Column, given: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """The strict test: every wanted dimension must be shared."""
    out = F.lit(True)
    for d in dimensions:
        out = out & ((F.size(wanted[d]) == 0) | F.arrays_overlap(wanted[d], given[d]))
    return out


def divergences(observations: DataFrame, value: str = "value", core: tuple[str, ...] = ("indicator", "period", "unit"), also: tuple[str, ...] = (), dims: str = "dims", id_col: str = "id") -> DataFrame:
    """(signature..., also..., alternatives, observations, lowest, highest): equal scope, different values.

    All dimensions but the source sign an observation; the core ones must be single.  Values are compared as decimals.
    """
    d = F.col(dims)
    rows = observations.where(F.col(value).isNotNull())
    for x in core:
        rows = rows.where(F.size(d[x]) == 1)
    signed = [F.array_join(d[x], ",").alias(x) for x in DIMENSIONS if x != "source"]
    groups = rows.groupBy(*signed, *also).agg(F.count_distinct(value).alias("alternatives"), F.count("*").alias("observations"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.min(id_col).alias("first_id"))
    return groups.where("alternatives >= 2")
