"""Keeping an index in step with its files: snapshots, changes, incremental merges, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest order; map-side combined."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_x"))
    return top.select(*key, *(F.col("_x")[c].alias(c) for c in rest)).select(df.columns)


def detect_changes(old: DataFrame, new: DataFrame, key: str = "path", compare: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """(key, change) of the files that were added, removed or modified between two snapshots; repeated rows count once."""
    o = old.select(key, F.struct(*compare).alias("o")).distinct().groupBy(key).agg(F.max("o").alias("o"))
    n = new.select(key, F.struct(*compare).alias("n")).distinct().groupBy(key).agg(F.max("n").alias("n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def sync_action(changes: DataFrame, files: int, same_pipeline: bool, same_vocabulary: bool) -> str:
    """Whether to do nothing, annotate again, index the changes, or rebuild."""
    if not same_pipeline:
        return "full"
    n = changes.count()
    if n == 0:
        return "none" if same_vocabulary else "annotate"
    return "full" if n * 2 > files else "incremental"


def incremental_merge(index: DataFrame, fresh: DataFrame, changed: DataFrame, source_col: str, id_col: str) -> DataFrame:
    """The index after an update: rows of changed sources leave, fresh rows enter, an id stands once."""
    kept = index.join(changed, source_col, "left_anti").join(fresh.select(id_col), id_col, "left_anti")
    return kept.select(index.columns).union(fresh.select(index.columns)).dropDuplicates([id_col])


def cache_misses(texts: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Distinct keys of texts that the cache does not hold, with one text each."""
    return texts.withColumn("key", key).join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, fingerprint): a hash of all rows that does not depend on their order.

    Row hashes are summed in three 21-bit parts, so that sums of any size stay exact; nothing is gathered.
    """
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = df.select(*columns).agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws(":", *(F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("fingerprint"))
