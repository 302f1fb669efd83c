"""Choosing what reaches a context: diversity of documents, budgets with coverage, observations, gaps, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions.facets import DIMENSIONS

REQUIRED = ("indicator", "region", "period", "unit", "scale", "sector")


def document_diversity(ranked: DataFrame, limit: int, per_source: int = 3, source_col: str = "source") -> DataFrame:
    """(query_id, id, place): at most `per_source` rows of a source in rank order, then the others in rank order."""
    w = Window.partitionBy("query_id", source_col).orderBy("position", "id")
    rows = ranked.withColumn("_late", (F.row_number().over(w) > per_source) & F.col(source_col).isNotNull())
    w = Window.partitionBy("query_id").orderBy("_late", "position", "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query_id", "id", "place")


def pack_context(units: DataFrame, wanted: DataFrame, budget: int) -> DataFrame:
    """(query_id, id, place, size): units (query_id, id, position, size, carried) taken one by one, always the one that carries most
    of what is still wanted, then the best ranked, then the smallest, as long as it fits the budget.

    One query's ranked list is one group: its size is that of a list of candidates, not of the collection.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["position", "size", "id"]).reset_index(drop=True)
        want = f["wanted"].iloc[0]
        bit = {v: 1 << i for i, v in enumerate(dict.fromkeys(want if want is not None else []))}
        mark = [sum({bit.get(v, 0) for v in (c if c is not None else [])}) for c in f["carried"]]
        size = f["size"].tolist()
        rest, open_, room, taken = list(range(len(f))), sum(bit.values()), budget, []
        while True:
            fits = [i for i in rest if size[i] <= room]
            if not fits:
                break
            best = max(fits, key=lambda i: ((mark[i] & open_).bit_count(), -i))
            rest.remove(best)
            taken.append(best)
            room -= size[best]
            open_ &= ~mark[best]
        return pd.DataFrame({"query_id": f["query_id"].iloc[taken], "id": f["id"].iloc[taken], "place": range(1, len(taken) + 1), "size": [size[i] for i in taken]})

    kind = dict(units.dtypes)
    rows = units.join(wanted, "query_id", "left").withColumn("size", F.col("size").cast("long"))
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, place int, size long")


def ranked_observations(observations: DataFrame, wanted: Column, k: int, id_col: str = "id", dims: str = "dims") -> DataFrame:
    """(id, conflicts, matches, position) of the k observations that fit best: fewest conflicts, most matches, then by id.

    A dimension conflicts if both sides are known and share nothing; it matches if they share something.  Observations that
    miss a required wanted dimension are left out.
    """
    d = F.col(dims)
    share = lambda x: F.arrays_overlap(wanted[x], d[x])
    needed = F.lit(True)
    for x in REQUIRED:
        needed = needed & ((F.size(wanted[x]) == 0) | F.coalesce(share(x), F.lit(False)))
    count = lambda conds: sum((c.cast("int") for c in conds), F.lit(0))
    conflicts = count([(F.size(wanted[x]) > 0) & (F.size(d[x]) > 0) & ~share(x) for x in DIMENSIONS])
    matches = count([(F.size(wanted[x]) > 0) & F.coalesce(share(x), F.lit(False)) for x in DIMENSIONS])
    rows = observations.where(needed).select(id_col, conflicts.alias("conflicts"), matches.alias("matches")).orderBy("conflicts", F.desc("matches"), id_col).limit(k)
    return rows.withColumn("position", F.row_number().over(Window.orderBy("conflicts", F.desc("matches"), id_col)))


def gap_sources(missing: DataFrame, carried: DataFrame, per_value: int = 2, at_most: int = 6) -> DataFrame:
    """(query_id, id, value): nodes that carry a value a query still misses, `per_value` for each value and `at_most` in all."""
    met = missing.join(carried, "value")
    w = Window.partitionBy("query_id", "value").orderBy("id")
    rows = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_value)
    w = Window.partitionBy("query_id").orderBy("_n", "value", "id")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= at_most).select("query_id", "id", "value")


def batches(blocks: DataFrame, group: str, order: list[str], size_col: str, budget: int) -> DataFrame:
    """Adds `batch`: consecutive blocks of a group up to the budget; a block above it is a batch of its own.

    Rows stream through a task in order, so a group of any size needs no more memory than a batch of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used = None, 0, 0
        for f in frames:
            out = []
            for g, n in zip(f[group], f[size_col], strict=True):
                if g != now:
                    now, batch, used = g, 1, 0
                elif used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield f.assign(batch=out)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in blocks.schema.fields)
    return blocks.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, f"{fields}, batch int")


def marker_counts(answers: DataFrame, markers: list[tuple[str, str]], forbidden: str | None, id_col: str, text: Column) -> DataFrame:
    """(id, found, asked): how many marker patterns an answer contains; a forbidden pattern leaves none."""
    hits = sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for _, p in markers), F.lit(0))
    found = F.when(F.coalesce(text.rlike(forbidden), F.lit(False)), 0).otherwise(hits) if forbidden else hits
    return answers.select(id_col, found.alias("found"), F.lit(len(markers)).alias("asked"))


def distribution_problems(rows: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(value, n, expected) of the values whose count is not the expected one."""
    want = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    have = rows.groupBy(F.coalesce(by, F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    named = rows.sparkSession.createDataFrame([(k,) for k in expected], "value string")
    return named.join(have, "value", "full_outer").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(want[F.col("value")], F.lit(0)).alias("expected")).where("n <> expected")
