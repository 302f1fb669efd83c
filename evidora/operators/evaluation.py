"""Paired comparison of configurations: coverage, wins and losses, exact sign test, bootstrap intervals."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p-value; ties are left out; 1 without any win or loss."""
    n, k = wins + losses, F.least(wins, losses)
    # the binomial coefficients of row n, each over 2**n, built one from the other in logarithms
    first = -n * F.log(F.lit(2.0))
    step = lambda s, i: (lambda c: F.struct(c.alias("c"), (s["sum"] + F.exp(c)).alias("sum")))(s["c"] + F.log((n - i + 1) / i))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, F.struct(first.alias("c"), F.exp(first).alias("sum")), step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 9))


def paired(results: DataFrame, first: str, second: str) -> DataFrame:
    """One row comparing two variants of (question, variant, score): difference, wins, losses, ties, p."""
    mean = results.groupBy("question").agg(F.avg(F.when(F.col("variant") == first, F.col("score"))).alias("a"), F.avg(F.when(F.col("variant") == second, F.col("score"))).alias("b")).where("a is not null and b is not null")
    g = mean.agg(F.round(F.sum(F.col("a") - F.col("b")), 6).alias("difference"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
    return g.select("*", sign_test(F.col("wins"), F.col("losses")).alias("p"))


def bootstrap(differences: DataFrame, group: str, value: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """(group, low, high): percentile interval of the summed differences of a group, reproducible for a seed."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed)
        x = sorted(f[value].tolist())
        totals = sorted(sum(rng.choices(x, k=len(x))) for _ in range(resamples))
        return pd.DataFrame({group: [f[group].iloc[0]], "low": [totals[int(0.025 * resamples)]], "high": [totals[int(0.975 * resamples) - 1]]})

    return differences.select(group, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).groupBy(group).applyInPandas(run, f"{group} string, low double, high double")


def covered_references(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(question, gold, covered): the gold references (question, file, page, passage) met by a found chunk of the file.

    A reference is met on its page, or without a page by a chunk that contains its passage.
    """
    page = F.col("g.page").isNotNull() & (F.col("f.page") == F.col("g.page"))
    passage = F.col("g.page").isNull() & F.col("g.passage").isNotNull() & F.col("f.text").contains(F.col("g.passage"))
    met = gold.alias("g").join(found.alias("f"), (F.col("g.question") == F.col("f.question")) & (F.col("g.file") == F.col("f.file")), "left")
    each = met.groupBy("g.question", "g.file", "g.page", "g.passage").agg(F.max(F.coalesce((page | passage).cast("int"), F.lit(0))).alias("met"))
    return each.groupBy("question").agg(F.count("*").alias("gold"), F.sum("met").alias("covered"))


def select_coverage(ranked: DataFrame, wanted: DataFrame, limit: int, per_source: int = 3) -> DataFrame:
    """(query_id, id, place): rows that together carry the wanted values first, then the rest, at most `per_source` of a source
    before the others.

    ranked (query_id, id, position, source, carried array of values), wanted (query_id, wanted array).  One query's ranking is
    one group: its size is that of a ranked list, not of the collection.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["position", "id"]).reset_index(drop=True)
        names = {v: 1 << i for i, v in enumerate(dict.fromkeys(f["wanted"].iloc[0] if f["wanted"].iloc[0] is not None else []))}
        marks = [sum(names.get(v, 0) for v in set(c if c is not None else [])) for c in f["carried"]]
        open_ = (1 << len(names)) - 1
        chosen: list[int] = []
        while open_ and len(chosen) < limit:
            gain, best = max((((m & open_).bit_count(), -i) for i, m in enumerate(marks) if i not in chosen), default=(0, 0))
            if not gain:
                break
            chosen.append(-best)
            open_ &= ~marks[-best]
        seen = f["source"].iloc[chosen].value_counts().to_dict() if chosen else {}
        later = []
        for i, s in enumerate(f["source"]):
            if i in set(chosen):
                continue
            if seen.get(s, 0) < per_source:
                seen[s] = seen.get(s, 0) + 1
                chosen.append(i)
            else:
                later.append(i)
        order = (chosen + later)[:limit]
        return pd.DataFrame({"query_id": f["query_id"].iloc[order], "id": f["id"].iloc[order], "place": range(1, len(order) + 1)})

    kind = dict(ranked.dtypes)
    return ranked.join(wanted, "query_id").groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, place int")

