"""Streams of events: rate limits per client, windowed counters, and upserts of an index by source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admit(times: list[float], before: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which requests are admitted: at most `limit` in any `window` seconds; those refused do not count."""
    kept, out = list(before), []
    for t in times:
        kept = [x for x in kept if t - x <= window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out, kept


def rate_limited(events: DataFrame, limit: int, window: float, client: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(client, id, admitted) over a finished table.

    After a pause longer than the window nothing is remembered, so a client's requests are divided at such pauses and each run of
    requests is judged on its own, in order of time.  Rows without client or time are left out.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    w = Window.partitionBy(client).orderBy("s", id_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for f in frames:
            out = []
            for key in zip(f[client], f["_run"], f["s"], strict=True):
                if key[:2] != now:
                    now, kept = key[:2], []
                ok, kept = admit([key[2]], kept, limit, window)
                out.extend(ok)
            yield pd.DataFrame({client: f[client], id_col: f[id_col], "admitted": out})

    kinds = dict(events.dtypes)
    rows = events.select(client, id_col, seconds.alias("s")).where(F.col(client).isNotNull() & F.col("s").isNotNull())
    rows = rows.withColumn("_new", (F.col("s") - F.lag("s").over(w) > window).cast("int")).withColumn("_run", F.coalesce(F.sum("_new").over(w), F.lit(0)))
    ordered = rows.repartition(client, "_run").sortWithinPartitions(client, "_run", "s", id_col)
    return ordered.mapInPandas(run, f"{client} {kinds[client]}, {id_col} {kinds[id_col]}, admitted boolean")


def rate_limited_stream(stream: DataFrame, limit: int, window: float, client: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The same on a stream: the admitted times of the last window are the state of a client.

    Events of one micro-batch are ordered by time; events older than the newest admitted one are judged when they arrive.
    """
    kinds = dict(stream.dtypes)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values(["s", id_col])
        ok, kept = admit(f["s"].tolist(), before, limit, window)
        state.update((kept,))
        yield pd.DataFrame({client: f[client], id_col: f[id_col], "admitted": ok})

    rows = stream.select(client, id_col, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("s"))
    return rows.groupBy(client).applyInPandasWithState(run, f"{client} {kinds[client]}, {id_col} {kinds[id_col]}, admitted boolean", "kept array<double>", "append", "NoTimeout")


def request_metrics(events: DataFrame, path: str = "event_type", value: str = "value", window: str | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(path, requests, errors, latency_sum, latency_max), per tumbling window if one is given; later events than `late` are
    dropped on streams."""
    keys = [F.col(path)]
    if window:
        if events.isStreaming:
            events = events.withWatermark(ts, late)
        keys.insert(0, F.window(ts, window).alias("window"))
    return events.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(F.col(path) == "error").alias("errors"), F.sum(value).alias("latency_sum"), F.max(value).alias("latency_max"))


def prometheus(metrics: DataFrame, path: str = "event_type") -> DataFrame:
    """(line): the counters in the text format of metric scrapers."""
    names = ("requests", "errors", "latency_sum", "latency_max")
    line = lambda n: F.concat(F.lit(f'app_{n}{{path="'), F.col(path), F.lit('"} '), F.col(n).cast("string"))
    return metrics.select(F.explode(F.array(*(line(n) for n in names))).alias("line"))


def upsert_by_source(stream: DataFrame, path: str, source: str, checkpoint: str):
    """Writes a stream of rows into a table partitioned by source: a micro-batch replaces the sources it brings."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
