"""Containers of fixed capacity filled with items of varying length.

Sizes are tokens of a public tokenizer.  The histogram of all sizes goes to the driver (at most `capacity` rows): dynamic
programming places the bucket boundaries that minimise padding.  Inside each bucket items form batches of at most the
capacity in tokens.  A bucket above half of the capacity holds single items then; a plan that combines buckets, the largest
first, fills containers further and can be chosen instead.  No group of items is ever gathered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.scratch import stored

#: The pattern that splits text before the merges of that vocabulary; a fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS, CHUNK = 64, 100_000
#: A text is tokenized in stretches of about so many characters, so that very long ones stay linear; cut at white space.
STRETCH = 100_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    enc = _encoding(path)
    if len(text) <= STRETCH:
        return len(enc.encode_ordinary(text))
    n = i = 0
    while i < len(text):
        j = min(len(text), i + STRETCH)
        while j < len(text) and not (text[j].isspace() and not text[j - 1].isspace()):
            j += 1
        n += len(enc.encode_ordinary(text[i:j]))
        i = j
    return n


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc, tokens) of each text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count_tokens(t, path) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(run, "doc long, tokens long")


def best_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets of the sizes 0..len(counts)-1 with the least padding of all items.

    A best bound is the size of some item.  The padding of the sizes after the i-th up to the j-th is a line in the bound, so a
    lower hull of lines gives the best beginning of every bucket: time and memory grow with buckets times sizes.
    """
    sizes = np.flatnonzero(counts).tolist()
    many, total = [0], [0]
    for x in sizes:
        many.append(many[-1] + int(counts[x]))
        total.append(total[-1] + int(counts[x]) * x)
    m = len(sizes)
    best: list[int | None] = [0] + [None] * m  # padding of the first j sizes
    ways = []
    for _ in range(min(buckets, m)):
        now, way = [None] * (m + 1), np.zeros(m + 1, dtype=np.int32)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, where the bucket begins
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-many[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) - at >= 2 and _useless(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            bound = sizes[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * bound + hull[at + 1][1] <= hull[at][0] * bound + hull[at][1]:
                at += 1
            if at < len(hull):
                now[j], way[j] = bound * many[j] - total[j] + hull[at][0] * bound + hull[at][1], hull[at][2]
        best = now
        ways.append(way)
    out, j = [], m
    for way in reversed(ways):
        out.append(sizes[j - 1])
        j = int(way[j])
    return out[::-1]


def _useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c; slopes fall."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def container_plan(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """For each bucket its runs (first rank, items in a container, first container), and the number of containers."""
    left = list(counts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in bounds]
    done = [0] * len(bounds)
    at = 0
    while any(left):
        room, take = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            k = min(room // bounds[b], left[b]) if bounds[b] else 0
            if k:
                take[b] = k
                room -= k * bounds[b]
        times = min(left[b] // k for b, k in take.items())
        for b, k in take.items():
            runs[b].append((done[b], k, at))
            done[b] += k * times
            left[b] -= k * times
        at += times
    return runs, at


def packed(docs: DataFrame, capacity: int, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, combine: bool = False) -> DataFrame:
    """(id, part_no, first_token, tokens, container): where each document goes; only those above the capacity are divided.

    path: the vocabulary of the tokenizer.  Containers hold items of one bucket, or of several if `combine`.  Parts of divided
    documents fill whole containers but for their last.  Documents without tokens need no room and have a null container.
    """
    counts = stored(token_counts(docs, id_col, text_col, path), "tokens")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / capacity))))
    items = counts.select("doc", "tokens", part.alias("part_no")).select("doc", F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part_no") * capacity).alias("tokens"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("tokens").count().collect():
        histogram[r["tokens"]] = r["count"]
    histogram[0] = 0
    bounds = best_bounds(histogram, buckets)
    chunks = max(1, int(histogram.sum()) // CHUNK)
    limits = np.array(bounds)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(n > 0, np.searchsorted(limits, n), -1).astype(np.int32))], names=[*b.schema.names, "bucket"])

    fields = "doc long, part_no int, first_token long, tokens long"
    placed = items.mapInArrow(bucket, f"{fields}, bucket int").withColumn("chunk", F.pmod(F.xxhash64("doc", "part_no"), F.lit(chunks)))
    out = f"{id_col} long, part_no int, first_token long, tokens long, container long"
    names = [id_col, "part_no", "first_token", "tokens", "container"]
    if combine:
        cuts = np.concatenate([[0], np.cumsum(histogram)])
        each = [int(cuts[hi + 1] - cuts[lo + 1]) for lo, hi in zip([0, *bounds], bounds, strict=False)]
        return _combined(placed, container_plan(bounds, each, capacity)[0], out, names)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items in order of bucket and chunk; a batch ends where the next item would exceed the capacity."""
        now, number, room = None, 0, 0
        for b in batches:
            container: list[int | None] = []
            for k, c, n in zip(*(b.column(x).to_pylist() for x in ("bucket", "chunk", "tokens")), strict=True):
                if k < 0:
                    container.append(None)
                    continue
                if (k, c) != now:
                    now, number, room = (k, c), ((k * chunks + c) << 32) - 1, 0
                if n > room:
                    number, room = number + 1, capacity
                room -= n
                container.append(number)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc", "part_no", "first_token", "tokens")), pa.array(container, pa.int64())], names=names)

    return placed.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "doc", "part_no").mapInArrow(batches_of, out)


def _combined(placed: DataFrame, runs: list[list[tuple[int, int, int]]], out: str, names: list[str]) -> DataFrame:
    """Each item's container by a plan that combines buckets, from the item's rank in its bucket."""
    ahead = placed.where("bucket >= 0").groupBy("bucket", "chunk").count()
    ahead = ahead.select("bucket", "chunk", (F.sum("count").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("count")).alias("ahead"))
    ranked = placed.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("doc", "part_no"))).join(ahead, ["bucket", "chunk"], "left")
    ranked = ranked.select("doc", "part_no", "first_token", "tokens", "bucket", (F.coalesce("ahead", F.lit(0)) + F.col("own") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [tuple(np.array(x) for x in zip(*r, strict=True)) if r else () for r in runs]
        for b in batches:
            bucket_of, rank = b.column("bucket").to_numpy(), b.column("rank").to_numpy()
            to = np.full(b.num_rows, -1, dtype=np.int64)
            for k in np.unique(bucket_of[bucket_of >= 0]).tolist():
                mine = bucket_of == k
                start, per, first = table[k]
                i = np.searchsorted(start, rank[mine], side="right") - 1
                to[mine] = first[i] + (rank[mine] - start[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc", "part_no", "first_token", "tokens")), pa.array(to, mask=to < 0)], names=names)

    return ranked.mapInArrow(assign, out)


def fill(containers: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, percent): how full they are."""
    each = containers.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(100 * F.sum("tokens") / (F.count("*") * capacity), 2).alias("percent"))
