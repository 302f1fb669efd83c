"""The most similar vectors of every vector, by robust-pruned directed graphs over shards.

A bounded sample places centres; every vector is indexed in the shard of its nearest centre, and queried there and in the
shards of centres almost as near.  Shards whose centres lie together share a task and its rows, so that a vector is sent there
once.  A shard that is still too large is divided at random, and the queries that reach a shard, which are counted first, into
blocks, so that a search never holds more than about SHARD base vectors and BLOCK queries.  In it, two rounds of
beam searches propose neighbours (the first over random edges), relaxed distance pruning keeps diverse ones, and a last
beam search answers the queries.  Cosines of the answers are computed in double precision.

Equal vectors are one class with its smallest ids; classes are answered once and expanded to their members at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.folding import mix

#: Vectors a cell and most base vectors and queries of a task.
CELL, SHARD, BLOCK = 512, 4096, 16384
#: Cells whose centres lie together; a vector is sent to them once.
TOGETHER = 8
#: Vectors of the sample per centre, and most of the sample: its bound, 32 MB of single floats.
PER_CENTRE, SAMPLE = 8, 131_072
#: Cosine by which a centre may be farther than the nearest and still be probed.
MARGIN = 0.12
DEGREE, BEAM, WIDTH, RELAX, SEEDS = 16, 24, 4, 1.2, 256


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)  # squares of very small or large elements stay finite
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centres_of(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(3)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        order = np.argsort(near, kind="stable")
        have, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c[have] = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c[have])
    return c


def cells_together(c: np.ndarray) -> np.ndarray:
    """A number for each centre, the same for at most TOGETHER of them: centres halved along their widest direction."""
    out, todo, number = np.zeros(len(c), dtype=np.int64), [np.arange(len(c))], 0
    while todo:
        at = todo.pop()
        if len(at) <= TOGETHER:
            out[at], number = number, number + 1
            continue
        x = c[at] - c[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return out


def _search(u: np.ndarray, graph: np.ndarray, seeds: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam searches in step for the rows of q: ids and cosines of the best `beam` nodes, the best first."""
    rows = np.arange(len(q))[:, None]
    sims = q @ u[seeds].T
    k = min(beam, len(seeds))
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    ids, sim = seeds[best], sims[rows, best]
    seen = np.zeros((len(q), len(u)), dtype=bool)
    seen[rows, ids] = True
    fresh = np.ones(ids.shape, dtype=bool)
    while True:
        live = fresh.any(axis=1)
        if not live.any():
            break
        on = np.flatnonzero(live)
        r = np.arange(len(on))[:, None]
        score = np.where(fresh[on], sim[on], -9)
        w = min(WIDTH, score.shape[1])
        pick = np.argpartition(-score, w - 1, axis=1)[:, :w]
        usable = score[r, pick] > -9
        fresh[on[:, None], pick] = False
        near = np.where(usable[:, :, None], graph[ids[on][r, pick]], -1).reshape(len(on), -1)
        near.sort(axis=1)
        bad = near < 0
        bad[:, 1:] |= near[:, 1:] == near[:, :-1]
        bad |= seen[on[:, None], near]
        qr, at = np.nonzero(~bad)
        node = near[qr, at]
        seen[on[qr], node] = True
        s = np.full(near.shape, -8, dtype=np.float32)
        s[qr, at] = np.einsum("ij,ij->i", u[node], q[on[qr]])  # only nodes that are new to the query
        all_ids, all_sim = np.concatenate([ids[on], near], axis=1), np.concatenate([sim[on], s], axis=1)
        all_fresh = np.concatenate([fresh[on], ~bad], axis=1)
        k = min(beam, all_sim.shape[1])
        top = np.argpartition(-all_sim, k - 1, axis=1)[:, :k]
        if ids.shape[1] < k:
            pad = k - ids.shape[1]
            ids, sim, fresh = (np.pad(x, ((0, 0), (0, pad)), constant_values=v) for x, v in ((ids, 0), (sim, -8), (fresh, False)))
        ids[on], sim[on], fresh[on] = all_ids[r, top], all_sim[r, top], all_fresh[r, top]
        fresh &= sim > -8
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.where(sim > -8, ids, -1)[rows, order], sim[rows, order]


def _pruned(u: np.ndarray, node: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Robust pruning: of the candidates (the best first, -1 empty), those not covered by a nearer kept one."""
    v = u[np.maximum(cand, 0)]
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    own = 1 - sims
    alive = (cand >= 0) & (cand != node[:, None])
    out = np.full((len(node), DEGREE), -1, dtype=np.int32)
    r = np.arange(len(node))
    for k in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[r, first]
        if not some.any():
            break
        out[some, k] = cand[r, first][some]
        alive &= RELAX * between[r, first] > own
        alive[r, first] = False
    return out


def build_graph(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of each node (-1: none) and the entry nodes of a shard of unit vectors."""
    n = len(u)
    rng = np.random.default_rng(n)
    seeds = rng.permutation(n)[:SEEDS]
    graph = rng.integers(0, n, (n, DEGREE), dtype=np.int32) if n > 1 else np.full((n, DEGREE), -1, dtype=np.int32)
    room = DEGREE * 2
    for beam in (BEAM, BEAM):
        found = [_search(u, graph, seeds, u[i : i + 512], beam) for i in range(0, n, 512)]
        to = np.concatenate([np.pad(f[0], ((0, 0), (0, beam - f[0].shape[1])), constant_values=-1) for f in found])
        sim = np.concatenate([np.pad(f[1], ((0, 0), (0, beam - f[1].shape[1]))) for f in found])
        src, dst, s = np.repeat(np.arange(n), beam), to.ravel(), sim.ravel()
        keep = (dst >= 0) & (dst != src)
        src, dst, s = src[keep], dst[keep], s[keep]
        a, b, s = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([s, s])
        order = np.argsort(a * 4.0 - s)  # by node, the nearest first
        a, b, s = a[order], b[order], s[order]
        keep = np.ones(len(a), dtype=bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # found from both ends
        a, b, s = a[keep], b[keep], s[keep]
        start = np.searchsorted(a, np.arange(n))
        rank = np.arange(len(a)) - start[a]
        keep = rank < room
        cand, sims = np.full((n, room), -1, dtype=np.int64), np.full((n, room), -8, dtype=np.float32)
        cand[a[keep], rank[keep]], sims[a[keep], rank[keep]] = b[keep], s[keep]
        graph = np.concatenate([_pruned(u, np.arange(i, min(i + 512, n)), cand[i : i + 512], sims[i : i + 512]) for i in range(0, n, 512)])
    return graph, seeds


def _classes(v: np.ndarray) -> np.ndarray:
    """128-bit hashes of whole vectors, as 16 bytes each."""
    words = np.ascontiguousarray(v + np.float32(0)).view(np.uint32).astype(np.uint64)  # -0.0 and 0.0 are equal
    out = np.zeros((len(v), 2), dtype=np.uint64)
    for side, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        h = np.full(len(v), odd, dtype=np.uint64)
        for j in range(words.shape[1]):
            h = mix(h * np.uint64(odd) + words[:, j])
        out[:, side] = h
    return out


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vector) where the vector has `dim` finite elements, not all zero."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v")).where((F.size("v") == dim) & fine & F.col("id").isNotNull())


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _lists(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of values as a list array."""
    size = end - begin
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin - to[:-1], size) + np.arange(to[-1])
    return pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(values[at]))


def nearest_vectors(df: DataFrame, k: int, floor: float, id_col: str = "vec_id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id, neighbour, cosine, rank) of up to k most similar other vectors with a cosine of at least `floor`.

    Cosines are rounded to 9 places, ties go to the smaller id.  Null, empty, short, long, zero and non-finite vectors take no
    part; equal vectors are neighbours of each other.
    """
    spark = df.sparkSession
    vectors = valid_vectors(df, id_col, vector_col, dim)
    n = vectors.count()
    count = max(1, min(SAMPLE // PER_CENTRE, round(n / CELL)))
    # the vectors with the least hashes, by a threshold: a map, about as many as wanted
    share = min(1.0, max(256, count * PER_CENTRE) / max(n, 1))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))).select("v").toArrow()
    sample = unit_rows(_matrix(sample.column("v"), dim)).astype(np.float32) if sample.num_rows else np.eye(1, dim, dtype=np.float32)
    shared = spark.sparkContext.broadcast(centres_of(sample, count))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = unit_rows(_matrix(b.column("v"), dim)).astype(np.float32) @ shared.value.T
            k = near.shape[1]
            size = np.bincount(near.argmax(axis=1), minlength=k)
            asks = (near >= near.max(axis=1, keepdims=True) - MARGIN).sum(axis=0)
            cell = np.flatnonzero(asks)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, size[cell], asks[cell])], names=["cell", "size", "asks"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _classes(_matrix(b.column("v"), dim)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["id", "hi", "lo"])

    sizes, reach = np.zeros(len(shared.value), dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64)
    for r in vectors.mapInArrow(homes, "cell long, size long, asks long").groupBy("cell").agg(F.sum("size").alias("n"), F.sum("asks").alias("asks")).collect():  # a row a centre
        sizes[r["cell"]], reach[r["cell"]] = r["n"], r["asks"]
    parts = np.maximum(1, -(-sizes // SHARD))
    blocks = np.maximum(1, -(-reach // BLOCK))
    plan = spark.sparkContext.broadcast((parts, blocks, cells_together(shared.value)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blocks, together = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
            cls = _classes(v)
            order = np.lexsort((ids, cls[:, 1], cls[:, 0]))
            ids, v, cls = ids[order], v[order], cls[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (cls[1:] != cls[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            last = np.minimum(np.append(first[1:], len(ids)), first + k + 1)  # the smallest ids answer ties
            v, cls = v[first], cls[first]
            near = unit_rows(v).astype(np.float32) @ shared.value.T
            home = near.argmax(axis=1)
            at, cell = np.nonzero(near >= near.max(axis=1, keepdims=True) - MARGIN)
            salt = (cls[:, 0] >> np.uint64(7)).astype(np.int64) & 0x7FFFFFFF
            rows: list[tuple[np.ndarray, ...]] = []
            for p in range(int(parts[cell].max(initial=1))):
                x = at[p < parts[cell]]
                c = cell[p < parts[cell]]
                own = (home[x] == c) & (salt[x] % parts[c] == p)
                for q in range(int(blocks[c].max(initial=1)) if len(c) else 0):
                    asks = (salt[x] // 97) % blocks[c] == q
                    use = (asks | own) & (q < blocks[c])
                    rows.append((x[use], c[use], np.full(use.sum(), p), np.full(use.sum(), q), own[use], asks[use]))
            x, c, p, q, own, asks = (np.concatenate(z) for z in zip(*rows, strict=True))
            group = together[c]
            order = np.lexsort((c, q, p, group, x))
            x, c, p, q, own, asks, group = (z[order] for z in (x, c, p, q, own, asks, group))
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            begin = np.flatnonzero(new)
            cells = _lists((c * 4 + own * 2 + asks).astype(np.int32), begin, np.append(begin[1:], len(x)))
            mine = np.logical_or.reduceat(own, begin)
            x, p, q, group = x[begin], p[begin], q[begin], group[begin]
            arrays = [pa.array(group), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), cells, pa.array(cls[x, 0].view(np.int64)), pa.array(cls[x, 1].view(np.int64)), _lists(ids, first[x], np.where(mine, last[x], first[x])), pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(v[x]))]).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "part", "block", "cells", "hi", "lo", "ids", "v"])

    def answers_of(group: pa.Table) -> pa.Table:
        """The answers of each cell of a group; a code of a row is its cell, whether it is indexed there, and whether it asks."""
        code, row = pa.compute.list_flatten(group.column("cells")).to_numpy(), pa.compute.list_parent_indices(group.column("cells")).to_numpy()
        order = np.argsort(code >> 2, kind="stable")
        each = np.split(order, np.flatnonzero(np.diff(code[order] >> 2)) + 1)
        return pa.concat_tables([answer(group.take(pa.array(row[at])), (code[at] & 2) > 0, (code[at] & 1) > 0) for at in each])

    def answer(group: pa.Table, own: np.ndarray, asks: np.ndarray) -> pa.Table:
        hi, lo = group.column("hi").to_numpy(), group.column("lo").to_numpy()
        v = np.frombuffer(b"".join(group.column("v").to_pylist()), dtype=np.float32).reshape(-1, dim)
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        cls = np.empty(len(order), dtype=np.int64)
        cls[order] = np.cumsum(new) - 1
        rep = order[new]
        base, ask = np.unique(cls[own]), np.unique(cls[asks])
        none = pa.table({"hi": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()), "found": pa.array([], kind)})
        if not len(base) or not len(ask):
            return none
        mine = np.flatnonzero(own)
        many = pa.compute.list_value_length(group.column("ids")).to_numpy()[mine]
        owner, every = np.repeat(np.searchsorted(base, cls[mine]), many), group.column("ids").filter(pa.array(own)).combine_chunks().flatten().to_numpy()
        order = np.lexsort((every, owner))  # ids of each base class, the k + 1 smallest of all tasks that met it
        owner, every = owner[order], every[order]
        keep = np.arange(len(owner)) - np.searchsorted(owner, owner) <= k
        owner, every = owner[keep], every[keep]
        first, size = np.searchsorted(owner, np.arange(len(base))), np.bincount(owner, minlength=len(base))
        exact = unit_rows(v[rep])
        u = exact.astype(np.float32)
        ub = np.ascontiguousarray(u[base])
        graph, seeds = build_graph(ub)
        answers = []
        for i in range(0, len(ask), 512):
            part = ask[i : i + 512]
            to, sim = _search(ub, graph, seeds, u[part], max(BEAM, 2 * k + 2))
            here = np.minimum(np.searchsorted(base, part), len(base) - 1)
            r, c = np.nonzero((to >= 0) & (sim >= floor - 1e-4) & ((to != here[:, None]) | (base[here] != part)[:, None]))
            cosine = np.round(np.einsum("ij,ij->i", exact[part[r]], exact[base[to[r, c]]]), 9)
            known = np.flatnonzero(base[here] == part)  # the query's own class needs no search
            asked, node = np.concatenate([known, r[cosine >= floor]]), np.concatenate([here[known], to[r, c][cosine >= floor]])
            cosine = np.concatenate([np.ones(len(known)), cosine[cosine >= floor]])
            asked, cosine = np.repeat(asked, size[node]), np.repeat(cosine, size[node])
            within = np.arange(len(asked)) - np.repeat(np.cumsum(size[node]) - size[node], size[node])
            answers.append((asked + i, cosine, every[np.repeat(first[node], size[node]) + within]))
        asked, cosine, ids = (np.concatenate(x) for x in zip(*answers, strict=True))
        order = np.lexsort((ids, -cosine, asked))
        asked, cosine, ids = asked[order], cosine[order], ids[order]
        keep = np.arange(len(asked)) - np.searchsorted(asked, asked) <= k
        asked, cosine, ids = asked[keep], cosine[keep], ids[keep]
        have, begin = np.unique(asked, return_index=True)
        found = pa.ListArray.from_arrays(pa.array(np.append(begin, len(asked)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(cosine), pa.array(ids)], names=["s", "id"]))
        at = rep[ask[have]]
        return pa.table({"hi": pa.array(hi[at]), "lo": pa.array(lo[at]), "found": found})

    kind = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
    routed = vectors.mapInArrow(route, "shard long, part int, block int, cells array<int>, hi long, lo long, ids array<long>, v binary")
    answers = routed.groupBy("shard", "part", "block").applyInArrow(answers_of, "hi long, lo long, found array<struct<s: double, id: long>>")
    merged = answers.groupBy("hi", "lo").agg(F.flatten(F.collect_list("found")).alias("found"))  # one row per probed shard
    best = F.slice(F.array_sort(F.transform("found", lambda x: F.struct((-x["s"]).alias("s"), x["id"].alias("id")))), 1, k + 1)
    each = vectors.mapInArrow(members, "id long, hi long, lo long").join(merged.select("hi", "lo", best.alias("found")), ["hi", "lo"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select(F.col("id"), F.posexplode(others).alias("at", "x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.s")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def neighbour_pairs(df: DataFrame, k: int, floor: float, id_col: str = "vec_id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(vec_a < vec_b) of which one is among the up to k nearest of the other."""
    near = nearest_vectors(df, k, floor, id_col, vector_col, dim)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()
