"""Graphs as tables of edges: structure of documents, context, entities, components, personalised rank.

Iterative operators write each round to the shared folder: plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.scratch import dropped, stored

#: Weight of a relation in the personalised rank; fixed values.
RANK_WEIGHTS = {"CONTIDA_EM": 1.0, "PERTENCE_A_DOC": 0.4, "REPRESENTADA_EM": 1.0, "NEXT_CHUNK": 1.0, "SAME_PAGE": 0.3, "TEM_NOTA": 1.0, "TEM_TITULO": 1.0, "DESCRITA_EM": 1.0, "DICIONARIO_DE": 1.0, "SUSTENTADA_POR": 1.0}
RANK_DEFAULT = 0.4
#: Directed edges of a component that one task gathers, and the queries of a block on it; numbers a task holds per round.
GATHERED, QUERIES, HELD = 4_000_000, 32, 1 << 22


def structural_edges(chunks: DataFrame, source: str = "source_file", page: str = "page", ordinal: str = "chunk_id", id_col: str = "node_id") -> DataFrame:
    """(source_id, label, target_id): chunks in pages, pages in documents, and each chunk to the next of its page."""
    place = F.concat_ws("::", source, page)
    contained = chunks.select(F.col(id_col).alias("source_id"), F.lit("CONTIDA_EM").alias("label"), place.alias("target_id"))
    pages = chunks.select(place.alias("source_id"), F.lit("PERTENCE_A_DOC").alias("label"), F.col(source).alias("target_id")).distinct()
    w = Window.partitionBy(source, page, "type").orderBy(ordinal, id_col)
    following = chunks.select(F.col(id_col).alias("source_id"), F.lit("NEXT_CHUNK").alias("label"), F.lead(id_col).over(w).alias("target_id"), F.col(ordinal).alias("_o"), F.lead(ordinal).over(w).alias("_n"))
    following = following.where(F.col("_n") == F.col("_o") + 1).select("source_id", "label", "target_id")
    return contained.union(pages).union(following)


def page_boundaries(chunks: DataFrame, source: str = "source_file", page: str = "page", ordinal: str = "chunk_id", id_col: str = "node_id") -> DataFrame:
    """(source_id, target_id): the last text chunk of a page and the first of the next; gaps in the pages are not bridged."""
    text = chunks.where("type = 'text'").select(source, F.col(page).try_cast("int").alias("_p"), ordinal, id_col).where("_p is not null")
    ends = text.groupBy(source, "_p").agg(F.max_by(id_col, F.struct(ordinal, id_col)).alias("source_id"), F.min_by(id_col, F.struct(ordinal, id_col)).alias("first_id"))
    nexts = ends.select(source, (F.col("_p") - 1).alias("_p"), F.col("first_id").alias("target_id"))
    return ends.drop("first_id").join(nexts, [source, "_p"]).select("source_id", "target_id")


def mentions(nodes: DataFrame, dims: Column, id_col: str = "node_id", dimensions: tuple[str, ...] = ("indicator", "region", "sector", "source")) -> DataFrame:
    """(id, entity): the entities that the facets of a node name."""
    named = lambda d: F.transform(dims[d], lambda v: F.concat(F.lit(d + ":"), v))
    each = F.array(*(named(d) for d in dimensions))
    return nodes.select(F.col(id_col).alias("id"), F.explode(F.flatten(each)).alias("entity")).distinct()


def cooccurrence(mentioned: DataFrame) -> DataFrame:
    """(a < b, weight): how many nodes mention both entities.  Pairs come from the entities of one node, which its dimensions bound."""
    sets = mentioned.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    pairs = sets.select("n", "e", F.posexplode("e").alias("i", "a")).select("n", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight"))


def entity_expansion(seeds: DataFrame, mentioned: DataFrame, total: int, k: int, share: float = 0.02) -> DataFrame:
    """(query_id, id, score, position): nodes that share rare entities with the seeds (query_id, id, rank from 0).

    An entity gives log(1 + total / mentions) / (rank + 1); those mentioned by more than a share of all nodes, or 50, are hubs
    and give nothing.
    """
    counts = mentioned.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") <= max(50, int(share * total)))
    gain = F.log1p(F.lit(float(total)) / F.col("n")) / (F.col("rank") + 1)
    given = seeds.join(mentioned, "id").join(counts, "entity").groupBy("query_id", "entity").agg(F.sum(gain).alias("gain"))
    reached = given.join(mentioned, "entity").groupBy("query_id", "id").agg(F.round(F.sum("gain"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reached.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, hops): nodes within `depth` undirected steps of the seeds (query_id, id), with the fewest steps."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("target_id", "source_id")).distinct()
    known = seeds.select("query_id", "id", F.lit(0).alias("hops")).distinct()
    frontier = known
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id")).distinct()
        frontier = stored(step.join(known, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(hop).alias("hops")), "frontier")
        known = known.union(frontier)
    return known


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component): connected components of undirected edges, the component named by its least id.

    Alternating large-star and small-star rounds: each contracts the graph, so the rounds grow with the logarithm of its size,
    and no component is gathered.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    nodes = edges.select(F.col(a).alias("id")).union(edges.select(b)).distinct()
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        last, now = now, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        dropped(last)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    return nodes.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.6, rounds: int = 10, most: int = GATHERED) -> DataFrame:
    """(query_id, id, score) after a fixed number of rounds of personalised PageRank on the undirected weighted graph.

    An edge weighs its relation's weight over log2(2 + degree of where it leads); seeds (query_id, id, rank from 0) restart with
    1 / (rank + 1).  A score never leaves the component of its seed: components of up to `most` directed edges are gathered, and all
    rounds of a block of queries are one task's products with their matrix; larger ones exchange their scores in each round.
    """
    table = F.create_map(*(F.lit(x) for kv in RANK_WEIGHTS.items() for x in kv))
    edges = stored(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.coalesce(table[F.col("label")], F.lit(RANK_DEFAULT)).alias("w")), "edges")
    both = edges.union(edges.select("b", "a", "w"))
    degree = both.groupBy("b").agg(F.count("*").alias("degree"))
    weighted = both.join(degree, "b").groupBy("a", "b").agg(F.sum(F.col("w") / F.log2(F.col("degree") + 2)).alias("w"))
    out = weighted.groupBy("a").agg(F.sum("w").alias("all"))
    share = stored(weighted.join(out, "a").select("a", "b", (F.col("w") / F.col("all")).alias("share")), "shares")
    dropped(edges)
    start = seeds.groupBy("query_id", "id").agg(F.sum(1.0 / (F.col("rank") + 1)).alias("s"))
    whole = start.groupBy("query_id").agg(F.sum("s").alias("all"))
    start = stored(start.join(whole, "query_id").select("query_id", "id", (F.col("s") / F.col("all")).alias("s")), "start")
    of = stored(components(share.where("a <= b"), "a", "b"), "parts")
    placed = share.join(of.select(F.col("id").alias("a"), "component"), "a")
    seeded = start.join(of, "id").withColumn("block", F.floor((F.dense_rank().over(Window.partitionBy("component").orderBy("query_id")) - 1) / QUERIES))
    sizes = placed.groupBy("component").agg(F.count("*").alias("edges"))
    used = stored(seeded.groupBy("component").agg((F.max("block") + 1).alias("blocks")).join(sizes, "component"), "parts")
    each = used.where(F.col("edges") <= most).select("component", "blocks")
    query, node = (start.schema[x].dataType.simpleString() for x in ("query_id", "id"))
    packs = placed.join(each, "component", "left_semi").groupBy("component").applyInArrow(_packed, f"component {node}, pack binary")
    packs = packs.join(each, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "pack", F.lit(None).cast(query).alias("query_id"), F.lit(None).cast(node).alias("id"), F.lit(None).cast("double").alias("s"))
    asked = seeded.join(each, "component").select("component", "block", F.lit(None).cast("binary").alias("pack"), "query_id", "id", "s")
    work = stored(packs.union(asked), "rank")
    work = work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "block")  # rows returned are many times those read
    back = F.col("s") * (1 - alpha if rounds else 1.0)
    alone = start.join(of, "id", "left_anti").select("query_id", "id", back.alias("score"))
    done = alone.union(work.groupBy("component", "block").applyInArrow(_all_rounds(alpha, rounds), alone.schema))
    if used.where(F.col("edges") > most).isEmpty():
        dropped(share)
        return done
    large = used.where(F.col("edges") > most).select("component")
    share = stored(placed.join(large, "component", "left_semi").select("a", "b", "share"), "shares")
    start = stored(seeded.join(large, "component", "left_semi").select("query_id", "id", "s"), "start")
    now, last = start.select("query_id", "id", F.col("s").alias("score")), None
    for _ in range(rounds):
        moved = now.join(share, F.col("id") == F.col("a")).groupBy("query_id", F.col("b").alias("id")).agg(F.sum(alpha * F.col("score") * F.col("share")).alias("m"))
        back = start.select("query_id", "id", ((1 - alpha) * F.col("s")).alias("m"))
        now = stored(moved.union(back).groupBy("query_id", "id").agg(F.sum("m").alias("score")), "rank")
        if last is not None:  # a round is read by the next one only
            dropped(last)
        last = now
    return done.union(now)


def _packed(t: pa.Table) -> pa.Table:
    """The edges of a component in one row, as places in the list of its nodes."""
    from_ = t.column("a").combine_chunks().dictionary_encode()
    b = pa.compute.index_in(t.column("b").combine_chunks(), from_.dictionary)
    ids = pa.RecordBatch.from_arrays([from_.dictionary], names=["id"])
    parts = [from_.indices.to_numpy().astype(np.int32).tobytes(), b.to_numpy().astype(np.int32).tobytes(), t.column("share").to_numpy().tobytes()]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as w:
        w.write_batch(ids)
    return pa.table({"component": t.column("component").slice(0, 1), "pack": pa.array([np.int64(t.num_rows).tobytes() + b"".join(parts) + sink.getvalue().to_pybytes()], pa.binary())})


def _all_rounds(alpha: float, rounds: int):
    """Scores of the seeds of a block of queries on the edges of their component, as many queries at once as HELD allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        packed = pa.compute.is_valid(t.column("pack"))
        (raw,), seeds = t.column("pack").filter(packed).to_pylist(), t.filter(pa.compute.invert(packed)).sort_by([("query_id", "ascending"), ("id", "ascending")])
        m = int(np.frombuffer(raw, np.int64, 1)[0])
        a, b = np.frombuffer(raw, np.int32, m, 8), np.frombuffer(raw, np.int32, m, 8 + 4 * m)
        share = np.frombuffer(raw[8 + 8 * m : 8 + 16 * m], np.float64)
        nodes = pa.ipc.open_stream(raw[8 + 16 * m :]).read_all().column("id").combine_chunks()
        order = np.lexsort((a, b))
        a, b, share = a[order], b[order], alpha * share[order, None]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))  # every node has an edge that leads to it
        asked = seeds.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        q, at, s = asked.indices.to_numpy(), pa.compute.index_in(seeds.column("id").combine_chunks(), nodes).to_numpy(), seeds.column("s").to_numpy()
        step = max(1, HELD // len(a))
        for i in range(0, len(asked.dictionary), step):
            own = (q >= i) & (q < i + step)
            start = np.zeros((len(nodes), min(step, len(asked.dictionary) - i)))
            np.add.at(start, (at[own], q[own] - i), s[own])
            now, back = start, (1 - alpha) * start
            for _ in range(rounds):
                now = np.add.reduceat(now[a] * share, first, axis=0) + back
            of, id_ = np.nonzero(now.T > 0)
            for j in range(0, len(of), 1 << 18):
                x, y = of[j : j + (1 << 18)], id_[j : j + (1 << 18)]
                yield pa.RecordBatch.from_arrays([asked.dictionary.take(pa.array(x + i)), nodes.take(pa.array(y)), pa.array(now[y, x])], names=["query_id", "id", "score"])

    return run


def descendants(parents: DataFrame, child: str = "child", parent: str = "parent", most: int = 20) -> DataFrame:
    """(ancestor, descendant, depth): the transitive closure of a hierarchy, each node its own descendant at depth 0."""
    links = parents.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("p is not null").distinct()
    every = links.select(F.col("c").alias("x")).union(links.select("p")).distinct()
    known = every.select(F.col("x").alias("ancestor"), F.col("x").alias("descendant"), F.lit(0).alias("depth"))
    frontier = known
    for d in range(1, most + 1):
        frontier = stored(frontier.join(links, F.col("descendant") == F.col("p")).select("ancestor", F.col("c").alias("descendant"), F.lit(d).alias("depth")).join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").select("ancestor", "descendant", "depth"), "closure")
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def communities(weighted: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community): synchronous label propagation over edges (a, b, weight) for a fixed number of rounds.

    A node takes the label with the most weight among its neighbours and itself (its own label weighs half of its heaviest edge,
    which stops labels from swapping); ties go to the least label.
    """
    both = stored(weighted.select("a", "b", "weight").union(weighted.select("b", "a", "weight")), "weights")
    own = both.groupBy("a").agg((F.max("weight") / 2).alias("weight"))
    now = own.select(F.col("a").alias("id"), F.col("a").alias("community"))
    for _ in range(rounds):
        heard = both.join(now, F.col("b") == F.col("id")).select("a", "community", "weight")
        kept = own.join(now, F.col("a") == F.col("id")).select("a", "community", "weight")
        votes = heard.union(kept).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        top = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("t"))
        now = stored(top.select(F.col("a").alias("id"), F.col("t.community").alias("community")), "labels")
    return now


def comparison_graph(plans: DataFrame) -> DataFrame:
    """(source_id, label, target_id) of calculations (plan_id, operation, operand_no, cell_id): which cells enter which result."""
    binary = F.col("operation").isin("difference", "percent_change", "percentage_points")
    label = F.when(binary & (F.col("operand_no") == 1), "BASE_DE").when(binary & (F.col("operand_no") == 2), "FINAL_DE").otherwise("OPERANDO_DE")
    return plans.select(F.col("cell_id").alias("source_id"), label.alias("label"), F.col("plan_id").alias("target_id")).distinct()
