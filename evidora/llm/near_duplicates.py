"""Near-duplicate documents: a signature-coordinate inverted join with an exact check.

A text's signature has `COORDINATES` coordinates; each joins four of `MINIMA` minima of differently permuted shingle hashes,
so texts of Jaccard similarity J agree in it with probability J**4.  Texts are posted under each coordinate-value pair, and
collisions are counted per pair of texts.  Pairs with `MATCHES` collisions or more are decided on their whole shingle sets,
which are sent once per pair and text.  At a similarity of exactly 0.6 a pair collides less often with probability 0.00006
(simulated; 0.000003 at 0.65).

* Prefix: lengths of all lists are counted first, in a fixed number of counters.  A text whose longest list is long is not
  posted there: of two collisions one is in another list.
* Skips: pairs that may have met in such a list need one collision less; the check of their sets decides.
* A list that is long for all that is divided into tiles of blocks of texts, so that no task holds it.
* Sketches: pairs of unrelated texts grow as the square of the table, nearly all from lists of stock phrases.  A list of more than
  SHORT texts hands on its members, not its pairs; they meet with a bitmap of their shingles.  A bit of one that the other lacks
  stands for a shingle that the other lacks, so the bitmaps bound the similarity from above: pairs below the threshold are dropped
  and none above it is.  Pairs with enough collisions pass the same bound before their sets are sent.
* Rounds: lists are merged in rounds of at most ROUND postings, and the shuffle files of a round are removed after it.

Postings leave the map stage as blocks of sorted keys, about eight bytes a posting.  Exact copies (equal sequences of folded
words) form one class that is posted once per task, so that a class holding a third of all rows adds a text per task, not per
document; pairs are expanded at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.folding import folded_words, mix, shingles
from evidora.operators.graph import components
from evidora.scratch import dropped, stored

MINIMA, COORDINATES, ROWS, MATCHES = 192, 128, 4, 2
BATCH, BLOCK_TEXTS = 256, 2048
#: Counters of list lengths; they are sent in chunks, so that sums are spread over tasks.
COUNTERS_LOG, CHUNKS = 20, 64
#: Lists above LONG may be skipped, those above BLOCK are divided; postings of a merging task.
LONG, BLOCK, POSTINGS = 256, 1024, 500_000
#: Lists up to SHORT hand on their pairs; postings of a round; members of long lists in a task; bits of the largest bitmap.
SHORT, ROUND, MEMBERS, BITS_LOG = 16, 200_000_000, 50_000, 16

_rng = np.random.default_rng(20_24)
_ODD = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SUBSETS = np.array([_rng.choice(MINIMA, ROWS, replace=False) for _ in range(COORDINATES)])


def _sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with shingles, a class hash of each, and the distinct shingles of all with the place of their text."""
    h, no = folded_words(texts)
    s, sno = shingles(h, no, words)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    have = np.unique(sno)
    named, begin = np.unique(no, return_index=True)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(h)))).astype(np.uint64)
    cls = mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), begin))[np.searchsorted(named, have)].view(np.int64)
    at = np.searchsorted(have, sno)
    order = np.lexsort((s, at))
    s, at = s[order], at[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    return have, cls, s[new], at[new]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            part = b.slice(i, BATCH)
            yield part.column(0), part.column(1).to_pylist()


def _signatures(words: int):
    """Rows of up to BLOCK_TEXTS texts: a number, the documents, their classes, which are new to the task; of those keys, sizes, bitmaps."""
    names = ["block", "docs", "classes", "fresh", "keys", "sizes", "bits"]

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            docs, cls, fresh, keys, sizes, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            number = mix(docs[:1].view(np.uint64)).view(np.int64) & ~np.int64(0xFFF)
            raw = [x.tobytes() for x in (docs, cls, fresh, _planes(keys.ravel(), 5), sizes, bits)]
            return pa.RecordBatch.from_arrays([pa.array(number), *(pa.array([x]) for x in raw)], names=names)

        for ids, texts in _slices(batches):
            have, cls, s, at = _sets(texts, words)
            if not len(have):
                continue
            fresh = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()], dtype=bool)
            keep = fresh[at]
            s = (s[keep] >> np.uint64(32)).astype(np.uint32)
            first = np.searchsorted(at[keep], np.flatnonzero(fresh))
            minima = np.empty((len(first), MINIMA), dtype=np.uint64)
            if len(first):
                for k, odd in enumerate(_ODD):
                    minima[:, k] = np.minimum.reduceat(s * odd, first)
            key = np.broadcast_to(np.arange(1, COORDINATES + 1, dtype=np.uint64), (len(first), COORDINATES))
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, _SUBSETS[:, r]])
            sizes = np.diff(np.append(first, len(s))).astype(np.int32)
            held.append((ids.to_numpy(zero_copy_only=False)[have], cls, fresh, key >> np.uint64(24), sizes, _bitmaps(s, sizes)))
            if sum(len(x[0]) for x in held) > BLOCK_TEXTS - BATCH:
                yield flush()
        if held:
            yield flush()

    return run


def _widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of the bitmaps of sets: a power of two, two to four bits a shingle."""
    return np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(2 * sizes.astype(np.int64), 1))).astype(np.int64), 6, BITS_LOG)


def _bitmaps(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bitmaps of all sets one after the other; s has the shingles of each set in turn."""
    width = _widths(sizes)
    end = np.cumsum(width)
    bits = np.zeros(end[-1] if len(end) else 0, dtype=np.uint8)
    bits[np.repeat(end - width, sizes) + (s.astype(np.int64) & (np.repeat(width, sizes) - 1))] = 1
    return np.packbits(bits, bitorder="little")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, cls, size, bits) of the texts that are posted."""
    for b in batches:
        for block, classes, fresh, sizes, bits in zip(*(b.column(c).to_pylist() for c in ("block", "classes", "fresh", "sizes", "bits")), strict=True):
            cls, sizes = np.frombuffer(classes, np.int64)[np.frombuffer(fresh, bool)], np.frombuffer(sizes, np.int32)
            end = np.cumsum(_widths(sizes) // 8)
            parts = [bits[i:j] for i, j in zip([0, *end[:-1]], end, strict=True)] if len(end) else []
            yield pa.RecordBatch.from_arrays([pa.array(block | np.arange(len(cls))), pa.array(cls), pa.array(sizes), pa.array(parts, pa.binary())], names=["node", "cls", "size", "bits"])


def _may_reach(common, one, other, percent: int):
    """Whether sets of these sizes with at most `common` shingles in common may reach the threshold."""
    return common * 100 >= percent * (one + other - common)


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bytes of each number, as n planes of bytes."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :n].T)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :n] = planes.T
    return out.view("<u8").ravel()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters; rows come sorted by chunk, one sum is held at a time."""
    now, total = None, None
    one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()])], names=["chunk", "counts"])
    for b in batches:
        for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
            if chunk == now:
                total += part
            else:
                if now is not None:
                    yield one()
                now, total = chunk, part.copy()
    if now is not None:
        yield one()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, cls, node): node names the text where its class was new."""
    for b in batches:
        for block, docs, cls, fresh in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "classes", "fresh")), strict=True):
            fresh = np.frombuffer(fresh, dtype=bool)
            node = block | (np.cumsum(fresh) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(np.frombuffer(cls, np.int64)), pa.array(node, mask=~fresh)], names=["doc", "cls", "node"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's counters of list lengths as rows (chunk, counts)."""
    counts = np.zeros(1 << COUNTERS_LOG, dtype=np.int64)
    for b in batches:
        for raw in b.column("keys").to_pylist():
            counts += np.bincount((_numbers(raw, 5) >> np.uint64(40 - COUNTERS_LOG)).astype(np.int64), minlength=len(counts))
    parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(counts, CHUNKS)) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "counts"])


def _postings(buckets: int, lengths, rounds: int = 1, now: int = 0):
    """Rows (bucket, block, postings): sorted keys, places in the block with flags, and fingerprints of classes.

    Flags: bit 12, a list was skipped; bits 13 and 14, the side of a tile where two blocks of a divided list meet.
    """

    def run(batches):
        counts = lengths.value
        for b in batches:
            for block, classes, fresh, raw in zip(*(b.column(c).to_pylist() for c in ("block", "classes", "fresh", "keys")), strict=True):
                cls = np.frombuffer(classes, np.uint64)[np.frombuffer(fresh, bool)]
                keys = _numbers(raw, 5).reshape(-1, COORDINATES)
                if not len(keys):
                    continue
                long = counts[(keys >> np.uint64(40 - COUNTERS_LOG)).astype(np.int64)]
                most = long.argmax(axis=1)
                skip = long[np.arange(len(keys)), most] > LONG
                post = np.ones(keys.shape, dtype=bool)
                post[skip, most[skip]] = False
                if rounds > 1:
                    post &= (keys >> np.uint64(40 - COUNTERS_LOG)) % np.uint64(rounds) == now
                at = np.nonzero(post)[0]
                key, long = keys[post], long[post]
                flags = at | skip[at] * 0x1000
                print_ = mix(cls) & np.uint64(0xFFFFFF)
                many = long // BLOCK + 1
                if (many > 1).any():
                    n = np.where(many > 1, many, 1)
                    row = np.repeat(np.arange(len(key)), n)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    own = (mix(cls[at[row]] + np.uint64(1)) % n[row].astype(np.uint64)).astype(np.int64)
                    lo, hi = np.minimum(own, other), np.maximum(own, other)
                    tiled = mix(key[row] * np.uint64(0x9E3779B97F4A7C15) + (lo << 20 | hi).astype(np.uint64)) >> np.uint64(24)
                    key = np.where(n[row] > 1, tiled, key[row])
                    flags = flags[row] | np.where(lo == hi, 0, np.where(own == lo, 0x2000, 0x4000))
                    at = at[row]
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                bucket, key, flags, at = bucket[order], key[order] // np.uint64(buckets), flags[order], at[order]
                have, first = np.unique(bucket, return_index=True)
                out = []
                for i, j in zip(first, np.append(first[1:], len(key)), strict=True):
                    out.append(np.concatenate([_planes(key[i:j], 5), _planes(flags[i:j], 2), _planes(print_[at[i:j]], 3)]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(np.full(len(have), block)), pa.array(out, pa.binary())], names=["bucket", "block", "postings"])

    return run


def _merged(table: pa.Table, buckets: int = 1) -> pa.Table:
    """(a, b, asked): a row for each collision in the lists of a bucket; copies of a class on a list count once, as the least node.

    A member of a list of more than SHORT texts is a row (list, node, -1 - flags) instead.
    """
    table = table.sort_by("block")  # a class has the same node on all its lists, however rows arrive
    parts = [_split(raw) for raw in table.column("postings").to_pylist()]
    key, flags, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
    node = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts]) | (flags & np.uint64(0xFFF)).astype(np.int64)
    both = key << np.uint64(24) | prints
    order = np.argsort(both, kind="stable")
    both, flags, node = both[order], flags[order], node[order]
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    key, flags, node = (both >> np.uint64(24))[new], flags[new], node[new]
    start = np.ones(len(key), dtype=bool)
    start[1:] = key[1:] != key[:-1]
    left = np.append(np.flatnonzero(start)[1:], len(key))[np.cumsum(start) - 1] - np.arange(len(key)) - 1
    side, skipped = flags >> np.uint64(13), (flags >> np.uint64(12) & np.uint64(1)).astype(np.int32)
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
    long = np.bincount(np.cumsum(start) - 1, minlength=1)[np.cumsum(start) - 1] > SHORT
    if long.any():
        list_ = key[long].astype(np.int64) * buckets + table.column("bucket")[0].as_py()
        out.append((list_, node[long], -1 - (flags[long] >> np.uint64(12)).astype(np.int32)))
    rows, step = np.flatnonzero((left > 0) & ~long), 1
    while len(rows):
        x, y = rows, rows + step
        fits = (side[x] == 0) | (side[x] != side[y])
        x, y = x[fits], y[fits]
        out.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), MATCHES - (skipped[x] & skipped[y])))
        step += 1
        rows = rows[left[rows] >= step]
    return pa.table(dict(zip(("a", "b", "asked"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))


def _met_in_long_lists(percent: int):
    """Rows (a, b, asked) for each collision in long lists whose bitmaps do not keep the pair below the threshold."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("list", "ascending"), ("node", "ascending")])
        list_, node, size = (table.column(c).to_numpy() for c in ("list", "node", "size"))
        flags = -1 - table.column("asked").to_numpy()
        side, skipped, raw, width = flags >> 1, flags & 1, table.column("bits").to_pylist(), _widths(size)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
        first = np.flatnonzero(np.append(True, list_[1:] != list_[:-1]))
        for i, j in zip(first, np.append(first[1:], len(list_)), strict=True):
            of = {w: i + np.flatnonzero(width[i:j] == w) for w in np.unique(width[i:j]).tolist()}
            for w, wide in of.items():
                bits = np.frombuffer(b"".join(raw[k] for k in wide), np.uint64).reshape(len(wide), -1)
                for v in (v for v in of if v <= w):  # wider bitmaps are folded to the width of the narrower
                    folded = np.bitwise_or.reduce(bits.reshape(len(wide), w // v, -1), axis=1)
                    ones = np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
                    other = folded if v == w else np.frombuffer(b"".join(raw[k] for k in of[v]), np.uint64).reshape(len(of[v]), -1)
                    others = ones if v == w else np.bitwise_count(other).sum(axis=1, dtype=np.int64)
                    for k, x in enumerate(wide):
                        y, at = (of[v][k + 1 :], slice(k + 1, None)) if v == w else (of[v], slice(None))
                        both = np.bitwise_count(folded[k] & other[at]).sum(axis=1, dtype=np.int64)
                        most = np.minimum(size[x] - (ones[k] - both), size[y] - (others[at] - both))
                        y = y[_may_reach(most, size[x].astype(np.int64), size[y], percent) & ((side[x] == 0) | (side[x] != side[y]))]
                        out.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), (MATCHES - (skipped[x] & skipped[y])).astype(np.int32)))
        return pa.table(dict(zip(("a", "b", "asked"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _bounded(percent: int):
    """Pairs whose bitmaps do not keep them below the threshold."""

    def run(batches):
        for b in batches:
            near = []
            for m, x, n, y in zip(*(b.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b")), strict=True):
                size, p, q = 8 * min(len(x), len(y)), int.from_bytes(x, "little"), int.from_bytes(y, "little")
                p, q = _folded(p, size), _folded(q, size)
                both = (p & q).bit_count()
                near.append(_may_reach(min(m - p.bit_count(), n - q.bit_count()) + both, m, n, percent))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near, pa.bool_())) for c in ("cls_a", "cls_b")], names=["cls_a", "cls_b"])

    return run


def _folded(bits: int, size: int) -> int:
    out, low = 0, (1 << size) - 1
    while bits:
        out, bits = out | bits & low, bits >> size
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of rows of a task."""
    yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], names=["n"])


def _split(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 10
    return _numbers(raw[: 5 * n], 5), _numbers(raw[5 * n : 7 * n], 2), _numbers(raw[7 * n :], 3)


def _shingle_sets(words: int):
    def run(batches):
        for _, texts in _slices(batches):
            _, cls, s, at = _sets(texts, words)
            parts = np.split(s, np.searchsorted(at, np.arange(1, len(cls)))) if len(cls) else []
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([x.tobytes() for x in parts], pa.binary())], names=["cls", "shingles"])

    return run


def _similar(percent: int):
    """Pairs whose sets of shingles reach the threshold."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                b = batch.slice(i, BATCH)
                near = []
                for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                    both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                    common = int((both[1:] == both[:-1]).sum())
                    near.append(common * 100 >= percent * (len(both) - common) and common > 0)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near, pa.bool_())) for c in ("cls_a", "cls_b")], names=["cls_a", "cls_b"])

    return run


def near_duplicate_classes(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc, cls) of each class of exact copies, and pairs (cls_a < cls_b) of classes with similarity >= percent.

    Texts that are null or have fewer than `words` folded words have no shingles and belong to no class.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    kinds = "block long, docs binary, classes binary, fresh binary, keys binary, sizes binary, bits binary"
    signed = stored(docs.mapInArrow(_signatures(words), kinds), "signatures")
    members = stored(signed.select("block", "docs", "classes", "fresh").mapInArrow(_members, "doc long, cls long, node long"), "copies")
    sketches = stored(signed.select("block", "classes", "fresh", "sizes", "bits").mapInArrow(_sketches, "node long, cls long, size int, bits binary"), "sketches")
    sums = signed.select("keys").mapInArrow(_lengths, "chunk int, counts binary").repartition(CHUNKS, "chunk").sortWithinPartitions("chunk").mapInArrow(_summed, "chunk int, counts binary")
    counts = np.zeros((CHUNKS, (1 << COUNTERS_LOG) // CHUNKS), dtype=np.int64)
    for r in sums.collect():  # a fixed number of counters, 8 MB
        counts[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.int64)
    counts = counts.ravel()
    rounds = int(counts.sum()) // ROUND + 1
    buckets = int(counts.sum()) // POSTINGS // rounds + 1
    usual = int(np.median(counts[counts > 0])) if counts.any() else 0  # other values that share a counter
    shared = docs.sparkSession.sparkContext.broadcast(np.maximum(counts - usual, 0).astype(np.int32))
    met = []
    for now in range(rounds):
        posted = signed.select("block", "classes", "fresh", "keys").mapInArrow(_postings(buckets, shared, rounds, now), "bucket long, block long, postings binary")
        met.append(stored(posted.groupBy("bucket").applyInArrow(lambda t: _merged(t, buckets), "a long, b long, asked int"), "met"))
    dropped(signed)
    met = reduce(DataFrame.union, met)
    pairs = met.where("asked > 0")
    in_long = sum(r["n"] for r in met.where("asked < 0").select("asked").mapInArrow(_number, "n long").collect())  # without a shuffle
    if in_long:
        long = met.where("asked < 0").select(F.col("a").alias("list"), F.col("b").alias("node"), "asked").join(sketches.select("node", "size", "bits"), "node")
        long = long.withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(in_long // MEMBERS + 1)))
        pairs = pairs.union(long.groupBy("bucket").applyInArrow(_met_in_long_lists(percent), "a long, b long, asked int"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("collisions"), F.max("asked").alias("asked")).where("collisions >= asked")
    named = lambda x: sketches.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "size", "bits")))
    close = counted.select("a", "b").join(named("a"), "a").join(named("b"), "b").drop("a", "b").mapInArrow(_bounded(percent), "cls_a long, cls_b long")
    close = stored(close.select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b")).where("cls_a < cls_b").distinct(), "close")
    dropped(met)
    dropped(sketches)
    wanted = members.join(close.select(F.col("cls_a").alias("cls")).union(close.select("cls_b")).distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc").alias("doc"))
    sets = stored(docs.join(wanted.select("doc"), "doc", "left_semi").mapInArrow(_shingle_sets(words), "cls long, shingles binary"), "sets")
    side = lambda x: sets.select(F.col("cls").alias(f"cls_{x}"), F.col("shingles").alias(f"set_{x}"))
    pairs = close.join(side("a"), "cls_a").join(side("b"), "cls_b").select("cls_a", "cls_b", "set_a", "set_b").mapInArrow(_similar(percent), "cls_a long, cls_b long")
    return members.select("doc", "cls"), stored(pairs.distinct(), "pairs")


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 60, words: int = 3) -> DataFrame:
    """All pairs doc_a < doc_b of documents whose sets of `words` folded words reach the similarity, copies expanded."""
    members, pairs = near_duplicate_classes(docs, id_col, text_col, percent, words)
    left = members.select(F.col("doc").alias("x"), F.col("cls").alias("cls_a"))
    right = members.select(F.col("doc").alias("y"), F.col("cls").alias("cls_b"))
    between = pairs.join(left, "cls_a").join(right, "cls_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    several = members.groupBy("cls").count().where("count > 1").select("cls")
    copies = members.join(several, "cls", "left_semi")
    within = copies.alias("l").join(copies.alias("r"), "cls").where("l.doc < r.doc").select(F.col("l.doc").alias("doc_a"), F.col("r.doc").alias("doc_b"))
    return between.union(within)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 60, words: int = 3) -> DataFrame:
    """(id, class_id, group_id, links): one row per document with shingles.

    class_id is the least id among its exact copies, links the number of other classes it is linked to, group_id the least id
    of its connected component.  Nothing is expanded to pairs of documents.
    """
    members, pairs = near_duplicate_classes(docs, id_col, text_col, percent, words)
    linked = components(pairs, "cls_a", "cls_b").select(F.col("id").alias("cls"), "component")
    links = pairs.select(F.col("cls_a").alias("cls")).union(pairs.select("cls_b")).groupBy("cls").agg(F.count("*").alias("links"))
    least = members.groupBy("cls").agg(F.min("doc").alias("class_id"))
    named = least.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(links, "cls", "left")
    groups = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.join(named.join(groups, "component"), "cls").select(F.col("doc").alias(id_col), "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
