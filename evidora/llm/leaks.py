"""Passages of evaluation items inside a corpus, by a distributed positional inverted index.

The index holds the postings of every token of the corpus, in shards of documents: a shard stores its terms with the sorted
positions of each.  It serves any table of items.  A window of consecutive words of an item is looked up from its rarest term
in the corpus: that term's postings, shifted by its offset in the window, are candidate beginnings; the lists of the next
rarest terms, shifted likewise, are intersected with them until all words agree.  For proximity the lists are walked instead:
from each posting of the rarest term to the nearest posting of the next word on either side, as long as the span allows.

Items are looked up in rounds of at most WINDOWS windows, which are sent to every task; any number of items is served.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.folding import fold_text, folded_words, word_hash
from evidora.scratch import stored

#: Documents and characters of a shard; positions between two documents, the bound of the words between those of a match.
SHARD, CHARS, GAP = 256, 4_000_000, 64
#: Windows of a round, and candidates looked at together.
WINDOWS, CANDIDATES = 200_000, 2_000_000
_INDEX = "docs binary, first binary, terms binary, counts binary, positions binary"


def _words(text: str | None) -> list[str]:
    flat = fold_text(text or "")
    return "".join(c if c.isascii() and c.isalnum() else " " for c in flat).split()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            if i > begin and (i - begin >= SHARD or size + len(t or "") > CHARS):
                yield ids[begin:i], texts[begin:i]
                begin, size = i, 0
            size += len(t or "")
        if begin < len(texts):
            yield ids[begin:], texts[begin:]


def positional_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per shard: its documents, the first position of each, its terms (hashes, sorted), their counts, and their postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shards(batches):
            h, no = folded_words(texts)
            place = np.arange(len(h), dtype=np.int64) + no * GAP
            first = np.searchsorted(no, np.arange(len(texts))) + np.arange(len(texts)) * GAP
            by = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            steps = np.diff(place[by], prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T  # planes of bytes: most are of zeros
            raw = [ids.astype(np.int64), first.astype(np.int64), terms, counts.astype(np.int32), np.ascontiguousarray(steps)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in raw], names=["docs", "first", "terms", "counts", "positions"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null").mapInArrow(run, _INDEX)


def term_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms (hashes) occurs in the corpus."""
    order = np.argsort(terms)
    shared = index.sparkSession.sparkContext.broadcast(terms[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        n = np.zeros(len(asked), dtype=np.int64)
        for b in batches:
            for t, c in zip(b.column("terms").to_pylist(), b.column("counts").to_pylist(), strict=True):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                at = np.minimum(np.searchsorted(t, asked), len(t) - 1) if len(t) else None
                if at is not None:
                    n += np.where(t[at] == asked, c[at], 0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row a term
        out[order[r["term"]]] = r["n"]
    return out


class _Shard:
    """Postings of a shard, and windows found in it."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.terms, self.counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64)
        steps = np.ascontiguousarray(np.frombuffer(positions, np.uint8).reshape(4, -1).T).view("<i4").ravel()
        self.place = np.cumsum(steps.astype(np.int64))
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts) << 32 | self.place

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the shard; -1 for those it does not have."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def candidates(self, windows: np.ndarray, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term), about CANDIDATES at a time."""
        term = windows[np.arange(len(windows)), rarest]
        size = self.counts[term]
        cuts = np.searchsorted(np.cumsum(size), np.arange(CANDIDATES, int(size.sum()), CANDIDATES), side="right")
        for part in np.split(np.arange(len(windows)), cuts):
            n = size[part]
            w = np.repeat(part, n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            yield w, self.place[self.begin[term[w]] + within]

    def exact(self, windows: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and where they begin; offsets: places in the window, the rarest term's first."""
        for w, at in self.candidates(windows, offsets[:, 0]):
            at = at - offsets[w, 0]
            for step in range(1, windows.shape[1]):
                o = offsets[w, step]
                wanted = windows[w, o] << 32 | np.maximum(at + o, 0)
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                keep = (self.keys[found] == wanted) & (at >= 0)
                w, at = w[keep], at[keep]
            yield w, at

    def near(self, windows: np.ndarray, rarest: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows whose words stand in order with at most `slack` others between them in all, and where they begin."""
        words = windows.shape[1]
        for w, at in self.candidates(windows, rarest):
            lo, hi = at.copy(), at.copy()
            for step in range(1, words):
                for side in (1, -1):
                    o = rarest[w] + side * step
                    on = np.flatnonzero((o >= 0) & (o < words))
                    term = windows[w[on], o[on]] << 32
                    if side == 1:
                        found = np.searchsorted(self.keys, term | hi[on] + 1)
                    else:
                        found = np.searchsorted(self.keys, term | lo[on]) - 1
                    key = self.keys[np.clip(found, 0, len(self.keys) - 1)]
                    good = (found >= 0) & (found < len(self.keys)) & (key >> 32 == term >> 32)
                    (hi if side == 1 else lo)[on] = np.where(good, key & 0xFFFFFFFF, side * (1 << 40))
                keep = hi - lo + 1 <= words + slack
                w, lo, hi = w[keep], lo[keep], hi[keep]
            yield w, lo


def _rounds(items: DataFrame, item_col: str, fields: list[str], words: int) -> Iterator[dict[tuple[str, ...], set[int]]]:
    """Windows of the items with the items they stand in, about WINDOWS at a time; the driver holds one round."""
    now: dict[tuple[str, ...], set[int]] = {}
    for row in items.select(F.col(item_col).cast("long").alias("item"), *fields).where("item is not null").toLocalIterator():
        for f in fields:
            w = _words(row[f])
            for i in range(len(w) - words + 1):
                now.setdefault(tuple(w[i : i + words]), set()).add(row["item"])
        if len(now) >= WINDOWS:
            yield now
            now = {}
    if now:
        yield now


def matches(index: DataFrame, items: DataFrame, fields: list[str], words: int, slack: int = 0, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, item_id): documents of the index in which `words` consecutive words of a field of the item stand in order, with at most
    `slack` (below 64) other words between them in all; a slack of 0 finds exact phrases."""
    if not 0 <= slack < GAP:
        raise ValueError("the slack must be below the distance of documents in a shard")
    result = f"{id_col} long, {item_col} long"
    found = [_round(index, of_window, words, slack, id_col, item_col, result) for of_window in _rounds(items, item_col, fields, words)]
    if len(found) > 1:
        found = [stored(f, "matches") for f in found]
    return reduce(DataFrame.union, found).distinct() if found else index.sparkSession.createDataFrame([], result)


def _round(index: DataFrame, of_window: dict[tuple[str, ...], set[int]], words: int, slack: int, id_col: str, item_col: str, result: str) -> DataFrame:
    names = sorted({t for w in of_window for t in w})
    number = {t: i for i, t in enumerate(names)}
    windows = np.array([[number[t] for t in w] for w in of_window], dtype=np.int64)
    terms = word_hash(names)
    frequency = term_frequencies(index, terms)
    offsets = np.argsort(frequency[windows], axis=1, kind="stable")
    somewhere = (frequency[windows] > 0).all(axis=1)
    owners = [sorted(x) for x, there in zip(of_window.values(), somewhere, strict=True) if there]
    shared = index.sparkSession.sparkContext.broadcast((terms, windows[somewhere], offsets[somewhere], owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, windows, offsets, owners = shared.value
        for b in batches:
            hits: set[tuple[int, int]] = set()
            for r in b.to_pylist():
                if not r["terms"] or not len(windows):
                    continue
                shard = _Shard(r["terms"], r["counts"], r["positions"])
                local = shard.ranks(terms)[windows]
                there = np.flatnonzero((local >= 0).all(axis=1))
                if not len(there):
                    continue
                local, order = local[there], offsets[there]
                docs, first = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["first"], np.int64)
                for w, at in shard.near(local, order[:, 0], slack) if slack else shard.exact(local, order):
                    doc = docs[np.searchsorted(first, at, side="right") - 1]
                    for x, d in set(zip(there[w].tolist(), doc.tolist(), strict=True)):
                        hits.update((d, item) for item in owners[x])
            d, i = zip(*sorted(hits), strict=True) if hits else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=[id_col, item_col])

    return index.mapInArrow(run, result)


def leaked_items(docs: DataFrame, items: DataFrame, fields: list[str], words: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", slack: int = 0) -> DataFrame:
    """Rows (doc_id, item_id): the document has at least `words` consecutive folded words of one of the item's fields; with a
    slack, in order and with at most so many other words between them.

    Null texts and fields have no words; fields shorter than `words` leak nothing; an empty corpus or item table gives no rows.
    """
    return matches(stored(positional_index(docs, id_col, text_col), "index"), items, fields, words, slack, id_col, item_col)
