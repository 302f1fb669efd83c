"""Text decoded with wrong character encodings: found, and restored where nothing was lost.

Suspect words (characters outside the usual repertoire, or in impossible places) are judged against every encoding chain: the
bytes are recovered along the chain and the word they give is compared with the word as stored, under a character bigram
model of the records without suspect words.  The chain is latent; expectation-maximization estimates how often each chain
occurs per source and field, with the whole collection as the prior, so weak evidence in one record is pooled with that of
others from the same source.  A word is repaired along its most probable chain a posteriori.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.scratch import stored

#: Characters of ordinary text beside ASCII.
USUAL = "áàâãäéêèíóôõöúüçñÁÀÂÃÄÉÊÈÍÓÔÕÖÚÜÇÑºª°–—“”‘’…•²³‰€½±§©®£™×⁄\u00a0"
_TAIL = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Evidence: an unusual character, a lower-case letter before an accented capital, a lead byte before a continuation byte,
#: a sign that is glued to letters on both sides, or a lone accented capital.
EVIDENCE = rf"[^\x00-\x7f{USUAL}]|[a-zß-ÿ][À-Þ]|[ÃÂâ][{_TAIL}]|[A-Za-zÀ-ÿ][½±§©®£¶™×²³][a-zß-ÿ]"
_WORD = re.compile(r"[^ \n\r\t]+")
_EVIDENCE = re.compile(EVIDENCE)
_HIGH = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{3}")


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; undefined bytes stand for the control characters of their number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _utf8_read_as(codec: str) -> Callable[[str], str]:
    to = _bytes_of(codec)
    back = {b: c for c, b in to.items()}

    def run(m: re.Match) -> str:
        out, raw, s = [], bytearray(), m[0]

        def flush() -> None:
            at = 0
            for x in _UTF8.finditer(raw):
                out.extend(back[b] for b in raw[at : x.start()])
                out.append(x[0].decode("utf-8", "replace"))
                at = x.end()
            out.extend(back[b] for b in raw[at:])
            raw.clear()

        for c in s:
            if c in to:
                raw.append(to[c])
            else:
                flush()
                out.append(c)
        flush()
        return "".join(out)

    return lambda word: _HIGH.sub(run, word)


def _swapped(true: str, read: str) -> Callable[[str], str]:
    to, back = _bytes_of(read), {b: c for c, b in _bytes_of(true).items()}
    moves = {ord(c): back[b] for c, b in to.items()}
    return lambda word: word.translate(moves)


def _twice(f: Callable[[str], str], g: Callable[[str], str]) -> Callable[[str], str]:
    return lambda word: g(f(word))


_READ = {c: _utf8_read_as(c) for c in ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "iso8859_15", "cp1254")}
#: Inverse of each chain; the first entry keeps the word.
CHAINS: dict[str, Callable[[str], str]] = {"kept": lambda w: w}
CHAINS |= {f"utf-8 as {c}": f for c, f in _READ.items()}
CHAINS |= {f"utf-8 as {c} twice": _twice(_READ[c], _READ[c]) for c in ("cp1252", "latin-1")}
CHAINS["utf-8 as cp1252 three times"] = _twice(CHAINS["utf-8 as cp1252 twice"], _READ["cp1252"])
CHAINS |= {f"utf-8 as {a}, utf-8 as {b}": _twice(_READ[b], _READ[a]) for a, b in (("cp1252", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"))}
CHAINS |= {f"{a} as {b}": _swapped(a, b) for a, b in (("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1250"))}
NAMES = list(CHAINS)


@lru_cache(1)
def _flags() -> np.ndarray:
    """What EVIDENCE asks of each code point, as bits."""
    f = np.zeros(0x110000, dtype=np.uint8)
    f[128:] |= 1
    for c in USUAL:
        f[ord(c)] &= 0xFE
    f[[ord(c) for c in map(chr, range(0x250)) if re.match("[a-zß-ÿ]", c)]] |= 2
    f[ord("À") : ord("Þ") + 1] |= 4
    f[[ord(c) for c in "ÃÂâ"]] |= 8
    f[[cp for cp in range(0x3000) if re.match(f"[{_TAIL}]", chr(cp))]] |= 16
    f[[ord(c) for c in "½±§©®£¶™×²³"]] |= 32
    f[[cp for cp in range(0x250) if re.match("[A-Za-zÀ-ÿ]", chr(cp))]] |= 64
    return f


def with_evidence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which texts have EVIDENCE; the code points of all, joined by line ends, and the text of each."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = _flags()[codes]
    hit = (f & 1).astype(bool)
    hit[1:] |= (f[:-1] & 2).astype(bool) & (f[1:] & 4).astype(bool)
    hit[1:] |= (f[:-1] & 8).astype(bool) & (f[1:] & 16).astype(bool)
    hit[2:] |= (f[:-2] & 64).astype(bool) & (f[1:-1] & 32).astype(bool) & (f[2:] & 2).astype(bool)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    some = np.zeros(len(texts), dtype=bool)
    some[np.searchsorted(begin, np.flatnonzero(hit), side="right") - 1] = True
    return some, codes, np.repeat(~some, sizes)[: len(codes)]


def suspects_and_pairs(fields: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(tbl, rec, field, source, word) of all suspect words, and log probabilities of a character after another.

    The second is a table of 256 classes (0 for all beyond Latin-1) of the texts without evidence.  Both come from one pass.
    """
    names = ["tbl", "rec", "field", "source", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for b in batches:
            out: list[tuple] = []
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [t or "" for t in part.column(4).to_pylist()]
                some, codes, clean = with_evidence(texts)
                c = np.where(codes == 10, 32, np.where(codes < 256, codes, 0)).astype(np.int64)
                both = clean[:-1] & clean[1:]
                total += np.bincount((c[:-1] * 256 + c[1:])[both], minlength=65536)
                if some.any():
                    rows = part.take(pa.array(np.flatnonzero(some)))
                    for tbl, rec, field, source, text in zip(*(x.to_pylist() for x in rows.columns), strict=True):
                        out.extend((tbl, rec, field, source, w) for w in {w for w in _WORD.findall(text) if _EVIDENCE.search(w)})
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cols), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())], names=[*names, "pair", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), pa.string()) for _ in names), pa.array(at.astype(np.int32)), pa.array(total[at])], names=[*names, "pair", "n"])

    ready = fields.select("tbl", "rec", "field", F.coalesce("source", F.lit("")).alias("source"), "text")
    seen = stored(ready.mapInArrow(run, "tbl string, rec string, field string, source string, word string, pair int, n long"), "suspects")
    counts = np.zeros(65536)
    for r in seen.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65536 rows
        counts[r["pair"]] = r["n"]
    counts = counts.reshape(256, 256)
    return seen.where("pair is null").select(names).distinct(), np.log((counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * 256))


def _plausible(word: str, pairs: np.ndarray) -> float:
    c = [32, *(ord(x) if ord(x) < 256 else 0 for x in word), 32]
    return float(pairs[c[:-1], c[1:]].sum()) - 12.0 * sum(ord(x) >= 256 and x not in USUAL for x in word)


def garbled_words(fields: DataFrame, rounds: int = 3) -> DataFrame:
    """(tbl, rec, field, source, word, fixed, chain, lost) of every garbled word of (tbl, rec, field, source, text).

    fixed is null for words that lost characters to U+FFFD.  Null texts have no words.
    """
    spark = fields.sparkSession
    places, table = suspects_and_pairs(fields)
    pairs = spark.sparkContext.broadcast(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[float]] = {}
        for b in batches:
            rows = []
            for w in b.column("word").to_pylist():
                if w not in known:
                    own = _plausible(w, pairs.value)
                    known[w] = [0.0] + [(_plausible(x, pairs.value) - own) if (x := f(w)) != w else -1e9 for f in list(CHAINS.values())[1:]]
                rows.append(known[w])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "gain"])

    lost = F.contains("word", F.lit("�"))
    distinct = places.where(~lost).groupBy("source", "field", "word").agg(F.count("*").alias("n"))
    evidence = stored(distinct.mapInArrow(judge, "source string, field string, word string, n long, gain array<double>"), "evidence")
    k = len(NAMES)
    start = [0.7] + [0.3 / (k - 1)] * (k - 1)
    share = None  # of each chain per source and field

    def posterior(df: DataFrame, whole: list[float]) -> DataFrame:
        return df.mapInArrow(_posterior(whole), "source string, field string, word string, n long, p array<double>")

    whole = start
    for _ in range(rounds):
        now = posterior(evidence if share is None else evidence.join(share, ["source", "field"]), whole).withColumn("p", F.transform("p", lambda x: x * F.col("n")))
        sums = now.groupBy("source", "field").agg(F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("share"))
        share = stored(sums, "shares")
        total = share.agg(*(F.coalesce(F.sum(F.col("share")[i]), F.lit(0.0)).alias(str(i)) for i in range(k))).first()
        whole = [(x + 1e-3) / (sum(total) + k * 1e-3) for x in total]
        whole[0] = max(whole[0], 0.05)
    final = posterior(evidence.join(share, ["source", "field"]), whole)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, field, word, p in zip(*(b.column(c).to_pylist() for c in ("source", "field", "word", "p")), strict=True):
                best = int(np.argmax(p[1:])) + 1
                if p[0] < 0.5:
                    rows.append((source, field, word, CHAINS[NAMES[best]](word), NAMES[best]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["source", "field", "word", "fixed", "chain"])

    fixed = final.mapInArrow(repair, "source string, field string, word string, fixed string, chain string")
    whole_words = places.join(fixed, ["source", "field", "word"]).withColumn("lost", F.lit(False))
    broken = places.where(lost).select("source", "field", "word", "tbl", "rec", F.lit(None).cast("string").alias("fixed"), F.lit(None).cast("string").alias("chain"), F.lit(True).alias("lost"))
    return whole_words.select(broken.columns).union(broken)


def _posterior(whole: list[float]):
    prior = np.array(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gain = np.array(b.column("gain").to_pylist())
            mix = np.broadcast_to(prior, gain.shape)
            if "share" in b.schema.names:
                own = np.array(b.column("share").to_pylist())
                mix = (own + 5 * prior) / (own.sum(axis=1, keepdims=True) + 5)  # five words' weight for the collection
            x = gain + np.log(mix)
            p = np.exp(x - x.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("source", "field", "word", "n")), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["source", "field", "word", "n", "p"])

    return run


def garbled_fields(fields: DataFrame) -> DataFrame:
    """(tbl, rec_id, field, recoverable) of the fields with garbled characters; 0 where characters were lost to U+FFFD."""
    return garbled_words(fields).groupBy("tbl", F.col("rec").alias("rec_id"), "field").agg(F.min(F.when(F.col("lost"), 0).otherwise(1)).alias("recoverable"))


def repaired_fields(fields: DataFrame) -> DataFrame:
    """(tbl, rec_id, field, text, repaired) of the garbled fields that lost nothing; other texts stay as they are."""
    found = garbled_words(fields).groupBy("tbl", "rec", "field").agg(F.max("lost").alias("lost"), F.collect_list(F.struct("word", "fixed")).alias("words")).where("not lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, words in zip(b.column("text").to_pylist(), b.column("words").to_pylist(), strict=True):
                to = {w["word"]: w["fixed"] for w in words}
                out.append(_WORD.sub(lambda m, to=to: to.get(m[0], m[0]), text))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("tbl", "rec", "field", "text")), pa.array(out, pa.string())], names=["tbl", "rec_id", "field", "text", "repaired"])

    rows = fields.select("tbl", "rec", "field", "text").join(found, ["tbl", "rec", "field"])
    return rows.mapInArrow(run, "tbl string, rec_id string, field string, text string, repaired string").distinct()
