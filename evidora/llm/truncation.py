"""Texts cut before their end.

The method is a self-join by prefix: of sorted values, one that is a strict prefix of another stands directly before such a
one, so one range-partitioned sort and a look at the next value find every prefix.  It is applied twice.

* Whole texts: a text that is a strict prefix of a longer one was cut if the longer one goes on within a word or number.  Texts
  meet under the hash of their first 1, 2, 4 ... 256, 512, 768 ... characters: a text is asked under the longest of these it
  has, and what is sorted is the rest up to the next one.  Whole texts never move, and only keys that some text asks for.
* Last words: a text ends inside a word if its last two words are no words of any other text, but a strict prefix of two.

Most cut texts have no longer copy, and those cut between two words share no words with another text.  The way a text ends is
therefore also compared with how lines end elsewhere in the collection: a last line without a sentence end is whole if its
pattern (list entry, table row, source line, heading) also closes lines inside other texts.  `evidence` keeps the three apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.llm.folding import hash_powers, mix
from evidora.scratch import stored

#: Marks that may be left at a cut.
MARKS = (" ", "\n", "\t", "\r", "\f", "\v", "…", "...", "[…]", "[...]", "(…)", "(...)", "-")
#: Characters between two places where prefixes are hashed, and keys of the filter of keys asked for: a bound, 8 MB.
STEP, FILTER_LOG = 256, 20
#: Word pairs a task holds before they are sent.
PAIRS = 500_000
_MARK = re.compile(r"(?:…|\.{2,}|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|\s)+\Z")
_SENTENCE = re.compile(r"[.!?][\"”’»)\]]*\Z")
_BARE = re.compile(r"(?:^|\s)(\d{1,3}[.]|[^\W\d_][.])\Z")
_ENTRY = re.compile(r"\s*(?:[–—•*·-]|[^\x00-\x7f]{1,15}|\d+[.)]|[a-z]\))\s+\S")
_LABEL = re.compile(r"(\w{3,20}): \S")
_SKIP = re.compile(r"[aeioucnáàâãäéêèíóôõöúüçñ]|[^\x00-\x7f]+")
#: A last line in capitals, or the end of a labelled line, is whole if so many distinct texts and such a share of their kind end so.
REPEATS, SHARE = 3, 0.02
_LONG = 200


def _skeleton(line: str) -> str:
    """What is left of a line, whatever its case, accents, digits, or encoding; its last two characters stay."""
    low = line.strip().lower()
    end = re.sub(r"[^\x00-\x7f]+", "?", low[-2:])
    low = re.sub(r"\d{1,3}(?=\.\d{3}|,|\D|$)", "9", low)
    return re.sub(r"\s+", " ", _SKIP.sub("", re.sub(r"(?<=\.)\d{3}", "999", low))) + "|" + re.sub(r"\d", "9", end)


def line_key(line: str, before: str) -> str:
    """Pattern of a line without a sentence end."""
    if line.count("|"):
        cells = line.split("|")
        own = before.count("|")
        return f"row {len(cells) - 1 if own in (0, len(cells) - 1) else -1} {_skeleton(cells[-1])}"
    if _ENTRY.match(line) and ":" in line:
        return "entry " + _skeleton(line.rpartition(":")[2])
    if m := _LABEL.match(line):
        return f"source {_skeleton(m[1])} {_skeleton(' '.join(line.split()[-2:]))}"
    if len(line) > _LONG:
        return ""
    return "head " + _skeleton(line)


def _body(text: str) -> bytes:
    """What stands before the last line, as a hash: copies that end alike have it in common."""
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _endings(text: str) -> tuple[str, str, bool, bytes | None]:
    """(state, key, capitals, body): state is whole, cut, or open, which depends on the key; a line of capitals after other text."""
    body = _MARK.sub("", text)
    if not body:
        return "whole", "", False, None
    if len(body) < len(text.rstrip()) or body[-1] in ",;:-–(":
        return "cut", "", False, None
    line = body.rpartition("\n")[2]
    if _SENTENCE.search(body):
        m = _BARE.search(line)
        return ("open", "stop " + ("9." if m[1][0].isdigit() else m[1].lower()), False, None) if m else ("whole", "", False, None)
    above = body[: len(body) - len(line)]
    before = above.rstrip("\n").rpartition("\n")[2]
    rest = above[-400:]
    capitals = line == line.upper() and rest != rest.upper()
    key = line_key(line, before)
    voting = capitals or key.startswith("source ")
    return ("open", key, capitals, _body(above) if voting else None) if key else ("cut", "", False, None)


_STOPS = re.compile(r"(?:^|\s)(\d{1,3}\.|[^\W\d_]\.)(?=\s+[A-ZÀ-Þ]|\n)")


def _inner_keys(text: str) -> Iterator[str]:
    for m in _STOPS.finditer(text):
        yield "stop " + ("9." if m[1][0].isdigit() else m[1].lower())
    lines = text.split("\n")
    before = ""
    for line, after in zip(lines, lines[1:], strict=False):
        # a line before a blank one is whole; of wrapped text only rows and entries are
        if line.strip() and not _SENTENCE.search(line.rstrip()) and (not after.strip() or "|" in line or _ENTRY.match(line)):
            if key := line_key(line.rstrip(), before):
                yield key
        before = line


def _map(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def text_endings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, state, key) of each text that does not plainly end, and (key, inside, last, capitals, docs, capital_docs), how often keys close lines.

    last and capitals count source lines and lines in capitals by distinct texts before them, so copies of a text count once; docs and
    capital_docs count every document.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *_endings(t)) for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True) if t]
            rows = [r for r in rows if r[1] != "whole"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "state", "key", "capitals", "body"])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            for t in b.column("text").to_pylist():
                n.update(_inner_keys(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])

    open_ends = stored(_map(docs, ends, "doc long, state string, key string, capitals boolean, body binary"), "endings")
    inside = _map(docs.select("text"), inner, "key string, n long").groupBy("key").agg(F.sum("n").alias("inside"))
    texts = open_ends.where("state = 'open'").groupBy("key", "body").agg(F.count("*").alias("docs"), F.count_if("capitals").alias("capital_docs"))
    last = texts.groupBy("key").agg(F.count("*").alias("last"), F.count_if(F.col("capital_docs") > 0).alias("capitals"), F.sum("docs").alias("docs"), F.sum("capital_docs").alias("capital_docs"))
    return open_ends, last.join(inside, "key", "left").fillna(0)


_ENDS = frozenset(m[-1] for m in MARKS)
#: Lengths of the prefixes under which a text stands.
_PLACES = np.array([1 << k for k in range(9)] + list(range(2 * STEP, 1 << 16, STEP)))


def bare(text: str) -> str:
    """The text without marks at its end."""
    n = len(text)
    while n and text[n - 1] in _ENDS:
        for m in MARKS:
            if n >= len(m) and text.startswith(m, n - len(m)):
                n -= len(m)
                break
        else:
            break
    return text[:n]


def _keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every place of every text: number of the text, length of the prefix, its hash, and whether it is the text's last place; a
    text is asked under its last place."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    power, inverse = hash_powers(len(codes) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + np.uint64(0x51)) * power[: len(codes)], dtype=np.uint64)])
    begin = np.cumsum(sizes) - sizes
    places = _PLACES
    if len(sizes) and sizes.max() >= places[-1] + STEP:
        places = np.concatenate([places, np.arange(places[-1] + STEP, sizes.max() + 1, STEP)])
    many = np.searchsorted(places, sizes, side="right")
    no = np.repeat(np.arange(len(texts)), many)
    at = places[np.arange(len(no)) - np.repeat(np.cumsum(many) - many, many)]
    last = np.zeros(len(no), dtype=bool)
    last[np.cumsum(many)[many > 0] - 1] = True
    return no, at, _prefix_hash(run, inverse, begin[no], at), last


def _prefix_hash(run: np.ndarray, inverse: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix((run[begin + n] - run[begin]) * inverse[begin] + n.astype(np.uint64)).view(np.int64)


def _bare_texts(b: pa.RecordBatch, size: int = 256) -> Iterator[tuple[list[int], list[str]]]:
    for i in range(0, b.num_rows, size):
        part = b.slice(i, size)
        yield part.column("doc").to_pylist(), [bare(t or "") for t in part.column("text").to_pylist()]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, whole, asked) of each distinct text of a batch; whole tells texts apart."""
    for b in batches:
        for _, texts in _bare_texts(b):
            texts = list(dict.fromkeys(texts))
            no, _, h, last = _keys(texts)
            whole = np.array([int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(whole[no]), pa.array(last)], names=["key", "whole", "asked"])


def _tails(live):
    """(doc, key, tail, asked): what follows a prefix that may be asked for, up to a character beyond the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = live.value
        for b in batches:
            for docs, texts in _bare_texts(b):
                no, at, h, last = _keys(texts)
                out = []
                for k in np.flatnonzero(there[h.view(np.uint64) >> np.uint64(64 - FILTER_LOG)]).tolist():
                    i, n = int(no[k]), int(at[k])
                    out.append((docs[i], int(h[k]), texts[i][n : min(2 * n, n + STEP) + 1], bool(last[k])))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["doc", "key", "tail", "asked"])

    return run


def strict_prefixes(values: DataFrame) -> DataFrame:
    """(key, value, following) of the distinct values (key, value) that are strict prefixes of another value of their key.

    following: the characters of the next such value after the prefix.  A key of any size is spread over tasks by the sort.
    """
    ordered = values.select("key", "value").distinct().repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    names = ["key", "value", "following", "edge"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32()]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, str] | None = None
        first: tuple[int, str] | None = None
        for b in batches:
            out = []
            for key, value in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                first = first or (key, value)
                if last and last[0] == key and value.startswith(last[1]):
                    out.append((*last, value[len(last[1]) :], None))
                last = (key, value)
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if first:
            edges = [(*first, None, 0), (*last, None, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*edges, strict=True), kinds, strict=True)], names=names)

    found = stored(_map(ordered, steps, "key long, value string, following string, edge int"), "prefixes")
    seam = Window.orderBy("key", "value", "edge")  # the first and the last value of each task
    met = found.where("edge is not null").select("key", "value", "edge", F.lead("key").over(seam).alias("k"), F.lead("value").over(seam).alias("v"))
    across = met.where((F.col("edge") == 1) & (F.col("k") == F.col("key")) & F.col("v").startswith(F.col("value")) & (F.col("v") != F.col("value")))
    across = across.select("key", "value", F.expr("substring(v, length(value) + 1)").alias("following"))
    return found.where("edge is null").select("key", "value", "following").union(across)


def prefixes_of_longer(docs: DataFrame) -> DataFrame:
    """(doc, goes_on) of each text that, without a mark at its end, is a strict prefix of another text; of equal texts all.

    goes_on: the longer text continues within a word or number.  Prefixes are compared by 64-bit hashes, rests as they are.
    """
    keys = docs.mapInArrow(_asked, "key long, whole long, asked boolean").groupBy("key").agg(F.max("asked").alias("asked"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    live = stored(keys.where("asked and a <> b").select("key"), "live")
    there = np.zeros(1 << FILTER_LOG, dtype=bool)
    slots = live.select(F.shiftrightunsigned("key", 64 - FILTER_LOG).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    there[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(there)
    tails = stored(docs.mapInArrow(_tails(shared), "doc long, key long, tail string, asked boolean").join(live, "key", "left_semi"), "tails")
    found = strict_prefixes(tails.select("key", F.col("tail").alias("value")))
    rows = tails.where("asked").select("doc", "key", F.col("tail").alias("value")).join(found, ["key", "value"])
    ends = docs.join(rows.select("doc"), "doc", "left_semi").mapInArrow(_last_characters, "doc long, last string")
    inside = F.substring("following", 1, 1).rlike(r"[\p{L}\p{N}]") & (F.col("last").rlike(r"[\p{L}\p{N}]") | F.substring("following", 1, 1).rlike(r"\p{Nd}") & F.col("last").isin(".", ","))
    return rows.join(ends, "doc").groupBy("doc").agg(F.max(inside).alias("goes_on"))


def _last_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for docs, texts in _bare_texts(b):
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([t[-1:] for t in texts], pa.string())], names=["doc", "last"])


_WORDS = re.compile(r"[^\W_]+")


def cut_words(docs: DataFrame) -> DataFrame:
    """(doc) of the texts whose last two words stand nowhere inside a text, but are a strict prefix of two words that do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc", "before", "word"], (pa.int64(), pa.string(), pa.string())
        known: set[tuple[str, str]] = set()

        def send(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            ends = []
            for docs, texts in _bare_texts(b):
                for doc, text in zip(docs, texts, strict=True):
                    words = _WORDS.findall(text.lower())
                    if len(words) > 1 and text[-1:].isalnum():
                        ends.append((doc, words[-2], words[-1]))
                    known.update(zip(words, words[1:-1], strict=False))
            yield send(ends)
            if len(known) > PAIRS:
                yield send([(None, *x) for x in known])
                known.clear()
        yield send([(None, *x) for x in known])

    pairs = stored(_map(docs, run, "doc long, before string, word string"), "pairs")
    key = F.xxhash64("before").alias("key")
    inside = pairs.where("doc is null").select(key, F.col("word").alias("value")).distinct()
    ends = pairs.where("doc is not null").select("doc", key, F.col("word").alias("value"))
    new = ends.select("key", "value").distinct().join(inside, ["key", "value"], "left_anti")
    asked = inside.join(new.select("key").distinct(), "key", "left_semi")  # words that follow a word before a new last word
    found = strict_prefixes(asked.union(new)).select("key", "value").join(new, ["key", "value"], "left_semi")
    return ends.join(found, ["key", "value"], "left_semi").select("doc")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, evidence) of the texts that were cut.

    evidence: `text` for those that a longer copy goes on within a word, `words` for those whose last two words are a strict
    prefix of two words elsewhere, `ending` for those known only by the way they end.  Null and empty texts were not cut.  A text that ends with a sentence counts only if a longer copy goes on within the word.
    Copies of a text have one vote on how its kind of line ends; a kind of fewer than REPEATS distinct texts is judged by documents.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    open_ends, known = text_endings(docs)
    labelled = F.col("key").startswith("source ")
    kind = F.when(labelled, F.substring_index("key", "|", 1)).when(F.col("capitals") > 0, "capitals")
    n = F.when(labelled, F.col("last")).otherwise(F.col("capitals")).alias("n")
    repeats = known.select("key", "inside", kind.alias("kind"), n, F.when(labelled, F.col("docs")).otherwise(F.col("capital_docs")).alias("docs"))
    kinds = repeats.where("kind is not null").groupBy("kind").agg(F.sum("n").alias("all"), F.sum("docs").alias("all_docs"))
    by_text = (F.col("n") >= REPEATS) & (F.col("n") >= F.col("all") * SHARE)
    by_docs = (F.col("docs") >= REPEATS) & (F.col("docs") >= F.col("all_docs") * SHARE)
    often = F.when(F.col("all") >= REPEATS, by_text).otherwise(by_docs)
    whole = repeats.join(kinds, "kind", "left").where((F.col("inside") > 0) | F.coalesce(often, F.lit(False))).select("key")
    ending = open_ends.join(whole, "key", "left_anti").select("doc", F.lit("ending").alias("evidence"))
    ending = stored(ending, "cut")
    words = cut_words(docs).join(ending.select("doc"), "doc", "left_semi").select("doc", F.lit("words"))
    longer = prefixes_of_longer(docs).where("goes_on").select("doc", F.lit("text"))
    best = F.when(F.array_contains("all", "text"), "text").when(F.array_contains("all", "words"), "words").otherwise("ending")
    found = ending.union(words).union(longer).groupBy(F.col("doc").alias(id_col)).agg(F.collect_set("evidence").alias("all"))
    return found.select(id_col, best.alias("evidence"))


def cut_rates(docs: DataFrame, source: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source, documents, cut, by_text, by_words, by_ending, share): how often each source cuts, and by which evidence; a null source
    is one of its own."""
    cut = cut_texts(docs, id_col, text_col)
    rows = docs.select(source.alias("source"), id_col).join(cut, id_col, "left")
    by = [F.count_if(F.coalesce(F.col("evidence") == x, F.lit(False))).alias(f"by_{x}") for x in ("text", "words", "ending")]
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count("evidence").alias("cut"), *by, F.round(F.count("evidence") / F.count("*"), 6).alias("share"))
