"""Text of scanned pages made continuous: divided words, misread characters, running headers and page numbers.

Page furniture is decided per file from aggregates (lines that recur at the top of its pages, numbers that run with the
pages), so a file of any size is never gathered in one task.  Words misread are corrected against the vocabulary of the
collection: each is a Levenshtein automaton of distance two that is intersected with tries of the vocabulary, which finds
every candidate.  Candidates are ranked by confusions of shapes, then by how often they follow the word before, then by their
frequency.  One that no confusion of the table explains is taken too if the context speaks for it and the word as read stands
in no page that was not scanned.  Numbers are an open class that no vocabulary holds: letters in them are read as the digits
they look like.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.scratch import stored

EDGES = ".,;:()“”\"–"
DIVIDERS = "¬\u00ad-"
#: Shapes that scanning confuses, as read and as printed; fixed values of the data description's kind of noise.
CONFUSED = (("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("c", "e"), ("e", "c"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("6", "b"), ("9", "g"), ("5", "s"), ("8", "b"), ("vv", "w"), ("ri", "n"), ("in", "m"), ("u", "ii"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("nn", "rm"), ("6", "ó"))
IN_NUMBERS = str.maketrans("OolIiSsBbZzgq", "0011155862299")
#: A correction must be so many times as frequent as what was read, in the collection or after the word before.
TIMES = 8
#: Words of a trie, and words looked up in it by one task; cost of edits that no confusion explains, letters a word with one or two of them must have.
TRIE, ASKED, OTHER, SHORT = 20_000, 500, 10, (5, 9)
#: Slots of the filter of words with candidates.
FILTER_LOG = 20

_NUMBER = re.compile(r"\d{1,3}(?:\.\d{3})+(?:,\d+)?%?|\d+,\d+%?|\d{1,3}%?|(?:19|20)\d\d|\d[ºª]")
_NUMERIC = re.compile(r"[\dOolIiSsBbZzgq.,]*[\dOolIiSsBbZzgq][%ºª]?")
_DIGIT = r"[0-9OolI]"
_PAGE_NO = re.compile(rf"\s*(?:(?P<dash>[-–—]\s*{_DIGIT}{{1,4}}\s*[-–—])|(?P<square>\[\s*{_DIGIT}{{1,4}}\s*\])|(?P<of>(?:p\.|p[áa]g(?:ina|\.)?|fl\.)?\s*{_DIGIT}{{1,4}}\s*(?:/|de)\s*{_DIGIT}{{1,4}})|(?P<page>(?:p\.|p[áa]g(?:ina|\.)?|fl\.)\s*{_DIGIT}{{1,4}})|(?P<plain>\d{{1,4}}))\s*", re.I)
_DIVIDED = re.compile(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{DIVIDERS}][ \t]*\n[ \t]*([^\W\d_][\w{DIVIDERS}]*)")
_FRAGMENT = re.compile(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{DIVIDERS}]\Z")
_CLITICS = {"se", "lhe", "lhes", "lo", "la", "los", "las", "me", "te", "nos", "vos", "o", "a", "os", "as"}


def page_number(line: str) -> tuple[str, int] | None:
    """(style, number) of a line that is only a printed page number."""
    m = _PAGE_NO.fullmatch(line)
    if not m:
        return None
    digits = re.search(rf"{_DIGIT}*\d{_DIGIT}*|{_DIGIT}+(?=\W|$)", line[re.match(r"\W*(?:p\.|p[áa]g(?:ina|\.)?|fl\.)?", line, re.I).end() :])
    if not digits:
        return None
    n = digits[0].translate(IN_NUMBERS)
    return (m.lastgroup, int(n)) if n.isdigit() else None


def header_key(line: str) -> str:
    """A header without its page number and with confused shapes made equal; empty for lines that cannot be headers."""
    low = re.sub(r"\s+", " ", line.strip().lower())
    low = re.sub(r"^[-–\[(]?\s*\d{1,4}\s*[-–\])|]?\s{0,5}(?=\D)|\s{1,9}[-–|\[(]?\s*\d{1,4}\s*[-–\])]?$", "", low) if not re.search(r"cap[ií1l]tu[l1i]o \S+$", low) else re.sub(r"^\d{1,4}\s+", "", low)
    for read, printed in (("0", "o"), ("1", "i"), ("l", "i"), ("rn", "m"), ("ii", "u"), ("ci", "d"), ("c", "e"), ("6", "b"), ("9", "g"), ("5", "s"), ("8", "b")):
        low = low.replace(read, printed)
    prose = re.search(r"[.;!?,]\s|[.,;]$|%", line.strip()) or line.rstrip()[-1:] in DIVIDERS
    return low.strip() if 3 <= len(low.strip()) <= 120 and not prose else ""


def _rows(run, schema: list[tuple[str, pa.DataType]]):
    names, kinds = [n for n, _ in schema], [k for _, k in schema]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(run(b.to_pylist()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return each


def _tops(rows):
    for r in rows:
        lines = r["text"].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        divided = len(_DIVIDED.findall(r["text"]))
        for place, i in [("first", full[0]), ("second", full[1])][: len(full)] if len(full) > 1 else [("first", full[0])] if full else []:
            follows = i + 1 < len(lines) and bool(lines[i + 1].strip())
            n = page_number(lines[i])
            yield (r["page_id"], r["file"], r["page"], divided, r["ocr"], place, i, n[0] if n else None, n[1] if n else None, header_key(lines[i]) if follows and not n else "")
        if len(full) > 1:
            n = page_number(lines[full[-1]])
            yield (r["page_id"], r["file"], r["page"], divided, r["ocr"], "last", full[-1], n[0] if n else None, n[1] if n else None, "")
        if not full:
            yield (r["page_id"], r["file"], r["page"], 0, r["ocr"], "none", -1, None, None, "")


def page_furniture(pages: DataFrame) -> DataFrame:
    """(page_id, scanned, header, number): whether the file was scanned, and the index of the header and number lines (-1: none)."""
    kinds = [("page_id", pa.int64()), ("file", pa.string()), ("page", pa.int64()), ("divided", pa.int64()), ("ocr", pa.bool_()), ("place", pa.string()), ("line", pa.int64()), ("style", pa.string()), ("printed", pa.int64()), ("key", pa.string())]
    edges = stored(pages.mapInArrow(_rows(_tops, kinds), "page_id long, file string, page long, divided long, ocr boolean, place string, line long, style string, printed long, key string"), "edges")
    first = edges.where("place in ('first', 'none')")
    files = first.groupBy("file").agg(F.sum("divided").alias("divided"), F.avg(F.coalesce(F.col("ocr").cast("int"), F.lit(0))).alias("ocr"))
    headers = edges.where("place in ('first', 'second') and key <> ''").groupBy("file", "key").agg(F.countDistinct("page").alias("times"))
    # what closes recurring headers of several files after a dash, or begins those without one, tells a header of one page only
    dash = F.contains("key", F.lit(" – "))
    mark = F.when(dash, F.concat(F.lit("– "), F.regexp_replace(F.substring_index("key", " – ", -1), r"\s?\S*\d\S*$|\s\S$", ""))).otherwise(F.substring_index("key", " ", 1))
    common = headers.where("times >= 2").select(mark.alias("mark"), "file").groupBy("mark").agg(F.countDistinct("file").alias("files")).where("files >= 3 and length(mark) > 2").select("mark", F.lit(True).alias("known"))
    numbers = edges.where("style is not null").groupBy("file", "style", (F.col("printed") - F.col("page")).alias("offset")).agg(F.countDistinct("page").alias("times"))
    styles = numbers.groupBy("file", "style").agg(F.max_by("offset", F.struct("times", -F.abs("offset"))).alias("offset"), F.max("times").alias("times"))
    judged = edges.join(files.withColumnRenamed("divided", "all_divided").withColumnRenamed("ocr", "ocr_share"), "file").join(headers, ["file", "key"], "left").join(styles.withColumnRenamed("times", "runs"), ["file", "style"], "left")
    judged = judged.withColumn("mark", mark).join(common, "mark", "left")
    recurring = (F.col("key") != "") & ((F.col("times") >= 2) | F.col("known").isNotNull())
    runs = (F.col("printed") - F.col("page") == F.col("offset")) & ((F.col("runs") >= 2) | (F.col("offset") == 0) | ~F.col("printed").between(1900, 2099))
    numbered = F.col("style").isNotNull() & F.when(F.col("style") == "plain", runs & (F.col("place") != "second")).otherwise(True)
    judged = judged.withColumn("is_header", recurring).withColumn("is_number", numbered)
    out = judged.groupBy("page_id").agg(
        F.max((F.col("all_divided") > 0) | (F.col("ocr_share") > 0.5)).alias("scanned"),
        F.coalesce(F.min(F.when(F.col("is_header") & F.col("place").isin("first", "second"), F.col("line"))), F.lit(-1)).alias("header"),
        F.coalesce(F.max(F.when(F.col("is_number"), F.col("line"))), F.lit(-1)).alias("number"),
    )
    # a header stands first, or after the page number
    return out.withColumn("header", F.when((F.col("header") <= 0) | (F.col("header") == F.col("number") + 1) | (F.col("number") < 0), F.col("header")).otherwise(-1))


def _body(text: str, header: int, number: int) -> list[str]:
    return [x for i, x in enumerate(text.split("\n")) if i not in (header, number)]


def _prose(line: str) -> bool:
    """A line of running text: not a table, nor a heading in capitals."""
    return "|" not in line and "\t" not in line and any(c.islower() for c in line)


def _words_of(lines: list[str]) -> Iterator[str]:
    for k, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        if k and lines[k - 1].rstrip()[-1:] and lines[k - 1].rstrip()[-1] in DIVIDERS:
            words = words[1:]
        if words and words[-1][-1] in DIVIDERS and len(words[-1]) > 1:
            words = words[:-1]
        yield from words


_WORDS_SCHEMA = "before string, word string, n long, clean long, page_id long, file string, page long, place string, left string, right string"


def _words_and_divisions(rows):
    """Pairs of consecutive words with their counts, and of scanned pages the divided words, the fragment at the end, the first word."""
    n: Counter[tuple[str, str]] = Counter()
    clean: Counter[tuple[str, str]] = Counter()
    for r in rows:
        body = _body(r["text"], r["header"], r["number"])
        words = [x for w in _words_of(body) if (x := w.strip(EDGES).lower())]
        (n if r["scanned"] else clean).update(zip(["", *words], words, strict=False))
        if not r["scanned"]:
            continue
        text = "\n".join(x.rstrip() for x in body).strip()
        at = 0
        while m := _DIVIDED.search(text, at):
            yield (None, None, None, None, r["page_id"], r["file"], r["page"], "inside", m[1], m[2].rstrip(DIVIDERS))
            at = m.start(2)
        if m := _FRAGMENT.search(text[-200:]):
            yield (None, None, None, None, r["page_id"], r["file"], r["page"], "end", m[1], None)
        if m := re.match(r"([^\W\d_][\w-]*)", text):
            yield (None, None, None, None, r["page_id"], r["file"], r["page"], "begin", None, m[1].rstrip(DIVIDERS))
    for (a, b), k in n.items():
        yield (a, b, k, 0, *(None,) * 6)
    for (a, b), k in clean.items():
        yield (a, b, k, k, *(None,) * 6)


def divided_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, file, page, place, left, right, whole, unknown): every divided word of scanned pages as one word, with its own hyphen
    if it has one.  Of a page read twice the first reading begins the word that the page before ends with."""
    begins = found.where("place = 'begin'").groupBy("file", (F.col("page") - 1).alias("page")).agg(F.min_by("right", "page_id").alias("right"))
    over = found.where("place = 'end'").drop("right").join(begins, ["file", "page"])
    columns = ["page_id", "file", "page", "place", "left", "right"]
    both = found.where("place = 'inside'").select(columns).union(over.select(columns))
    both = both.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("dashed", F.lower(F.concat("left", F.lit("-"), "right")))
    for form in ("joined", "dashed"):
        both = both.join(words.select(F.col("word").alias(form), F.col("n").alias(f"n_{form}")), form, "left")
    dashed = (F.coalesce("n_dashed", F.lit(0)) > F.coalesce("n_joined", F.lit(0))) | (F.col("n_dashed").isNull() & F.col("n_joined").isNull() & F.lower("right").isin(*sorted(_CLITICS)))
    return both.select("page_id", "file", "page", "place", "left", "right", F.when(dashed, F.col("dashed")).otherwise(F.col("joined")).alias("whole"), (F.col("n_joined").isNull() & F.col("n_dashed").isNull()).alias("unknown"))


class Trie:
    """Vocabulary as nested dictionaries; `within` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, word: str, most: int = 2) -> list[str]:
        """Every word of the vocabulary within `most` edits.  The automaton's state is the bit sets of positions at 0..most edits."""
        n = len(word)
        full = (1 << (n + 1)) - 1
        place: dict[str, int] = {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << i

        def closed(state: list[int]) -> tuple[int, ...]:
            for e in range(1, most + 1):
                state[e] |= (state[e - 1] << 1) & full  # a character of the word is skipped
            return tuple(state)

        out: list[str] = []
        stack = [(self.root, closed([1] + [0] * most))]
        accept = 1 << n
        while stack:
            node, state = stack.pop()
            if "" in node and any(s & accept for s in state):
                out.append(node[""])
            for c, child in node.items():
                if not c:
                    continue
                hit = place.get(c, 0)
                new = [(state[0] & hit) << 1]
                for e in range(1, most + 1):
                    new.append((((state[e] & hit) << 1) | state[e - 1] | (state[e - 1] << 1)) & full)
                if any(new):
                    stack.append((child, closed(new)))
        return out


def shape_cost(read: str, printed: str, most: int = 3) -> int:
    """Least number of confusions of shapes that turn `printed` into `read`; more than `most` if there is no such way."""
    best = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        cost = best[i, j]
        steps = [(1, 1, 0)] if i < len(read) and j < len(printed) and read[i] == printed[j] else []
        steps += [(len(a), len(b), 1) for a, b in CONFUSED if read.startswith(a, i) and printed.startswith(b, j)]
        for di, dj, c in steps:
            if cost + c <= most and cost + c < best.get((i + di, j + dj), most + 1):
                best[i + di, j + dj] = cost + c
                todo.append((i + di, j + dj))
    return best.get((len(read), len(printed)), most + 1)


def _distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
        last = row
    return last[-1]


def corrections(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(word, correct, cost, n, own) of the distinct words of `asked` (word, n): all words within two edits that were read oftener.

    cost: the confusions of shapes, or OTHER and the edits if those do not explain it; n and own: how often the candidate and the
    word were read.  The vocabulary lies in tries by length, of at most about TRIE words; a task looks up ASKED words in one.
    """
    usable = words.where((F.col("n") >= 2) & F.col("word").rlike(r"^[\p{L}-]{2,}$")).select("word", "n", F.length("word").alias("len"))
    parts = {r["len"]: -(-r["count"] // TRIE) for r in usable.groupBy("len").count().collect()}  # a row per length
    if not parts:
        return asked.select("word", F.col("word").alias("correct"), F.lit(0).alias("cost"), F.col("n"), F.col("n").alias("own")).limit(0)
    reach = F.filter(F.sequence(F.length("word") - 2, F.length("word") + 2), lambda x: F.array_contains(F.lit(sorted(parts)), x))
    looked = asked.select("word", "n", F.explode(reach).alias("len"))
    blocks = {r["len"]: -(-r["count"] // ASKED) for r in looked.groupBy("len").count().collect()}
    if not blocks:
        return asked.select("word", F.col("word").alias("correct"), F.lit(0).alias("cost"), F.col("n"), F.col("n").alias("own")).limit(0)
    by_len = lambda d: F.create_map(*(F.lit(x) for kv in sorted(d.items()) for x in kv))[F.col("len")]
    place = lambda many: F.pmod(F.xxhash64("word"), many).cast("int")
    looked = looked.withColumn("block", place(by_len(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), (by_len(parts) - 1).cast("int"))))
    shelf = usable.where(F.col("len").isin(*blocks)).withColumn("part", place(by_len(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), (by_len(blocks) - 1).cast("int"))))

    def look(asked: pd.DataFrame, shelf: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(shelf.word, shelf.n, strict=True))
        out = []
        trie = Trie(list(known)) if len(asked) else None
        for word, n in zip(asked.word, asked.n, strict=True):
            for c in trie.within(word):
                if known[c] <= n:
                    continue
                cost = shape_cost(word, c, 2)
                if cost > 2:
                    edits = _distance(word, c)
                    if known[c] < TIMES * n or len(word) < SHORT[edits - 1]:
                        continue
                    cost = OTHER + edits
                out.append((word, c, cost, known[c], n))
        return pd.DataFrame(out, columns=["word", "correct", "cost", "n", "own"])

    keys = ["len", "part", "block"]
    return looked.groupBy(keys).cogroup(shelf.groupBy(keys)).applyInPandas(look, "word string, correct string, cost int, n long, own long")


def in_context(read: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, before, correct): the best candidate for each word after the word before it, if there is one.

    Candidates are taken by confusions if they are TIMES as frequent as the word; all others only if they follow the word before
    TIMES as often as the word itself does, and, without a confusion, if the word stands in no page that was not scanned.  Of these
    the ones with the fewest confusions come first, then the one seen most often after the word before, then the most frequent.
    """
    asked = read.select("word", "before").distinct()
    met = asked.join(candidates, "word")
    open_ = met.select("before", F.col("correct").alias("word")).union(asked.select("before", "word")).distinct()
    seen = pairs.join(open_, ["before", "word"], "left_semi").groupBy("before", "word").agg(F.sum("n").alias("times"), F.sum("clean").alias("clean"))
    ranked = met.join(seen.select("before", F.col("word").alias("correct"), "times"), ["before", "correct"], "left")
    ranked = ranked.join(seen.select("before", "word", F.col("times").alias("own_times")), ["before", "word"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("times", "own_times")})
    often = F.col("n") >= TIMES * F.col("own")
    backed = F.col("times") >= TIMES * F.greatest("own_times", F.lit(1))
    taken = F.when(F.col("cost") <= 2, often | backed).otherwise(often & backed & (F.col("clean_n") == 0))
    return ranked.where(taken).groupBy("word", "before").agg(F.min_by("correct", F.struct("cost", -F.col("times"), -F.col("n"), "correct")).alias("correct"))


def _slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - FILTER_LOG)


def _body_words(there):
    """(page_id, word, correct, before) of the words that may have candidates, and of numbers with their correct form."""

    def run(rows):
        slots = there.value
        known: dict[str, bool] = {}
        for r in rows:
            lines = _body(r["text"], r["header"], r["number"])
            seen = set()
            for k, line in enumerate(lines):
                if not _prose(line):
                    continue
                before = lines[k - 1].rstrip()[-1:] if k else ""
                words = line.split()
                if words and before and before in DIVIDERS:
                    words = words[1:]
                if words and words[-1][-1] in DIVIDERS:
                    words = words[:-1]
                for i, w in enumerate(words):
                    bare = w.strip(EDGES)
                    w = bare.lower()
                    ask = known.get(w)
                    if ask is None:
                        ask = known[w] = any(c.isdigit() for c in w) or bool(slots[_slot(w)])
                    if not ask:
                        continue
                    if w[-1:] == "o" and w[:-1].isdigit() and i + 1 < len(words) and words[i + 1].startswith("tri"):
                        continue  # an ordinal
                    if w == "0" and i + 1 < len(words) and words[i + 1][:1].isalpha() and words[i + 1] != "mil":
                        w = "0 "
                    seen.add((w, bare, words[i - 1].strip(EDGES).lower() if i else ""))
            for w, bare, before in seen:
                if w == "0 ":
                    yield (r["page_id"], "0", "o", before)
                elif _NUMERIC.fullmatch(w) and any(c.isdigit() for c in w):
                    right = bare.translate(IN_NUMBERS)  # capitals and small letters look like different digits
                    if right != bare and _NUMBER.fullmatch(right):
                        yield (r["page_id"], w, right, before)
                elif len(w) > 1 and any(c.isalpha() for c in w):
                    yield (r["page_id"], w, None, before)

    return run


def with_furniture(pages: DataFrame, id_col: str = "page_id", file_col: str = "source_file", page_col: str = "page", text_col: str = "text", kind_col: str = "extraction") -> DataFrame:
    """(page_id, file, page, text, scanned, header, number) of the pages with text."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(file_col), F.lit("")).alias("file"), F.col(page_col).cast("long").alias("page"), F.col(text_col).alias("text"), (F.col(kind_col) == "ocr").alias("ocr")).where("text is not null and page_id is not null")
    return stored(base.drop("ocr").join(page_furniture(base), "page_id"), "furniture")


def _misread(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned pages, their divided words made whole (page_id, file, page, place, left, right, whole), and corrections (page_id, word, correct)."""
    laid = with_furniture(pages)
    found = stored(laid.mapInArrow(_rows(_words_and_divisions, _kinds(_WORDS_SCHEMA)), _WORDS_SCHEMA), "words")
    pairs = found.where("word is not null").select("before", "word", "n", "clean")
    words = stored(pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")), "vocabulary")
    divided = stored(divided_words(found.where("place is not null").select("page_id", "file", "page", "place", "left", "right"), words), "divided")
    most = words.agg(F.max("n")).first()[0] or 0
    told = words.where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}") & (F.col("n") < most) & (F.col("n") > F.col("clean"))).select("word", "n")
    unknown = divided.where("unknown").select(F.col("whole").alias("word")).distinct().join(words.select("word"), "word", "left_anti").withColumn("n", F.lit(1).cast("long"))
    near = corrections(stored(told.union(unknown), "asked"), words)
    near = stored(near.join(words.select("word", F.col("clean").alias("clean_n")), "word", "left").withColumn("clean_n", F.coalesce("clean_n", F.lit(0))), "corrections")
    there = np.zeros(1 << FILTER_LOG, dtype=bool)
    for r in near.select(F.shiftright(F.crc32(F.col("word").cast("binary")), 32 - FILTER_LOG).alias("slot")).distinct().toLocalIterator():  # at most a row a slot
        there[r["slot"]] = True
    shared = pages.sparkSession.sparkContext.broadcast(there)
    scanned = laid.where("scanned")
    schema = "page_id long, word string, correct string, before string"
    read = stored(scanned.mapInArrow(_rows(_body_words(shared), _kinds(schema)), schema), "read")
    placed = in_context(read.where("correct is null"), near, pairs)
    fixes = read.where("correct is not null").select("page_id", "word", "correct").union(read.where("correct is null").drop("correct").join(placed, ["word", "before"]).select("page_id", "word", "correct"))
    best = near.where((F.col("cost") <= 2) & (F.col("n") >= TIMES * F.col("own"))).groupBy("word").agg(F.min_by("correct", F.struct("cost", -F.col("n"), "correct")).alias("correct"))
    whole = divided.join(best.select(F.col("word").alias("whole"), "correct"), "whole", "left").withColumn("whole", F.when(F.col("unknown"), F.coalesce("correct", "whole")).otherwise(F.col("whole")))
    return scanned, whole.select("page_id", "file", "page", "place", "left", "right", "whole"), stored(fixes.distinct(), "fixes")


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in schema.split(", ")]


def page_defects(pages: DataFrame) -> DataFrame:
    """(page_id, defect, value) of the defects of scanned pages: hyphen, glyph, header, page_number.  Null texts have none."""
    scanned, divided, fixes = _misread(pages)
    lines = F.split("text", "\n")
    header = scanned.where("header >= 0").select("page_id", F.lit("header").alias("defect"), F.get(lines, F.col("header").cast("int")).alias("value"))
    number = scanned.where("number >= 0").select("page_id", F.lit("page_number").alias("defect"), F.get(lines, F.col("number").cast("int")).alias("value"))
    hyphen = divided.select("page_id", F.lit("hyphen").alias("defect"), F.col("whole").alias("value"))
    return header.union(number).union(hyphen).union(fixes.select("page_id", F.lit("glyph"), "correct")).distinct()


def continuous_text(pages: DataFrame) -> DataFrame:
    """(file, page, paragraph, text) of scanned files: paragraphs on one line each, without furniture, words whole and corrected.

    A paragraph that goes on stands on the page where it begins, with its rest from the pages after.  Of a page read twice the
    longer text counts, then the smaller id.
    """
    scanned, divided, fixes = _misread(pages)
    once = scanned.groupBy("file", "page").agg(F.max_by("page_id", F.struct(F.length("text"), -F.col("page_id"))).alias("page_id")).select("page_id")
    fixes = fixes.groupBy("page_id", "word").agg(F.min("correct").alias("correct")).groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("fixes"))
    joins = divided.groupBy("page_id").agg(F.collect_set(F.struct("left", "right", "whole", "place")).alias("joins"))
    ended = divided.where("place = 'end'").join(once, "page_id", "left_semi").groupBy("file", (F.col("page") + 1).alias("page")).agg(F.min("right").alias("taken"))
    rows = scanned.join(once, "page_id", "left_semi").join(fixes, "page_id", "left").join(joins, "page_id", "left").join(ended, ["file", "page"], "left")
    fields = rows.select("file", "page", "text", "header", "number", "taken", F.map_entries("fixes").alias("fixes"), "joins")
    kinds = [("file", pa.string()), ("page", pa.int64()), ("paragraphs", pa.list_(pa.string())), ("continues", pa.bool_()), ("follows", pa.bool_())]
    flowed = stored(fields.mapInArrow(_rows(lambda rs: ((r["file"], r["page"], *_reflow(r)) for r in rs), kinds), "file string, page long, paragraphs array<string>, continues boolean, follows boolean"), "flowed")
    # of each page: does its first paragraph go on from the page before, and where does that paragraph begin
    marks = flowed.select("file", "page", F.size("paragraphs").alias("many"), "follows", F.lag(F.struct("page", "continues")).over(Window.partitionBy("file").orderBy("page")).alias("last"))
    marks = marks.withColumn("joined", F.coalesce((F.col("last.page") == F.col("page") - 1) & F.col("last.continues") & F.col("follows"), F.lit(False)))
    earlier = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.last(F.when(~F.col("joined") | (F.col("many") > 1), F.struct(F.col("page").alias("page"), F.col("many").alias("at"))), ignorenulls=True).over(earlier)
    marks = marks.select("file", "page", F.when(F.col("joined"), begins).alias("begins"))
    each = flowed.join(marks, ["file", "page"]).select("file", "page", "begins", F.posexplode("paragraphs").alias("at", "text"))
    there = F.when((F.col("at") == 0) & F.col("begins").isNotNull(), F.col("begins")).otherwise(F.struct(F.col("page").alias("page"), (F.col("at") + 1).alias("at")))
    parts = each.select("file", there.alias("b"), "page", "text").groupBy("file", F.col("b.page").alias("page"), F.col("b.at").alias("paragraph")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), "text"))).alias("parts"))
    spaced = lambda x: F.when(x["text"].rlike("^[.,;:!?)”]"), x["text"]).otherwise(F.concat(F.lit(" "), x["text"]))
    return parts.select("file", "page", "paragraph", F.ltrim(F.array_join(F.transform("parts", spaced), "")).alias("text"))


def _reflow(r: dict) -> tuple[list[str], bool, bool]:
    """Paragraphs of a page, whether the last goes on, and whether the first may go on from the page before."""
    lines = [x.rstrip() for x in _body(r["text"], r["header"], r["number"])]
    text = "\n".join(lines).strip()
    taken = bool(r["taken"]) and text.startswith(r["taken"])
    if taken:
        text = text[len(r["taken"]) :].lstrip()
    inside, ends = {}, {}
    for j in r["joins"] or []:
        (ends if j["place"] == "end" else inside)[j["left"] if j["place"] == "end" else (j["left"], j["right"])] = j["whole"]

    def cased(word: str, like: str) -> str:
        return word.upper() if like.isupper() and len(like) > 1 else like[0] + word[1:] if like[:1].lower() == word[:1] else word

    text = _DIVIDED.sub(lambda m: cased(inside.get((m[1], m[2].rstrip(DIVIDERS)), m[1] + m[2]), m[1]) + m[2][len(m[2].rstrip(DIVIDERS)) :], text)
    text = re.sub(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{DIVIDERS}]\Z", lambda m: cased(ends[m[1]], m[1]) if m[1] in ends else m[0], text)
    fixes = {e["key"]: e["value"] for e in r["fixes"] or []}

    def fixed(m: re.Match) -> str:
        bare = m[0].strip(EDGES)
        to = fixes.get(bare.lower())
        return m[0].replace(bare, cased(to, bare)) if to else m[0]

    paragraphs = []
    for block in re.split(r"\n[ \t]*\n", text):
        prose: list[str] = []
        for line in block.split("\n"):
            line = re.sub(r"\S+", fixed, line) if fixes else line
            if prose and _prose(line) and _prose(prose[-1]) and not re.search(r"[.!?:]$", prose[-1]):
                prose[-1] += " " + line.strip()
            elif prose and _prose(line) and _prose(prose[-1]) and len(prose[-1]) > 60:
                prose[-1] += " " + line.strip()
            else:
                prose.append(line.strip())
        paragraphs.append("\n".join(prose))
    paragraphs = [p for p in paragraphs if p]
    goes_on = bool(paragraphs) and not re.search(r"[.!?:%\d][\"”)]*\Z", paragraphs[-1])
    return paragraphs, goes_on, taken or bool(paragraphs) and (paragraphs[0][:1].islower() or paragraphs[0][:1].isdigit())
