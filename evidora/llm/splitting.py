"""Pieces under a size limit, cut at natural boundaries, each repeating the end of the one before.

Separators form a hierarchy: section, paragraph, line, sentence, word, character.  A text is split by the strongest; only
parts that do not fit are split by the next weaker one.  Parts are packed greedily: a piece ends at the last boundary before
the part that no longer fits.  Before a part that must be divided itself, a piece ends only if it is at least half full, else
it is filled from the beginning of that part.  Characters are split only inside a stretch without white space that is longer
than the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels from strong to weak; a piece may end after a match.  Words and characters follow.
SEPARATORS = (
    ("section", re.compile(r"\n\s*\n(?=(?:\d+(?:\.\d+)*\.? +\S|[^a-zà-ÿ\n]{5,90}(?:\n|$)))")),
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"(?<=[.!?…;])[\"”)]?\s+")),
)
_STRETCH = re.compile(r"\S+|\s+")
PIECE = "struct<piece_no:int, begin_char:int, end_char:int, level:string, piece:string>"


class _Packer:
    """Boundaries of one text: `ends` holds (position, level) of each cut, `start` where the current piece's own part begins."""

    def __init__(self, text: str, limit: int, overlap: int) -> None:
        self.text, self.limit, self.room = text, limit, limit - overlap
        self.ends: list[tuple[int, str]] = []
        self.start = self.least = 0  # a stretch too long for the room ends a piece no sooner than `least`

    def full(self, end: int) -> bool:
        return end - self.start > self.capacity()

    def capacity(self) -> int:
        return self.room if self.start else self.limit

    def cut(self, at: int, level: str) -> None:
        self.ends.append((at, level))
        self.start = at

    def pack(self, begin: int, end: int, level: int, before: str) -> None:
        """Packs the part from begin to end; `before` is the level of the boundary at its beginning."""
        if level == len(SEPARATORS):
            self.words(begin, end, before)
            return
        name, separator = SEPARATORS[level]
        for b in [*(m.end() for m in separator.finditer(self.text, begin, end) if begin < m.end() < end), end]:
            if self.full(b):
                alone = b - begin <= self.room
                if begin > self.start and (alone or 2 * (begin - self.start) >= self.capacity()):
                    self.cut(begin, before)
                if self.full(b):
                    self.pack(begin, b, level + 1, before)
            begin, before = b, name

    def words(self, begin: int, end: int, before: str) -> None:
        for m in _STRETCH.finditer(self.text, begin, end):
            a, b = m.span()
            if not self.full(b):
                continue
            if m[0].isspace() or b - a > self.limit:
                level = "word" if m[0].isspace() else "character"
                while self.full(b):
                    at = max(self.start + self.capacity(), self.least)
                    self.cut(at, level if at > a else "word")
            else:
                if a > self.start:
                    self.cut(a, before if a == begin else "word")
                self.least = b


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(begin, end, level of the cut at its end) of each piece; the last one ends with the text.

    Consecutive pieces share exactly `overlap` characters, fewer only where a stretch without white space of almost the
    limit leaves no room for them.  No stretch of up to the limit is ever cut.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    packer = _Packer(text, limit, overlap)
    packer.pack(0, n, 0, "section")
    out, last = [], 0
    for end, level in [*packer.ends, (n, "end")]:
        out.append((max(0, last - overlap, end - limit) if last else 0, end, level))
        last = end
    return out


def with_pieces(df: DataFrame, limit: int, overlap: int, text_col: str = "text") -> DataFrame:
    """Adds `pieces`, the array of the pieces of each text: one piece if it fits, none if it is null or empty.

    A column of that name is replaced; all others stay.
    """
    df = df.drop("pieces")
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("piece_no", pa.int32()), ("begin_char", pa.int32()), ("end_char", pa.int32()), ("level", pa.string()), ("piece", pa.string())]))
        for b in batches:
            pieces = [[{"piece_no": i, "begin_char": s, "end_char": e, "level": level, "piece": t[s:e]} for i, (s, e, level) in enumerate(split_text(t, limit, overlap))] if t else [] for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, kind)], names=[*b.schema.names, "pieces"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, pieces array<{PIECE}>")


def oversized(df: DataFrame, limit: int, overlap: int, id_col: str, text_col: str = "text") -> DataFrame:
    """Texts of more than one piece, and whether some cut had to divide a stretch without white space."""
    cut = F.when(F.exists("pieces", lambda p: p.level == "character"), "forced").otherwise("natural")
    return with_pieces(df.select(id_col, text_col).where(F.length(text_col) > limit), limit, overlap, text_col).select(id_col, cut.alias("cut"))


def rebuilt(df: DataFrame, limit: int, overlap: int, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text_md5, fits): each text put together again from its pieces without what they repeat, and whether all keep the limit."""
    own = F.transform("pieces", lambda p, i: F.when(i == 0, p.piece).otherwise(F.substring(p.piece, F.try_element_at("pieces", i)["end_char"] - p.begin_char + 1, limit)))
    fits = F.forall("pieces", lambda p: F.length(p.piece) <= limit)
    return with_pieces(df.select(id_col, text_col), limit, overlap, text_col).where(F.size("pieces") > 0).select(id_col, F.md5(F.array_join(own, "")).alias("text_md5"), fits.alias("fits"))
