"""Text functions as column expressions: folding, tokens, titles, sanitising, citations, sizes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in lexical search; fixed values.
STOPWORDS = "a ao aos as com da das de do dos e em entre foi na nas no nos o os ou para pela pelas pelo pelos por qual quais que se sua suas seu seus um uma".split()
#: Words that carry no content in labels of tables; fixed values.
LABEL_STOPWORDS = "com das dos entre foi nas nos para pela pelas pelo pelos por qual quais que sua suas seu seus uma como quanto quanta quantos quantas onde quando sobre segundo valor".split()
TOKEN = r"[0-9]+(?:[.,/-][0-9]+)*|[a-z]+"
RARE_TERM = r"[0-9]+(?:[.,/-][0-9]+)*[a-z]?|[a-z]{3,}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: A full stop that is not the end of an abbreviated unit, or another sentence end.
CLAIM_END = r"(?<=[!?;])\s+|(?<=(?<!p)\.)\s+(?=[A-ZÀ-Ý])|\n+"
#: Headings by their form or their folded words; fixed values.
OUTER_SPACES = r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z"
BLANKS = r"[\t\n\f\r ]+"
NUMBERED = r"(?d)^[\t\n\f\r ]*([0-9]+(\.[0-9]+)*|[IVX]+)[\.\-\)][\t\n\f\r ]+.+"
HEADING_WORDS = " (introducao|panorama|conjuntura|mercado de trabalho|industria|comercio|servicos|agropecuaria|inflacao|pib|emprego|resultados|consideracoes) "
CITATION = r"\[([^\[\]]+\.(?:pdf|csv|xlsx|xls|txt))(?:,\s*p(?:\.|ag\.|agina|ágina)?\s*([0-9][0-9,\s-]*))?\]"


@lru_cache(2)
def _letters(form: str) -> tuple[str, str]:
    """Characters with a decomposition to one base character, and those characters; marks come last and vanish."""
    pairs, marks = [], []
    for cp in [*range(0xA0, 0x300), *range(0x370, 0x600), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize(form, c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1 and base.strip():
            pairs.append((c, base))
    marks = [chr(cp) for cp in range(0x300, 0x370)]
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents (canonical decomposition)."""
    return F.translate(F.lower(c), *_letters("NFD"))


def fold_compatible(c: Column) -> Column:
    """Lower case without accents, ordinal signs and other compatible forms as plain characters."""
    return F.translate(F.lower(c), *_letters("NFKD"))


def tokens(c: Column) -> Column:
    """Tokens for lexical search: numbers with inner marks stay whole, stop words are left out, repeated words stay."""
    found = F.regexp_extract_all(fold_compatible(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def rare_terms(c: Column) -> Column:
    """The distinct terms of at least three letters and the numbers of a text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(c), F.lit(RARE_TERM), F.lit(0)), lambda t: ~t.isin(*LABEL_STOPWORDS)))


def without_control(c: Column) -> Column:
    """Without control characters; tabs and line ends stay."""
    return F.regexp_replace(c, CONTROL, "")


def claims(c: Column) -> Column:
    """Sentences and clauses of an answer, in order."""
    return F.filter(F.transform(F.split(c, CLAIM_END), lambda x: F.trim(x)), lambda x: x != "")


def section_title(c: Column) -> Column:
    """The first of the first three lines that reads like a heading; null without one.

    5 to 90 characters, at most ten words; numbered, or mostly capitals, or with a heading word, its accents written or not, in a
    line of at most 60 characters.
    """
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, OUTER_SPACES, "")), lambda x: x != ""), 1, 3)
    letters = lambda x: F.regexp_replace(x, r"[^\p{L}]", "")
    capitals = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    shaped = lambda x: F.length(x).between(5, 90) & (F.size(F.split(x, BLANKS)) <= 10)
    numbered = lambda x: x.rlike(NUMBERED)
    upper = lambda x: (F.length(letters(x)) > 0) & (capitals(x) * 5 > F.length(letters(x)) * 3)
    word = lambda x: (F.length(x) <= 60) & F.concat(F.lit(" "), F.regexp_replace(fold(x), "[^a-z0-9_]", " "), F.lit(" ")).rlike(HEADING_WORDS)
    return F.try_element_at(F.filter(lines, lambda x: shaped(x) & (numbered(x) | upper(x) | word(x))), F.lit(1))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(c) + 3) / 4)


def packing_tokens(c: Column) -> Column:
    """A quarter of the characters with a separator, rounded up: the estimate used when filling a context."""
    return F.floor((F.length(c) + 5) / 4)


def excerpt(c: Column, limit: int, mark: str = "\n[…]") -> Column:
    """At most `limit` characters, with a mark where more was left out."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def cited_pages(c: Column) -> Column:
    """Array of (source, pages) of the citations in an answer; ranges of up to 100 pages are expanded."""
    found = F.regexp_extract_all(c, F.lit(CITATION), F.lit(0))

    def pages(x: Column) -> Column:
        parts = F.filter(F.split(F.regexp_extract(x, CITATION, 2), r"\s*,\s*"), lambda p: p.rlike("[0-9]"))
        ends = lambda p: F.transform(F.split(p, r"\s*-\s*"), lambda e: F.trim(e).try_cast("int"))
        span = lambda e: F.sequence(e[0], F.least(F.greatest(F.coalesce(F.try_element_at(e, F.lit(2)), e[0]), e[0]), e[0] + 99))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: span(ends(p))))))

    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, CITATION, 1).alias("source"), pages(x).alias("pages")))
