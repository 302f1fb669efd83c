"""Folded words of whole text batches, as numpy arrays.

Folding: compatibility decomposition, combining marks dropped, lower case, then maximal runs of a-z and 0-9.
One table look-up per code point replaces the per-text decomposition; the few code points that decompose into
several letters or digits (ligatures, vulgar fractions) are expanded first.  Words are 64-bit hashes, so a batch
of texts becomes three flat arrays (hash, text number, length) without a Python loop over words.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

DROP, EXPAND = 255, 254
_SEED = 0x5EED
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fold_text(text: str) -> str:
    """The definition, one text at a time: decomposed, without combining marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@lru_cache(1)
def _table() -> tuple[np.ndarray, dict[int, str]]:
    table = np.zeros(0x110000, dtype=np.uint8)
    several: dict[int, str] = {}
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        parts = unicodedata.normalize("NFKD", c)
        left = fold_text(c)
        if not left and all(unicodedata.combining(x) for x in parts):
            table[cp] = DROP
        elif len(left) == 1 and left.isascii() and left.isalnum():
            table[cp] = ord(left)
        elif any(x.isascii() and x.isalnum() for x in left):
            table[cp] = EXPAND
            several[cp] = "".join(x if x.isascii() and x.isalnum() else " " for x in left)
    return table, several


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; wraps."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64)


_powers: list[np.ndarray] = []


def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the multiplier of polynomial hashes, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((int(_ODD), pow(int(_ODD), -1, 2**64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            p = np.multiply.accumulate(step)
            if len(_powers) > i:
                _powers[i] = p
            else:
                _powers.append(p)
    return _powers[0], _powers[1]


def _hash_slices(text_bytes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = hash_powers(len(text_bytes) + 1)
    run = np.empty(len(text_bytes) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_letters()[text_bytes] * power[: len(text_bytes)], out=run[1:])
    return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every folded word of the batch and the number of its text, in order of the texts.

    Null and empty texts have no words.
    """
    table, several = _table()
    texts = [t or "" for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = table[codes]
    if (b == EXPAND).any():
        for cp in np.unique(codes[b == EXPAND]).tolist():
            texts = [t.replace(chr(cp), several[cp]) for t in texts]
        b = table[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    begin = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begin[1:])
    keep = b != DROP
    if not keep.all():
        place = np.concatenate([[0], np.cumsum(keep)])
        begin = place[begin]
        b = b[keep]
    inside = np.concatenate([[False], b > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return _hash_slices(b, starts, ends), np.searchsorted(begin, starts, side="right") - 1


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single folded words, equal to those of folded_words."""
    raw = np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return _hash_slices(raw, ends - np.array([len(w) for w in words], dtype=np.int64), ends)


def shingles(hashes: np.ndarray, text_no: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and the text of each."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = h * _ODD + hashes[i : i + m]
    whole = text_no[:m] == text_no[n - 1 :]
    return mix(h[whole]), text_no[:m][whole]
