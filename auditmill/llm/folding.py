"""Skip-and-fold: what remains of texts when only letters and digits count, without case.

Texts stay in their Arrow buffers. A lookup table maps each code point to 0
(skipped) or to its folded form; from the places that aren't skipped come two
64-bit polynomial hashes per text and, for texts whose hashes agree, a
comparison place by place. No canonical strings are built, but the folded code
points of a whole batch are held as arrays, for a comparison those of both
sides; there are no two pointers that skip along the texts.

Letters and digits are the code points of the Unicode classes L* and N*.
Accented letters differ from plain ones; a combining accent is joined to its
letter first where Unicode has the composed letter. Case folding may give
several code points.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PLANE = 0x110000


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
    """Folded code point by code point, 0 for skipped; and those that fold to several."""
    fold = np.zeros(PLANE, np.uint32)
    several: dict[int, tuple[int, ...]] = {}
    for cp in range(PLANE):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] not in "LN":
            continue
        to = [ord(c) for c in ch.casefold()]
        fold[cp] = to[0]
        if len(to) > 1:
            several[cp] = tuple(to)
    return fold, several


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the text each belongs to; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lead = (raw & 0xC0) != 0x80
    text = bytes(raw).decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(lead)
    owner = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    return points, owner


def _compose(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combining accents joined to the letter before them."""
    marks = np.flatnonzero((points >= 0x300) & (points < 0x370))
    if not len(marks):
        return points, owner
    points, keep = points.copy(), np.ones(len(points), bool)
    for m in marks:
        b = m - 1
        while b >= 0 and not keep[b]:
            b -= 1
        if b >= 0 and owner[b] == owner[m]:
            joined = unicodedata.normalize("NFC", chr(points[b]) + chr(points[m]))
            if len(joined) == 1:
                points[b], keep[m] = ord(joined), False
    return points[keep], owner[keep]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points that count, and the text each belongs to."""
    points, owner = _compose(*_points(texts))
    fold, several = _table()
    codes = fold[points]
    kept = codes != 0
    codes, owner, points = codes[kept], owner[kept], points[kept]
    if several and len(points):
        multi = np.isin(points, np.fromiter(several, np.uint32, len(several)))
        if multi.any():
            width = np.ones(len(points), np.int64)
            at = np.flatnonzero(multi)
            width[at] = [len(several[int(points[i])]) for i in at]
            place = np.cumsum(width) - width
            owner = np.repeat(owner, width)
            wide = np.repeat(codes, width)
            for i in at:
                for k, cp in enumerate(several[int(points[i])]):
                    wide[place[i] + k] = cp
            codes = wide
    return codes, owner


def lengths(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text; equal for texts that fold alike."""
    n = len(texts)
    codes, owner = folded(texts)
    size = lengths(owner, n)
    start = np.cumsum(size) - size
    place = np.arange(len(codes)) - start[owner] if len(codes) else np.zeros(0, np.int64)
    out = []
    for base in BASES:
        power = _powers(base, int(size.max()) if n else 0)
        h = np.zeros(n, np.uint64)
        if len(codes):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * power[place]
            some = size > 0
            h[some] = np.add.reduceat(terms, start[some])
        h ^= (size.astype(np.uint64) + np.uint64(1)) * base
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out[0], out[1]


def combined(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each record of several fields, as signed numbers."""
    n = len(columns[0])
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for c in columns:
        x, y = hashes(c)
        a = (a + x) * BASES[1] + np.uint64(1)
        b = (b + y) * BASES[0] + np.uint64(1)
        a ^= a >> np.uint64(31)
        b ^= b >> np.uint64(27)
    return a.view(np.int64), b.view(np.int64)


def same(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether texts fold alike: the folded code points of both sides are built and compared as arrays."""
    n = len(left)
    a, at_a = folded(left)
    b, at_b = folded(right)
    size_a, size_b = lengths(at_a, n), lengths(at_b, n)
    equal = size_a == size_b
    keep_a, keep_b = equal[at_a] if len(a) else np.zeros(0, bool), equal[at_b] if len(b) else np.zeros(0, bool)
    x, y, who = a[keep_a], b[keep_b], at_a[keep_a]
    equal[who[x != y]] = False
    return equal
