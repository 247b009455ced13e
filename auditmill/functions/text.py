"""Text functions: native expressions first, Arrow UDFs for 64-bit arithmetic."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

# Anchor texts that say nothing about their target.
GENERIC_ANCHORS = ("click here", "click", "here", "read more", "more", "learn more", "this page", "link", "go", "this", "more info", "find out more")
# Two-letter language codes, and two-letter region codes.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz "
    "ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw "
    "sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
WORD = re.compile(r"\S*[^\W_]\S*", re.U)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """White-space separated words with at least one letter or digit."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def fnv1a64(data: bytes) -> int:
    """FNV-1a, 64 bits, as an unsigned number."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fnv1a64_many(items: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once, column by column."""
    n = len(items)
    h = np.full(n, FNV_START, np.uint64)
    size = np.fromiter((len(b) for b in items), np.int64, n)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(items), np.uint8)
    start = np.cumsum(size) - size
    at, left = start[order], size[order]
    live = int((left > 0).sum())
    g = h[order]
    k = 0
    while live:
        g[:live] = (g[:live] ^ flat[at[:live] + k].astype(np.uint64)) * FNV_PRIME
        k += 1
        live = int(np.searchsorted(-left, -k, side="left"))
    h[order] = g
    return h


@F.pandas_udf(LongType())
def fnv1a64_udf(text: pd.Series) -> pd.Series:
    ok = text.notna()
    out = pd.Series([None] * len(text), index=text.index, dtype="Int64")
    if ok.any():
        out[ok] = fnv1a64_many([t.encode() for t in text[ok]]).view(np.int64)
    return out


def page_words(text: str | None) -> list[str]:
    """Lower-case words as duplicates are compared by."""
    return [w for w in (text or "").lower().split() if re.search(r"[^\W_]", w)]


def simhash64(words: list[str]) -> int:
    """64-bit SimHash over runs of three words; a short text is hashed whole, an empty one is 0."""
    if not words:
        return 0
    if len(words) < 3:
        return _signed(fnv1a64(" ".join(words).encode()))
    runs = [" ".join(words[i : i + 3]).encode() for i in range(len(words) - 2)]
    h = fnv1a64_many(runs)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0).astype(np.int64)
    on = 2 * bits > len(runs)
    return _signed(int((on.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()))


@F.pandas_udf(LongType())
def simhash64_udf(text: pd.Series) -> pd.Series:
    return pd.Series([simhash64(page_words(t)) for t in text], dtype="int64")


@F.pandas_udf(LongType())
def content_hash_udf(text: pd.Series) -> pd.Series:
    """FNV-1a of the lower-case words joined by blanks."""
    return pd.Series(fnv1a64_many([" ".join(page_words(t)).encode() for t in text]).view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


def bands(h: Column) -> Column:
    """The four 16-bit bands of a hash."""
    return F.array(*[F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(65535)).cast("int") for i in range(4)])


def _advance(ch: str) -> int:
    """Advance of a character in thousandths of the font size, by class; an approximation of a plain sans serif."""
    narrow, slim, wide, broad = "'|ijl", " !,./:;I[\\]ft()-`r\"", "ABEKPSVXYC&DHNRUwGOQT", "mMW@%"
    if ch in narrow:
        return 222
    if ch in slim:
        return 278 if ch not in '()-`r"' else 333
    if ch in broad:
        return {"m": 833, "M": 833, "W": 944, "@": 1015, "%": 889}[ch]
    if ch in wide:
        return 722 if ch in "CDHNRUwG" else 778 if ch in "OQ" else 611 if ch == "T" else 667
    return 500 if ch in "ckJsvxyz" else 556


ADVANCES = {chr(c): _advance(chr(c)) for c in range(32, 127)}


def pixel_width(text: str | None, size: float) -> float:
    return round(sum(ADVANCES.get(ch, 556) for ch in text or "") * size / 1000, 1)


def pixel_width_udf(size: float):
    @F.pandas_udf(DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([pixel_width(t, size) for t in text], dtype="float64")

    return run


@lru_cache(maxsize=1)
def regions() -> tuple[str, ...]:
    """The region codes of ISO 3166, as Java's locales list them."""
    codes = SparkSession.active()._jvm.java.util.Locale.getISOCountries()
    return tuple(sorted(str(c) for c in codes))


def valid_hreflang(value: Column) -> Column:
    """x-default, or a language with script, region or both; the codes are those of ISO 639 and ISO 3166."""
    v = F.trim(value)
    parts = F.split(F.lower(v), "-")
    script, region = (lambda p: p.rlike(r"^\p{L}{4}$")), (lambda p: F.upper(p).isin(*regions()))
    known = parts[0].isin(*LANGUAGES)
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    ok = known & F.when(n == 1, True).when(n == 2, region(at(1)) | script(at(1))).when(n == 3, script(at(1)) & region(at(2))).otherwise(False)
    return F.coalesce((F.lower(v) == "x-default") | ok, F.lit(False))


def robots_directive(meta: Column, header: Column, name: str, bots: tuple[str, ...] = ("googlebot",)) -> Column:
    """Whether ``noindex`` or ``nofollow`` holds by meta robots or by the header, whose parts may be scoped to a bot."""
    wanted = F.array(F.lit(name), F.lit("none"))
    tokens = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[,\s]+")
    known = r"^\s*(?:unavailable_after|max-snippet|max-image-preview|max-video-preview)\s*:"
    parts = F.split(F.lower(F.coalesce(header, F.lit(""))), ",")
    start = F.struct(F.lit(True).alias("on"), F.lit(False).alias("hit"))

    def step(acc: Column, part: Column) -> Column:
        scoped = part.contains(":") & ~part.rlike(known)
        on = F.when(scoped, F.trim(F.regexp_extract(part, "^([^:]*):", 1)).isin(*bots)).otherwise(acc["on"])
        body = F.when(scoped, F.regexp_extract(part, "^[^:]*:(.*)$", 1)).otherwise(part)
        return F.struct(on.alias("on"), (acc["hit"] | (on & F.arrays_overlap(F.split(F.trim(body), r"\s+"), wanted))).alias("hit"))

    return F.arrays_overlap(tokens(meta), wanted) | F.aggregate(parts, start, step)["hit"]


def refresh_target(content: Column) -> Column:
    """The address of a meta refresh; null for a plain reload."""
    u = F.trim(F.regexp_extract(content, r"(?i)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=)?\s*['\"]?([^'\"]+)", 1))
    return F.when(u != "", u)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def csv_field(text: Column) -> Column:
    """Quoted where a comma, quote or line break asks for it."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def markdown_cell(text: Column) -> Column:
    return F.replace(collapse(text), F.lit("|"), F.lit("\\|"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


# The folders of a theme that a template error can name.
THEME_FOLDERS = ("snippets", "sections", "templates", "layout")


def liquid_place(path: Column) -> Column:
    """The file and line a template error in an address names, 'the theme' where it names none; null without an error.

    The file is the earliest piece of the address that begins at a theme folder,
    the line the first number after the word 'line'.
    """
    said = F.translate(F.coalesce(F.try_url_decode(path), path), "+", " ")
    begins = F.array_sort(F.filter(F.array(*[F.instr(said, f"{f}/") for f in THEME_FOLDERS]), lambda at: at > 0))
    begun = F.transform(begins, lambda at: F.regexp_extract(F.substr(said, at), "^[a-z]+/[A-Za-z0-9_.-]+", 0))
    file = F.get(F.filter(begun, lambda f: f != ""), F.lit(0))
    after = F.split(said, "line ")
    number = F.get(F.filter(F.slice(after, 2, F.greatest(F.size(after), F.lit(1))), lambda t: t.rlike("^[0-9]")), F.lit(0))
    line = F.concat(F.lit("line "), F.regexp_extract(number, "^[0-9]+", 0))
    place = F.concat_ws(" ", file, line)
    return F.when(F.lower(said).contains("liquid error"), F.when(place == "", F.lit("the theme")).otherwise(place))


def rewrite_kind(source: Column, target: Column) -> Column:
    """How an address was rewritten: 'removed:x', 'inserted:x' or 'moved:a>b'; null for no change worth naming.

    What both addresses begin and end with is found by one pattern each, over
    the two joined by a character that no address holds: the longest group that
    comes back after it.
    """
    number = lambda t: F.when(t.rlike("^-?[0-9]+$"), F.when(t.startswith("-"), F.lit("-#")).otherwise(F.lit("#"))).otherwise(t)

    def said(x: Column) -> Column:
        a, b, gone, new, kept = (x[k] for k in ("a", "b", "gone", "new", "kept"))
        within = ~F.concat(gone, new).contains("/")
        less = lambda t: F.substr(t, F.lit(1), F.length(t) - F.length(kept))
        return (
            F.when((gone == "") & (new == ""), F.lit(None))
            .when(within & (new == ""), F.concat(F.lit("removed:"), number(gone)))
            .when(within & (gone == ""), F.concat(F.lit("inserted:"), number(new)))
            .when(kept.startswith("/") & (F.length(kept) > 2), F.concat(F.lit("moved:"), less(a), F.lit(">"), less(b)))
        )

    def with_tail(x: Column) -> Column:
        lost, won = F.substr(x["a"], x["head"] + 1), F.substr(x["b"], x["head"] + 1)
        kept = F.regexp_extract(F.concat(lost, F.lit("\u0000"), won), r"(?s)^[^\x00]*?([^\x00]*)\x00[^\x00]*\1$", 1)
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), lost.alias("lost"), won.alias("won"), kept.alias("kept")), lambda y: let(F.struct(
            y["a"].alias("a"), y["b"].alias("b"), F.substr(y["lost"], F.lit(1), F.length(y["lost"]) - F.length(y["kept"])).alias("gone"),
            F.substr(y["won"], F.lit(1), F.length(y["won"]) - F.length(y["kept"])).alias("new"), y["kept"].alias("kept")), said))

    a, b = F.lower(source), F.lower(target)
    head = F.length(F.regexp_extract(F.concat(a, F.lit("\u0000"), b), r"(?s)^(.*)[^\x00]*\x00\1", 1))
    return let(F.struct(a.alias("a"), b.alias("b"), head.alias("head")), with_tail)
