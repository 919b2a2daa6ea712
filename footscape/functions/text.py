"""Text, identifier and time helpers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case Latin and Greek letters that Unicode decomposes into one letter and marks, and those letters."""
    pairs = [(c, base) for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)))
             if c == c.lower() and len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and base != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
#: Marks that stand on their own, as in decomposed text.
MARKS = "[\u0300-\u036f]"
# --- fixed values: phonetic folding, applied in this order ------------------
GREEK_PAIRS = [
    ("αι", "e"), ("ει", "i"), ("οι", "i"), ("υι", "i"), ("ου", "u"), ("αυ", "av"), ("ευ", "ev"),
    ("ηυ", "iv"), ("μπ", "b"), ("ντ", "d"), ("γκ", "g"), ("γγ", "g"), ("τσ", "ts"), ("τζ", "tz"),
]
GREEK_LETTERS = ("αβγδεζηικλμνξοπρσςτυφχω", "avgdeziiklmnxoprsstifxo")
GREEK_WIDE = [("θ", "th"), ("ψ", "ps")]
LATIN_FOLDS = [
    ("ai", "e"), ("ei", "i"), ("oi", "i"), ("ui", "i"), ("ou", "u"), ("nt", "d"), ("mp", "b"),
    ("gk", "g"), ("ng", "g"), ("ch", "x"), ("kh", "x"), ("ph", "f"), ("gh", "g"), ("ck", "k"),
    ("qu", "k"), ("q", "k"), ("c", "k"), ("y", "i"), ("j", "i"), ("w", "v"), ("ee", "i"), ("oo", "u"),
]


def phonetic_key(c: Column) -> Column:
    """One key for the Greek and Latin spellings of a name; empty for null."""
    s = F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN), MARKS, "")
    for old, new in GREEK_PAIRS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.translate(s, *GREEK_LETTERS)
    for old, new in GREEK_WIDE + LATIN_FOLDS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(s, "([a-z])\\1+", "$1")


def short_text(c: Column, limit: int) -> Column:
    """Trim, squeeze white space, cut to `limit` characters with an ellipsis; null becomes ''."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)


def dedupe_key(source_type: Column, source_id: Column, model: Column, version: Column,
               source_hash: Column | None = None) -> Column:
    h = F.lit("-") if source_hash is None else F.coalesce(source_hash, F.lit("-"))
    return F.concat_ws("::", source_type, source_id, h, model, version)


def observation_id(source_type: Column, source_id: Column, model: Column, version: Column) -> Column:
    safe = F.regexp_replace(source_id, "[^A-Za-z0-9_.-]", "_")
    return F.left(F.concat_ws("_", source_type, safe, model, version), F.lit(300))


def image_id_from_url(url: Column, domain: str) -> Column:
    """The numeric `pKey` of a viewer link; null unless the host is the domain or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ours = (host == domain) | host.endswith("." + domain)
    key = F.try_parse_url(url, F.lit("QUERY"), F.lit("pKey"))
    return F.when(ours & key.rlike("^[0-9]+$"), key)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def to_timestamp_any(number_ms: Column, text: Column, seconds: Column) -> Column:
    """First usable of epoch milliseconds, an ISO string and epoch seconds."""
    return F.coalesce(
        F.timestamp_millis(number_ms), F.try_to_timestamp(text), F.timestamp_seconds(seconds))


def hash_unit(c: Column) -> Column:
    """A stable number in [0, 1) per string: 32-bit FNV-1a modulo 100 000."""
    chars = F.split(c, "")
    codes = F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.filter(chars, lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint")))

    def step(h, code):
        x = h.bitwiseXOR(code)
        # x * 16777619 modulo 2^32 without leaving 64 bits: 16777619 = 2^24 + 403
        low = F.shiftleft(x.bitwiseAND(F.lit(255)), 24)
        return (low + x * F.lit(403)).bitwiseAND(F.lit(4294967295))

    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), step)
    return (h % 100000).cast("double") / F.lit(100000.0)
