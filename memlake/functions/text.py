"""String helpers: content ids, JS-compatible trim and lengths, name normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.config import ID_CHARS, SHORT_ID_CHARS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(*parts) -> Column:
    """First 16 hex chars of SHA-256 over the concatenated parts (strings or Columns)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat(*[c.cast("string") for c in cols]), 256), 1, ID_CHARS)


def short_id(h="hash") -> Column:
    return F.substring(_c(h), 1, SHORT_ID_CHARS)


# Fixed value: the characters JavaScript's String.prototype.trim removes (WhiteSpace and
# LineTerminator of the language spec), as a regex class valid in Java and RE2.
JS_SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


# The same set as a plain string of characters (for Spark's trim(str, chars)).
JS_SPACE_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(x) -> Column:
    """String.prototype.trim: strip leading/trailing whitespace.

    Spark's one-argument trim strips spaces only; trim(str, chars) strips any of `chars`
    from both ends without scanning the middle of the string."""
    return F.trim(_c(x), F.lit(JS_SPACE_CHARS))


NAME_JUNK = f"(?:[-_.]|{JS_SPACE})+"


def normalize_name(x) -> Column:
    """Lower-case and drop '-', '_', whitespace and '.'."""
    return F.regexp_replace(F.lower(_c(x)), NAME_JUNK, "")


def utf16_length(x) -> Column:
    """Length in UTF-16 code units, as JavaScript counts it (supplementary chars count 2)."""
    s = _c(x)
    return F.length(s) + F.length(F.regexp_replace(s, r"[\x{0}-\x{FFFF}]", ""))


def token_estimate(chars) -> Column:
    """round(chars / 4) with halves rounded up."""
    return F.floor(_c(chars) / F.lit(4.0) + F.lit(0.5)).cast("bigint")


def js_number(x) -> Column:
    """Render a double the way JavaScript prints it for integral values (3 not 3.0)."""
    v = _c(x)
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def iso_utc(epoch_seconds) -> Column:
    """Date.toISOString for whole seconds: 2024-03-01T00:00:00.000Z."""
    return F.date_format(F.timestamp_seconds(_c(epoch_seconds)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
