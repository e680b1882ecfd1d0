"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGES, TEXT_ENDINGS

#: White space that a trim removes: Unicode space plus the byte order mark.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_DIGITS = 36


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, f"{_WS}+\\z", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(trim_end(text), f"\\A{_WS}+", "")


def lines(text: Column) -> Column:
    """Lines by newline; a final newline makes an empty last line."""
    return F.split(text, "\n", -1)


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the length, rounded up."""
    return F.ceil(units(text) / F.lit(4.0)).cast("int")


def extension(path: Column) -> Column:
    """The lower-cased last extension with its dot; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text"))


def detect_module(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 1, parts[0]).otherwise("root")


def is_text_file(path: Column) -> Column:
    """True for known extensions and for the few names that count as text."""
    known = detect_language(path) != "text"
    for end in TEXT_ENDINGS:
        known = known | F.endswith(path, F.lit(end))
    return known


def iso_millis(ts: Column) -> Column:
    """UTC ISO-8601 text with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hash_id(path: Column, line: Column) -> Column:
    """Base-36 id of ``path:line``: a 32-bit rolling hash with factor 31 over UTF-16 units, at least 8 digits."""
    key = F.encode(F.concat(path, F.lit(":"), line.cast("string")), "UTF-16BE")
    hexed = F.hex(key)
    places = F.sequence(F.lit(0), (F.length(hexed) / 4).cast("int") - 1)
    codes = F.transform(places, lambda k: F.conv(F.substr(hexed, k * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    wrapped = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(wrapped >= 1 << 31, (1 << 32) - wrapped).otherwise(wrapped)
    return F.lpad(F.lower(F.conv(signed.cast("string"), 10, _DIGITS)), 8, "0")


def fence_language(language: Column) -> Column:
    return F.regexp_replace(F.lower(F.when(F.coalesce(language, F.lit("")) == "", "text").otherwise(language)), "[^a-z0-9+#-]", "")


def short_number(value: Column) -> Column:
    """Four decimals at most, without trailing zeros, as text."""
    fixed = F.format_string("%.4f", F.round(value.cast("double"), 4))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def heading_level(line: Column) -> Column:
    """True for a heading of level 1 to 3."""
    return line.rlike(r"^#{1,3}\s+.")


def heading_title(line: Column) -> Column:
    return F.regexp_extract(line, r"^#{1,3}\s+(.+)", 1)
