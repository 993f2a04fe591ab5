"""Texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS = "０１２３４５６７８９"
#: Characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Punctuation that counts as meaningful beside letters and digits.
PUNCTUATION = '，。、；：！？"（）【】'
MEANINGLESS = rf"[^\p{{L}}\p{{N}}{PUNCTUATION}]"


def unicode_pattern(pattern: str) -> str:
    """Case-insensitive, with classes over all of Unicode."""
    return f"(?iuU){pattern}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def number(text: Column) -> Column:
    """Thousands commas removed, full-width digits read; null if it isn't a number."""
    return F.translate(text, f"{WIDE_DIGITS},", "0123456789").try_cast("double")


def unbracketed(text: Column) -> Column:
    """Commas and parentheses removed; the sign that parentheses mean is lost."""
    return F.translate(text, ",()", "")


def meaningful_chars(text: Column, dropped: str = MEANINGLESS) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), dropped, "")).cast("long")


def text_ratio(chars: Column, pages: Column) -> Column:
    """Characters over 500 a page, at most 1; 0 without pages."""
    return F.coalesce(F.least(F.try_divide(chars.cast("double"), pages * 500), F.lit(1.0)), F.lit(0.0))


def size_label(size: Column) -> Column:
    """0 B, 512.0 B, 1.5 KB, ... up to GB; null beyond 1 TB or below 0."""
    value = lambda power: F.round(size.cast("decimal(20,0)") / F.lit(1024**power).cast("decimal(12,0)"), 2).cast("double").cast("string")
    label = F.when(size == 0, "0 B").when(size < 0, F.lit(None))
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        label = label.when(size < 1024 ** (power + 1), F.concat(value(power), F.lit(f" {unit}")))
    return label


def iso_year(text: Column) -> Column:
    """Year of an ISO time, with or without zone; null if it can't be read."""
    plain = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")
    return F.year(plain.try_cast("timestamp_ntz"))


def message_prefix(message: Column) -> Column:
    return F.trim(F.substring_index(message, "(", 1))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def swap_suffix(name: Column, old: str, new: str) -> Column:
    cut = F.substring(name, F.lit(1), F.length(name) - len(old))
    return F.when(F.endswith(name, F.lit(old)), F.concat(cut, F.lit(new))).otherwise(name)


def absolute_url(url: Column, base: str) -> Column:
    root = base.split("//")[0] + "//" + base.split("//")[1].split("/")[0] if "//" in base else base
    folder = base.rsplit("/", 1)[0] + "/" if "/" in base.split("//")[-1] else base + "/"
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("/")), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(folder), url))


def unwrap(value: Column) -> Column:
    """A plain value, or the value of a {"value": ...} object, as text."""
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), F.get_json_object(value, "$.value")).otherwise(value)


def links(html: Column, suffix: str) -> Column:
    """Array of struct(url, text, size) of the anchors without markup inside whose href, in any
    case of letters, holds ``suffix``; the size is the N of "N byte" or "N bytes" in the text, else 0."""
    # Fixed value: the pattern of a link.
    quoted = suffix.replace(".", r"\.")
    pattern = rf"""(?i)<a[^>]+href=["']([^"']*{quoted}[^"']*)["'][^>]*>([^<]*)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("text"))
    size = lambda t: F.coalesce(F.translate(F.regexp_extract(t, r"(?U)(\d+(?:,\d+)*)\s*bytes?", 1), f"{WIDE_DIGITS},", "0123456789").try_cast("long"), F.lit(0).cast("long"))
    return F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), strip(p["text"]).alias("text"), size(p["text"]).alias("size")))
