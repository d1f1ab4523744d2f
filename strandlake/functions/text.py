"""Helpers on text and packed integers, as columns: URLs, forms, cookies, HTML, bit fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that HTML text can't hold as they are.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_encode(text: Column) -> Column:
    return F.url_encode(text)


def url_decode(text: Column) -> Column:
    """Null where the text is no valid encoding."""
    return F.try_url_decode(text)


def html_escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def html_unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def form_fields(body: Column) -> Column:
    """Map of the decoded fields of a query or form body; a field without a value is empty, the last of equal names counts."""
    cells = F.filter(F.split(body, "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.when(F.instr(x, "=") > 0, F.substring(x, F.length(name(x)) + 2, F.length(x))).otherwise("")
    pairs = F.transform(cells, lambda x: F.struct(url_decode(name(x)).alias("key"), url_decode(value(x)).alias("value")))
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def cookies(header: Column) -> Column:
    """Map of the cookies of a header line."""
    return form_fields(F.regexp_replace(header, r"\s*;\s*", "&"))


def packed(values: list[Column], widths: list[int]) -> Column:
    """Non-negative integers of the given numbers of bits (63 in all) in one long, the first lowest."""
    if sum(widths) > 63:
        raise ValueError("more than 63 bits")
    out, at = F.lit(0).cast("long"), 0
    for v, w in zip(values, widths, strict=True):
        out = out.bitwiseOR(F.shiftleft(v.cast("long").bitwiseAND(F.lit((1 << w) - 1)), at))
        at += w
    return out


def unpacked(value: Column, widths: list[int]) -> list[Column]:
    """The integers of :func:`packed`."""
    out, at = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return out
