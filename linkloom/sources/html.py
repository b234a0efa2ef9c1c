"""Small pattern helpers for listing pages, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _has_class(name: str) -> str:
    return rf"""\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']"""


def has_class(text: Column, name: str) -> Column:
    return text.rlike(rf"(?is)<[a-z][^>]*{_has_class(name)}")


def attrs_of(text: Column, name: str) -> Column:
    """Attributes of the first tag with the class, "" when there is none."""
    return F.regexp_extract(text, rf"(?is)<[a-z][a-z0-9]*\b([^>]*{_has_class(name)}[^>]*)>", 1)


def after_class(text: Column, name: str) -> Column:
    """Text behind the first tag with the class, "" when there is none."""
    return F.regexp_extract(text, rf"(?is)<[a-z][^>]*{_has_class(name)}[^>]*>(.*)", 1)


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute, null when it is not there."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*["']([^"']*)["']"""
    return F.when(attrs.rlike(pattern), F.regexp_extract(attrs, pattern, 1))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def links(text: Column) -> Column:
    """array<struct<attrs, text>> of all links in order."""
    attrs = F.regexp_extract_all(text, F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>"), 1)
    inner = F.regexp_extract_all(text, F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>"), 2)
    return F.zip_with(attrs, inner, lambda a, t: F.struct(
        a.alias("attrs"), strip_tags(t).alias("text")))


def first_link(text: Column) -> Column:
    """struct<attrs, text> of the first link, null when there is none."""
    pattern = r"(?is)<a\b([^>]*)>(.*?)</a>"
    return F.when(text.rlike(pattern), F.struct(
        F.regexp_extract(text, pattern, 1).alias("attrs"),
        strip_tags(F.regexp_extract(text, pattern, 2)).alias("text")))


def digits(text: Column) -> Column:
    """The digits of a text as a number, null without any or beyond 32 bits."""
    n = F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")
    return F.when(n <= 4294967295, n)
