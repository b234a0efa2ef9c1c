"""URL keys: host, canonical string ("norm"), host tokens, jitter.

The canonical form is this project's own rule: lower-case the host; drop scheme, user
info, default port, a leading ``www<digits>.`` or ``m.``, the fragment, tracking
arguments, a trailing slash and a trailing ``index.html``; sort the other arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$"
_LINE_ENDS = ("\n", "\r", "\u0085", "\u2028", "\u2029")  # "$" also matches before the last of these


def strip_host_prefix(host: Column) -> Column:
    return F.regexp_replace(host, r"^(?:www[0-9]*|m)\.([^.]+\..*)$", "$1")


def _authority(url: Column) -> Column:
    return strip_host_prefix(
        F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^.*@", ""))


def _host_of(authority: Column) -> Column:
    h = F.regexp_replace(authority, r":[0-9]*$", "")
    return F.when(h != "", h)


def _norm_of(authority: Column, path: Column, query: Column) -> Column:
    bare = F.regexp_replace(authority, r":(80|443)?$", "")
    short = F.regexp_replace(path, r"(/index\.html)?/*$", "")
    return F.when(_host_of(authority).isNotNull(), F.concat(bare, short, _shown(query)))


def _shown(query: Column) -> Column:
    args = F.array_join(F.sort_array(F.filter(
        F.split(F.substring(query, 2, 1 << 30), "&"),
        lambda a: (a != "") & ~a.rlike(_TRACKING))), "&")
    return F.when(query == "", F.lit("")).otherwise(
        F.regexp_replace(F.concat(F.lit("?"), args), r"^\?$", ""))


def has_host(url: Column) -> Column:
    """Whether ``host`` is not null, as one pattern.

    For filters: the optimizer moves a filter below the projection and would otherwise
    compute the whole canonical form a second time there.
    """
    return url.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?+"
                     r"(?!:[0-9]*(?:[/?#]|$))[^/?#]")


def host(url: Column) -> Column:
    """Host of a URL without port and site prefix; null when there is none."""
    return _host_of(_authority(url))


def url_norm(url: Column) -> Column:
    """Canonical string; equal for all spellings of one link. Null without a host."""
    return _norm_of(_authority(url), F.regexp_extract(url, _URL, 3),
                    F.regexp_extract(url, _URL, 4))


def with_url_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``url_norm``, taking the URL apart once per row.

    The same rule as ``host`` and ``url_norm``, in steps. Where a pattern can only match in a text
    with a certain part, a plain test comes first: few hosts and paths have one, and a
    pattern costs many times the test.
    """
    c = F.col

    def only(test: Column, text: str, pattern: str, new: str = "") -> Column:
        return F.when(test, F.regexp_replace(text, pattern, new)).otherwise(c(text))

    a = c("_authority")
    parts = df.withColumns({
        "_authority": F.lower(F.regexp_extract(url, _URL, 2)),
        "_path": F.regexp_extract(url, _URL, 3),
        "_query": F.regexp_extract(url, _URL, 4)})
    parts = parts.withColumn("_authority", only(a.contains("@"), "_authority", r"^.*@"))
    parts = parts.withColumn("_authority", F.when(
        a.startswith("www") | a.startswith("m."), strip_host_prefix(a)).otherwise(a))
    ported = a.contains(":")
    parts = parts.withColumns({
        "_host": only(ported, "_authority", r":[0-9]*$"),
        "_bare": only(ported, "_authority", r":(80|443)?$"),
        # What is cut ends in a slash or in "index.html", or a line end follows it.
        "_short": only(F.right("_path", F.lit(1)).isin("/", "l", *_LINE_ENDS), "_path", r"(/index\.html)?/*$")})
    return parts.withColumns({
        "host": F.when(c("_host") != "", c("_host")),
        "url_norm": F.when(c("_host") != "", F.concat("_bare", "_short", _shown(c("_query")))),
    }).drop("_authority", "_path", "_query", "_host", "_bare", "_short")


def host_tokens(host_col: Column) -> Column:
    return F.filter(F.split(F.lower(host_col), "[^a-z0-9]+"), lambda t: t != "")


def host_phrase(host_col: Column) -> Column:
    """Tokens joined by and wrapped in spaces, so a phrase test is a substring test."""
    return F.concat(F.lit(" "), F.array_join(host_tokens(host_col), " "), F.lit(" "))


def jitter(norm: Column) -> Column:
    """Stable pseudo-random number in [0, 6), in steps of 1e-6."""
    h = F.conv(F.substring(F.md5(norm), 1, 13), 16, 10).cast("bigint")
    return (h % F.lit(6000000)) / F.lit(1000000.0)
