"""URL functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import filled, lookup, stripped, words


def authority(url: Column) -> Column:
    """What stands between ``://`` and the path; null without a scheme or when empty."""
    return filled(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def normalized(url: Column) -> Column:
    """Trimmed and with a scheme; null for what is no URL."""
    bare = stripped(url)
    full = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when((bare != "") & authority(full).isNotNull(), full)


def url_error(url: Column) -> Column:
    bare = stripped(F.coalesce(url, F.lit("")))
    return F.when(bare == "", F.lit(fixed.E_EMPTY_URL)).otherwise(F.concat(F.lit(fixed.E_BAD_URL), F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))))


def www_toggled(url: Column) -> Column:
    """With ``www.`` in front of the host, or without if it was there."""
    has = F.lower(authority(url)).startswith("www.")
    return F.when(has, F.regexp_replace(url, r"(?i)^([^/]*//)www\.", "$1")).otherwise(F.regexp_replace(url, r"^([^/]*//)", "$1www."))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def country_of(url: Column) -> Column:
    """The country that the host's last label stands for, or null."""
    host = F.split_part(F.lower(authority(url)), F.lit(":"), F.lit(1))
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= 2, F.try_element_at(lookup(fixed.COUNTRY_OF_TLD), F.element_at(labels, -1)))


def common_paths(url: Column, paths: tuple[str, ...]) -> Column:
    """The usual addresses of such a page, in order."""
    return F.transform(words(paths), lambda p: F.concat(origin(url), p))


def looks_like_url(value: Column) -> Column:
    v = F.lower(stripped(value))
    return (v != "") & (v.startswith("http://") | v.startswith("https://") | (v.contains(".") & ~v.contains(" ")))


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null for what cannot be resolved.  The page parser resolves anchors itself."""

    def one(b, h):
        try:
            return urljoin(b, h)
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
