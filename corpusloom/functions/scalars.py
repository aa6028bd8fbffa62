"""Scalar functions on columns: cleaning, language, names of files and links, countries."""

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import lexicons as lex
from corpusloom.functions.text import SPACE

_C = lambda c: F.col(c) if isinstance(c, str) else c


def is_chinese(text: Column | str) -> Column:
    """More than 0.3 of the word characters are Chinese; false for a text without any."""
    n = F.regexp_count(_C(text), F.lit(r"[\p{L}\p{N}_]"))
    return (n > 0) & (F.regexp_count(_C(text), F.lit(r"[\x{4E00}-\x{9FA5}]")) / F.nullif(n, F.lit(0)) > 0.3)


def detect_language(text: Column | str) -> Column:
    """`zh` if more than 0.3 of letters and digits are Chinese, `unknown` without any or for null, else `en`."""
    t = F.coalesce(_C(text), F.lit(""))
    n = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    return F.when(n == 0, "unknown").when(F.length(F.regexp_replace(t, r"[^\x{4E00}-\x{9FFF}]+", "")) / F.nullif(n, F.lit(0)) > 0.3, "zh").otherwise("en")


def clean_text(text: Column | str) -> Column:
    """Drops tags, then web addresses, then folds white space. Null gives an empty string."""
    t = F.regexp_replace(F.coalesce(_C(text), F.lit("")), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"https?://[^{SPACE}]+", ""), rf"[{SPACE}]+", " "))


def sha16(text: Column | str) -> Column:
    return F.substring(F.sha1(F.encode(_C(text), "UTF-8")), 1, 16)


def normalize_url(url: Column | str) -> Column:
    return F.substring_index(F.trim(F.coalesce(_C(url), F.lit(""))), "#", 1)


def safe_name(text: Column | str) -> Column:
    name = F.trim(F.regexp_replace(_C(text), r"[^\p{L}\p{N}_.\-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(F.substring(name, 1, 180), F.lit("")), F.lit("untitled"))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_C(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_C(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def is_binary_url(url: Column | str) -> Column:
    ext = F.regexp_extract(F.lower(url_path(url)), r"\.([^.]*)$", 1)
    return ext.isin(lex.BINARY_EXTENSIONS)


def clean_filename(name: Column | str, most: int = 100) -> Column:
    return F.trim(F.substring(F.regexp_replace(_C(name), r'[\\/*?:"<>|]', ""), 1, most))


def to_full_url(href: Column | str, domain: Column | str) -> Column:
    h = _C(href)
    return F.when(h.startswith("/"), F.concat(domain if isinstance(domain, Column) else F.lit(domain), h)).when(h.startswith("http"), h)


def absolute_href(href: Column | str, host: str) -> Column:
    h = _C(href)
    return F.when(h.startswith("/"), F.concat(F.lit(host), h)).when(~h.startswith("http"), F.concat(F.lit(host + "/"), h)).otherwise(h)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 resolution of a link against its page; null where either is null or can't be read."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return None if b is None or h is None else urljoin(b, h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def search_query(keyword: Column | str, url: Column | str) -> Column:
    site = F.rtrim(F.regexp_replace(_C(url), r"https://|http://", ""), F.lit("/"))
    return F.concat(_C(keyword), F.lit(" site:"), site, F.lit(" -filetype:pdf -inurl:.php"))


def hit_date(title: Column | str, description: Column | str, url: Column | str) -> Column:
    text = F.concat(*[F.coalesce(_C(c), F.lit("")) for c in (title, description, url)])
    return F.regexp_extract(text, r"20[0-2]\d[-/年]\d{1,2}[-/月]\d{1,2}日?", 0)


def hit_type(title: Column | str, url: Column | str) -> Column:
    """Null for hits that are skipped: .php anywhere, or a .pdf at the end."""
    u = F.lower(_C(url))
    kept = F.when(F.contains(_C(title), F.lit("[PDF]")), "PDF").when(u.endswith(".doc") | u.endswith(".docx"), "DOC").otherwise("HTML")
    return F.when(u.contains(".php") | u.endswith(".pdf"), None).otherwise(kept)


def _first(text: Column, table: list[tuple[str, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, kv: F.when(text.contains(kv[0]), kv[1]).otherwise(rest), reversed(table), otherwise)


def normalize_country(country: Column | str, table: list[tuple[str, str]] = lex.COUNTRY_NAMES) -> Column:
    c = _C(country)
    return _first(c, table, F.translate(c, " -", "__"))


def src_file_of_name(name: Column | str) -> Column:
    n = _C(name)
    found = F.nullif(F.regexp_extract(n, r"^(.+?_links\.txt)_[a-f0-9]+", 1), F.lit(""))
    return F.coalesce(found, F.nullif(F.regexp_extract(n, r"^([^_]*(?:_[^_]*)*?links\.txt[^_]*)", 1), F.lit("")))


def country_of_name(name: Column | str, table: list[tuple[str, str]] = lex.FILE_COUNTRIES) -> Column:
    return _first(F.lower(_C(name)), table, F.lit("Unknown"))
