"""Addresses as columns: canonical forms, scope, languages."""

from __future__ import annotations

import re
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewatch.functions import words as W
from pagewatch.functions.text import Col, c

#: Session marks in paths.
_SESSION = re.compile(r";(?:jsessionid|phpsessid|sid)=[^/;?]*", re.I)


def canonical(base: str | None, href: str | None) -> str | None:
    """An address against its base: http and https only, host in lower case, without session, fragment, last slash and visitor parameters, others sorted."""
    try:
        parts = urllib.parse.urlsplit(urllib.parse.urljoin(base or "", (href or "").strip()))
        if parts.scheme not in ("http", "https"):
            return None
        kept = sorted((k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in W.VISITOR_PARAMS)
        path = _SESSION.sub("", parts.path).rstrip("/") or "/"
        return urllib.parse.urlunsplit((parts.scheme, parts.netloc.lower(), path, urllib.parse.urlencode(kept), ""))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if y is None and x is None else canonical(x, y) for x, y in zip(base, href, strict=True)], dtype=object)


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?U)^[\s\x00-\x20]+|[\s]+$", ""), r"[\t\r\n]", "")


#: Addresses that say everything themselves: with a host in plain letters, figures, dots, hyphens, and perhaps a port or a name.
_WHOLE = r"^[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.:_@~-]+([/?#]|$)"


def _parameters(query: Column, left_out: list[str] | tuple[str, ...] | set[str], blanks: bool) -> Column:
    """The parameters of a query as structs of decoded name and value."""
    plus = F.regexp_replace(query, "%(?![0-9A-Fa-f]{2})", "%25")
    parts = F.filter(F.split(plus, "&"), lambda x: x != "")
    both = F.transform(parts, lambda x: F.struct(F.url_decode(F.regexp_replace(x, "(?s)=.*", "")).alias("k"), F.url_decode(F.regexp_replace(x, "(?s)^[^=]*=?", "")).alias("v")))
    kept = F.filter(both, lambda p: ~F.lower(p["k"]).isin(*left_out))
    return kept if blanks else F.filter(kept, lambda p: p["v"] != "")


def _written(parameters: Column) -> Column:
    def code(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    query = F.array_join(F.transform(parameters, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    return F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))


def canonical_absolute(url: Col) -> Column:
    """The canonical form of an address that says its scheme and host, by expressions alone; null for any other."""
    own = _cleaned(c(url))
    scheme, host = F.lower(F.regexp_extract(own, "^([A-Za-z]+):", 1)), F.lower(F.regexp_extract(own, "^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(own, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), f"(?i){_SESSION.pattern}", ""), "/+$", "")
    kept = F.array_sort(_parameters(F.regexp_extract(own, r"^[^?#]*\?([^#]*)", 1), W.VISITOR_PARAMS, True))
    return F.when(own.rlike(_WHOLE), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), _written(kept)))


def canonical_url(base: Col, href: Col) -> Column:
    """canonical() as a column: by expressions where the address says its scheme and host; only others go to Python, with their base."""
    whole = F.coalesce(_cleaned(c(href)).rlike(_WHOLE), F.lit(False))
    return F.when(whole, canonical_absolute(href)).otherwise(_resolved(F.when(~whole, F.coalesce(c(base), F.lit(""))), F.when(~whole, c(href))))


@F.pandas_udf(StringType())
def _listing(url: pd.Series) -> pd.Series:
    def one(u: str | None) -> str | None:
        if u is None:
            return None
        try:
            parts = urllib.parse.urlsplit(re.sub(r";jsessionid=[^/?#]*", "", u, flags=re.I))
        except ValueError:
            return u
        kept = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query) if k.lower() not in W.POSTING_PARAMS]
        return urllib.parse.urlunsplit((parts.scheme, parts.netloc, parts.path, urllib.parse.urlencode(kept), ""))

    return url.map(one)


def listing_url(url: Col) -> Column:
    """A posting's address without session, fragment and tracking; the order of parameters stays. Only addresses without scheme and host go to Python."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(c(url), "(?i);jsessionid=[^/?#]*", ""), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(own, "^([A-Za-z]+):", 1))
    kept = _parameters(F.regexp_extract(own, r"^[^?#]*\?([^#]*)", 1), W.POSTING_PARAMS, False)
    whole = F.coalesce(own.rlike(_WHOLE), F.lit(False))
    return F.when(whole, F.concat(scheme, F.regexp_extract(own, "^[A-Za-z]+(://[^?#]*)", 1), _written(kept))).otherwise(_listing(F.when(~whole, c(url))))


def host_of(url: Col) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Col) -> Column:
    return F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Col) -> Column:
    return F.regexp_extract(c(url), r"^[^?#]*\?([^#]*)", 1)


def language_of(url: Col) -> Column:
    """The language that a path begins with, or null."""
    found = F.lower(F.regexp_extract(path_of(url), rf"(?i)^/({'|'.join(W.LANGUAGES)})(/|$)", 1))
    return F.nullif(found, F.lit(""))


def redundant_language(url: Col, languages: Col) -> Column:
    """The language of a /language/xx/ address that isn't one of the country's, or null."""
    tag = F.lower(F.regexp_extract(c(url), "/language/([^/]*)", 1))
    wanted = F.exists(F.coalesce(c(languages), F.array().cast("array<string>")), lambda w: tag.startswith(F.lower(w)))
    return F.when(c(url).contains("/language/") & ~wanted, tag)


def in_scope(url: Col, entry: Col, suffixes: Col) -> tuple[Column, Column]:
    """(inside, why): a host of the country's official suffixes; where there are none, the entry's host."""
    host = host_of(url)
    own = F.coalesce(c(suffixes), F.array().cast("array<string>"))
    official = F.exists(own, lambda s: (host == F.regexp_replace(s, r"^\.+", "")) | host.endswith(s))
    same = host == host_of(entry)
    inside = F.when(F.size(own) > 0, official).otherwise(same)
    why = F.when(F.size(own) > 0, F.when(official, "an official domain").otherwise("outside the official domains")).otherwise(F.when(same, "same host").otherwise("different host"))
    return inside, why


def by_country(country: Col, table: dict[str, list[str]]) -> Column:
    """A country's list of a fixed table, or null."""
    own = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.try_element_at(own, c(country))


def url_prefixes(url: Col) -> Column:
    """An address and all addresses that it is under, for equality joins in place of prefix joins."""
    parts = F.split(F.regexp_replace(c(url), "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
