"""URL functions on columns. Four notions of a site's domain differ on purpose; see each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import lexicon

#: scheme, authority, path, query, fragment of any string, after the generic syntax of URIs.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def normalize(url: Column, keep_fragment: bool = False) -> Column:
    """Scheme and host in lower case, default port dropped, empty path as /; text without scheme or host stays as it is (trimmed).

    User information, path, query and fragment are kept verbatim; the fragment only if asked for.
    """
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme, authority = F.lower(part(text, 1)), part(text, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.when(part(text, 3) == "", F.lit("/")).otherwise(part(text, 3))
    query = F.regexp_replace(part(text, 4), r"^\?$", "")
    fragment = F.regexp_replace(part(text, 5), r"^#$", "") if keep_fragment else F.lit("")
    whole = F.concat(scheme, F.lit("://"), user, host, path, query, fragment)
    return F.when((scheme == "") | (authority == ""), text).otherwise(whole)


def host(url: Column) -> Column:
    """Authority in lower case without user information and port."""
    return F.regexp_replace(F.lower(F.regexp_replace(part(F.trim(url), 2), r"^.*@", "")), r":\d+$", "")


def _last(labels: Column, count: Column | int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    start = F.greatest(F.size(labels) - count + 1, F.lit(1))
    return F.array_join(F.slice(labels, start, count), ".")


def registrable(host: Column) -> Column:
    """The last two labels, three under one of the listed two-part suffixes; addresses of numbers whole."""
    labels = F.split(host, r"\.")
    three = _last(labels, 2).isin(*lexicon.TWO_PART_SUFFIXES)
    split = F.when(three, _last(labels, 3)).otherwise(_last(labels, 2))
    return F.when(host.rlike(r"^\d+(\.\d+){3}$"), host).otherwise(split)


def subdomain(host: Column) -> Column:
    """What stands before the registrable domain."""
    return F.when(host == registrable(host), F.lit("")).otherwise(F.regexp_replace(F.substring(host, F.lit(1), F.length(host) - F.length(registrable(host))), r"\.$", ""))


def by_country(host: Column) -> Column:
    """The last two labels, three if the last is one of four country codes."""
    labels = F.split(host, r"\.")
    return F.when(F.element_at(labels, -1).isin("cn", "uk", "jp", "au"), _last(labels, 3)).otherwise(_last(labels, 2))


def two_labels(host: Column) -> Column:
    """The last two labels, whatever they are."""
    return _last(F.split(host, r"\."), 2)


def has_suffix(host: Column, suffix: Column | str) -> Column:
    """The host is the suffix or ends in a dot and it."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    return (host == suffix) | host.endswith(F.concat(F.lit("."), suffix))


def has_any_suffix(host: Column, suffixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: has_suffix(host, s)) if suffixes else F.lit(False)


def generic_platform(host: Column) -> Column:
    return has_any_suffix(host, lexicon.GENERIC_PLATFORM_DOMAINS)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(F.trim(url), 3), "/"), lambda s: s != "")


def query_keys(url: Column) -> Column:
    """Keys of the query in order, blank values included."""
    pairs = F.filter(F.split(F.regexp_replace(part(F.trim(url), 4), r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))


def homepage(url: Column) -> Column:
    """scheme://authority/"""
    return F.concat(part(F.trim(url), 1), F.lit("://"), part(F.trim(url), 2), F.lit("/"))


def repository(url: Column) -> Column:
    """A project's page: two path segments under a code host, neither reserved nor an option."""
    return repository_under(host(url), url)


def repository_under(domain: Column, url: Column) -> Column:
    """``repository`` for a record whose domain is known apart from its link."""
    segments = path_segments(url)
    first, second = F.lower(F.get(segments, 0)), F.lower(F.get(segments, 1))
    free = [~s.isin(*lexicon.REPOSITORY_RESERVED) & ~s.startswith("-") for s in (first, second)]
    return F.coalesce(two_labels(domain).isin(*lexicon.REPOSITORY_HOSTS) & (F.size(segments) >= 2) & free[0] & free[1], F.lit(False))


def dois(text: Column) -> Column:
    """Document identifiers in a text, percent signs decoded, closing marks removed, first of each spelling that differs only by case."""
    plain = F.coalesce(F.try_url_decode(F.replace(F.coalesce(text, F.lit("")), F.lit("+"), F.lit("%2B"))), text, F.lit(""))
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"(?i)10\.\d{4,9}/[-._;()/:a-z0-9]+"), 0), lambda d: F.regexp_replace(d, r"[).,;\]]+$", ""))
    return F.filter(found, lambda d, n: F.array_position(F.transform(found, F.lower), F.lower(d)) == n + 1)
