"""Url parts, canonical urls and keys.  Parts follow the RFC 3986 appendix B split."""

from pyspark.sql import Column, functions as F

from dealsift import rules
from dealsift.functions.text import capture, once

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def _plain(url: Column) -> Column:
    """Web addresses without fragment: cut at their separators, which costs less than the pattern."""
    return (url.startswith("https://") | url.startswith("http://")) & ~url.contains("#")


def _behind_scheme(url: Column) -> Column:
    return F.substr(url, F.when(url.startswith("https://"), F.lit(9)).otherwise(F.lit(8)))


def scheme(url: Column) -> Column:
    secure = F.when(url.startswith("https://"), F.lit("https")).otherwise(F.lit("http"))
    return F.when(_plain(url), secure).otherwise(F.lower(_part(url, 1)))


def host(url: Column) -> Column:
    cut = F.substring_index(F.substring_index(_behind_scheme(url), "/", 1), "?", 1)
    return F.when(_plain(url), cut).otherwise(_part(url, 2))


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    asked_off = F.substring_index(_behind_scheme(url), "?", 1)
    cut = F.substr(asked_off, F.length(F.substring_index(asked_off, "/", 1)) + 1)
    return F.when(_plain(url) & ~url.contains(";"), cut).otherwise(F.regexp_replace(_part(url, 3), r";[^/]*$", ""))


def query(url: Column) -> Column:
    cut = F.substr(url, F.length(F.substring_index(url, "?", 1)) + 2)
    return F.when(_plain(url), cut).otherwise(_part(url, 4))


def domain(url: Column) -> Column:
    """Lower-case host without a leading ``www.``."""
    name = F.lower(host(url))
    return F.when(name.startswith("www."), F.substr(name, F.lit(5))).otherwise(name)


def trim_slashes(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


def _raw_param(query_text: Column, name: str) -> Column:
    return capture(query_text, rf"(?:^|&){name}=([^&]+)", 1, ignore_case=False)


def param(query_text: Column, name: str) -> Column:
    """First non-empty value of a query parameter, decoded."""
    value = once(_raw_param(query_text, name), lambda raw: F.coalesce(F.try_url_decode(raw), raw))
    return F.when(query_text.contains(f"{name}="), value)


def encode(value: Column) -> Column:
    """Form encoding that also keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Scheme, bare host, trimmed path and the identifying parameters only."""
    def assemble(u: Column) -> Column:
        item = F.regexp_extract(u["path"], r"/itm/(?:[^/]+/)?(\d{10,})", 1)
        where = F.when(u["site"].contains("ebay.com") & (item != ""), F.concat(F.lit("/itm/"), item)).otherwise(u["path"])
        kept = F.array_join(F.array_compact(F.array(*[
            F.concat(F.lit(f"{name}="), encode(param(u["query"], name))) for name in rules.URL_KEPT_PARAMS])), "&")
        asks = u["query"].rlike("(?:^|&)(?:" + "|".join(rules.URL_KEPT_PARAMS) + ")=[^&]")
        tail = F.when(asks, F.concat(F.lit("?"), kept)).otherwise(F.lit(""))
        rooted = once(where, lambda w: F.when(w.startswith("/"), w).otherwise(F.concat(F.lit("/"), w)))
        named = F.when(u["scheme"] != "", u["scheme"]).otherwise(F.lit("https"))
        return F.concat(named, F.lit("://"), u["site"], rooted, tail)

    return once(F.struct(
        scheme(url).alias("scheme"), domain(url).alias("site"), trim_slashes(path(url)).alias("path"),
        query(url).alias("query")), assemble)


def key_of(canonical_url: Column, seller: Column, title: Column, model: Column, state: Column) -> Column:
    """Identity of a listing: host, path and query, else seller, title, model and state."""
    asked = once(query(canonical_url), lambda a: F.when(a != "", F.concat(F.lit("?"), a)).otherwise(F.lit("")))
    located = F.concat(domain(canonical_url), trim_slashes(path(canonical_url)), asked)
    described = F.array_join(F.transform(
        F.filter(F.array(seller, title, model, state), lambda p: p.isNotNull() & (p != "")),
        lambda p: F.trim(F.lower(p)),
    ), "|")
    return once(located, lambda k: F.when(k != "", k).otherwise(described))


def without_query(url: Column) -> Column:
    """Scheme, bare host and trimmed path."""
    start = once(scheme(url), lambda s: F.when(s != "", F.concat(s, F.lit(":"))).otherwise(s))
    site = once(domain(url), lambda d: F.when(d != "", F.concat(F.lit("//"), d)).otherwise(d))
    return F.concat(start, site, trim_slashes(path(url)))


def root(url: Column) -> Column:
    """Scheme and host, or the whole text when either is missing."""
    return once(F.struct(scheme(url).alias("s"), host(url).alias("h")), lambda u: F.when(
        (u["s"] != "") & (u["h"] != ""), F.concat(u["s"], F.lit("://"), u["h"])).otherwise(url))


def listing_id(url: Column) -> Column:
    """Last path segment."""
    return once(trim_slashes(path(url)), lambda w: F.when(
        w != "", F.element_at(F.split(w, "/"), -1)))


def unwrap_redirect(url: Column, name: str = "uddg") -> Column:
    """Target of a redirect link that carries it in a query parameter."""
    absolute = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return once(absolute, lambda u: F.coalesce(param(query(u), name), u))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page, without dot segments."""
    def absolute(link: Column) -> Column:
        origin = root(base)
        folder = F.regexp_replace(path(base), "[^/]*$", "")
        joined = (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.startswith("?"), F.concat(origin, path(base), link))
            .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
            .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
        )
        plain = link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|\?|#)")
        return once(joined, lambda u: F.when(plain | ~u.rlike(r"/\.{1,2}(?:[/?#]|$)"), u).otherwise(without_dots(u)))

    return once(link, absolute)


def without_dots(url: Column) -> Column:
    """Path segments ``.`` and ``..`` applied, as in RFC 3986 section 5.2.4; query and fragment are left alone."""
    def clean(route: Column) -> Column:
        none = F.array().cast("array<string>")
        kept = F.aggregate(F.split(F.substring(route, 2, F.length(route)), "/"), none, lambda done, part: (
            F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))))
        # a dot segment at the end names a folder
        last = F.when(route.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(none)
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))

    start, route, rest = (F.regexp_extract(url, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.concat(start, once(route, clean), rest)
