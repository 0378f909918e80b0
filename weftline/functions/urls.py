"""URL functions as Column expressions. Malformed URLs give nulls or false, never errors."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import let, rx

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^[^@]*@", ""), r":\d*$", "")


def domain(url: Column) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def _query(url: Column, drop: tuple[str, ...]) -> Column:
    """Parameters with a value, sorted, without those named in ``drop``."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: F.rlike(p, F.lit(r"^[^=]*=.+$")))
    if drop:
        names = F.array(*[F.lit(n) for n in drop])
        pairs = F.filter(pairs, lambda p: ~F.array_contains(names, F.split_part(p, F.lit("="), F.lit(1))))
    return F.array_join(F.array_sort(pairs), "&")


def _build(url: Column, path_: Column, query: Column) -> Column:
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit("://"))).otherwise(""), netloc(url), path_, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def normalize_crawl(url: Column) -> Column:
    """Key of a page in the crawl frontier: no fragment, tracking parameters or trailing slashes; parameters sorted."""
    p = F.regexp_replace(path(url), r"/+$", "")
    return _build(url, F.when(p == "", F.lit("/")).otherwise(p), _query(url, C.TRACKING_PARAMETERS))


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``: absolute, scheme-relative, host-relative, query or fragment only, or relative; dot segments are resolved."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = (
        F.when(rx(href, r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
    return F.when(rx(joined, r"/\.\.?(/|$|\?|#)"), _dots(joined)).otherwise(joined)


def _dots(url: Column) -> Column:
    segments = F.split(path(url), "/")
    last = F.element_at(segments, -1)

    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    p = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    rest = F.regexp_extract(url, r"([?#].*)$", 1)
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), p, rest)


def normalize_probe(url: Column, base: Column) -> Column:
    """Key of an endpoint: resolved, parameters sorted, no fragment; null for other schemes than http(s) and ws(s)."""
    full = resolve(base, url)
    ok = ~rx(url, r"^(javascript:|data:|mailto:|#|void|$)") & scheme(full).isin("http", "https", "ws", "wss")
    return F.when(ok, _build(full, path(full), _query(full, ())))


def same_host(a: Column, b: Column) -> Column:
    return part(a, 2) == part(b, 2)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (netloc(a) == netloc(b))


def crawl_priority(url: Column, depth: Column) -> Column:
    """Lower comes first."""
    return depth.cast("double") - F.when(rx(url, C.PATH_HIGH_VALUE), 2.0).otherwise(0.0) + F.when(rx(url, C.PATH_LOW_VALUE), 3.0).otherwise(0.0)


def api_score(url: Column) -> Column:
    p = F.lower(path(url))
    score = F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))
    for pattern, points in C.API_PATHS:
        score = score + F.when(rx(p, pattern), points).otherwise(0)
    return score


def ip_number(host_: Column) -> Column:
    """An IPv4 literal as a number, else null."""

    def number(h: Column) -> Column:
        octet = lambda k: F.split_part(h, F.lit("."), F.lit(k)).cast("long")
        literal = rx(h, r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
        return F.when(literal, octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))

    return let(host_, number)


def net_ranges() -> list[tuple[str, int, int]]:
    nets = [ipaddress.ip_network(n) for n in C.PRIVATE_NETS]
    return [(str(n), int(n.network_address), int(n.broadcast_address)) for n in nets]


def is_private(host_: Column) -> Column:
    def within(ip: Column) -> Column:
        out = F.lit(False)
        for _, lo, hi in net_ranges():
            out = out | ip.between(lo, hi)
        return F.coalesce(out, F.lit(False))

    return let(ip_number(host_), within)


def invalid_reason(url: Column) -> Column:
    """'ok', or why a URL is not fetched (names are not resolved)."""

    def reason(u: Column) -> Column:
        def of_host(h: Column) -> Column:
            return F.when(h == "", "no_host").when(h.isin(*C.BLOCKED_HOSTS), "blocked_host").when(is_private(h), "private_address").otherwise("ok")

        return (
            F.when(u == "", "empty")
            .when(F.char_length(u) > C.MAX_URL_LENGTH, "too_long")
            .when(~scheme(u).isin("http", "https"), "bad_scheme")
            .otherwise(let(host(u), of_host))
        )

    return let(F.trim(F.coalesce(url, F.lit(""))), reason)
