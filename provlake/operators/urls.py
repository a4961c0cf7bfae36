"""URL and domain operators (B): canonical form, safety, policy, classification."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.functions import rules

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
V4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), SCHEME, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), AUTHORITY, 1))


def host_name(url: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":[0-9]*$", "")


def host(url: Column) -> Column:
    """The publisher's host: lower case, without www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def parameter_stays(p: Column) -> Column:
    """Whether a query parameter is neither blank nor for tracking."""
    name = F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    blank = ~p.contains("=") | p.endswith("=") & (F.length(name) + 1 == F.length(p))
    tracked = name.isin(rules.TRACKING_NAMES)
    for prefix in rules.TRACKING_PREFIXES:
        tracked = tracked | name.startswith(prefix)
    return ~blank & ~tracked


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, tracking or blank parameters, fragment or trailing slash; '' for no host (B1)."""
    url = F.trim(F.coalesce(url, F.lit("")))
    return with_query(url, F.array_join(F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), parameter_stays), "&"))


def with_query(url: Column, query: Column) -> Column:
    """The canonical url with the parameters that stay (B1)."""
    site = F.regexp_replace(authority(url), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")
    named = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    return F.when(site == "", "").otherwise(F.concat(named, F.lit("://"), site, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def ipv4_value(name: Column) -> Column:
    """The address as a number; null for a name that is no literal address."""
    part = [F.regexp_extract(name, V4, i).try_cast("long") for i in (1, 2, 3, 4)]
    ok = name.rlike(V4)
    for p in part:
        ok = ok & (p <= 255)
    return F.when(ok, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def blocked_ranges(networks=rules.BLOCKED_V4) -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(n) for n in networks]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


def address_key(name: Column) -> Column:
    """A literal address, IPv4 or bracketed IPv6 in any form, as 32 hex digits that sort like the address; null for any other name.

    IPv4 is keyed as its mapped IPv6 form, so that ::ffff:10.0.0.1 and 10.0.0.1 are one address.
    """
    hexed = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    bare = F.regexp_extract(name, r"^\[([0-9a-f:.]*)(?:%[^\]]*)?\]$", 1)

    def undotted(text: Column) -> Column:
        """A dotted end as the two groups that it stands for."""
        tail = F.regexp_extract(text, r":([0-9.]*\.[0-9.]*)$", 1)
        joined = once(hexed(ipv4_value(tail)), lambda h: F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(text.contains("."), joined).otherwise(text)

    def expanded(plain: Column) -> Column:
        gap = F.instr(plain, "::")
        groups = lambda c: F.filter(F.split(c, ":"), lambda g: g != "")
        left = groups(F.when(gap > 0, F.substr(plain, F.lit(1), gap - 1)).otherwise(plain))
        right = groups(F.when(gap > 0, F.substr(plain, gap + 2, F.length(plain))).otherwise(""))

        def filled(two: Column) -> Column:
            n = F.size(two[0]) + F.size(two[1])
            full = F.concat(two[0], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), two[1])
            return F.when(F.when(gap > 0, n <= 7).otherwise(n == 8), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

        groups_in_form = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
        return F.when(groups_in_form, once(F.array(left, right), filled))

    v4 = F.concat(F.lit("0" * 20 + "ffff"), hexed(ipv4_value(name)))
    return F.when(name.startswith("["), once(once(bare, undotted), expanded)).otherwise(v4)


def address_intervals(networks) -> list[tuple[str, str]]:
    """Sorted, disjoint intervals of address keys; networks that touch or overlap become one."""
    ends = []
    for n in map(ipaddress.ip_network, networks):
        mapped = 0xFFFF << 32 if n.version == 4 else 0
        ends.append((mapped + int(n.network_address), mapped + int(n.broadcast_address)))
    out: list[list[int]] = []
    for low, high in sorted(ends):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(f"{low:032x}", f"{high:032x}") for low, high in out]


def in_intervals(key: Column, intervals: list[tuple[str, str]]) -> Column:
    """Whether a key lies in one of the sorted, disjoint intervals: a search by halving, so that a table of thousands costs some steps a row."""
    if not intervals:
        return F.lit(False)
    lows, highs = (F.split(F.lit(",".join(x)), ",") for x in zip(*intervals, strict=True))
    steps, size = [], 1 << (len(intervals).bit_length() - 1)
    while size:
        steps.append(size)
        size >>= 1
    # at: how many intervals begin at the key or before it
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(intervals)) & (F.get(lows, at + s - 1) <= key), at + s).otherwise(at))
    return once(at, lambda n: F.coalesce((n > 0) & (F.get(highs, n - 1) >= key), F.lit(False)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def url_safety(url: Column, networks=(*rules.BLOCKED_V4, *rules.BLOCKED_V6)) -> Column:
    """struct(safe, reason): whether a url may be fetched from outside (B2).

    A literal address, in any form, must lie outside the networks; a bracketed host that is
    no address is not safe. A mapped IPv4 address counts as the IPv4 address.
    """
    intervals = address_intervals(networks)

    def judged(name: Column, key: Column) -> Column:
        return (
            F.when(F.coalesce(F.trim(url), F.lit("")) == "", "empty")
            .when(~scheme(url).isin("http", "https"), "scheme")
            .when(name == "", "no_host")
            .when(name.isin(rules.BLOCKED_HOSTS) | name.endswith(".local") | name.endswith(".internal"), "internal_host")
            .when(name.startswith("[") & key.isNull(), "bad_address")
            .when(key.isNotNull() & in_intervals(key, intervals), "internal_address")
            .otherwise("safe")
        )

    reason = once(host_name(url), lambda name: once(address_key(name), lambda key: judged(name, key)))
    return once(reason, lambda r: F.struct((r == "safe").alias("safe"), r.alias("reason")))


def of_domains(name: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return name.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def exclusion(url: Column, domains: dict[str, list[str]] = rules.EXCLUDED_DOMAINS, paths=rules.EXCLUDED_PATHS) -> Column:
    """struct(excluded, reason): the hard-exclusion policy."""
    name = host(url)
    reason = F.when(F.coalesce(url, F.lit("")) == "", "empty_url")
    for why, names in domains.items():
        reason = reason.when(of_domains(name, names), why)
    for pattern, why in paths:
        reason = reason.when(url.rlike(pattern), why)
    reason = reason.otherwise("allowed")
    return F.struct((reason != "allowed").alias("excluded"), reason.alias("reason"))


def classify_domain(url: Column, table=rules.DOMAIN_RULES, general=rules.GENERAL_WEB) -> Column:
    """struct(source_type, quality) by the first matching rule; domains match at label boundaries."""
    name = F.regexp_replace(authority(url), r":[0-9]*$", "")

    def first(value):
        out = None
        for kind, quality, domains, inner in table:
            test = of_domains(name, domains)
            for label in inner:
                test = test | name.contains(f".{label}.") | name.startswith(f"{label}.")
            out = F.when(test, value(kind, quality)) if out is None else out.when(test, value(kind, quality))
        return out.otherwise(value(*general))

    return F.struct(first(lambda k, q: F.lit(k)).alias("source_type"), first(lambda k, q: F.lit(q)).alias("quality"))


def source_role(source_type: Column, quality: Column, relevance: Column) -> Column:
    """What a source may be used for."""
    return (
        F.when((quality < 0.40) | source_type.isin(rules.LOW_GRADE_TYPES), "DISCOVERY_ONLY")
        .when((quality >= 0.85) & (relevance >= 0.40), "PRIMARY")
        .when((quality >= 0.70) & (relevance >= 0.25), "SECONDARY")
        .otherwise("SUPPORTING")
    )


def fetch_guard(url: Column, content_type: Column) -> Column:
    """'ok', 'binary_file_skipped' or 'unsupported_content_type' (B6)."""
    low = F.lower(F.coalesce(url, F.lit("")))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    binary, text = F.lit(False), kind == ""
    for suffix in rules.BINARY_SUFFIXES:
        binary = binary | low.endswith(suffix)
    for name in rules.TEXT_TYPES:
        text = text | kind.contains(name)
    return F.when(binary, "binary_file_skipped").when(~text, "unsupported_content_type").otherwise("ok")
