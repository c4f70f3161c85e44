"""URL, host, address and network helpers (no DNS, no I/O)."""

from __future__ import annotations

import functools
import ipaddress
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentguard.functions.expr import let

# Host of a URL by its text: lenient where java.net.URI rejects the whole URL.
HOST_PATTERN = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
USERINFO_PATTERN = r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*@"
SCHEME_PATTERN = r"(?i)^([a-z][a-z0-9+.\-]*):"
IPV4_PATTERN = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"


def url_host(url: Column) -> Column:
    """Host without port, user info and IPv6 brackets; empty when there is none."""
    return F.regexp_replace(F.regexp_extract(url, HOST_PATTERN, 1), r"^\[|\]\z", "")


def extract_domain(url: Column) -> Column:
    """Host of a URL, or of the text read as a URL without a scheme."""
    return F.coalesce(F.nullif(url_host(url), F.lit("")), url_host(F.concat(F.lit("http://"), url)))


def url_problem(url: Column) -> Column:
    """Why a URL is unsafe to hand to another parser, or NULL."""
    authority = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#]*)", 1)
    host = url_host(url)
    return (
        F.when(url.rlike(USERINFO_PATTERN), F.lit("URL contains embedded credentials"))
        .when(F.contains(url, F.lit("\\")), F.lit("URL contains backslash"))
        .when(F.contains(url, F.lit("\x00")), F.lit("URL contains null byte"))
        .when((authority != host) & F.contains(authority, F.lit("%")), F.lit("URL host contains percent-encoded characters"))
    )


def match_domain(domain: Column, pattern: Column) -> Column:
    """Exact match, or `*.x` for x and everything below it."""
    return (domain == pattern) | (
        F.startswith(pattern, F.lit("*."))
        & ((domain == F.substr(pattern, F.lit(3))) | F.endswith(domain, F.substr(pattern, F.lit(2))))
    )


def ipv4_to_long(ip: Column) -> Column:
    """Dotted address as a number; NULL for anything else."""
    value = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
    return F.when(ip.rlike(IPV4_PATTERN), value)


def ipv6_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address in any of its spellings; NULL for anything else."""
    low = F.lower(ip)
    dotted = F.regexp_extract(low, r":(\d+\.\d+\.\d+\.\d+)\z", 1)
    number = ipv4_to_long(dotted)
    tail = F.concat(F.lower(F.hex(F.shiftrightunsigned(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(0xFFFF))))
    plain = F.when(dotted == "", low).otherwise(F.concat(F.left(low, F.length(low) - F.length(dotted)), tail))

    def groups(text: Column) -> Column:
        parts = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
        cut = F.instr(text, F.lit("::"))
        head, rest = parts(F.substring(text, F.lit(1), cut - 1)), parts(F.substring(text, cut + 2, F.length(text)))
        room = F.lit(8) - F.size(head) - F.size(rest)
        filled = F.when(room >= 1, F.concat(head, F.array_repeat(F.lit("0"), room), rest))
        listed = F.when(cut > 0, filled).otherwise(F.split(text, ":"))
        fits = (F.size(listed) == 8) & F.forall(listed, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z")) & ~text.rlike("::.*::|:::")
        return F.when(fits, F.transform(listed, lambda g: F.conv(g, 16, 10).cast("long")))

    return F.when(F.contains(ip, F.lit(":")), let(plain, groups))


def ipv4_mapped(groups: Column) -> Column:
    """The IPv4 address number inside an IPv4-mapped IPv6 address, or NULL."""
    mapped = F.forall(F.slice(groups, 1, 5), lambda g: g == 0) & (groups[5] == 0xFFFF)
    return F.when(mapped, groups[6] * 65536 + groups[7])


def internal_ipv6(groups: Column) -> Column:
    """Loopback, unique-local and link-local addresses."""
    loopback = F.forall(F.slice(groups, 1, 7), lambda g: g == 0) & (groups[7] == 1)
    return loopback | (groups[0].bitwiseAND(0xFE00) == 0xFC00) | (groups[0].bitwiseAND(0xFFC0) == 0xFE80)


def long_le_to_ipv4(addr: Column) -> Column:
    """Dotted address of a little-endian 32-bit number, as kernel events carry it."""
    return F.concat_ws(".", *[F.shiftright(addr, 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 network."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_any_cidr(addr: Column, cidrs) -> Column:
    """Address number inside one of a fixed list of networks."""
    ranges = [cidr_range(c) for c in cidrs]
    return let(addr, lambda a: functools.reduce(operator.or_, [a.between(lo, hi) for lo, hi in ranges]))


def egress_url_problem(url: Column) -> Column:
    """Why an outgoing webhook URL is refused, or NULL when it is fine."""

    def judge(f: Column) -> Column:
        internal = in_any_cidr(f["addr"], ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/24"))
        internal_v6 = f["host"].rlike(r"^(?:[0:]*:0*1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff02:.*)\z")
        return (
            F.when(~F.startswith(url, F.lit("https://")), F.lit("must use https"))
            .when(f["host"] == "", F.lit("no host"))
            .when(f["host"].isin("localhost", "ip6-localhost", "ip6-loopback"), F.lit("localhost"))
            .when(f["host"] == "169.254.169.254", F.lit("metadata endpoint"))
            .when(F.coalesce(internal, F.lit(False)) | internal_v6, F.lit("internal address"))
        )

    host = let(F.lower(url_host(url)), lambda h: F.when(h == "", F.lower(extract_domain(url))).otherwise(h))
    return let(host, lambda h: let(F.struct(h.alias("host"), ipv4_to_long(h).alias("addr")), judge))
