"""Server-side request forgery: verdicts on the URLs found in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentguard.functions import net, text as tx
from agentguard.functions.expr import let
from agentguard.functions.regex import re2
from agentguard.rules import vuln

URL_JAVA = re2(tx.URL_PATTERN)
PREFIX = "vuln_scan: SSRF detected — "


def _verdict(description: Column, excerpt: Column) -> Column:
    return F.struct(description.alias("description"), excerpt.alias("excerpt"))


def url_verdict(url: Column) -> Column:
    """Struct (description, excerpt) for a URL that points inside, or NULL."""

    def by_host(host: Column) -> Column:
        low = F.lower(host)
        inside = let(net.ipv6_groups(host), lambda g: F.coalesce(net.internal_ipv6(g), F.lit(False)) | F.coalesce(
            net.in_any_cidr(F.coalesce(net.ipv4_mapped(g), net.ipv4_to_long(host)), vuln.PRIVATE_CIDRS_V4), F.lit(False)))
        private = F.coalesce(inside, F.lit(False))
        return (
            F.when(host == "", F.lit(None))
            .when(host.isin(*vuln.METADATA_HOSTS), _verdict(F.lit(PREFIX + "cloud metadata endpoint"), host))
            .when(low.isin(*vuln.LOOPBACK_V6), _verdict(F.concat(F.lit(PREFIX + "IPv6 localhost/loopback "), host), host))
            .when(private, _verdict(F.concat(F.lit(PREFIX + "private/internal IP "), host), host))
            .when(host.rlike(r"^[0-9]{%d,}\z" % vuln.DECIMAL_IP_MIN_DIGITS), _verdict(F.lit(PREFIX + "decimal IP encoding"), host))
            .when(F.startswith(low, F.lit("0x")), _verdict(F.lit(PREFIX + "hex IP encoding"), host))
        )

    scheme = F.lower(F.regexp_extract(url, net.SCHEME_PATTERN, 1))
    quoted = F.concat(F.lit(PREFIX + 'disallowed scheme "'), scheme, F.lit('"'))
    return F.when(scheme.isin(*vuln.BAD_SCHEMES), _verdict(quoted, scheme)).otherwise(let(net.url_host(url), by_host))


def url_verdicts(text: Column) -> Column:
    """Array of struct (url, verdict) for every URL of a text."""
    return F.transform(
        tx.extract_urls(text, URL_JAVA),
        lambda u: F.struct(u.alias("url"), url_verdict(u).alias("verdict")),
    )


def first_ssrf(text: Column) -> Column:
    """Verdict on the first URL of a text that points inside, or NULL."""
    bad = F.filter(
        F.transform(tx.extract_urls(text, URL_JAVA), url_verdict), lambda v: v.isNotNull()
    )
    return F.when(F.contains(text, F.lit("://")), F.get(bad, F.lit(0)))
