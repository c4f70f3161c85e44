"""Address ranges as a table: longest-prefix match by equi-join.

An address is 128 bits in two numbers, IPv4 mapped into IPv6, and a range is the first bits of an address and their number. For
every prefix length that occurs an address brings its own first bits as a key, so it meets all ranges that hold it
without any comparison of greater and smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions.expr import computed_once, let
from agentguard.functions.net import ipv4_to_long, ipv6_groups
from agentguard.session import staged

_MAPPED = 0xFFFF << 32


def _number(groups: Column, at: int) -> Column:
    """Four 16-bit groups as one 64-bit number."""
    shifted = [F.shiftleft(groups[at + k], 48 - 16 * k) for k in range(4)]
    return shifted[0].bitwiseOR(shifted[1]).bitwiseOR(shifted[2]).bitwiseOR(shifted[3])


def address(text: Column) -> Column:
    """The address as struct (high, low) of its 128 bits; NULL for what is no address."""
    four = lambda n: F.struct(F.lit(0).cast("bigint").alias("high"), (n + F.lit(_MAPPED)).alias("low"))
    six = lambda g: F.struct(_number(g, 0).alias("high"), _number(g, 4).alias("low"))
    return F.coalesce(
        let(ipv4_to_long(text), lambda n: F.when(n.isNotNull(), four(n))), let(ipv6_groups(text), lambda g: F.when(g.isNotNull(), six(g))))


def first_bits(value: Column, length: Column) -> Column:
    """The address with all but its first `length` bits cleared, as struct (high, low)."""
    def kept(part: Column, bits: Column) -> Column:
        mask = F.when(bits <= 0, F.lit(0).cast("bigint")).when(bits >= 64, F.lit(-1).cast("bigint")).otherwise(
            F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - bits).cast("int")))
        return part.bitwiseAND(mask)

    return F.struct(kept(value["high"], length).alias("high"), kept(value["low"], length - 64).alias("low"))


def parse_range(text: Column) -> Column:
    """A range `address/length`, or an address alone, as struct (length, high, low), bits behind the length cleared; NULL for what is none.

    The length of an IPv4 range counts from bit 96, where its bits begin.
    """
    base, written = F.substring_index(text, "/", 1), F.regexp_extract(text, r"/(\d{1,3})\z", 1)
    v4 = ~F.contains(base, F.lit(":"))
    most = F.when(v4, 32).otherwise(128)
    bits = F.when(~F.contains(text, F.lit("/")), most).otherwise(F.nullif(written, F.lit("")).cast("int"))
    whole = bits + F.when(v4, 96).otherwise(0)
    facts = F.struct(address(base).alias("a"), F.when(bits <= most, whole).alias("length"))
    return let(facts, lambda f: F.when(f["a"].isNotNull() & f["length"].isNotNull(), let(
        first_bits(f["a"], f["length"]), lambda b: F.struct(f["length"].alias("length"), b["high"].alias("high"), b["low"].alias("low")))))


def range_matches(rows: DataFrame, ranges: DataFrame, ip: str = "ip", cidr: str = "range", keys=(), out: str = "matched") -> DataFrame:
    """The rows with the longest range of the same `keys` that holds their address, or NULL.

    Of ranges that are the same bits in different spelling, the first by text stands for all. Addresses are made distinct before they
    meet the ranges, so an address in a third of all rows is looked up once. What is no address, or no range, matches nothing.
    The prefix lengths that occur, 129 at most, are read before the join. Each spelling is parsed once, and the parsed ranges are staged. What is
    joined may have any size, so the joins do not gather it on the driver.
    """
    keys = list(keys)
    spelled = ranges.select(*keys, F.col(cidr).alias("__range")).distinct()
    known = computed_once(spelled, "__r", parse_range(F.col("__range"))).where("__r IS NOT NULL")
    known = known.groupBy(*keys, "__r").agg(F.min("__range").alias("__range")).select(
        *keys, "__range", F.col("__r.length").alias("__length"), F.col("__r.high").alias("__high"), F.col("__r.low").alias("__low"))
    known = staged(known, "ranges")
    lengths = sorted(r[0] for r in known.select("__length").distinct().collect())
    seen = computed_once(rows.select(*keys, ip).distinct(), "__a", address(F.col(ip))).where("__a IS NOT NULL")
    each = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(each, lambda n: F.struct(n.alias("length"), first_bits(F.col("__a"), n).alias("bits")))
    cut = seen.withColumn("__p", F.explode(prefixes)).select(
        *keys, ip, F.col("__p.length").alias("__length"), F.col("__p.bits.high").alias("__high"), F.col("__p.bits.low").alias("__low"))
    best = cut.join(known.hint("merge"), [*keys, "__length", "__high", "__low"]).groupBy(*keys, ip).agg(F.max_by("__range", "__length").alias(out))
    best = best.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, ip]})
    same = [rows[k] == best[f"__k_{k}"] for k in [*keys, ip]]
    return rows.join(best.hint("merge"), same, "left").drop(*[f"__k_{k}" for k in [*keys, ip]])
