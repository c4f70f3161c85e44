"""Domain patterns as a table: hosts meet them at keys of their label suffixes.

`a.b.c` has the exact key `a.b.c` and the wildcard keys `a.b.c`, `b.c` and `c`; the pattern `*.b.c` has the wildcard
key `b.c`. A host therefore brings a key per label, and every pattern one: an equi-join, however many patterns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_keys(host: Column) -> Column:
    """Keys of a host: itself as `=`, and each suffix of whole labels as `*`."""
    labels = F.split(host, r"\.")
    suffix = lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    wide = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.lit("*").alias("kind"), suffix(k).alias("domain")))
    return F.concat(F.array(F.struct(F.lit("=").alias("kind"), host.alias("domain"))), wide)


def pattern_key(pattern: Column) -> Column:
    """The key of a pattern, exact or `*.x`."""
    wide = F.startswith(pattern, F.lit("*."))
    return F.struct(F.when(wide, "*").otherwise("=").alias("kind"), F.when(wide, F.substr(pattern, F.lit(3))).otherwise(pattern).alias("domain"))


def matched_domains(hosts: DataFrame, patterns: DataFrame, keys, host: str = "host", pattern: str = "pattern") -> DataFrame:
    """(keys, host, pattern) for each distinct host and the most specific pattern of the same keys that it matches: exact first, then the longest.

    Hosts are made distinct before they meet, so a host that is in a third of all rows is looked up once per value of the keys. A null
    host, or null keys, match nothing; an empty host matches an empty pattern, as it is the same text.
    """
    seen = hosts.select(*keys, host).where(F.col(host).isNotNull()).distinct()
    left = seen.withColumn("__k", F.explode(host_keys(F.col(host)))).select("*", F.col("__k.kind").alias("__kind"), F.col("__k.domain").alias("__domain")).drop("__k")
    known = patterns.select(*keys, F.col(pattern).alias("__pattern")).where("__pattern IS NOT NULL").distinct()
    right = known.select("*", pattern_key(F.col("__pattern")).alias("__k")).select(*keys, "__pattern", F.col("__k.kind").alias("__kind"), F.col("__k.domain").alias("__domain"))
    met = left.join(right, [*keys, "__kind", "__domain"])
    best = F.max_by("__pattern", F.struct((F.col("__kind") == "=").alias("exact"), F.length("__domain").alias("length")))
    return met.groupBy(*keys, host).agg(best.alias(pattern))


def with_matched_domain(rows: DataFrame, patterns: DataFrame, keys, host: str = "host", pattern: str = "pattern", out: str = "matched") -> DataFrame:
    """The rows with the pattern that their host matches, or NULL."""
    found = matched_domains(rows, patterns, keys, host, pattern).withColumnsRenamed({**{k: f"__k_{k}" for k in [*keys, host]}, pattern: out})
    same = [rows[k] == found[f"__k_{k}"] for k in [*keys, host]]
    return rows.join(found, same, "left").drop(*[f"__k_{k}" for k in [*keys, host]])
