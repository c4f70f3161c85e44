"""Registry of queries with their reference SQL, and the derived inputs they share.

The derived inputs are SQL text that Spark and the checking engine both run; only the
payload list is spelled per engine, because string literals differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from agentguard.sources.readers import local_table, read_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn

    return wrap


#: Number of partitions into which tables for pattern matching are dealt; unset, they stay as their files are.
PARTITIONS = "spark.agentguard.textPartitions"


def table(spark: SparkSession, sf: str, name: str, texts: bool = False) -> DataFrame:
    """A given table; `texts` marks those whose columns are matched against patterns."""
    partitions = spark.conf.get(PARTITIONS, None) if texts else None
    return read_table(spark, f"{sf}/{name}.parquet", int(partitions) if partitions else None)


def q(text: str) -> str:
    """String literal for the checking engine."""
    return "'" + text.replace("'", "''") + "'"


def values(rows, columns) -> str:
    """Inline table for the checking engine."""
    def cell(v):
        if v is None:
            return "NULL"
        return q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    """The same inline table for Spark; its size is known to the optimiser."""
    return local_table(spark, rows, schema)


# --- SQL text of rules for the checking engine ---------------------------------------------


def sql_fires(rule, column: dict[str, str]) -> str:
    return f"regexp_matches({column[rule.view]}, {q(rule.pattern)})"


def sql_valid(kind: str | None, hit: str) -> str:
    """Validator of a hit as SQL, written independently of the column expressions."""
    digits = f"regexp_replace({hit}, '[^0-9]', '', 'g')"
    if kind is None:
        return "true"
    if kind == "luhn":
        nums = f"list_reverse(list_transform(string_split({digits}, ''), lambda d: try_cast(d AS INT)))"
        total = (
            f"list_sum(list_transform({nums}, lambda d, i: CASE WHEN i % 2 = 1 THEN d "
            "WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END))"
        )
        return f"(length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"
    if kind == "ssn":
        return (
            f"(length({digits}) = 9 AND left({digits}, 3) NOT IN ('000', '666') AND left({digits}, 1) <> '9' "
            f"AND substr({digits}, 4, 2) <> '00' AND right({digits}, 4) <> '0000')"
        )
    if kind == "public_ipv4":
        a, b = (f"try_cast(split_part({hit}, '.', {i}) AS INT)" for i in (1, 2))
        return (
            f"({a} NOT IN (0, 10, 127, 255) AND NOT ({a} = 172 AND {b} BETWEEN 16 AND 31) "
            f"AND NOT ({a} = 192 AND {b} = 168))"
        )
    clean = f"replace({hit}, ' ', '')"
    return f"(length({clean}) BETWEEN 15 AND 34 AND regexp_matches({clean}, '^[A-Z]{{2}}[0-9]{{2}}'))"


def sql_findings(source: str, key: str, column: dict[str, str], rules) -> str:
    """Counts per rule over every text: texts with a hit, hits, texts whose first hit is valid."""
    parts = []
    for order, r in enumerate(rules):
        hits = f"regexp_extract_all({column[r.view]}, {q(r.pattern)})"
        valid = f"list_filter(h, lambda x: {sql_valid(r.validator, 'x')})"
        parts.append(
            f"SELECT {q(r.scanner)} AS scanner, {q(r.rule_id)} AS rule_id, {order} AS rule_order, "
            f"{key} AS k, len({valid}) AS n, {sql_valid(r.validator, 'h[1]')} AS first_ok "
            f"FROM (SELECT {key}, {hits} AS h FROM {source}) WHERE len(h) > 0"
        )
    union = " UNION ALL ".join(parts)
    return (
        "SELECT scanner, rule_id, rule_order, count(*) AS texts, sum(n)::BIGINT AS hits, "
        f"count_if(first_ok) AS detected FROM ({union}) WHERE n > 0 GROUP BY ALL"
    )


TEXT_VIEWS = {"raw": "text", "lower": "lower(text)", "nfkc_lower": "lower(text)"}
