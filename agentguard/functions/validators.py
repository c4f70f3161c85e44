"""Checks applied to a regex hit.

`validator_sql(kind, hit)` gives the check as SQL text over a hit; rule packs are compiled to
one SQL expression, which costs one call from Python instead of one per node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _luhn(h: str) -> str:
    # Doubling every second digit from the right and folding 10..18 to a digit sum.
    digits = f"reverse(regexp_extract_all({h}, '[0-9]', 0))"
    total = (
        f"aggregate(transform({digits}, (d, i) -> IF(i % 2 = 0, int(d), int(d) * 2 % 10 + int(d) DIV 5)), 0L, (a, d) -> a + d)"
    )
    return f"(size({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def _ssn(h: str) -> str:
    return f"rlike(regexp_replace({h}, '[^0-9]', ''), '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$')"


def _public_ipv4(h: str) -> str:
    a, b = f"int(split_part({h}, '.', 1))", f"int(split_part({h}, '.', 2))"
    return (
        f"NOT ({a} IN (0, 10, 127, 255) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168))"
    )


def _iban(h: str) -> str:
    clean = f"replace({h}, ' ', '')"
    return f"(length({clean}) BETWEEN 15 AND 34 AND rlike({clean}, '^[A-Z]{{2}}[0-9]{{2}}'))"


_VALIDATORS = {"luhn": _luhn, "ssn": _ssn, "public_ipv4": _public_ipv4, "iban": _iban}


def validator_sql(kind: str | None, hit: str) -> str:
    """The named check as SQL text; no check accepts every hit. User checks are given as
    a function from the hit's SQL text to a condition."""
    if kind is None:
        return "true"
    return kind(hit) if callable(kind) else _VALIDATORS[kind](hit)


def validate(kind, hit: Column) -> Column:
    """The check on a column."""
    return F.transform(F.array(hit), lambda h: h)[0].isNotNull() if kind is None else _on_column(kind, hit)


def _on_column(kind, hit: Column) -> Column:
    return F.call_function("exists", F.array(hit), F.expr(f"h -> {validator_sql(kind, 'h')}"))
