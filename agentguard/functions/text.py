"""Text helpers built from SQL functions: everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Excerpt limit and mask.
EXCERPT_RUNES = 100
MASK = "****"

# Fixed value: schemes looked for in free text (RE2 dialect).
URL_PATTERN = (
    r"""(?i)(https?://[^\s"'<>]+|file://[^\s"'<>]+|gopher://[^\s"'<>]+|dict://[^\s"'<>]+|ftp://[^\s"'<>]+)"""
)


def byte_len(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text)


def folded(text: Column) -> Column:
    """Lower case with the long s folded: the text in which literal prefilters are looked up."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def contains_any(text: Column, needles) -> Column:
    """True if any literal occurs in `text`; used in front of the costlier regex."""
    cond = F.lit(False)
    for needle in needles:
        cond = cond | F.contains(text, F.lit(needle))
    return cond


def all_matches(text: Column, java_pattern: str) -> Column:
    """All hits of a regex, in order."""
    return F.regexp_extract_all(text, F.lit(java_pattern), F.lit(0))


def truncate_excerpt(text: Column) -> Column:
    """At most 100 characters, marked with an ellipsis when cut."""
    return F.when(F.length(text) > EXCERPT_RUNES, F.concat(F.left(text, F.lit(EXCERPT_RUNES)), F.lit("..."))).otherwise(text)


def canonical_method(method: Column) -> Column:
    """Trimmed method name with inner whitespace collapsed."""
    return F.trim(F.regexp_replace(method, r"[\s\x{85}\x{A0}]+", " "))


def extract_urls(text: Column, java_url: str) -> Column:
    """URLs in free text, in order; texts without a scheme separator skip the regex."""
    return F.when(F.contains(text, F.lit("://")), all_matches(text, java_url)).otherwise(
        F.array().cast("array<string>")
    )


def sanitize_for_log(text: Column, limit: int = 200) -> Column:
    """Control characters become underscores; longer values are cut."""
    clean = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "_")
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit)), F.lit("..."))).otherwise(clean)


def is_streaming_content_type(content_type: Column) -> Column:
    """Event stream, NDJSON or JSON stream content type."""
    return F.lower(content_type).rlike(r"text/event-stream|application/x-ndjson|application/stream\+json")
