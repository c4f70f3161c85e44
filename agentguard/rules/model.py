"""What a detection rule is."""

from __future__ import annotations

from dataclasses import dataclass

from agentguard.functions.regex import check_user_pattern, re2


@dataclass(frozen=True)
class Rule:
    """One pattern of a rule pack.

    `pattern` is RE2 text; `java` replaces its translation where the JVM needs another
    form to stay linear. `needs` are folded literals, one of which is in every hit;
    `guard` is a cheap regex that every text with a hit matches, tested once per text for
    all rules that share it.
    """

    scanner: str
    rule_id: str
    pattern: str
    name: str = ""
    category: str = ""
    confidence: str = "high"
    needs: tuple[str, ...] = ()
    guard: str | None = None
    view: str = "raw"  # raw | lower | nfkc_lower
    validator: str | None = None
    java: str | None = None
    note: str = ""

    @property
    def java_pattern(self) -> str:
        return self.java or re2(self.pattern)


# Guards shared by many rules.
THREE_DIGITS = "[0-9]{3}"
NON_ASCII = r"[^\x00-\x7F]"


def custom_rule(scanner: str, name: str, pattern: str, description: str = "", **kw) -> Rule:
    """A user-supplied rule; its pattern is checked when the rule is loaded."""
    pattern = check_user_pattern(pattern)
    return Rule(scanner, snake_case(name), pattern, name=name, note=description or name, **kw)


def snake_case(name: str) -> str:
    """Rule id from a rule name: lower case, other characters become single underscores."""
    out = "".join(c if c.isalnum() else "_" for c in name.lower().replace("'", ""))
    return "_".join(part for part in out.split("_") if part)
