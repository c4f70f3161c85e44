"""RE2-dialect patterns on the JVM regex engine.

Rule packs are written in the RE2 dialect (linear time, ASCII classes). Spark
evaluates `rlike`/`regexp_extract` with java.util.regex, which disagrees on a few
constructs. `re2()` rewrites those constructs so that both engines give the same hits.
"""

from __future__ import annotations

import re

WORD = "0-9A-Za-z_"
_SPACE_IN_CLASS = r"\t\n\f\r "
_NOT_SPACE_IN_CLASS = r"\x00-\x08\x0B\x0E-\x1F\x21-\x{10FFFF}"
# Boundaries are ASCII whatever the flags: with case folding, [A-Za-z] would take in the long s
# and the Kelvin sign, which are no word characters.
_GENERIC_BOUNDARY = f"(?-iu:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_AFTER_WORD = f"(?-iu:(?![{WORD}]))"
_BEFORE_WORD = f"(?-iu:(?<![{WORD}]))"
_FOLDS_OUTSIDE_ASCII = "skSK"
_WORD_CLASS = re.compile(r"\[[A-Za-z0-9_\-]+\]")


def _alternatives(body: str) -> list[str]:
    """Top-level alternatives of a group body."""
    parts, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(body[start:i])
            start = i + 1
        i += 1
    return parts + [body[start:]]


def _group_end(p: str, i: int) -> int:
    """Index of the ')' that closes the '(' at `i`."""
    depth, in_class = 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced group in {p!r}")


def _optional(p: str, i: int) -> bool:
    return p[i : i + 1] in ("?", "*") or p[i : i + 2] == "{0"


def _starts_with_word(p: str, fold: bool = False) -> bool:
    """True when every match of `p` surely begins with an ASCII word character."""
    if not p:
        return False
    if p[0].isascii() and (p[0].isalnum() or p[0] == "_"):
        return not _optional(p, 1) and not (fold and p[0] in _FOLDS_OUTSIDE_ASCII)
    if p.startswith(r"\d") or (p.startswith(r"\w") and not fold):
        return not _optional(p, 2)
    m = _WORD_CLASS.match(p)
    if m:
        return not fold and not _optional(p, m.end())
    if p[0] == "(":
        end = _group_end(p, 0)
        body = p[3:end] if p.startswith("(?:") else p[1:end]
        if body.startswith("?") or _optional(p, end + 1):
            return False
        return all(_starts_with_word(a, fold) for a in _alternatives(body))
    return False


def _ends_with_word(p: str, fold: bool = False) -> bool:
    """True when every match of `p` surely ends with an ASCII word character."""
    if re.search(r"(?:^|[^\\])(?:\\\\)*\\[dw](?:\{[1-9]\d*(?:,\d*)?\}|\+)?$", p):
        return not fold or p.rstrip("+").split("{")[0].endswith(r"\d")
    if re.search(r"\[[A-Za-z0-9_\-]+\](?:\{[1-9]\d*(?:,\d*)?\}|\+)?$", p):
        return not fold
    if p and p[-1].isascii() and (p[-1].isalnum() or p[-1] == "_"):
        return (len(p) < 2 or p[-2] != "\\") and not (fold and p[-1] in _FOLDS_OUTSIDE_ASCII)
    if p.endswith(")") and not p.endswith("\\)"):
        for start in range(len(p) - 1, -1, -1):
            escaped = start and p[start - 1] == "\\"
            if p[start] == "(" and not escaped and _group_end(p, start) == len(p) - 1:
                body = p[start + 1 : -1]
                body = body[2:] if body.startswith("?:") else body
                return not body.startswith("?") and all(_ends_with_word(a, fold) for a in _alternatives(body))
    return False


def _peek(p: str) -> str:
    """Look-ahead for the first character of `p`: cheaper to fail on than a look-behind."""
    if p[0].isalnum():
        return f"(?={p[0]})"
    if p[0] == "\\":
        return f"(?={p[:2]})"
    m = _WORD_CLASS.match(p)
    return f"(?={m.group()})" if m else ""


# Named ASCII classes of the RE2 dialect.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": r"!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_LINE_START, _LINE_END = r"(?:\A|(?<=\n))", r"(?:\z|(?=\n))"
_NOT_BOUNDARY = f"(?-iu:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_NAMED_GROUP = re.compile(r"\(\?P?<[A-Za-z_][A-Za-z0-9_]*>")
_MAX_REPEAT = 1000


def _property(pattern: str, i: int) -> tuple[str, int]:
    """A Unicode class at `i` (behind the backslash) for the JVM, and where it ends."""
    negative, i = pattern[i] == "P", i + 1
    if pattern[i : i + 1] == "{":
        end = pattern.index("}", i)
        name, i = pattern[i + 1 : end], end + 1
    else:
        name, i = pattern[i : i + 1], i + 1
    if name.startswith("^"):
        negative, name = not negative, name[1:]
    if not name:
        raise ValueError(f"no class name in {pattern!r}")
    if name == "Any":
        return (r"[^\x00-\x{10FFFF}]" if negative else r"[\x00-\x{10FFFF}]"), i
    return "\\" + ("P" if negative else "p") + "{" + (name if len(name) <= 2 else "Is" + name) + "}", i


def _posix(pattern: str, i: int) -> tuple[str, int] | None:
    """A named class at `i` inside brackets, and where it ends."""
    m = re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, i)
    if not m:
        return None
    if m[2] not in _POSIX:
        raise ValueError(f"unknown class {m[0]} in {pattern!r}")
    return (f"[^{_POSIX[m[2]]}]" if m[1] else _POSIX[m[2]]), m.end()


def re2(pattern: str) -> str:
    """Translate an RE2 pattern to an equivalent java.util.regex pattern.

    Raises ValueError for what RE2 does not know (look-around, back references, repetitions over
    1000) and for ungreedy mode, which is not translated.
    """
    out: list[str] = ["(?d)"]
    i, n, in_class = 0, len(pattern), False
    fold, lines = False, False
    outer: list[tuple[bool, bool]] = []
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt in "pP":
                text, i = _property(pattern, i + 1)
                out.append(text)
                continue
            if nxt == "Q":
                end = pattern.find("\\E", i)
                body = pattern[i + 2 :] if end < 0 else pattern[i + 2 : end]
                out.append("".join("\\" + x if x.isascii() and not x.isalnum() else x for x in body))
                i = n if end < 0 else end + 2
                continue
            if nxt == "s":
                out.append(_SPACE_IN_CLASS if in_class else f"[{_SPACE_IN_CLASS}]")
            elif nxt == "S":
                out.append(_NOT_SPACE_IN_CLASS if in_class else f"[^{_SPACE_IN_CLASS}]")
            elif nxt == "v":
                out.append(r"\x0B")
            elif nxt == "b" and not in_class:
                if _starts_with_word(pattern[i + 2 :], fold):
                    out.append(_peek(pattern[i + 2 :]) + _BEFORE_WORD)
                elif _ends_with_word(pattern[:i], fold):
                    out.append(_AFTER_WORD)
                else:
                    out.append(_GENERIC_BOUNDARY)
            elif nxt == "B" and not in_class:
                out.append(_NOT_BOUNDARY)
            elif nxt == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(pattern[i : end + 1])
                i = end + 1
                continue
            elif nxt in "123456789" or nxt.isalpha() and nxt not in "adDwWftnrxAz":
                raise ValueError(f"\\{nxt} is not known in {pattern!r}")
            else:
                out.append(c + nxt)
            i += 2
            continue
        if in_class:
            named = _posix(pattern, i) if c == "[" else None
            if named:
                out.append(named[0])
                i = named[1]
                continue
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&":
                out.append("\\" + c)
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if c == "(":
            if flags := _FLAGS.match(pattern, i):
                on, off, end = flags[1], flags[2] or "", flags[3]
                if "U" in on or not (on or off or end == ":"):
                    raise ValueError(f"flags {flags[0]!r} are not supported in {pattern!r}")
                if end == ":":
                    outer.append((fold, lines))
                fold, lines = (fold or "i" in on) and "i" not in off, (lines or "m" in on) and "m" not in off
                plus = ("iu" if "i" in on else "") + ("s" if "s" in on else "")
                minus = ("i" if "i" in off else "") + ("s" if "s" in off else "")
                text = plus + ("-" + minus if minus else "")
                out.append(f"(?{text}{end}" if text or end == ":" else "")
                i = flags.end()
                continue
            outer.append((fold, lines))
            if named := _NAMED_GROUP.match(pattern, i):
                out.append("(")  # names differ between the dialects; numbers do not
                i = named.end()
                continue
            if pattern.startswith("(?", i):
                raise ValueError(f"{pattern[i : i + 4]!r} is not known in {pattern!r}")
            out.append(c)
        elif c == ")":
            if not outer:
                raise ValueError(f"unbalanced group in {pattern!r}")
            fold, lines = outer.pop()
            out.append(c)
        elif c == "$":
            out.append(_LINE_END if lines else "\\z")
        elif c == "^" and lines:
            out.append(_LINE_START)
        elif c == "{":
            repeat = _REPEAT.match(pattern, i)
            if repeat and max(int(repeat[1]), int(repeat[2] or 0)) > _MAX_REPEAT:
                raise ValueError(f"more than {_MAX_REPEAT} repetitions in {pattern!r}")
            out.append(c if repeat else "\\{")
        else:
            out.append(c)
        i += 1
    if in_class or outer:
        raise ValueError(f"unbalanced brackets or groups in {pattern!r}")
    return "".join(out)


_NESTED_LOOP = re.compile(r"\((?:\?:)?[^()\[\]]*(?:\||[*+])[^()\[\]]*\)[*+](?!\+)")
_ONE_SIGN = r"(?:\\[dDwWsS]|\\[^A-Za-z0-9\s]|[^\\\[\](){}|*+?.^$\s])"
_SIGN_CHOICE = re.compile(rf"\((?:\?:)({_ONE_SIGN}(?:\|{_ONE_SIGN})+)\)(?=[*+])")


def _as_class(m: re.Match) -> str:
    """A choice between single signs as a class, which loops without recursion."""
    signs = re.findall(_ONE_SIGN, m[1])
    return "[" + "".join(x if x.startswith("\\") or x.isalnum() else "\\" + x for x in signs) + "]"


def check_user_pattern(pattern: str) -> str:
    """The pattern in a form that is safe on the JVM; ValueError where there is none.

    An alternation or loop inside an unbounded group recurses once per repetition on the JVM. Choices
    between single signs become classes; any other such rule has to be rewritten with a possessive
    quantifier. The translation is compiled by Spark where a session is at hand.
    """
    pattern = _SIGN_CHOICE.sub(_as_class, pattern)
    java = re2(pattern)
    if _NESTED_LOOP.search(pattern):
        raise ValueError(f"pattern {pattern!r} repeats an alternation or a loop without bound")
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session.range(1).select(F.lit("").rlike(java)).collect()
        except PySparkException as err:
            raise ValueError(f"invalid pattern {pattern!r}: {err}") from err
    return pattern
