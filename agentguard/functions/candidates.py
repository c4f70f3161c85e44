"""Which rules of a pack occur in a text, by RE2 over Arrow batches.

The JVM reads a text once per literal and once per regex. Here all literals of many rules are one RE2 pattern, which is one pass whatever
their number; texts that hold one are tried on a quarter of the rules each, and so on down to single rules, whose own pattern
decides. Rules whose literals occur in most texts, or that need none, are tried at once, after their guard.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FANOUT = 4
#: Literals that say nothing of a text.
_COMMON = (".", "-", "'", "\n")


def _telling(literal: str) -> bool:
    return literal not in _COMMON and (len(literal) > 2 or not literal.isalpha())


def _any_of(literals) -> str:
    """A pattern of folded literals; the fold makes a long s plain, as lower case does not."""
    signs = lambda x: "".join("[sſ]" if c == "s" else re.escape(c) for c in x)
    return "|".join(map(signs, dict.fromkeys(literals)))


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    """Where a pattern occurs; everywhere, if this RE2 does not take it, as the JVM decides then."""
    try:
        return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        return np.ones(len(texts), bool)


def rule_numbers(rules, views: list[Column], columns: list[int], folds: list[int]) -> Column:
    """Ascending numbers of the rules that RE2 finds in a row, as array<int>.

    `columns` and `folds` say for each rule which of the views its pattern and its literals read. The first view is the text as it is, for guards.
    """
    plain = [(r.pattern, tuple(r.needs), r.guard) for r in rules]
    tree = [i for i, (_, needs, _) in enumerate(plain) if needs and all(map(_telling, needs))]
    alone = [i for i in range(len(plain)) if i not in set(tree)]

    @F.arrow_udf("array<int>")
    def numbers(*texts: pa.Array) -> pa.Array:
        hits = np.zeros((len(texts[0]), len(plain)), bool)

        def some(view: int, rows):
            return texts[view] if rows is None else texts[view].take(pa.array(rows))

        def narrowed(mask: np.ndarray, rows):
            return np.flatnonzero(mask) if rows is None else rows[mask]

        def decide(i: int, rows) -> None:
            found = _found(some(columns[i], rows), plain[i][0])
            hits[narrowed(found, rows), i] = True

        def descend(group: list[int], rows) -> None:
            if len(group) == 1:
                return decide(group[0], rows)
            left = narrowed(_found(some(folds[group[0]], rows), _any_of(n for i in group for n in plain[i][1])), rows)
            if len(left):
                size = -(-len(group) // FANOUT)
                for k in range(0, len(group), size):
                    descend(group[k:k + size], left)

        for view in sorted({folds[i] for i in tree}):
            descend([i for i in tree if folds[i] == view], None)
        guarded = {g: np.flatnonzero(_found(texts[0], g)) for g in {plain[i][2] for i in alone} if g}
        for i in alone:
            rows = guarded.get(plain[i][2])
            if rows is None or len(rows):
                decide(i, rows)
        of, number = np.nonzero(hits)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(hits)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number, pa.int32()))

    return numbers(*views)
