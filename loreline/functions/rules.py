"""K1: ordered first-match rules compiled to native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.text import first_or_null


@dataclass(frozen=True)
class PatternRule:
    """`pattern` decides the match; `build` makes the value, or None for a null result."""

    pattern: str
    group: int | None
    prefix: str = ""
    tidy: str = "keep"


@dataclass(frozen=True)
class RuleSet:
    """Rows (order, pattern, value recipe). The first matching rule ends the search,
    also when its result is null, so the chain is CASE WHEN, not COALESCE."""

    rules: tuple[PatternRule, ...]
    tidy_steps: dict

    def apply(self, c: Column) -> Column:
        chain = None
        for rule in self.rules:
            if rule.group is None:
                value = F.lit(None).cast("string")
            else:
                value = F.regexp_extract(c, rule.pattern, rule.group)
                value = self.tidy_steps[rule.tidy](value)
                if rule.prefix:
                    value = F.concat(F.lit(rule.prefix), value)
            hit = F.rlike(c, F.lit(rule.pattern))
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return chain

    def matched(self, c: Column) -> Column:
        """True when any rule matches, also one with a null result."""
        hit = F.lit(False)
        for rule in self.rules:
            hit = hit | F.rlike(c, F.lit(rule.pattern))
        return hit


def first_segment(text: Column, table) -> Column:
    """Value of the first table row whose segment occurs in the text, as one array literal.

    The table is a constant of known size, folded once; a CASE chain of the same
    length would overrun the size the JIT compiles.
    """
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = ", ".join(f"struct({quote(s)} AS segment, {quote(v)} AS value)" for s, v in table)
    rows = F.expr(f"array({cells})")
    return first_or_null(F.filter(rows, lambda r: F.contains(text, r["segment"])))["value"]


def first_segment_chain(text: Column, table) -> Column:
    """The same as a CASE chain, for short tables."""
    chain = None
    for segment, value in table:
        hit = F.contains(text, F.lit(segment))
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain
