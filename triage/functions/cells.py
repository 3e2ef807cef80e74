"""Column helpers shared by every detector: cell cleanup, list membership,
first-match selection and message rendering.  All return JVM-side Column
expressions (whole-stage codegen friendly); nothing here runs Python per row.
"""

from __future__ import annotations

import string
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (str.isspace() is true).  Spark's
# btrim with an explicit character set strips exactly these, without regex.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def col_or_empty(name: str | None) -> Column:
    """Physical column as a string, or '' when the logical column is absent."""
    if name is None:
        return F.lit("")
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """Missing cell -> '', then strip Unicode whitespace on both ends."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(PY_WHITESPACE))


def rx(pattern: str, ignore_case: bool = True) -> str:
    """Python `re` pattern -> Java pattern with matching semantics.

    i: case-insensitive, u: Unicode case folding, U: Unicode classes for
    \\w \\b \\s (Python str patterns are Unicode), d: only \\n ends a line.
    """
    flags = "(?udU)" if not ignore_case else "(?iudU)"
    return flags + pattern


def any_regex(c: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern matches somewhere in c (one combined regex)."""
    return c.rlike(rx("|".join(f"(?:{p})" for p in patterns)))


def first_regex(c: Column, patterns: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Label (default: the pattern text) of the first pattern that matches, else NULL.

    A combined alternation is evaluated first so rows matching nothing (the
    vast majority) pay for one regex, not one per pattern.
    """
    labels = list(labels) if labels is not None else list(patterns)
    chain = None
    for p, lab in zip(patterns, labels):
        chain = (F.when(c.rlike(rx(p)), F.lit(lab)) if chain is None
                 else chain.when(c.rlike(rx(p)), F.lit(lab)))
    return F.when(any_regex(c, patterns), chain)


def first_contains(c: Column, markers: Sequence[str]) -> Column:
    """First marker (list order) that occurs in c, else NULL (CASE chain)."""
    chain = None
    for m in markers:
        chain = (F.when(c.contains(m), F.lit(m)) if chain is None
                 else chain.when(c.contains(m), F.lit(m)))
    return chain


def any_startswith(c: Column, prefixes: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return cond


def render(template: str, **fields: Column) -> Column:
    """Fill a '{name}' template with Column values -> concat expression."""
    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(fields[field])
    return F.concat(*parts) if parts else F.lit("")


def py_list_repr(values: Sequence[str]) -> str:
    """repr() of a list of plain strings: "['a', 'b']"."""
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


