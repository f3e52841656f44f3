"""Name patterns of rules: ``schema.table`` with ``*`` and ``?``, ``!`` to exclude."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression, the same in Java, Python and RE2."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


@dataclass(frozen=True)
class TableRules:
    """Ordered rules; the last that matches decides.  No rules: every table matches."""

    rules: tuple[str, ...] = ()
    case_sensitive: bool = False

    def _parsed(self) -> list[tuple[bool, str, str]]:
        out = []
        for rule in self.rules or ("*.*",):
            exclude = rule.startswith("!")
            schema, dot, table = rule.removeprefix("!").partition(".")
            if not dot or not schema or not table:
                raise ValueError(f"a rule is schema.table, not {rule!r}")
            out.append((exclude, schema, table))
        return out

    def matches(self, schema: str, table: str) -> bool:
        fold = (lambda x: x) if self.case_sensitive else str.lower
        found = False
        for exclude, s, t in self._parsed():
            if re.match(glob_regex(fold(s)), fold(schema)) and re.match(glob_regex(fold(t)), fold(table)):
                found = not exclude
        return found

    def column(self, schema: Column, table: Column) -> Column:
        """One CASE over all rules, last rule first: the first branch that holds is the last rule that matches."""
        fold = (lambda x: x) if self.case_sensitive else str.lower
        if not self.case_sensitive:
            schema, table = F.lower(schema), F.lower(table)
        parsed = self._parsed()[::-1]
        branch = [(schema.rlike(glob_regex(fold(s))) & table.rlike(glob_regex(fold(t))), F.lit(not exclude)) for exclude, s, t in parsed]
        head = F.when(*branch[0])
        return reduce(lambda acc, b: acc.when(*b), branch[1:], head).otherwise(F.lit(False))

    def schema_column(self, schema: Column) -> Column:
        """Whether some table of the schema could match: an including rule does so, and no later rule takes the whole schema out."""
        fold = (lambda x: x) if self.case_sensitive else str.lower
        if not self.case_sensitive:
            schema = F.lower(schema)
        out = F.lit(False)
        for exclude, s, t in self._parsed():
            hit = schema.rlike(glob_regex(fold(s)))
            if not exclude:
                out = out | hit
            elif t == "*":
                out = out & ~hit
        return out


def match_columns(patterns: list[str], names: list[str]) -> list[str]:
    """The names that ordered patterns (``*``, prefix ``*``, ``!``) leave; the last match decides."""
    kept = []
    for name in names:
        found = False
        for p in patterns:
            if re.match(glob_regex(p.removeprefix("!").lower()), name.lower()):
                found = not p.startswith("!")
        if found:
            kept.append(name)
    return kept
