"""Selectors: small predicate values that compile to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex


@dataclass(frozen=True)
class Source:
    """An input source: a container type and fields; a field that is None matches any value."""

    container: str | None
    fields: tuple[tuple[str, str | None], ...] = ()

    def matches(self, container: str = "container") -> Column:
        parts = [F.col(container) == self.container] if self.container else []
        parts += [F.col(name) == value for name, value in self.fields if value is not None]
        return reduce(Column.__and__, parts, F.lit(True))


def any_of(*sources: Source) -> Column:
    return reduce(Column.__or__, (s.matches() for s in sources), F.lit(False))


@dataclass(frozen=True)
class Effect:
    """Effects by category, optionally by key and by scope bits."""

    categories: frozenset[str]
    keys: frozenset[str] | None = None
    scope: int | None = None

    def matches(self, category: str = "category", key: str = "key", scope: str = "scope") -> Column:
        """A scope filter rejects a null scope, then needs a common bit."""
        found = F.col(category).isin(*sorted(self.categories))
        if self.keys is not None:
            found &= F.col(key).isin(*sorted(self.keys))
        if self.scope is not None:
            found &= F.col(scope).isNotNull() & (F.col(scope).bitwiseAND(F.lit(self.scope)) != 0)
        return F.coalesce(found, F.lit(False))

    def __or__(self, other: Effect) -> Effect:
        """Categories unite; keys only if both sides have them; a scope filter is lost. Lossy by definition."""
        keys = self.keys | other.keys if self.keys is not None and other.keys is not None else None
        return Effect(self.categories | other.categories, keys)


@dataclass(frozen=True)
class Fn:
    """Functions by alternatives, else name, else qualified name, else pattern: the first that is set decides."""

    name: str | None = None
    fqn: str | None = None
    pattern: str | None = None
    alternatives: tuple[Fn, ...] = field(default=())

    def __or__(self, other: Fn) -> Fn:
        own = self.alternatives or (self,)
        return replace(Fn(), alternatives=own + (other.alternatives or (other,)))

    def matches(self, name: str = "name", fqn: str = "fqn", expression: str | None = None) -> Column:
        if self.alternatives:
            return reduce(Column.__or__, (a.matches(name, fqn, expression) for a in self.alternatives))
        if self.name is not None:
            return F.coalesce(F.col(name) == self.name, F.lit(False))
        if self.fqn is not None:
            return F.coalesce(F.col(fqn) == self.fqn, F.lit(False))
        if self.pattern is None:
            return F.lit(False)
        try:
            re.compile(self.pattern)
            test = self.pattern
        except re.error:
            test = glob_regex(self.pattern)
        candidates = [name, fqn, *([expression] if expression else [])]
        return reduce(Column.__or__, (F.coalesce(F.col(c).rlike(test), F.lit(False)) for c in candidates))


@dataclass(frozen=True)
class When:
    """A three-valued predicate: SQL's own logic is Kleene's, with null as unknown."""

    test: Column

    def __and__(self, other: When) -> When:
        return When(self.test & other.test)

    def __or__(self, other: When) -> When:
        return When(self.test | other.test)

    def __invert__(self) -> When:
        return When(~self.test)

    def outcome(self) -> Column:
        return F.when(self.test.isNull(), "unknown").when(self.test, "passed").otherwise("failed")

    def keeps(self) -> Column:
        """Unknown matches stay; their outcome goes with them as a gap."""
        return self.test.isNull() | self.test


def comparing(column: str, pattern: str) -> Column:
    """Operand text against a shell pattern; a null operand never matches."""
    return F.coalesce(F.col(column).rlike(glob_regex(pattern)), F.lit(False))
