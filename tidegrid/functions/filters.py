"""Filters over tags and metrics, as trees that become one boolean Column.

Two readings of a tree are in use. In data queries a chain is a fold (fold): children combine from left to right, each by its own operator, and all
negated ones are taken out at the end. In discovery queries a chain is set algebra (algebra): its operator joins all children,
negated ones are taken out; with none but negated ones, AND starts from everything and OR from nothing.
A missing tag matches no filter, so it passes a negated one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.model import Tags

AND, OR, NOT = "AND", "OR", "NOT"
_EVERYTHING = (".*", "^.*", ".*$", "^.*$")


@dataclass(frozen=True)
class Filter:
    op: str | None = None

    def test(self, tags: Tags) -> Column:
        raise NotImplementedError

    def keys(self) -> set[str]:
        """The tag keys that it names."""
        return set()


@dataclass(frozen=True)
class Literal(Filter):
    """The tag has one of the values."""

    tag: str = ""
    values: tuple[str, ...] = ()

    def test(self, tags: Tags) -> Column:
        return F.coalesce(tags.value(self.tag).isin(*self.values), F.lit(False))

    def keys(self) -> set[str]:
        return {self.tag}


@dataclass(frozen=True)
class Regexp(Filter):
    """The tag's value has a match of the pattern anywhere."""

    tag: str = ""
    pattern: str = ""

    def test(self, tags: Tags) -> Column:
        if self.pattern in _EVERYTHING:
            return tags.has(self.tag)
        return F.coalesce(tags.value(self.tag).rlike(self.pattern), F.lit(False))

    def keys(self) -> set[str]:
        return {self.tag}


def Wildcard(tag: str, pattern: str, op: str | None = None, lower: bool = False) -> Regexp:  # noqa: N802
    """Stars stand for anything; like other patterns, it may match in the middle of a value. Discovery queries lower its case."""
    pattern = pattern.lower() if lower else pattern
    return Regexp(op, tag, pattern.replace("*", ".*"))


@dataclass(frozen=True)
class MatchAll(Filter):
    def test(self, tags: Tags) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Metric(Filter):
    """The metric is one of the values, or has a match of the pattern."""

    values: tuple[str, ...] = ()
    pattern: str | None = None

    def test(self, tags: Tags) -> Column:
        return F.col("metric").rlike(self.pattern) if self.pattern is not None else F.col("metric").isin(*self.values)


@dataclass(frozen=True)
class TagKey(Filter):
    """There is a tag whose key is one of the values, or has a match of the pattern."""

    values: tuple[str, ...] = ()
    pattern: str | None = None

    def test(self, tags: Tags) -> Column:
        hit = (lambda k: k.rlike(self.pattern)) if self.pattern is not None else (lambda k: k.isin(*self.values))
        own = [name for key, name in tags.columns.items() if (re.search(self.pattern, key) if self.pattern is not None else key in self.values)]
        found = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in own], F.lit(False))
        return found | F.coalesce(F.exists(F.map_keys(tags.rest), hit), F.lit(False)) if tags.rest else found


@dataclass(frozen=True)
class AnyField(Filter):
    """Some tag's key or value has a match of the pattern; metrics aren't searched."""

    pattern: str = ""

    def test(self, tags: Tags) -> Column:
        hit = lambda x: x.rlike(self.pattern)
        found = F.lit(False)
        for key, name in tags.columns.items():
            value = F.col(name)
            found = found | (value.isNotNull() if re.search(self.pattern, key) else F.coalesce(hit(value), F.lit(False)))
        if tags.rest:
            for side in (F.map_keys, F.map_values):
                found = found | F.coalesce(F.exists(side(F.col(tags.rest)), hit), F.lit(False))
        return found


@dataclass(frozen=True)
class Chain(Filter):
    children: tuple[Filter, ...] = ()
    #: What joins the children in discovery queries; in data queries each child's own operator does.
    join: str = AND

    def __post_init__(self) -> None:
        if not self.children:
            raise ValueError("a chain needs a filter")

    def keys(self) -> set[str]:
        return set().union(*[c.keys() for c in self.children])

    def negative(self) -> bool:
        return all(c.op == NOT or isinstance(c, Chain) and c.negative() for c in self.children)


@dataclass(frozen=True)
class Explicit(Filter):
    """What its child matches, among series that have no tags but those that the child names."""

    child: Filter = MatchAll()

    def keys(self) -> set[str]:
        return self.child.keys()


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _fold(tree: Filter, tags: Tags) -> Column:
    if isinstance(tree, Explicit):
        return _fold(tree.child, tags)
    if not isinstance(tree, Chain):
        return tree.test(tags)
    if len(tree.children) == 1:
        return _fold(tree.children[0], tags)
    found, negated = None, []
    for child in tree.children:
        one = _fold(child, tags)
        if child.op == NOT or isinstance(child, Chain) and child.negative():
            negated.append(one)
        elif found is None:
            found = one
        else:
            found = found & one if child.op == AND else found | one
    if found is None:
        return _any(negated)
    return found & ~_any(negated) if negated else found


def fold(tree: Filter, tags: Tags) -> Column:
    """The reading of data queries. A tree that is negative as a whole is taken out of everything."""
    inner = tree.child if isinstance(tree, Explicit) else tree
    negative = inner.op == NOT or isinstance(inner, Chain) and inner.negative()
    if isinstance(tree, Explicit):
        if negative or tree.op == NOT:
            raise ValueError("explicit tags can't go with a negated filter")
        return _fold(tree, tags) & (tags.count() == len(tree.keys()))
    return ~_fold(tree, tags) if negative else _fold(tree, tags)


def algebra(tree: Filter, tags: Tags) -> Column:
    """The reading of discovery queries. Metric filters of one chain are one set: positive ones join, whatever the chain's operator."""
    if tree.op == NOT:
        return ~algebra(replace(tree, op=None), tags)
    if isinstance(tree, Explicit):
        return algebra(tree.child, tags) & (tags.count() == len(tree.keys()))
    if not isinstance(tree, Chain):
        return tree.test(tags)
    positive = [c for c in tree.children if c.op != NOT]
    metrics = [c.test(tags) for c in positive if isinstance(c, Metric)]
    hits = ([_any(metrics)] if metrics else []) + [algebra(c, tags) for c in positive if not isinstance(c, Metric)]
    negated = [algebra(replace(c, op=None), tags) for c in tree.children if c.op == NOT]
    if tree.join == AND:
        found = reduce(lambda a, b: a & b, hits) if hits else F.lit(True)
    else:
        found = _any(hits) if hits else F.lit(False)
    return found & ~_any(negated) if negated else found


def parsed(config: Mapping, op: str | None = None, lower: bool = False) -> Filter:
    """A tree from nested dictionaries as query services send them: type, and op, filters, filter, tagKey, key or metric with it."""
    kind = config["type"]
    text = config.get("filter") or config.get("metric") or ""
    either = tuple(x for x in str(text).split("|") if x) if isinstance(text, str) else ()
    tag = config.get("tagKey") or config.get("key") or ""
    match kind:
        case "Chain":
            inner = config.get("op", AND)
            return Chain(op, tuple(parsed(c, inner, lower) for c in config["filters"]), inner)
        case "NOT" | "Not":
            return parsed(config["filter"], NOT, lower)
        case "ExplicitTags":
            return Explicit(op, parsed(config["filter"], None, lower))
        case "TagValueLiteralOr":
            return Literal(op, tag, either)
        case "TagValueRegex":
            return Regexp(op, tag, text)
        case "TagValueWildcard":
            return Wildcard(tag, text, op, lower)
        case "TagKeyLiteralOr":
            return TagKey(op, either)
        case "TagKeyRegex":
            return TagKey(op, (), text)
        case "MetricLiteral":
            return Metric(op, either)
        case "MetricRegex":
            return Metric(op, (), text)
        case "AnyFieldRegex":
            return AnyField(op, text)
        case "MatchAll":
            return MatchAll(op)
    raise ValueError(f"no filter of type {kind}")
