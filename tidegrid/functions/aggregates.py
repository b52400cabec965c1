"""Aggregators by name: a closed set, and those that users register."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A factory takes the value and what orders the rows, and returns an aggregate.
Factory = Callable[[Column, Column], Column]

_AGGREGATES: dict[str, Factory] = {
    "sum": lambda v, order: F.sum(v),
    "avg": lambda v, order: F.avg(v),
    "count": lambda v, order: F.count(v).cast("double"),
    "min": lambda v, order: F.min(v),
    "max": lambda v, order: F.max(v),
    "last": lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
    "first": lambda v, order: F.min_by(v, F.when(v.isNotNull(), order)),
    "sumofsquare": lambda v, order: F.sum(v * v),
    "dev": lambda v, order: F.stddev_pop(v),
    "median": lambda v, order: F.percentile(v, F.lit(0.5)),
    "range": lambda v, order: F.max(v) - F.min(v),
}
_ALIASES = {"zimsum": "sum", "mimmin": "min", "mimmax": "max", "average": "avg", "squareSum": "sumofsquare"}
#: What a rollup keeps for each interval, in this order.
ROLLUP = ("avg", "sum", "count", "min", "max", "sumofsquare")


def register(name: str, factory: Factory) -> None:
    """Makes an aggregate of one's own, a pandas UDF's result among others, known by name."""
    if name in _AGGREGATES or name in _ALIASES:
        raise ValueError(f"{name} is taken")
    _AGGREGATES[name] = factory


def aggregate(name: str, value: Column, order: Column) -> Column:
    """pNN and pNNN are percentiles by linear interpolation: p99, p999."""
    name = _ALIASES.get(name, name)
    if name in _AGGREGATES:
        return _AGGREGATES[name](value, order)
    if found := re.fullmatch(r"p(\d{2,3})", name):
        return F.percentile(value, F.lit(int(found[1]) / 10 ** len(found[1])))
    raise ValueError(f"no aggregator {name}")


def chain(names: Sequence[str]) -> str:
    """The name of a chain of rollup aggregators, such as avg-count; one may not occur twice."""
    names = [_ALIASES.get(n, n) for n in names]
    if not names or len(set(names)) < len(names):
        raise ValueError("aggregators must be some, each once")
    if unknown := set(names) - set(ROLLUP):
        raise ValueError(f"no rollup aggregators: {sorted(unknown)}")
    return "-".join(names)
