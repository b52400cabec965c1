"""Sources by name, and which of them answer a query: by namespace, health, retention and how long they have been up.

Sources of one tier are replicas: one of them is asked, the first that is fit (failover) or each in turn (round robin). Tiers hold different times: a range that
the hot tier no longer holds as a whole is cut, and the colder tier gives the rest.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from tidegrid.functions.filters import AND, Chain, Explicit, Filter, Metric
from tidegrid.model import Points
from tidegrid.operators.series import tiered
from tidegrid.plans.query import Query, Store

FAILOVER, ROUND_ROBIN = "failover", "round_robin"


@dataclass(frozen=True)
class Source:
    """Where points may come from. keeps: seconds that it holds, None for all; up_since: it has points from then on; namespaces: what metrics may have before their first dot, empty for any."""

    name: str
    points: Callable[[], Points]
    namespaces: frozenset[str] = frozenset()
    keeps: int | None = None
    up_since: int = 0
    healthy: bool = True
    tier: int = 0

    def since(self, now: int) -> int:
        return self.up_since if self.keeps is None else max(self.up_since, now - self.keeps)

    def fits(self, namespace: str | None) -> bool:
        return self.healthy and (not self.namespaces or namespace in self.namespaces)


@dataclass
class Registry:
    mode: str = FAILOVER
    sources: dict[str, Source] = field(default_factory=dict)
    _turn: Iterable[int] = field(default_factory=itertools.count)

    def register(self, source: Source) -> None:
        """A source of a name that is known takes its place, as when its health changes."""
        self.sources[source.name] = source

    def route(self, query: Query, now: int, source: str | None = None) -> list[tuple[Source, int, int]]:
        """The sources to ask and the range for each, hottest tier first; source names one that is asked whatever its state. LookupError if some of the range has none."""
        start, end = query.start - query.shift, query.end - query.shift
        if source is not None:
            return [(self.sources[source], start, end)]
        namespace = query.metric.partition(".")[0] if query.metric else None
        turn = next(self._turn) if self.mode == ROUND_ROBIN else 0
        out: list[tuple[Source, int, int]] = []
        for tier in sorted({s.tier for s in self.sources.values()}):
            fit = [s for s in self.sources.values() if s.tier == tier and s.fits(namespace)]
            if not fit or end <= start:
                continue
            whole = [s for s in fit if s.since(now) <= start]
            chosen = whole[turn % len(whole)] if whole else min(fit, key=lambda s: s.since(now))
            since = max(start, chosen.since(now))
            if since < end:
                out.append((chosen, since, end))
                end = since
        if end > start:
            raise LookupError(f"no source has {query.metric} from {start} to {end}")
        return out

    def store(self, query: Query, now: int, source: str | None = None) -> Store:
        """What planned() needs to answer the query: the points of the sources that route() names, each in its range."""
        asked = self.route(query, now, source)
        points = asked[0][0].points()
        for (_, cut, _), (colder, _, _) in zip(asked, asked[1:]):
            points = tiered(points, colder.points(), cut)
        return Store(points)


@dataclass(frozen=True)
class MetaRequest:
    """A request to a discovery source for the series of a metric, in groups by tags."""

    namespace: str
    where: Filter
    start: int
    end: int
    group_by: tuple[str, ...] = ()


def meta_request(namespace: str, where: Filter | None, metric: str, start: int, end: int, group_by: Iterable[str] = ()) -> MetaRequest:
    """The metric joins the filter by AND; explicit tags stay outermost."""
    wanted = Metric(None, (metric,))
    inner = where.child if isinstance(where, Explicit) else where
    chain = Chain(None, (wanted,) if inner is None else (wanted, inner), AND)
    return MetaRequest(namespace, Explicit(None, chain) if isinstance(where, Explicit) else chain, start, end, tuple(group_by))


def as_config(request: MetaRequest, where: Mapping) -> dict:
    """The request as the nested dictionaries that discovery services take; where: its filter in that form."""
    return {"from": 0, "to": 1, "start": request.start, "end": request.end, "order": "ASCENDING", "type": "TIMESERIES", "group": list(request.group_by), "namespace": request.namespace, "query": dict(where)}
