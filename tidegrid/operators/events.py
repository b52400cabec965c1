"""Operational events: search, groups, counts by minute, updates, links.

Columns: event_id, namespace, source, title, message, priority, user_id (strings), ts, end_ts (epoch seconds), ongoing (boolean), dimensions and
additional_props (maps of strings), parent_ids (array).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_GROUP = "_NO_GROUP"
#: Fields split into words; others are one keyword each.
ANALYSED = ("title", "message")
KEYWORDS = ("source", "namespace", "user_id", "priority")
CHANGEABLE = ("title", "message", "priority", "user_id", "end_ts", "additional_props")


def _contains(field: str, pattern: str, plain: bool) -> Column:
    """Whether a word of the field (or all of it, for keywords) has the pattern somewhere."""
    text = F.lower(F.col(field))
    if plain:  # without white space in it, it is in a word when it is in the text
        return F.coalesce(F.contains(text, F.lit(pattern)), F.lit(False))
    if field in ANALYSED:
        return F.coalesce(F.exists(F.split(text, r"\s+"), lambda w: w.rlike(pattern)), F.lit(False))
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _in_map(field: str, pattern: str, plain: bool) -> Column:
    hit = (lambda v: F.contains(F.lower(v), F.lit(pattern))) if plain else (lambda v: F.lower(v).rlike(pattern))
    return F.coalesce(F.exists(F.map_values(field), hit), F.lit(False))


def _either(found: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, found, F.lit(False))


@dataclass(frozen=True)
class Term:
    """What is looked for, in one field or tag or in all: a word (its pattern plain, or a regular expression), or the words of a phrase, one after the other."""

    pattern: str
    plain: bool = True
    field: str | None = None
    phrase: tuple[str, ...] = ()

    def test(self) -> Column:
        name, pattern, plain = self.field, self.pattern, self.plain
        if self.phrase:
            fields = [f for f in ANALYSED if name in (None, f)]
            spaced = lambda f: F.concat(F.lit(" "), F.array_join(F.split(F.lower(F.col(f)), r"\s+"), " "), F.lit(" "))
            return _either(F.coalesce(F.contains(spaced(f), F.lit(f" {' '.join(self.phrase)} ")), F.lit(False)) for f in fields)
        if name == "*" or name is None and not plain and pattern == "(?i).*":
            return F.lit(True)
        if name in (*ANALYSED, *KEYWORDS):
            return _contains(name, pattern, plain)
        if name is not None:
            name = name.removeprefix("tag.")
            value = F.lower(F.coalesce(F.col("dimensions")[name], F.col("additional_props")[name]))
            return F.coalesce(F.contains(value, F.lit(pattern)) if plain else value.rlike(pattern), F.lit(False))
        return _either([_contains(f, pattern, plain) for f in (*KEYWORDS, *ANALYSED)] + [_in_map(f, pattern, plain) for f in ("dimensions", "additional_props")])


def _word(characters: list[tuple[str, bool]], field: str | None) -> Term:
    """characters come with whether they were escaped: an escaped star or question mark stands for itself."""
    text = "".join(c for c, _ in characters).lower()
    if any(c in "*?" and not escaped for c, escaped in characters):
        return Term("(?i)" + "".join({"*": ".*", "?": "."}[c] if c in "*?" and not escaped else re.escape(c) for c, escaped in characters), False, field)
    return Term(text, True, field)


def _scanned(query: str) -> Iterator[str | Term]:
    """Brackets, AND, OR, NOT, + and terms, in order. Terms are words, "phrases" and /patterns/, and may have a field before them."""
    at, field = 0, None
    while at < len(query):
        c = query[at]
        if c.isspace():
            at += 1
        elif c in "()":
            yield f"{field}:(" if c == "(" and field else c
            at, field = at + 1, None
        elif query.startswith(("&&", "||"), at):
            yield "AND" if c == "&" else "OR"
            at += 2
        elif c in "+-!" and at + 1 < len(query) and not query[at + 1].isspace() and field is None:
            yield "+" if c == "+" else "NOT"
            at += 1
        elif c in '"/':
            stop, text = at + 1, ""
            while stop < len(query) and query[stop] != c:
                if query[stop] == "\\" and stop + 1 < len(query) and (c == '"' or query[stop + 1] == c):
                    stop += 1
                text += query[stop]
                stop += 1
            if stop == len(query):
                raise ValueError(f"no end of {query[at:]}")
            at = stop + 1
            if c == '"':
                words = tuple(text.lower().split())
                yield Term(words[0] if len(words) == 1 else "", True, field, words if len(words) > 1 else ()) if words else Term("", True, field)
                suffix = re.match(r"[~^][0-9.]*", query[at:])
                at += suffix.end() if suffix else 0
            else:
                yield Term("(?i)" + text, False, field)
            field = None
        else:
            characters: list[tuple[str, bool]] = []
            while at < len(query) and not query[at].isspace() and query[at] not in '()"':
                escaped = query[at] == "\\" and at + 1 < len(query)
                at += escaped
                if query[at] == ":" and not escaped and characters and at + 1 < len(query) and not query[at + 1].isspace():
                    break
                characters.append((query[at], escaped))
                at += 1
            if at < len(query) and query[at] == ":" and characters:
                field = "".join(x for x, _ in characters)
                at += 1
                continue
            boost = next((k for k in range(len(characters) - 1, 0, -1) if not (characters[k][0].isdigit() or characters[k][0] == ".")), 0)
            if boost and characters[boost] in (("^", False), ("~", False)):
                del characters[boost:]
            text = "".join(x for x, _ in characters)
            if field is None and text in ("AND", "OR", "NOT"):
                yield text
            elif not characters or field is None and text in ("+", "-", "!"):
                at += not characters
            else:
                yield _word(characters, field)
                field = None


def matches(query: str | None) -> Column:
    """A query such as deploy AND (host1 OR host2) NOT test; terms side by side are joined by OR. Empty: everything.

    AND makes the terms on both its sides needed, + the next one; NOT, ! and - rule out the next one. Where some are needed the others don't count, else one of them must be there; a query, or a pair of brackets, of
    none but ruled out terms finds nothing. A query that begins with AND, OR or NOT has everything in front of it.
    """
    query = (query or "").strip()
    if not query:
        return F.lit(True)
    if query.startswith(("AND ", "OR ", "NOT ")):
        query = "*:* " + query
    tokens = list(_scanned(query))
    found, at = _clauses(tokens, 0, None)
    if at < len(tokens):
        raise ValueError(f"a bracket too many: {query}")
    return found


def _clauses(tokens: list[str | Term], at: int, field: str | None) -> tuple[Column, int]:
    """What the clauses up to the closing bracket find, and the place behind it. field: that of the bracket, for terms without one."""
    clauses: list[list] = []  # needed or ruled out or neither, and the test
    conjunction = modifier = None
    while at < len(tokens) and tokens[at] != ")":
        token = tokens[at]
        at += 1
        if token in ("AND", "OR"):
            conjunction = token
            continue
        if token in ("NOT", "+"):
            modifier = token
            continue
        if isinstance(token, Term):
            test = (token if token.field or not field else replace(token, field=field)).test()
        else:
            test, at = _clauses(tokens, at, token.removesuffix(":(") if token != "(" else field)
            if at >= len(tokens):
                raise ValueError("a bracket too few")
            at += 1
        if conjunction == "AND" and clauses and clauses[-1][0] != "NOT":
            clauses[-1][0] = "+"
        clauses.append(["NOT" if modifier == "NOT" else "+" if modifier == "+" or conjunction == "AND" else None, test])
        conjunction = modifier = None
    needed = [test for kind, test in clauses if kind == "+"]
    found = reduce(lambda a, b: a & b, needed) if needed else _either(test for kind, test in clauses if kind is None)
    return reduce(lambda a, b: a & ~b, [test for kind, test in clauses if kind == "NOT"], found), at


def query_of(config: Mapping | None) -> str:
    """The search of a metric query's filter: the pass-through string in a chain of AND (the last of several); anything else finds everything."""
    if not config or config.get("type") != "Chain" or config.get("op", "AND") != "AND":
        return ""
    return next((str(c["filter"]).strip() for c in reversed(config["filters"]) if c.get("type") == "PassThrough"), "")


def searched(events: DataFrame, start: int, end: int, query: str | None = None, namespace: str | None = None) -> DataFrame:
    """Events that begin or end in [start, end], both inclusive, or go on, and match the query."""
    when = F.col("ts").between(start, end) | F.col("end_ts").between(start, end) | F.col("ongoing")
    out = events.where(when)
    if namespace is not None:
        out = out.where(F.lower("namespace") == namespace.lower())
    return out.where(matches(query))


def top(events: DataFrame, size: int = 10) -> DataFrame:
    """The latest events; size 0 stands for 10, -1 for all."""
    ordered = events.orderBy(F.desc("ts"), F.desc("event_id"))
    return ordered if size < 0 else ordered.limit(size or 10)


def total_hits(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("hits"))


def grouped(events: DataFrame, key: str, fetch_last: bool = False) -> DataFrame:
    """Hits by the value of one dimension, and if wanted each group's latest event, as last."""
    columns = [F.count("*").alias("hits")]
    if fetch_last:
        columns.append(F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("last"))
    return events.groupBy(F.coalesce(F.col("dimensions")[key], F.lit(NO_GROUP)).alias("group")).agg(*columns)


def per_minute(events: DataFrame) -> DataFrame:
    return events.groupBy((F.col("ts") - F.col("ts") % 60).alias("minute")).agg(F.count("*").cast("double").alias("count"))


def event_id(namespace: Column, source: Column, dimensions: Column, ts: Column) -> Column:
    """The day of the event and a hash of what makes it."""
    sorted_dims = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dimensions))))
    what = F.concat_ws("|", F.coalesce(namespace, F.lit("")), F.coalesce(source, F.lit("")), F.coalesce(sorted_dims, F.lit("{}")), ts.cast("string"))
    return F.concat(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"), F.lit("_"), F.md5(what))


def updated(events: DataFrame, updates: DataFrame) -> DataFrame:
    """events after updates, which have the same columns, seq (their order) and upsert.

    Of an event that is there, CHANGEABLE fields that an update gives change; what later updates give wins. An update without its event adds one if it, or another to the same id, has upsert set;
    the first of them gives the other fields. One shuffle by event_id.
    """
    names = events.columns
    base = events.withColumns({"seq": F.lit(-1).cast("bigint"), "upsert": F.lit(True)})
    both = base.unionByName(updates.select(*names, F.col("seq").cast("bigint").alias("seq"), "upsert"))
    columns = []
    for c in names:
        if c in CHANGEABLE:
            columns.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c))
        elif c != "event_id":
            columns.append(F.min_by(c, "seq").alias(c))
    merged = both.groupBy("event_id").agg(*columns, F.bool_or("upsert").alias("known"))
    return merged.where("known").select(*names)


def updated_by_property(events: DataFrame, updates: DataFrame, name: str = "update_id") -> DataFrame:
    """updated() where updates say by a property, in any case of letters, which event they mean; those without the property mean an event_id.

    An update whose property several events have is skipped. If none has it, an update with upsert makes an event, with an id of its own; others are skipped.
    """
    key = F.lower(F.col("additional_props")[name])
    known = events.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.min("event_id").alias("_event"), F.count_distinct("event_id").alias("_n"))
    keyed = updates.withColumn("_key", key).join(known, "_key", "left")
    new = event_id(F.col("namespace"), F.col("source"), F.col("dimensions"), F.col("ts"))
    named = F.when(F.col("_key").isNull(), F.col("event_id")).when(F.col("_n") == 1, F.col("_event")).when(F.col("_n").isNull() & F.col("upsert"), new)
    resolved = keyed.withColumn("event_id", named).where(F.col("event_id").isNotNull()).drop("_key", "_event", "_n")
    return updated(events, resolved)


def with_children(events: DataFrame) -> DataFrame:
    """events with child_ids: the ids of the events that name each as a parent."""
    links = events.select(F.col("event_id").alias("child"), F.explode("parent_ids").alias("event_id"))
    children = links.groupBy("event_id").agg(F.array_sort(F.collect_set("child")).alias("child_ids"))
    return events.join(children, "event_id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))
