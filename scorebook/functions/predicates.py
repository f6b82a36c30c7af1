"""Predicate trees and time filters as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.functions.text import like_pattern

COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not in": lambda c, v: ~c.isin(*v),
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: c.ilike(like_pattern(v)),
}
TEXT_OPERATIONS = {"=", "<>", "in", "not in", "contains"}


@dataclass(frozen=True)
class Leaf:
    """`field` is a column, or object.column or object@role.column of a linked object."""

    field: str
    op: str
    value: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Predicate = Leaf | And | Or | Not


def leaves(p: Predicate) -> list[Leaf]:
    if isinstance(p, Leaf):
        return [p]
    return [x for q in ((p.part,) if isinstance(p, Not) else p.parts) for x in leaves(q)]


def to_column(p: Predicate, column: Callable[[str], Column]) -> Column:
    """One boolean column of the tree; `column` resolves a leaf's field."""
    if isinstance(p, Leaf):
        if p.op not in COMPARISONS:
            raise ValueError(f"{p.op!r} is no comparison")
        return COMPARISONS[p.op](column(p.field), p.value)
    if isinstance(p, Not):
        return ~to_column(p.part, column)
    if not p.parts:
        raise ValueError("an empty And or Or")
    out = to_column(p.parts[0], column)
    for q in p.parts[1:]:
        out = out & to_column(q, column) if isinstance(p, And) else out | to_column(q, column)
    return out


def check_types(p: Predicate, kind: Callable[[str], T.DataType]) -> None:
    """Text fields take =, <>, in, not in and contains with non-empty text; numbers and dates don't take contains."""
    for leaf in leaves(p):
        text = isinstance(kind(leaf.field), T.StringType)
        if text and leaf.op not in TEXT_OPERATIONS or not text and leaf.op == "contains":
            raise ValueError(f"{leaf.op!r} doesn't fit {leaf.field}")
        values = leaf.value if isinstance(leaf.value, (list, tuple)) else [leaf.value]
        if not values or text and not all(isinstance(v, str) and v for v in values):
            raise ValueError(f"{leaf.field} needs text that isn't empty")


@dataclass(frozen=True)
class TimeScope:
    """Time filters of a query. Relative windows end at the latest date of the whole fact, whatever else is filtered."""

    last_n_days: int | None = None
    past_year: bool = False
    date_from: str | None = None
    date_to: str | None = None
    season: str | None = None
    season_type: str | None = None

    def __post_init__(self) -> None:
        if (self.last_n_days is not None) + self.past_year > 1:
            raise ValueError("one relative window at a time")
        if self.last_n_days is not None and self.last_n_days <= 0:
            raise ValueError("last_n_days must be positive")
        if self.season and not self.season_type:
            raise ValueError("a season needs a season type")
        for d in (self.date_from, self.date_to):
            if d:
                date.fromisoformat(d)

    @classmethod
    def named(cls, window: str, *dates: str) -> TimeScope:
        """all, last_month (30 days), past_year, since d, until d, between d e."""
        made = {"all": lambda: cls(), "last_month": lambda: cls(last_n_days=30), "past_year": lambda: cls(past_year=True), "since": lambda d: cls(date_from=d), "until": lambda d: cls(date_to=d), "between": lambda d, e: cls(date_from=d, date_to=e)}
        if window not in made:
            raise ValueError(f"{window!r} is no time window")
        return made[window](*dates)

    def conditions(self, day: Column, latest: Column | None, season: Column | None = None, season_type: Column | None = None) -> list[Column]:
        """`latest`: the anchor, needed for relative windows."""
        out = []
        if self.last_n_days is not None:
            out.append(day >= F.date_sub(latest.cast("date"), self.last_n_days))
        if self.past_year:
            out.append(day >= F.add_months(latest.cast("date"), -12))
        if self.date_from:
            out.append(day >= F.lit(date.fromisoformat(self.date_from)))
        if self.date_to:
            out.append(day <= F.lit(date.fromisoformat(self.date_to)))
        if self.season:
            out.append(season == self.season)
        if self.season_type:
            out.append(season_type == self.season_type)
        return out
