"""The query families: rank, aggregate, object rows, trend, compare and find, each a lazy DataFrame.

A query names a fact of the catalog, fields (column, object.column or object@role.column), metrics, a predicate on rows,
one on results and a time scope. Joins follow the catalog's links; each path is joined once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.dates import bucket as bucket_label
from scorebook.functions.predicates import Predicate, TimeScope, check_types, leaves, to_column
from scorebook.functions.text import normalized_name
from scorebook.plans.catalog import Catalog, MetricDef


class Rows:
    """The fact's rows with the linked objects that a query has asked for so far."""

    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame], fact: str):
        self.catalog, self.tables, self.fact = catalog, tables, fact
        self.df, self.joined = tables[fact], {}
        for name, template in catalog.objects[fact].derived.items():
            self.df = self.df.withColumn(name, F.expr(template.format_map(_Same())))

    def col(self, name: str, how: str = "inner") -> Column:
        """Column of a field; joins its path (inner: rows without a partner go) unless that has been done."""
        owner, _, column = name.rpartition(".")
        target, _, role = owner.partition("@")
        if not target or target == self.fact:
            return F.col(column)
        at = ""
        for link in self.catalog.path(self.fact, target, role or None):
            prefix = f"{at}{link.target}{'@' + link.role if link.role else ''}__"
            if prefix not in self.joined:
                dim = self.tables[link.target]
                for derived, template in self.catalog.objects[link.target].derived.items():
                    dim = dim.withColumn(derived, F.expr(template.format_map(_Same())))
                dim = dim.select([F.col(c).alias(prefix + c) for c in dim.columns])
                on = [F.col(f"`{at}{a}`") == F.col(f"`{prefix}{b}`") for a, b in link.keys]
                self.df, self.joined[prefix] = self.df.join(dim, on, how), how
            at = prefix
        return F.col(f"`{at}{column}`")

    def kind(self, name: str):
        return self.df.select(self.col(name).alias("x")).schema["x"].dataType

    def where(self, predicate: Predicate | None, time: TimeScope | None, season: str | None = None, season_type: str | None = None) -> None:
        """Row predicate and time filters, before any window."""
        conditions = []
        if predicate is not None:
            for leaf in leaves(predicate):
                self.col(leaf.field)
            check_types(predicate, self.kind)
            conditions.append(to_column(predicate, self.col))
        day = self.catalog.objects[self.fact].date
        if time is not None and time != TimeScope():
            latest = None
            if time.last_n_days is not None or time.past_year:
                anchor = self.tables[self.fact].agg(F.max(day).alias("_latest"))  # one row, of all the fact's rows
                self.df, latest = self.df.crossJoin(F.broadcast(anchor)), F.col("_latest")
            conditions += time.conditions(F.col(day) if day else None, latest, F.col(season) if season else None, F.col(season_type) if season_type else None)
        for c in conditions:
            self.df = self.df.where(c)

    def last_n(self, entity: Column, n: int) -> None:
        """The last n rows of each entity by date, among those that are left; the key breaks ties."""
        spec = self.catalog.objects[self.fact]
        order = Window.partitionBy(entity).orderBy(F.col(spec.date).desc(), *[F.col(k).desc() for k in spec.key])
        self.df = self.df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n)


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key


def _metrics(catalog: Catalog, names: Sequence[str | MetricDef]) -> list[MetricDef]:
    return [catalog.metrics[m] if isinstance(m, str) else m for m in names]


def _sorted(c: str, direction: str) -> Column:
    return F.col(c).asc_nulls_last() if direction == "asc" else F.col(c).desc_nulls_last()


def _having(df: DataFrame, predicate: Predicate | None, hidden: list[MetricDef]) -> DataFrame:
    if predicate is not None:
        df = df.where(to_column(predicate, F.col))
    return df.drop(*[m.name for m in hidden])


def _by_entity(rows: Rows, entity: str, metrics: list[MetricDef], groups: Sequence[str], context: str | None, display: dict[str, Column]) -> DataFrame:
    """One row per entity (and group): latest non-null name and context, display columns, metrics."""
    spec = rows.catalog.objects[entity.partition("@")[0]]
    fact = rows.catalog.objects[rows.fact]
    key = F.struct(*[rows.col(f"{entity}.{k}") for k in spec.key]) if len(spec.key) > 1 else rows.col(f"{entity}.{spec.key[0]}")
    name = rows.col(f"{entity}.{spec.display}")
    shown = rows.col(context, "left") if context else F.lit(None).cast("string")
    order = F.col(fact.date) if fact.date else F.lit(1)
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(order, *[F.col(k) for k in fact.key])))
    groups = {g.rpartition(".")[2]: rows.col(g) for g in groups}
    return rows.df.groupBy(key.alias("entity_id"), *[c.alias(g) for g, c in groups.items()]).agg(
        latest(name).alias("entity_name"), latest(shown).alias("context_value"), *[c.alias(n) for n, c in display.items()], *[m.column().alias(m.name) for m in metrics]
    )


def rank(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, entity: str, metrics: Sequence[str | MetricDef], *, where: Predicate | None = None, time: TimeScope | None = None,
    last_n: int | None = None, groups: Sequence[str] = (), context: str | None = None, having: Predicate | None = None, hidden: Sequence[str | MetricDef] = (),
    display: dict[str, Column] | None = None, order: str | None = None, limit: int = 10,
) -> DataFrame:
    """Top entities by the first metric: filter, join, last n rows of each, aggregate, filter results, order, limit.

    `hidden` metrics are computed for `having` only. Only the `limit` best rows are numbered, so nothing is gathered.
    """
    rows, shown, extra = Rows(catalog, tables, fact), _metrics(catalog, metrics), _metrics(catalog, hidden)
    spec = catalog.objects[entity.partition("@")[0]]
    rows.col(f"{entity}.{spec.key[0]}")
    rows.where(where, time)
    if last_n:
        rows.last_n(rows.col(f"{entity}.{spec.key[0]}"), last_n)
    out = _having(_by_entity(rows, entity, [*shown, *extra], groups, context, display or {}), having, extra)
    return numbered(out, shown[0], order, limit)


def numbered(df: DataFrame, metric: MetricDef, order: str | None, limit: int, name: str = "entity_name") -> DataFrame:
    """The first rows by metric, then name, with their rank in front."""
    by = [_sorted(metric.name, metric.direction(order)), F.col(name).asc_nulls_last()]
    top = df.orderBy(*by).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*by)).alias("rank"), *df.columns).orderBy("rank")


def season_rank(catalog: Catalog, tables: dict[str, DataFrame], table: str, entity: str, metric: str | MetricDef, *, where: Predicate | None = None, order: str | None = None, limit: int = 10, columns: Sequence[str] = ()) -> DataFrame:
    """Top rows of an aggregated table; rows without the metric are left out."""
    m, rows = _metrics(catalog, [metric])[0], Rows(catalog, tables, table)
    spec = catalog.objects[entity]
    name = rows.col(f"{entity}.{spec.display}")
    rows.where(where, None)
    value = F.expr(m.expr)
    out = rows.df.where(value.isNotNull()).select(name.alias("entity_name"), *columns, value.alias(m.name))
    return numbered(out, m, order, limit)


def aggregate(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, groups: Sequence[str], metrics: Sequence[str | MetricDef], *, where: Predicate | None = None, time: TimeScope | None = None,
    last_n: int | None = None, per: str | None = None, having: Predicate | None = None, not_null: bool = False,
) -> DataFrame:
    """Metrics per group, in the order of the groups. `per`: the field whose last n rows count; `not_null`: drop results without the first metric."""
    rows, shown = Rows(catalog, tables, fact), _metrics(catalog, metrics)
    keys = {g.rpartition(".")[2]: rows.col(g) for g in groups}
    rows.where(where, time)
    if last_n:
        rows.last_n(rows.col(per or groups[0]), last_n)
    out = rows.df.groupBy(*[c.alias(g) for g, c in keys.items()]).agg(*[m.column().alias(m.name) for m in shown])
    out = _having(out, having, [])
    if not_null:
        out = out.where(F.col(shown[0].name).isNotNull())
    return out.orderBy(*[F.col(g).asc_nulls_last() for g in keys])


def object_rows(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, entity: str, metrics: Sequence[str | MetricDef], *, where: Predicate | None = None, time: TimeScope | None = None,
    last_n: int | None = None, context: str | None = None, having: Predicate | None = None, order: str | None = None, limit: int | None = None,
) -> DataFrame:
    """One row per entity with its metrics, by the first metric and then name."""
    rows, shown = Rows(catalog, tables, fact), _metrics(catalog, metrics)
    spec = catalog.objects[entity.partition("@")[0]]
    rows.col(f"{entity}.{spec.key[0]}")
    rows.where(where, time)
    if last_n:
        rows.last_n(rows.col(f"{entity}.{spec.key[0]}"), last_n)
    out = _having(_by_entity(rows, entity, shown, (), context, {}), having, [])
    out = out.orderBy(_sorted(shown[0].name, shown[0].direction(order)), F.col("entity_name").asc_nulls_last())
    return out.limit(limit) if limit else out


def season_object_rows(catalog: Catalog, tables: dict[str, DataFrame], table: str, entity: str, metrics: Sequence[str | MetricDef], *, where: Predicate | None = None, order: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of an aggregated table with their metrics; rows without a metric stay, last."""
    shown, rows = _metrics(catalog, metrics), Rows(catalog, tables, table)
    spec = catalog.objects[entity]
    name, key = rows.col(f"{entity}.{spec.display}"), rows.col(f"{entity}.{spec.key[0]}")
    rows.where(where, None)
    out = rows.df.select(key.alias("entity_id"), name.alias("entity_name"), *columns, *[F.expr(m.expr).alias(m.name) for m in shown])
    return out.orderBy(_sorted(shown[0].name, shown[0].direction(order)), F.col("entity_name").asc_nulls_last())


def trend(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, size: str, metrics: Sequence[str | MetricDef], *, series: Sequence[str] = (), where: Predicate | None = None,
    time: TimeScope | None = None, having: Predicate | None = None,
) -> DataFrame:
    """Metrics per time bucket (day, week, month, year, season) and series, in that order."""
    rows, shown = Rows(catalog, tables, fact), _metrics(catalog, metrics)
    keys = {s.rpartition(".")[2]: rows.col(s) for s in series}
    rows.where(where, time)
    label = bucket_label(F.col(catalog.objects[fact].date), size)
    out = rows.df.groupBy(label.alias("bucket"), *[c.alias(k) for k, c in keys.items()]).agg(*[m.column().alias(m.name) for m in shown])
    return _having(out, having, []).orderBy("bucket", *[F.col(k).asc_nulls_last() for k in keys])


def compare_rows(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, entity: str, ids: Sequence, *, where: Predicate | None = None, time: TimeScope | None = None, last_n: int | None = None,
    size: str | None = None, groups: Sequence[str] = (),
) -> DataFrame:
    """The fact rows of at least two chosen entities, with entity_id, entity_name and, if asked for, bucket and groups."""
    if len(set(ids)) < 2:
        raise ValueError("a comparison needs two entities")
    rows, spec = Rows(catalog, tables, fact), catalog.objects[entity]
    key, name = rows.col(f"{entity}.{spec.key[0]}"), rows.col(f"{entity}.{spec.display}")
    rows.df = rows.df.where(key.isin(*ids))
    keys = {g.rpartition(".")[2]: rows.col(g) for g in groups}
    rows.where(where, time)
    if last_n:
        rows.last_n(key, last_n)
    day = catalog.objects[fact].date
    extra = {"bucket": bucket_label(F.col(day), size)} if size else {}
    return rows.df.withColumns({"entity_id": key, "entity_name": name} | extra | {f"group_{g}": c for g, c in keys.items()})


def compare_summary(rows: DataFrame, metrics: Sequence[MetricDef]) -> DataFrame:
    """Per entity: games, metrics, and for the first metric who leads and by how much (1 decimal); the smallest id wins ties."""
    out = rows.groupBy("entity_id").agg(F.max("entity_name").alias("entity_name"), F.count(F.lit(1)).alias("games"), *[F.coalesce(m.column(), F.lit(0.0) if m.agg == "avg" else m.column()).alias(m.name) for m in metrics])
    m = metrics[0]
    order = Window.orderBy(_sorted(m.name, m.direction()), "entity_id")  # over the few entities compared
    place, gap = F.row_number().over(order), F.round(F.abs(F.col(m.name) - F.lead(m.name).over(order)), 1)
    return out.select("*", place.alias("place"), (place == 1).alias("is_leader"), gap.alias("gap_to_next")).orderBy("place")


def compare_breakdown(rows: DataFrame, metrics: Sequence[MetricDef], groups: Sequence[str] = ()) -> DataFrame:
    """Metrics and games per bucket, entity and groups."""
    keys = [c for c in ("bucket", "entity_id", "entity_name", *[f"group_{g}" for g in groups]) if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), *[m.column().alias(m.name) for m in metrics]).orderBy(*keys)


def find(
    catalog: Catalog, tables: dict[str, DataFrame], fact: str, fields: Sequence[str], *, where: Predicate | None = None, time: TimeScope | None = None, last_n: int | None = None,
    order: Sequence[tuple[str, str]] = (), limit: int | None = None,
) -> DataFrame:
    """Distinct values of `fields` (and of the predicate's fields) among the matching rows.

    Needs a predicate or a bounded window. An order field that isn't shown is carried through the distinct as its
    maximum. `last_n` takes the latest rows of the whole fact by a bounded sort, not by a window over everything.
    """
    if where is None and not last_n and (time is None or time == TimeScope()):
        raise ValueError("find needs a predicate or a bounded window")
    rows, spec = Rows(catalog, tables, fact), catalog.objects[fact]
    wanted = list(dict.fromkeys([*fields, *[x.field for x in (leaves(where) if where is not None else ())]]))
    shown = {f.replace(".", "_").replace("@", "_"): rows.col(f) for f in wanted}
    ordered = {f"_order{i}": rows.col(f) for i, (f, _) in enumerate(order)}
    rows.where(where, time)
    df = rows.df
    if last_n:
        df = df.orderBy(F.col(spec.date).desc(), *[F.col(k).desc() for k in spec.key]).limit(last_n)
    out = df.groupBy(*[c.alias(n) for n, c in shown.items()]).agg(*[F.max(c).alias(n) for n, c in ordered.items()]) if ordered else df.select(*[c.alias(n) for n, c in shown.items()]).distinct()
    by = [_sorted(f"_order{i}", direction) for i, (_, direction) in enumerate(order)]
    out = out.orderBy(*by, *[F.col(c).asc_nulls_last() for c in shown])
    return (out.limit(limit) if limit else out).select(*shown)


def resolve_entities(names: DataFrame, dim: DataFrame, key: str, name_col: str, wanted_col: str = "wanted") -> DataFrame:
    """(wanted, status, id): exact name ignoring case, else a single word of exactly one name; else ambiguous or missing."""
    wanted = names.select(F.col(wanted_col).alias("wanted")).distinct()
    people = dim.select(F.col(key).alias("id"), F.col(name_col).alias("name"))
    exact = wanted.join(people, F.lower("wanted") == F.lower("name")).groupBy("wanted").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    words = people.select("id", F.explode(F.split(normalized_name(F.col("name")), " ")).alias("word")).distinct()
    left = wanted.join(exact.select("wanted"), "wanted", "left_anti")
    token = left.join(words, normalized_name(F.col("wanted")) == F.col("word")).groupBy("wanted").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    found = exact.unionByName(token)
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return wanted.join(found, "wanted", "left").select("wanted", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))

