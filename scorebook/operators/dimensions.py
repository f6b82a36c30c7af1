"""Slowly changing dimensions, facts and season tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.dates import calendar, completed_years
from scorebook.functions.sport import half_even_ratio, percent, ratio
from scorebook.functions.text import null_if_empty
from scorebook.operators.relational import as_of, best_row, opponents, primary_team
from scorebook.sources.stored import parts


def versions(events: DataFrame, entity: str, tracked: Sequence[str], time: str, *, carry: Sequence[str] = (), order: Sequence[str] = (), day: str | None = None, source: str | None = None) -> DataFrame:
    """Type-2 versions: a new one whenever the tracked state changes.

    Columns in `carry` keep their last value through nulls. Events sort by `order` (else by time), nulls last. A version
    starts at its first non-null time and ends 1 microsecond before the next event's time (at it, if that isn't later).
    first_seen and last_seen come from `day`. Rows without an entity are left out.
    """
    by = [F.col(c).asc_nulls_last() for c in (order or [time])]
    w = Window.partitionBy(entity).orderBy(*by)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = [(F.last(c, ignorenulls=True).over(upto) if c in carry else F.col(c)).alias(c) for c in tracked]
    seen = Window.partitionBy(entity)
    extra = [F.min(day).over(seen).alias("first_seen"), F.max(day).over(seen).alias("last_seen")] if day else []
    df = events.where(F.col(entity).isNotNull()).select(entity, F.col(time).alias("_t"), F.row_number().over(w).alias("_nth"), *state, *extra)
    nth = Window.partitionBy(entity).orderBy("_nth")
    changed = F.col("_nth") == 1
    for c in tracked:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(nth))
    df = df.withColumn("_v", F.sum(changed.cast("int")).over(nth.rowsBetween(Window.unboundedPreceding, 0)))
    keep = [*tracked, *(("first_seen", "last_seen") if day else ())]
    # the first event's time opens a version; if that is null, the first later time of the same state does
    one = df.groupBy(entity, "_v").agg(*[F.first(c).alias(c) for c in keep], F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_nth"))).alias("valid_from_utc"), F.min_by("_t", "_nth").alias("_opened"))
    following = Window.partitionBy(entity).orderBy("_v")
    start, nxt = F.col("valid_from_utc"), F.lead("_opened").over(following)
    end = F.when(nxt.isNotNull() & start.isNotNull(), F.when(nxt > start, nxt - F.expr("INTERVAL 0.000001 SECOND")).otherwise(nxt))
    last = F.lead("_v").over(following).isNull()
    out = one.withColumns({"valid_to_utc": end, "is_current": last.cast("int"), "record_source": F.lit(source)})
    return out.withColumnRenamed("_v", "version").drop("_opened")


BIO = ("first_name", "family_name", "birth_date", "school", "country", "height_inches", "weight_lbs", "draft_year", "draft_round", "draft_number")
TRACKED = ("player_name", "first_name", "family_name", "display_name", "primary_position", "latest_team_id", "latest_nba_team_id")


def player_bios(bios: DataFrame, links: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """(person_id, BIO): each person's most filled bio; a missing birth date comes from the linked profile.

    links: external_id, person_id, confidence; profiles: external_id, birth_date. Of several linked profiles with a birth
    date the most confident counts (no confidence is least; ties: the lowest id). A person without a bio who has such a
    profile gets a row with the birth date alone.
    """
    best = best_row(bios.where("person_id > 0").select("person_id", *BIO), ["person_id"], ties=[F.col(c).asc_nulls_last() for c in BIO])
    if links is None or profiles is None:
        return best
    dated = profiles.where("external_id is not null and birth_date is not null").groupBy("external_id").agg(F.max("birth_date").alias("_born"))
    known = links.where("person_id > 0 and external_id is not null").join(dated, "external_id")
    order = Window.partitionBy("person_id").orderBy(F.col("confidence").desc_nulls_last(), "external_id")
    late = known.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("person_id", "_born")
    out = best.join(late, "person_id", "full_outer")
    return out.withColumn("birth_date", F.coalesce("birth_date", "_born")).select("person_id", *BIO)


def player_events(players: DataFrame, games: DataFrame, bios: DataFrame, teams: DataFrame) -> DataFrame:
    """One event per person and game, the most filled: names, position, team and time of what tracks a player.

    players: person_id, game_id, player_name, first_name, family_name, primary_position, team_id; games: game_id,
    game_time_utc; teams: team_id of the league's current teams. Names that a row lacks come from the bio. Rows are dealt
    by game, then by person, into parts that grow in number.
    """
    names = bios.select("person_id", F.col("first_name").alias("_first"), F.col("family_name").alias("_family"))
    rows = players.where("person_id > 0 and game_id is not null")
    n = parts(rows)
    rows = rows.repartition(n, "game_id").join(games.select("game_id", "game_time_utc"), "game_id", "left").repartition(n, "person_id").join(names, "person_id", "left")
    rows = rows.join(teams.select(F.col("team_id").alias("_league")).distinct(), F.col("team_id") == F.col("_league"), "left")
    first, family = F.coalesce(null_if_empty(F.col("first_name")), "_first"), F.coalesce(null_if_empty(F.col("family_name")), "_family")
    rows = rows.select("person_id", "game_id", "game_time_utc", F.to_date("game_time_utc").alias("game_date"), null_if_empty(F.col("player_name")).alias("player_name"), first.alias("first_name"), family.alias("family_name"), null_if_empty(F.col("primary_position")).alias("primary_position"), F.when(F.col("team_id") > 0, F.col("team_id")).cast("long").alias("latest_team_id"), F.col("_league").cast("long").alias("latest_nba_team_id"))
    full = F.concat_ws(" ", "first_name", "family_name")
    rows = rows.withColumn("display_name", F.when(full != "", full).otherwise(F.col("player_name")))
    return best_row(rows, ["person_id", "game_id"], ties=[F.col(c).asc_nulls_last() for c in rows.columns])


def player_versions(players: DataFrame, games: DataFrame, bios: DataFrame, teams: DataFrame, links: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Type-2 versions of players from box scores and bios; what doesn't depend on a game is filled over all of them.

    Position and teams carry forward through games that don't name them. A birth date that arrives late, from a bio or
    from a linked profile, goes back to every version of its person.
    """
    people = player_bios(bios, links, profiles)
    events = player_events(players, games, people, teams)
    out = versions(events, "person_id", TRACKED, "game_time_utc", carry=("primary_position", "latest_team_id", "latest_nba_team_id"), order=["game_time_utc", "game_id"], day="game_date", source="box_score")
    return out.join(people.drop("first_name", "family_name"), "person_id", "left")


def date_dimension(sources: Sequence[Column | tuple[DataFrame, str]], weeks: DataFrame | None = None) -> DataFrame:
    """Distinct dates of (table, column) sources with calendar attributes; `weeks` (day, ...) is joined if given."""
    days = None
    for df, column in sources:
        part = df.select(F.to_date(column).alias("day")).where("day is not null").distinct()
        days = part if days is None else days.union(part)
    out = days.distinct().select("day", *calendar(F.col("day")))
    return out.join(weeks, "day", "left") if weeks is not None else out


def first_known(choices: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source): the first non-null choice and its name."""
    value = F.coalesce(*[c for _, c in choices])
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choices])
    return value, source


def must_be_empty(df: DataFrame, what: str) -> None:
    """Raise if an audit finds rows; names the first few."""
    found = df.limit(5).collect()  # five rows at most
    if found:
        raise ValueError(f"{what}: {found}")


def sides(df: DataFrame, game: str, team: str, side: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per game with home_ and away_ columns."""
    pick = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{s}_{c}")
    return df.groupBy(game).agg(*[pick(s, c) for s in ("home", "away") for c in (team, *carry)])


def team_game_facts(df: DataFrame, game: str, team: str, points: str, side: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Team rows with their opponent, result (win, loss, tie) and point differential."""
    out = opponents(df, game, team, side, [points, *carry])
    diff = F.col(points) - F.col(f"opponent_{points}")
    return out.withColumns({"point_differential": diff, "result": F.when(diff > 0, "win").when(diff < 0, "loss").when(diff == 0, "tie")})


def fact_with_keys(facts: DataFrame, dims: Sequence[tuple[DataFrame, str, str, str, str]], event_time: str, row_id: Sequence[str]) -> DataFrame:
    """Best row per `row_id`, with the version keys of each (dim, fact id, dim id, key, output)."""
    out = best_row(facts, row_id)
    for dim, fact_id, dim_id, key, name in dims:
        out = as_of(out, dim, fact_id, dim_id, event_time, key, name, row_id)
    return out


def season_totals(games: DataFrame, keys: Sequence[str], totals: Sequence[str], played: Column, team: str | None = None, game: str | None = None) -> DataFrame:
    """Games played, <column>_total (null counts as 0), and the primary team, per season key; rows with a null key go."""
    rows = games.dropna(subset=list(keys))
    agg = [F.sum(played.cast("int")).alias("games_played"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_total") for c in totals]]
    if game:
        agg.append(F.count_distinct(game).alias("games_on_roster"))
    out = rows.groupBy(*keys).agg(*agg)
    return out.join(primary_team(rows, keys, team, played), list(keys), "left") if team else out


def season_rates(season: DataFrame, per_game: Sequence[str] = (), shares: dict[str, tuple[Column, Column]] | None = None, ratios: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Add <x>_per_game (exact ties to even), percentages and plain ratios."""
    add = {f"{c}_per_game": half_even_ratio(F.col(f"{c}_total"), F.col("games_played"), 1) for c in per_game}
    add |= {n: percent(a, b) for n, (a, b) in (shares or {}).items()}
    add |= {n: ratio(a, b) for n, (a, b) in (ratios or {}).items()}
    return season.withColumns(add) if add else season


def current_profile(events: DataFrame, entity: str, time: str, columns: Sequence[str], season: str) -> DataFrame:
    """Latest non-null value of each column, first and last season, per entity."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns]
    return events.groupBy(entity).agg(*latest, F.min(season).alias("first_season"), F.max(season).alias("last_season"))


def with_age(df: DataFrame, birth: str, season_start: str, name: str = "age") -> DataFrame:
    """Completed years on 31 January after the season's start."""
    return df.withColumn(name, completed_years(F.col(birth), F.make_date(F.col(season_start) + 1, F.lit(1), F.lit(31))))


def provenance(rows: DataFrame, keys: Sequence[str], method: str, methods: Sequence[str]) -> DataFrame:
    """Rows per method, coverage in percent, and the dominant method (first in the list if tied) per key."""
    n = {m: F.sum(F.when(F.col(method) == m, 1).otherwise(0)) for m in methods}
    out = rows.groupBy(*keys).agg(*[c.alias(f"rows_{m}") for m, c in n.items()], F.count(F.lit(1)).alias("rows"))
    most = F.greatest(*[F.col(f"rows_{m}") for m in methods])
    first = F.coalesce(*[F.when((F.col(f"rows_{m}") == most) & (most > 0), m) for m in methods])
    covered = sum((F.col(f"rows_{m}") for m in methods), F.lit(0))
    return out.withColumns({"coverage_percent": percent(covered, F.col("rows")), "dominant_method": first})


def bridge(df: DataFrame, links: DataFrame, external: str, person: str, confidence: str) -> DataFrame:
    """Rows joined to the most confident person of their external id."""
    order = Window.partitionBy(external).orderBy(F.col(confidence).desc(), F.col(person))
    best = links.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(external, person)
    return df.join(best, external)


def award_history(awards: DataFrame, links: DataFrame, league: str = "NBA") -> DataFrame:
    """Distinct (person_id, award_type, season_year, team_tier) of a league's awards whose external id has a person.

    awards: external_id, league_code, award_family, season_label, team_tier; links: external_id, person_id, confidence.
    A tier that isn't positive is null.
    """
    rows = bridge(awards.where(F.col("league_code") == league), links.where("external_id is not null and person_id is not null"), "external_id", "person_id", "confidence")
    tier = F.col("team_tier").try_cast("long")
    return rows.select("person_id", null_if_empty(F.col("award_family")).alias("award_type"), null_if_empty(F.col("season_label")).alias("season_year"), F.when(tier > 0, tier).alias("team_tier")).distinct()
