"""Column helpers for dates, clocks and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorebook.functions.text import normalized_game_id, null_if_empty

#: A season starts in this month.
SEASON_MONTH = 7
# The first three digits of a game id name the kind of season.
SEASON_TYPES = {"001": "Pre Season", "002": "Regular Season", "003": "All Star", "004": "Playoffs", "005": "Play-In", "006": "In-Season Tournament"}
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")


def timestamp_utc(c: Column) -> Column:
    """Timestamp of text in any of the known formats; null otherwise."""
    text = null_if_empty(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS], F.try_to_timestamp(text))


def parsed_date(c: Column) -> Column:
    text = null_if_empty(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS], F.try_to_timestamp(text).cast("date"))


def game_code_date(c: Column) -> Column:
    """Date of a game code 'YYYYMMDD/AWAYHOME'."""
    return F.try_to_timestamp(F.substring(c, 1, 8), F.lit("yyyyMMdd")).cast("date")


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO duration such as PT12M34.5S; null if it isn't one."""
    text = null_if_empty(c)
    pattern = r"^PT(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
    part = lambda i: F.coalesce(null_if_empty(F.regexp_extract(text, pattern, i)).try_cast("double"), F.lit(0.0))
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def duration_minutes(c: Column) -> Column:
    return F.bround(duration_seconds(c) / 60).cast("long")


def clock_seconds(c: Column) -> Column:
    """Seconds left on a game clock, given as an ISO duration or MM:SS."""
    parts = F.split(null_if_empty(c), ":")
    minutes = F.when(F.size(parts) == 2, parts[0].try_cast("double") * 60 + F.try_element_at(parts, F.lit(2)).try_cast("double"))
    return F.coalesce(duration_seconds(c), minutes)


def local_date(ts: Column, zone: Column) -> Column:
    """Date of a UTC timestamp in `zone`; the UTC date without one."""
    return F.to_date(F.coalesce(F.from_utc_timestamp(ts, zone), ts))


def season_start_year(day: Column) -> Column:
    return F.year(day) - F.when(F.month(day) >= SEASON_MONTH, 0).otherwise(1)


def season_label(start_year: Column) -> Column:
    """2024 -> 2024-25."""
    return F.format_string("%d-%02d", start_year, (start_year + 1) % 100)


def season_start_year_of_game(game_id: Column) -> Column:
    yy = F.substring(normalized_game_id(game_id), 4, 2).try_cast("int")
    return F.when(yy <= 50, yy + 2000).otherwise(yy + 1900)


def season_type_of_game(game_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SEASON_TYPES.items() for x in pair])
    return names[F.substring(normalized_game_id(game_id), 1, 3)]


def completed_years(birth: Column, at: Column) -> Column:
    """Age in completed years; someone born on 29 February has a birthday on 1 March in other years."""
    before = F.date_format(at, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(at) - F.year(birth) - F.when(before, 1).otherwise(0)


def bucket(day: Column, size: str) -> Column:
    """Label of the day, week (its Monday), month or season that `day` is in."""
    if size == "week":
        return F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")
    if size == "season":
        return season_label(season_start_year(day))
    return F.date_format(day, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[size])


def calendar(day: Column) -> list[Column]:
    """Attributes of a date for the date dimension."""
    return [
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("date_key"),
        F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"),
        F.weekofyear(day).alias("iso_week"), (F.weekday(day) + 1).alias("iso_weekday"),
        (F.weekday(day) >= 5).alias("is_weekend"), (F.dayofmonth(day) == 1).alias("is_month_start"),
        (F.last_day(day) == day).alias("is_month_end"), season_label(season_start_year(day)).alias("season_year"),
    ]
