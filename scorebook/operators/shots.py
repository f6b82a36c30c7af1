"""Shot facts of players' games: two bucket schemes, shot types, and the reporting view of the types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.text import null_if_empty

# Labels and column prefixes of the buckets, in order.
STANDARD = {
    "shot_type": {"AtRim": "at_rim", "ShortMidRange": "short_mid_range", "LongMidRange": "long_mid_range", "Corner3": "corner_3", "Arc3": "arc_3", "UnknownDistance2pt": "unknown_distance_2pt"},
}
SOURCE = {
    "area": {
        "Restricted Area": "restricted_area", "In The Paint (Non-RA)": "paint_non_restricted_area", "Mid-Range": "mid_range",
        "Left Corner 3": "left_corner_3", "Right Corner 3": "right_corner_3", "Above the Break 3": "above_the_break_3",
    },
    "area_detail": {
        "0-8 Center": "center_0_8", "8-16 Left": "left_8_16", "8-16 Center": "center_8_16", "8-16 Right": "right_8_16",
        "16-24 Left": "left_16_24", "16-24 Left Center": "left_center_16_24", "16-24 Center": "center_16_24",
        "16-24 Right Center": "right_center_16_24", "16-24 Right": "right_16_24", "24+ Left": "left_24_plus",
        "24+ Left Center": "left_center_24_plus", "24+ Center": "center_24_plus", "24+ Right Center": "right_center_24_plus", "24+ Right": "right_24_plus",
    },
}
#: Prefixes of what has no bucket; the standard scheme doesn't count it.
UNMAPPED = {"area": "unmapped_source_area", "area_detail": "unmapped_source_area_detail"}
KEYS = ["game_id", "person_id"]


def counts(made: Column, value: Column) -> dict[str, Column]:
    """Totals of field goals, over rows that all are attempts."""
    n = lambda x, v=F.lit(1): F.sum(F.when(F.coalesce(x, F.lit(False)), v).otherwise(0)).cast("long")
    return {
        "field_goals_attempted": F.count(F.lit(1)), "field_goals_made": n(made), "three_pointers_attempted": n(value == 3), "three_pointers_made": n(made & (value == 3)),
        "points_from_field_goals": n(made, F.coalesce(value, F.lit(0))),
    }


def attempts(shots: DataFrame) -> DataFrame:
    """Field goals of known players."""
    return shots.where("game_id is not null and person_id > 0 and is_field_goal")


def with_opponent(rows: DataFrame, teams: DataFrame) -> DataFrame:
    return rows.join(teams.select("game_id", "team_id", "opponent_team_id"), ["game_id", "team_id"], "left")


def shot_profiles(players: DataFrame, teams: DataFrame, shots: DataFrame, scheme: dict[str, dict[str, str]]) -> DataFrame:
    """One row for each player who played, with attempts and makes per bucket of the scheme (0 without shots).

    players: game_id, person_id, team_id, did_play and whatever is carried; teams: game_id, team_id, opponent_team_id;
    shots: game_id, person_id, is_field_goal, is_made, shot_value and the scheme's label columns.
    """
    made = F.coalesce(F.col("is_made"), F.lit(False))
    sums = counts(made, F.col("shot_value"))
    for label, buckets in scheme.items():
        known = F.coalesce(F.col(label).isin(*buckets), F.lit(False))
        tests = {p: F.coalesce(F.col(label) == x, F.lit(False)) for x, p in buckets.items()}
        if label in UNMAPPED:
            tests[UNMAPPED[label]] = ~known
        for p, test in tests.items():
            sums[f"{p}_field_goals_attempted"] = F.count_if(test)
            sums[f"{p}_field_goals_made"] = F.count_if(test & made)
    stats = attempts(shots).groupBy(*KEYS).agg(*[x.alias(n) for n, x in sums.items()])
    base = with_opponent(players.where("did_play = 1 and game_id is not null and person_id is not null").drop("did_play"), teams)
    return base.join(stats, KEYS, "left").select(*base.columns, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in sums])


def unknown_labels(shots: DataFrame, scheme: dict[str, dict[str, str]]) -> DataFrame:
    """(column, label, n): labels of attempts that no bucket has."""
    rows = attempts(shots).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label"), F.col(c).isin(*b).alias("known")) for c, b in scheme.items()])).alias("x")).select("x.*")
    return rows.where("label <> '' and not known").groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))


def type_family(sub_type: Column) -> Column:
    """The coarse family of a shot's sub-type."""
    plain = F.regexp_replace(F.lower(F.trim(sub_type)), "[^a-z0-9]+", "")
    return F.when(plain.isin("dunk", "hook", "layup"), F.initcap(plain)).when(plain.isin("jumpshot", "shot"), "Jump Shot").otherwise(F.initcap(sub_type))


def shot_types(players: DataFrame, teams: DataFrame, shots: DataFrame) -> DataFrame:
    """Totals per game, player and shot type (action, sub-type, descriptor and value) of players with a fact row."""
    token = lambda c: null_if_empty(F.regexp_replace(F.trim(F.col(c)), r"\s+", " "))
    rows = attempts(shots).withColumns({c: token(c) for c in ("action_type", "sub_type", "descriptor")}).where("action_type is not null and sub_type is not null and shot_value in (2, 3)")
    made = F.coalesce(F.col("is_made"), F.lit(False))
    by = ["action_type", "sub_type", "descriptor", "shot_value"]
    stats = rows.groupBy(*KEYS, *by).agg(*[x.alias(n) for n, x in counts(made, F.col("shot_value")).items()])
    family = type_family(F.col("sub_type"))
    base = F.when(family.endswith("Shot"), family).otherwise(F.concat(family, F.lit(" Shot")))
    label = F.concat_ws(" ", F.concat(F.col("shot_value").cast("string"), F.lit("PT")), F.initcap("descriptor"), base)
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    context = with_opponent(players.drop("did_play"), teams)
    out = context.join(stats, KEYS).withColumns({"source_shot_type_key": key, "source_shot_type_label": label, "source_shot_type_family": family})
    return out.withColumns({"is_two_point_shot": (F.col("shot_value") == 2).cast("int"), "is_three_point_shot": (F.col("shot_value") == 3).cast("int")})


def shot_type_view(types: DataFrame, games: DataFrame, people: DataFrame) -> DataFrame:
    """Shot types with names and the labels of team and opponent by side.

    games: game_id, home_team_id, home_team_abbreviation, away_team_abbreviation; people: person_id, display_name,
    player_name, is_current. Games without a row go.
    """
    home = F.coalesce(F.col("home_team_id") == F.col("team_id"), F.lit(False))
    label = lambda yes, no: F.when(home, F.col(f"{yes}_team_abbreviation")).otherwise(F.col(f"{no}_team_abbreviation"))
    names = people.where("coalesce(is_current, 0) = 1").select("person_id", F.coalesce("display_name", "player_name").alias("_name"))
    j = types.join(games, "game_id").join(names, "person_id", "left")
    return j.select(
        F.col("person_id").alias("player_id"), F.coalesce("_name", F.lit("")).alias("player_name"), "game_id", "team_id", label("home", "away").alias("team"), "opponent_team_id", label("away", "home").alias("opponent"),
        F.when(home, "Home").otherwise("Away").alias("home_away"), F.col("source_shot_type_key").alias("shot_type_key"), F.col("source_shot_type_label").alias("shot_type"), F.col("source_shot_type_family").alias("shot_family"),
        "action_type", "sub_type", "descriptor", "shot_value", "is_two_point_shot", "is_three_point_shot", "field_goals_attempted", "field_goals_made", "three_pointers_attempted", "three_pointers_made", "points_from_field_goals",
    )
