"""Ratios, rounding and basketball formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a free-throw attempt in possessions (fixed value of the formulas).
FT_WEIGHT = 0.44


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines on doubles do: the product with 10^digits to the next whole number, halves up.

    Spark's own round takes the shortest decimal form for the exact value, so near ties it differs from them both ways.
    """
    scale = float(10**digits)
    return F.round(x.cast("double") * scale) / scale


def percent(a: Column, b: Column, digits: int = 1) -> Column:
    return rounded(100 * ratio(a, b), digits)


def half_even_ratio(a: Column, b: Column, digits: int) -> Column:
    """a / b of whole numbers, rounded with exact ties to the even digit; null unless b > 0."""
    scale = 10**digits
    scaled = F.coalesce(a, F.lit(0)).cast("long") * scale
    low = F.floor(F.try_divide(scaled.cast("double"), b))
    tie = F.try_mod(scaled, b) * 2 == b
    even = F.when(low % 2 == 0, low).otherwise(low + 1) / F.lit(float(scale))
    return F.when(b > 0, F.when(tie, even).otherwise(F.round(ratio(F.coalesce(a, F.lit(0)), b), digits)))


def per_game(total: Column, games: Column) -> Column:
    return half_even_ratio(total, games, 1)


def possessions_estimate(fga, fta, oreb, tov, opp_fga, opp_fta, opp_oreb, opp_tov) -> Column:
    """Mean of both teams' FGA + 0.44 FTA - OREB + TOV."""
    own = lambda a, f, o, t: a + FT_WEIGHT * f - o + t
    return 0.5 * (own(fga, fta, oreb, tov) + own(opp_fga, opp_fta, opp_oreb, opp_tov))


def pace(possessions: Column, minutes: Column, per: int = 48) -> Column:
    return ratio(per * possessions, minutes)


def rating(points: Column, possessions: Column) -> Column:
    return ratio(100 * points, possessions)


def net_rating(points_for, points_against, own_possessions, other_possessions) -> Column:
    return rating(points_for, own_possessions) - rating(points_against, other_possessions)


def effective_fg(fgm, fg3m, fga) -> Column:
    return ratio(fgm + 0.5 * fg3m, fga)


def true_shooting(points, fga, fta) -> Column:
    return ratio(points, 2 * (fga + FT_WEIGHT * fta))


def usage(used, possessions, fga, fta, tov, minutes, team_fga, team_fta, team_tov, team_minutes) -> Column:
    """Share of possessions used: counted if plausible (0 to 100 %), else from the box score."""
    counted = percent(used, possessions)
    plays = (fga + FT_WEIGHT * fta + tov) * (team_minutes / 5)
    proxy = rounded(100 * ratio(plays, minutes * (team_fga + FT_WEIGHT * team_fta + team_tov)), 1)
    return F.coalesce(F.when(counted.between(0, 100), counted), proxy)


def assist_ratio(ast, fga, fta, tov) -> Column:
    return 100 * ratio(ast, fga + FT_WEIGHT * fta + ast + tov)


def turnover_ratio(ast, fga, fta, tov) -> Column:
    return 100 * ratio(tov, fga + FT_WEIGHT * fta + ast + tov)


def impact_terms(pts, fgm, ftm, fga, fta, dreb, oreb, ast, stl, blk, pf, tov) -> Column:
    """The linear form of the player impact estimate; a player's share of the game's sum is the estimate."""
    return pts + fgm + ftm - fga - fta + dreb + 0.5 * oreb + ast + stl + 0.5 * blk - pf - tov


def per_minutes(total: Column, seconds: Column, minutes: int = 36) -> Column:
    """Total per `minutes` minutes played."""
    return ratio(total * (minutes * 60), seconds)


def is_three(action_type: Column, shot_value: Column, distance: Column) -> Column:
    tests = (shot_value == 3, F.lower(F.trim(action_type)) == "3pt", distance >= 22.0)
    return F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)) | F.coalesce(tests[2], F.lit(False))


def shot_zone(x: Column, y: Column, distance: Column, three: Column) -> Column:
    """Zone of a shot by legacy coordinates in tenths of a foot; null without them."""
    feet_x, feet_y = x / 10.0, y / 10.0
    far = F.coalesce(distance, F.sqrt(feet_x * feet_x + feet_y * feet_y))
    corner = (F.abs(feet_x) >= 22.0) & (feet_y <= 9.0)
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.when(far <= 4.3, "Restricted Area")
        .when((F.abs(feet_x) <= 8.0) & (feet_y <= 13.75), "In The Paint (Non-RA)")
        .when(three & corner, F.when(feet_x < 0, "Left Corner 3").otherwise("Right Corner 3"))
        .when(three, "Above the Break 3")
        .otherwise("Mid-Range"),
    )


def shot_range(distance: Column, x: Column) -> Column:
    """Distance band of a shot with its side."""
    feet = x / 10.0
    side = F.when(feet < -8, "Left").when(feet > 8, "Right").otherwise("Center")
    return F.when(distance < 8, "0-8 Center").when(distance < 16, F.concat(F.lit("8-16 "), side)).when(distance < 24, F.concat(F.lit("16-24 "), side)).when(distance >= 24, F.concat(F.lit("24+ "), side))


def shot_value(action_type: Column) -> Column:
    t = F.regexp_replace(F.lower(action_type), "[^a-z0-9]", "")
    return F.when(t == "3pt", 3).when(t == "2pt", 2).when(t == "freethrow", 1)
