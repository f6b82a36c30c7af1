"""Registered queries of typed page records: pages are made from the tables' columns, so SQL knows what each must hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.operators import pages
from scorebook.plans.demo import tables
from scorebook.sources.stored import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Pages of a part: a page takes about a millisecond, and a million of the rows that pages are made from can be one row group, thus one task.
PART_PAGES = 2_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(tables(spark, d), spark, d)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def page(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def profile_pages(t: dict[str, DataFrame]) -> DataFrame:
    """A profile page for each customer; every eleventh lacks the part with the details, some lack single fields."""
    k, name, phone, seg = F.col("c_custkey"), F.col("c_name"), F.concat(F.lit("nah-"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment")
    born = F.date_add(F.lit("1970-01-01").cast("date"), (k % 9000).cast("int"))
    debut = F.date_add(F.lit("1995-11-01").cast("date"), (k % 5000).cast("int"))
    only = lambda when, html: F.when(when, html).otherwise("")
    inner = page(
        "<h1 itemprop='name'>\n<span>", name, "</span> </h1><img itemscope src='/req/", k, ".jpg'>",
        "<p><strong>", name, " &amp; Sons</strong>", only(k % 3 == 0, page("&nbsp;▪ Instagram: <a href='#'>acct", k, "</a>")), "</p>",
        only(k % 2 == 0, page("<p>(", seg, ", The &#39;", k, "&#39;)</p>")), only(k % 5 == 0, page("<p>(formerly known as ", seg, ")</p>")),
        "<p><strong>\nPosition:\n</strong>\nGuard and Forward\n&#9642;\n<strong>Shoots:</strong>\n", F.when(k % 4 == 0, "Left").otherwise("Right"), "</p>",
        "<p><span>6-", k % 12, "</span>,&nbsp;<span>", 180 + k % 90, "lb</span>&nbsp;(", 180 + k % 40, "cm,&nbsp;", 80 + k % 40, "kg)</p>",
        only(k % 7 != 0, page("<p><strong>Born:</strong> <span id='necro-birth' data-birth=\"", born, "\"><a>", F.date_format(born, "MMMM d, yyyy"), "</a></span> <span>in&nbsp;", seg, ", Ohio</span> <span class=\"f-i f-us\">us</span></p>")),
        "<p><strong>Pronunciation</strong>: \\", phone, "\\</p><p>   </p><p class='x'><strong>Draft:</strong> ", seg, " Team, ", k % 3 + 1, F.element_at(F.array(F.lit("st"), F.lit("nd"), F.lit("rd")), (k % 3 + 1).cast("int")), " round (", k % 30 + 4, "th pick, ", k % 60 + 4, "th overall), <a>", 1980 + k % 40, " NBA Draft</a></p>",
        "<p><strong>NBA Debut: </strong><a href='/b'>", F.date_format(debut, "MMMM d, yyyy"), "</a></p><p><strong>Experience:</strong> ", F.when(k % 6 == 0, "Rookie").otherwise(page(k % 20, " years")), "</p>",
        only(k % 10 == 0, page("<p><strong>Hall of Fame:</strong> Inducted as Player in ", 1990 + k % 30, " (Full List)</p>")), only(k % 13 == 0, page("<p><strong>Recruiting Rank:</strong> ", 1990 + k % 30, " (", k % 99, ")")),
    )
    html = page("<html><head><link rel=\"canonical\" href=\"https://x.example/p/", k, "?a=1&amp;b=2\"></head><body><p><strong>Born:</strong> outside</p>", F.when(k % 11 == 0, "<div>").otherwise('<DIV id="meta">'), inner, "</div>\n</div><!-- div#meta --><p><strong>Team:</strong> outside</p></body></html>")
    return dealt(t["customer"], "c_custkey", rows=PART_PAGES).select(k.alias("page_id"), F.when(k % 97 != 0, html).alias("html"))


@query("""
WITH c AS (SELECT c_custkey AS k, * FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 97 <> 0)
SELECT k AS page_id, 'https://x.example/p/' || k || '?a=1&b=2' AS profile_url, c_name AS page_name, '/req/' || k || '.jpg' AS headshot_url, c_name || ' & Sons' AS formal_name, CASE WHEN k % 3 = 0 THEN 'acct' || k END AS instagram_handle, CASE WHEN k % 5 = 0 THEN 'formerly known as ' || c_mktsegment END AS former_name_note,
  CASE WHEN k % 2 = 0 THEN c_mktsegment || ', The ''' || k || '''' END AS nicknames_raw, '6-' || k % 12 AS height_raw, CAST(72 + k % 12 AS INTEGER) AS height_inches, CAST(180 + k % 40 AS INTEGER) AS height_cm, CAST(180 + k % 90 AS INTEGER) AS weight_lbs, CAST(80 + k % 40 AS INTEGER) AS weight_kg, 'Guard and Forward' AS position_raw,
  CASE WHEN k % 4 = 0 THEN 'Left' ELSE 'Right' END AS shoots, '\\' || 'nah-' || c_nationkey || '\\' AS pronunciation, CAST(NULL AS VARCHAR) AS current_team_raw, CASE WHEN k % 7 <> 0 THEN DATE '1970-01-01' + CAST(k % 9000 AS INTEGER) END AS birth_date, CASE WHEN k % 7 <> 0 THEN c_mktsegment || ', Ohio' END AS birth_place_raw, CASE WHEN k % 7 <> 0 THEN 'us' END AS birth_country_code,
  CAST(k % 3 + 1 AS INTEGER) AS draft_round, CAST(k % 30 + 4 AS INTEGER) AS draft_pick_in_round, CAST(k % 60 + 4 AS INTEGER) AS draft_pick_overall, CAST(1980 + k % 40 AS INTEGER) AS draft_year, 'NBA' AS draft_league, c_mktsegment || ' Team' AS draft_team_raw, DATE '1995-11-01' + CAST(k % 5000 AS INTEGER) AS nba_debut_date, CASE WHEN k % 6 <> 0 THEN CAST(k % 20 AS INTEGER) END AS experience_years,
  CAST(k % 10 = 0 AS INTEGER) AS hall_of_fame_flag, CASE WHEN k % 10 = 0 THEN 'Player' END AS hall_of_fame_role, CASE WHEN k % 10 = 0 THEN CAST(1990 + k % 30 AS INTEGER) END AS hall_of_fame_year, CASE WHEN k % 13 = 0 THEN CAST(1990 + k % 30 AS INTEGER) END AS recruiting_rank_year, CASE WHEN k % 13 = 0 THEN CAST(k % 99 AS INTEGER) END AS recruiting_rank_ordinal FROM c
""")
def profile_records(t, spark, d):
    """Typed profiles: names, size, birth, draft, debut and honours."""
    got, _ = pages.profiles(profile_pages(t))
    return got.select("page_id", "profile_url", "page_name", "headshot_url", "formal_name", "instagram_handle", "former_name_note", "nicknames_raw", "height_raw", "height_inches", "height_cm", "weight_lbs", "weight_kg", "position_raw", "shoots", "pronunciation", "current_team_raw", "birth_date", "birth_place_raw", "birth_country_code", "draft_round", "draft_pick_in_round", "draft_pick_overall", "draft_year", "draft_league", "draft_team_raw", "nba_debut_date", "experience_years", "hall_of_fame_flag", "hall_of_fame_role", "hall_of_fame_year", "recruiting_rank_year", "recruiting_rank_ordinal")


@query("SELECT c_custkey AS page_id, CASE WHEN c_custkey % 97 = 0 THEN 'missing_page' ELSE 'missing_meta_block' END AS reject_reason FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 97 = 0")
def profile_rejects(t, spark, d):
    return pages.profiles(profile_pages(t))[1]


def award_pages(t: dict[str, DataFrame]) -> DataFrame:
    """A page for each customer with orders: an award for each, of a kind by the order's key; a second one is a repeat."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    season, top = pages.season_label(y), F.element_at(F.array(*[F.lit(x) for x in ("mvp", "finals_mvp", "smoy", "coy")]), (k % 4 + 1).cast("int"))
    span = {
        "notable-awards": page("<span><a href='/awards/", top, ".html'>", F.when((k % 4 == 1) & (k % 3 == 0), y.cast("string")).otherwise(season), " Award &amp; Co</a></span>"),
        "allstar": page("<span>", y, " <a href=\"/allstar/NBA_", y, ".html\">", F.when(k % 5 == 0, "nba").otherwise("NBA"), "</a></span>"),
        "all_league": page("<span><a href='/leagues/NBA_", y + 1, ".html'>", season, "</a> All-", F.element_at(F.array(F.lit("NBA"), F.lit("Defensive"), F.lit("ABA")), (k % 3 + 1).cast("int")), " (", k % 3 + 1, "th)</span>"),
        "other": page("<span>", y, " NBA</span>"),
    }
    body = page(*[x for name, html in span.items() for x in (f'<div id="leaderboard_{name}"><h4>x</h4>', F.array_join(F.array_sort(F.collect_list(html)), "\n"), "</div>")])
    mine = dealt(t["orders"], "o_custkey").groupBy("o_custkey").agg(body.alias("body"))
    return mine.select(F.col("o_custkey").alias("page_id"), page('<div id="meta"><h1><span>Customer ', F.col("o_custkey"), '</span></h1><div id="leaderboard_wrapper">', F.col("body")).alias("html"))


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, year(o_orderdate) AS y, printf('%d-%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100) AS season, printf('%d-%02d', year(o_orderdate) - 1, year(o_orderdate) % 100) AS before FROM orders),
a AS (SELECT DISTINCT c, CASE k % 4 WHEN 0 THEN 'mvp' WHEN 1 THEN 'finals_mvp' WHEN 2 THEN 'sixth_man' END AS family, 'NBA' AS league, CASE WHEN k % 4 = 1 AND k % 3 = 0 THEN before ELSE season END AS season, NULL AS tier, '/awards/' || CASE k % 4 WHEN 0 THEN 'mvp' WHEN 1 THEN 'finals_mvp' ELSE 'smoy' END || '.html' AS url, 'notable_awards' AS section FROM o WHERE k % 4 < 3
  UNION ALL SELECT DISTINCT c, 'all_star', 'NBA', before, NULL, '/allstar/NBA_' || y || '.html', 'all_star' FROM o WHERE k % 5 <> 0
  UNION ALL SELECT DISTINCT c, CASE k % 3 WHEN 0 THEN 'all_nba' ELSE 'all_defensive' END, 'NBA', season, k % 3 + 1, '/leagues/NBA_' || (y + 1) || '.html', 'all_league' FROM o WHERE k % 3 < 2)
SELECT c AS page_id, 'Customer ' || c AS page_name, family AS award_family, league AS league_code, season AS season_label, CAST(tier AS INTEGER) AS team_tier, url, section AS source_section FROM a
""")
def award_records(t, spark, d):
    """Typed awards from three kinds of sections; other sections and forms give none."""
    return pages.awards(award_pages(t))[0].drop("label")


def index_pages(t: dict[str, DataFrame]) -> DataFrame:
    """Index pages of about fifty customers; customers are listed again, less filled, on a later page."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    cell = lambda stat, body, more="": page(f'<td class="right" data-stat="{stat}" ', more, ">", body, "</td>")
    colleges = F.when(k % 3 == 0, page('<a href="/c">', seg, "</a>, <a href='/d'>State &amp; Tech</a>")).when(k % 3 == 1, seg).otherwise("")
    row = page(
        '<tr ><th scope="row" class="left" ', F.when(k % 17 == 0, "").otherwise(page('data-append-csv="p', k, '" ')), 'data-stat="player" >', F.when(k % 19 == 0, name).otherwise(page('<a href="/players/p', k, '.html">', name, "</a>")), F.when(k % 10 == 0, "*").otherwise(""), "</th>",
        cell("year_min", 1970 + k % 40), cell("year_max", F.when(F.col("late"), F.lit("")).otherwise((1975 + k % 40).cast("string"))), cell("pos", "G-F"), cell("height", page("6-", k % 12), page('csk="', 72 + k % 12, '"')), cell("weight", F.when(k % 8 == 0, "n/a").otherwise((180 + k % 90).cast("string"))),
        cell("birth_date", "x", page('csk="', F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (k % 9000).cast("int")), "yyyyMMdd"), '"')), cell("colleges", colleges), "</tr>",
    )
    both = t["customer"].withColumn("late", F.explode(F.array(F.lit(False), F.lit(True)))).where("not late or c_custkey % 2 = 0")
    made = both.groupBy(F.floor(k / 50).cast("long").alias("page_no"), "late").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    return made.select((F.col("page_no") * 2 + F.col("late").cast("long")).alias("page_id"), F.when(F.col("late"), "2024-02-01").otherwise("2024-01-01").alias("fetched"), page("<table><tr><th data-stat='x'>Head</th></tr>", F.col("rows"), "</table>").alias("html"))


@query("""
SELECT 'p' || k AS player_id, c_name AS player_name, 'https://www.basketball-reference.com/players/p' || k || '.html' AS player_profile_url, CAST(1970 + k % 40 AS INTEGER) AS year_min, CAST(1975 + k % 40 AS INTEGER) AS year_max, 'G-F' AS position, '6-' || k % 12 AS height_raw, CAST(72 + k % 12 AS INTEGER) AS height_inches, CASE WHEN k % 8 <> 0 THEN CAST(180 + k % 90 AS INTEGER) END AS weight_lbs,
  DATE '1970-01-01' + CAST(k % 9000 AS INTEGER) AS birth_date, CASE k % 3 WHEN 0 THEN c_mktsegment || '|State & Tech' WHEN 1 THEN c_mktsegment END AS colleges_raw, CAST(CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS colleges_count, CAST(k % 10 = 0 AS INTEGER) AS hall_of_fame_flag, '2024-01-01' AS fetched
FROM (SELECT c_custkey AS k, * FROM customer) WHERE k % 17 <> 0 AND k % 19 <> 0
""")
def index_records(t, spark, d):
    """The best row of each player of all index pages."""
    rows, _ = pages.index_rows(index_pages(t), carry=["fetched"])
    return pages.best_index_rows(rows, "fetched").drop("page_id", "row")


@query("SELECT detail, CAST(sum(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM (SELECT c_custkey AS k, 'Missing required fields: ' || CASE WHEN c_custkey % 17 = 0 AND c_custkey % 19 = 0 THEN 'player_id, player_name, player_profile_url' WHEN c_custkey % 17 = 0 THEN 'player_id' ELSE 'player_name, player_profile_url' END AS detail FROM customer WHERE c_custkey % 17 = 0 OR c_custkey % 19 = 0) GROUP BY detail")
def index_rejects(t, spark, d):
    """Rows of index pages without what a record needs, by what is missing."""
    return pages.index_rows(index_pages(t))[1].groupBy("detail").agg(F.count(F.lit(1)).alias("n"))
