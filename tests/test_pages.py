"""Typed page records: blocks, fields, rejects, odd markup."""

import datetime

import pytest
from pyspark.sql import functions as F

from scorebook.operators import pages


def frame(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


META = '<html><link rel="canonical" href="/p/1"><div id="meta"><h1>\n<span>Jo &amp; Co</span></h1>%s</div></div><!-- div#meta --><p><strong>Team:</strong> outside</p>'


def test_references_are_read_once(spark):
    got = [one(spark, pages.unescaped(F.lit(t))) for t in ("a &amp;lt; b", "&#39;&#x41;&eacute;", "&nope; &", "&#0;", "no reference", "&amp;amp;")]
    assert got == ["a &lt; b", "'Aé", "&nope; &", "&#0;", "no reference", "&amp;"]


def test_profile_fields(spark):
    body = (
        "<p><strong>Jo Formal</strong>&nbsp;▪ Instagram: <a>jo1</a></p><p>(The Jo, JJ)</p><p>(born Al, changed his name to Jo)</p><p> </p>"
        "<p><strong>Position:</strong> Guard ▪ <strong>Shoots:</strong> Left</p><p><span>6-5</span>,&nbsp;<span>215lb</span>&nbsp;(196cm,&nbsp;98kg)</p>"
        '<p><strong>Born:</strong> <span data-birth="1984-12-30">December 30, 1984</span> in&nbsp;Akron, Ohio <span class="f-i f-us">us</span></p><p><strong>Died:</strong> <span data-death="2020-02-30">x</span></p>'
        "<p><strong>College</strong>: First</p><p><strong>College:</strong> Last</p><p><strong>Draft:</strong> Team A, 1st round (2nd pick, 3rd overall), 2003 NBA Draft (early)</p>"
        "<p><strong>NBA Debut:</strong> <a>October 29, 2003</a></p><p><strong>Experience:</strong> 17 years</p><p><strong>Hall of Fame:</strong> Inducted as Player in 2020 (List)</p><p><strong>High Schools:</strong> Never closed"
    )
    typed, bad = pages.profiles(frame(spark, META % body, "<p>no meta</p>", None, META % "", "<DIV ID=\"meta\"><h1><span>X</span></h1><p>Only <strong>bold</strong>"))
    rows = {r.page_id: r for r in typed.collect()}
    assert {(r.page_id, r.reject_reason) for r in bad.collect()} == {(1, pages.NO_META), (2, pages.NO_PAGE)} and set(rows) == {0, 3, 4}
    r = rows[0]
    assert (r.profile_url, r.page_name, r.formal_name, r.instagram_handle, r.nicknames_raw, r.former_name_note) == ("/p/1", "Jo & Co", "Jo Formal", "jo1", "The Jo, JJ", "born Al, changed his name to Jo")
    assert (r.position_raw, r.shoots, r.height_raw, r.height_inches, r.height_cm, r.weight_lbs, r.weight_kg) == ("Guard", "Left", "6-5", 77, 196, 215, 98)
    assert (r.birth_date, r.birth_place_raw, r.birth_country_code, r.death_date) == (datetime.date(1984, 12, 30), "Akron, Ohio", "us", None)
    assert (r.college_raw, r.current_team_raw, r.high_schools_raw) == ("Last", None, "Never closed")
    assert (r.draft_team_raw, r.draft_round, r.draft_pick_in_round, r.draft_pick_overall, r.draft_year, r.draft_league, r.draft_selection_note) == ("Team A", 1, 2, 3, 2003, "NBA", "early")
    assert (r.nba_debut_date, r.experience_years, r.hall_of_fame_flag, r.hall_of_fame_role, r.hall_of_fame_year) == (datetime.date(2003, 10, 29), 17, 1, "Player", 2020)
    assert (rows[3].formal_name, rows[3].hall_of_fame_flag, rows[3].birth_date) == ("Jo & Co", 0, None) and rows[4].formal_name == "Only bold"


def test_awards(spark):
    boards = (
        '<div id="leaderboard_notable-awards"><span><a href="/awards/mvp.html">2012-13 MVP</a></span><span><a href="/awards/mvp.html">2012-13 MVP</a></span><span><a href="/awards/finals_mvp.html">2013 Finals</a></span><span><a href="/awards/mvp.html">2013 MVP</a></span><span>no link</span><span><a href="/awards/coy.html">2012-13 Coach</a></span>'
        '</div><div id="leaderboard_allstar"><span>2005 NBA</span><span>2005</span></div><div id="leaderboard_all_league"><span><a href="/leagues/NBA_2006.html">2005-06</a> All-NBA (1st)</span><span>2005-06 All-ABA (1st)</span></div><div id="leaderboard_blk"><span>2005 NBA</span></div>'
    )
    got, bad = pages.awards(frame(spark, META % boards, "x"))
    rows = sorted((r.award_family, r.league_code, r.season_label, r.team_tier or 0, r.label, r.source_section) for r in got.collect())
    assert rows == [
        ("all_nba", "NBA", "2005-06", 1, "2005-06 All-NBA (1st)", "all_league"), ("all_star", "NBA", "2004-05", 0, "2005 NBA", "all_star"),
        ("finals_mvp", "NBA", "2012-13", 0, "2013 Finals", "notable_awards"), ("mvp", "NBA", "2012-13", 0, "2012-13 MVP", "notable_awards"),
    ]
    assert [r.reject_reason for r in bad.collect()] == [pages.NO_META]


def test_index_rows(spark):
    row = '<tr><th data-append-csv="%s" data-stat="player"><a href="%s">%s</a>%s</th><td csk="19840230" data-stat="birth_date">x</td><td data-stat="weight">%s</td><td data-stat="height">6-1</td><td data-stat="colleges">%s</td></tr>'
    page = "<table><tr><th>Head</th></tr>" + row % ("a", "/a", "A &amp; B", "*", "200", "<a href='/x'>X</a>, <a href='/y'>Y</a>") + row % ("", "/b", "B", "", "n/a", "Plain") + row % ("a", "/a", "A", "", "", "") + "</table>"
    got, bad = pages.index_rows(frame(spark, page, None, "<tr><td>nothing"))
    first, again = got.orderBy("row").collect()
    assert (first.player_id, first.player_name, first.player_profile_url, first.weight_lbs, first.height_inches, first.colleges_raw, first.colleges_count, first.hall_of_fame_flag, first.birth_date) == ("a", "A & B", pages.SITE + "/a", 200, 73, "X|Y", 2, 1, None)
    assert (again.weight_lbs, again.colleges_raw, again.colleges_count) == (None, None, 0)
    assert [(r.reject_reason, r.detail) for r in bad.collect()] == [(pages.MISSING, "Missing required fields: player_id")]
    best = pages.best_index_rows(got.withColumn("fetched", F.when(F.col("row") > first.row, "2").otherwise("1")), "fetched").collect()
    assert [(r.player_name, r.weight_lbs) for r in best] == [("A & B", 200)]


@pytest.mark.parametrize("n", [2000])
def test_long_pages_take_linear_time(spark, n):
    """Thousands of unclosed paragraphs and bold starts."""
    html = '<div id="meta"><h1><span>N</span></h1>' + "<p><strong>" * n + "<p>tail"
    assert [r.page_name for r in pages.profiles(frame(spark, html))[0].collect()] == ["N"]
