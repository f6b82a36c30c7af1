"""Typed records from HTML pages: profiles, awards and index rows.

A page is cut at its tags into blocks (paragraphs, spans, table rows and cells), and each block gets its labels, its text
and the value that follows its first label. A record type is a table of field rules (name, label, parser) that run over
the blocks. A block is cut once and looked at by each rule, so the work grows with the page's length, and nothing is
exploded or shuffled for a profile. An element that isn't closed ends where the next of its kind begins.

Null pages and pages without the part that a record needs are rejected with a reason; missing fields are null.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.functions.text import null_if_empty
from scorebook.operators.relational import best_row

# What begins and ends the part with a person's details, the kinds of award and what a page calls them.
META, META_ENDS = '<div id="meta">', (r"</div>\s*</div><!-- div#meta -->", '<ul id="bling">', '<div id="leaderboard_wrapper">')
NOTABLE = {"mvp": "mvp", "finals_mvp": "finals_mvp", "dpoy": "dpoy", "smoy": "sixth_man", "mip": "mip", "roy": "roy"}
ALL_LEAGUE = {"All-NBA": "all_nba", "All-Defensive": "all_defensive", "All-Rookie": "all_rookie"}
SITE = "https://www.basketball-reference.com"
NO_META, NO_PAGE, MISSING = "missing_meta_block", "missing_page", "missing_required_field"


@dataclass(frozen=True)
class Field:
    """A typed field: from the last block whose first label is `label`, or from the first that `when` accepts."""

    name: str
    parse: Callable[[Column], Column]
    label: str | None = None
    when: Callable[[Column], Column] | None = None


def unescaped(text: Column) -> Column:
    """`text` with its character references replaced by the characters; unknown names stay."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(html.entities.name2codepoint.items()) for x in (name, chr(code))])
    digits = lambda e: F.regexp_extract(e, "([0-9A-Fa-f]+);", 1)
    code = lambda e: F.when(F.lower(e).startswith("&#x"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("long")
    of_code = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    char = lambda e: F.when(F.substring(e, 2, 1) == "#", of_code(code(e))).otherwise(F.try_element_at(named, F.regexp_extract(e, "&([A-Za-z0-9]+);", 1)))
    # one pass from left to right, so what comes out of a reference isn't read as another one
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#?[A-Za-z0-9]+;|&|[^&]+"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda e: F.when(e.startswith("&") & e.endswith(";"), F.coalesce(char(e), e)).otherwise(e)), "")).otherwise(text)


def visible(markup: Column) -> Column:
    """The text of some markup: tags as spaces, references replaced, white space collapsed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(markup, "(?s)<[^>]+>", " ")), r"[\s ]+", " "))


def elements(markup: Column, tag: str) -> Column:
    """The contents of all `tag` elements (a regular expression of names), in order."""
    pieces = F.filter(F.split(markup, rf"(?i)(?=<(?:{tag})[\s>])"), lambda p: p.rlike(rf"(?is)\A<(?:{tag})[\s>]"))
    return F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, rf"(?is)</(?:{tag})\s*>.*\z", ""), r"(?s)\A<[^>]*>", ""))


def attribute(markup: Column, name: str) -> Column:
    """The first value of an attribute; null if there's none."""
    found = F.regexp_extract(markup, rf"""(?i)[\s<]{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
    other = F.regexp_extract(markup, rf"""(?i)[\s<]{name}\s*=\s*'([^']*)'""", 1)
    return null_if_empty(unescaped(F.when(found != "", found).otherwise(other)))


def section(page: Column, start: str, ends: Sequence[str]) -> Column:
    """The page from the first `start` (text, any case) up to the nearest of `ends` (regular expressions); null without it."""
    rest = F.nullif(F.regexp_extract(page, rf"(?is)\Q{start}\E.*\z", 0), F.lit(""))
    return F.regexp_replace(rest, rf"(?is)(?:{'|'.join(ends)}).*\z", "")


def label_name(text: Column) -> Column:
    """A label in lower case, with underscores for all that isn't a letter or digit."""
    return null_if_empty(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def labelled(markup: Column, tag: str = "p", mark: str = "strong") -> Column:
    """Blocks (html, text, labels, value) of the `tag` elements that have any text.

    A label is a `mark` element that ends with a colon or is followed by one; the value is the text after the first one.
    """
    lead = rf"(?is)\A<{mark}[^>]*>(.*?)</{mark}\s*>"
    marks = lambda h: F.filter(F.split(h, rf"(?i)(?=<{mark}[\s>])"), lambda p: p.rlike(lead))
    name = lambda p: visible(F.regexp_extract(p, lead, 1))
    follows = lambda p: F.ltrim(F.regexp_replace(p, lead, "")).startswith(":")
    seen = lambda h: F.transform(marks(h), lambda p: F.struct(name(p).alias("name"), follows(p).alias("follows")))
    is_label = lambda m: m["name"].endswith(":") | (m["follows"] & (m["name"] != ""))
    raw = lambda h: F.transform(F.filter(seen(h), is_label), lambda m: F.rtrim(F.regexp_replace(m["name"], ":+$", "")))
    own = F.transform(elements(markup, tag), lambda h: F.struct(h.alias("html"), visible(h).alias("text"), raw(h).alias("raw")))
    rest = lambda b: F.ltrim(F.substring(b["text"], F.length(F.get(b["raw"], F.lit(0))) + 1, F.length(b["text"])))
    begins = lambda b: F.startswith(b["text"], F.get(b["raw"], F.lit(0))) & rest(b).startswith(":")
    value = lambda b: null_if_empty(F.when(begins(b), F.trim(F.substring(rest(b), F.lit(2), F.length(b["text"])))))
    labels = lambda b: F.array_compact(F.transform(b["raw"], label_name))
    return F.transform(F.filter(own, lambda b: b["text"] != ""), lambda b: F.struct(b["html"], b["text"], labels(b).alias("labels"), value(b).alias("value")))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns worked out once a row, where they stand.

    They come from a generator. Spark pushes filters through plain columns and works these out again in the filter, even
    before an exchange that deals the rows; it pushes none through a generator.
    """
    made = df.select("*", F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("_once"))
    return made.select(*[c for c in df.columns if c not in columns], *[F.col(f"_once.{n}").alias(n) for n in columns])


def picked(blocks: Column, field: Field) -> Column:
    """The block that a field's rule is about."""
    if field.label is not None:
        return F.try_element_at(F.filter(blocks, lambda b: F.get(b["labels"], F.lit(0)).eqNullSafe(F.lit(field.label))), F.lit(-1))
    return F.try_element_at(F.filter(blocks, lambda b: (F.size(b["labels"]) == 0) & F.coalesce(field.when(b), F.lit(False))), F.lit(1))


def parsed(rows: DataFrame, blocks: str, fields: Sequence[Field]) -> DataFrame:
    """What the fields' rules find in the blocks; fields that are about the same block share it."""
    own = {(f.label, f.when): f for f in fields}
    name = {k: f"_b{i}" for i, k in enumerate(own)}
    found = once(rows, {name[k]: picked(F.col(blocks), f) for k, f in own.items()})
    return found.select(*[c for c in rows.columns if c != blocks], *[f.parse(F.col(name[f.label, f.when])).alias(f.name) for f in fields])


# ---------------------------------------------------------------- parsers of fields


def found(column: str, pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda b: null_if_empty(F.regexp_extract(b[column], pattern, group))


def number(column: str, pattern: str, group: int = 1) -> Callable[[Column], Column]:
    return lambda b: found(column, pattern, group)(b).try_cast("int")


def iso_date(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(text).try_cast("date"))


def written_date(b: Column) -> Column:
    """A date such as `October 29, 2003` that stands alone in an element."""
    return F.try_to_timestamp(F.regexp_extract(b["html"], r">([A-Za-z]+\s+\d{1,2},\s+\d{4})<", 1), F.lit("MMMM d, yyyy")).cast("date")


def country(b: Column) -> Column:
    return null_if_empty(F.regexp_extract(b["html"], r'<span[^>]*class="[^"]*f-i[^"]*"[^>]*>\s*([a-z]{2})\s*</span>', 1))


def birth_place(b: Column) -> Column:
    place = F.when(b["value"].contains(" in "), F.trim(F.regexp_extract(b["value"], "(?s) in (.*)", 1)))
    ends = F.lower(place).endswith(F.concat(F.lit(" "), country(b)))
    return null_if_empty(F.when(F.coalesce(ends, F.lit(False)), F.trim(F.substring(place, F.lit(1), F.length(place) - 3))).otherwise(place))


SIZE = r"^(\d+)-(\d+)\s*,\s*(\d+)lb\s*\((\d+)cm,\s*(\d+)kg\)$"
FORMER, NAMED = r"(?i)formerly known as|changed his name to", r"(?s)^(.*?)\s*[▪•]\s*Instagram\s*:\s*(.+)$"
_value: Callable[[Column], Column] = lambda b: b["value"]
_sized = lambda b: b["text"].rlike(SIZE)
_bracketed = lambda b: b["text"].startswith("(") & b["text"].endswith(")")
_inner = lambda b: null_if_empty(F.trim(F.substring(b["text"], F.lit(2), F.length(b["text"]) - 2)))
_plain = lambda b: ~_sized(b) & ~_bracketed(b)
_sides = r"(?s)^Position\s*:\s*(.*?)\s*[▪•]\s*Shoots\s*:\s*(.*)$"
_pair = lambda group: lambda b: F.when(b["labels"] == F.array(F.lit("position"), F.lit("shoots")), found("text", _sides, group)(b))

PROFILE = (
    Field("formal_name", lambda b: F.when(b["text"].rlike(NAMED), found("text", NAMED)(b)).otherwise(b["text"]), when=_plain),
    Field("instagram_handle", found("text", NAMED, 2), when=_plain),
    Field("former_name_note", _inner, when=lambda b: _bracketed(b) & b["text"].rlike(FORMER)),
    Field("nicknames_raw", _inner, when=lambda b: _bracketed(b) & ~b["text"].rlike(FORMER)),
    Field("height_raw", found("text", r"^(\d+-\d+)"), when=_sized),
    Field("height_inches", lambda b: number("text", SIZE, 1)(b) * 12 + number("text", SIZE, 2)(b), when=_sized),
    Field("height_cm", number("text", SIZE, 4), when=_sized),
    Field("weight_lbs", number("text", SIZE, 3), when=_sized),
    Field("weight_kg", number("text", SIZE, 5), when=_sized),
    Field("position_raw", _pair(1), "position"),
    Field("shoots", _pair(2), "position"),
    Field("pronunciation", _value, "pronunciation"),
    Field("current_team_raw", _value, "team"),
    Field("birth_date", lambda b: iso_date(attribute(b["html"], "data-birth")), "born"),
    Field("birth_place_raw", birth_place, "born"),
    Field("birth_country_code", country, "born"),
    Field("death_date", lambda b: iso_date(attribute(b["html"], "data-death")), "died"),
    Field("relatives_raw", _value, "relatives"),
    Field("college_raw", _value, "college"),
    Field("colleges_raw", _value, "colleges"),
    Field("high_school_raw", _value, "high_school"),
    Field("high_schools_raw", _value, "high_schools"),
    Field("recruiting_rank_raw", _value, "recruiting_rank"),
    Field("recruiting_rank_year", number("value", r"(\d{4})\s*\((\d+)\)"), "recruiting_rank"),
    Field("recruiting_rank_ordinal", number("value", r"(\d{4})\s*\((\d+)\)", 2), "recruiting_rank"),
    Field("draft_raw", _value, "draft"),
    Field("draft_team_raw", lambda b: null_if_empty(F.trim(F.get(F.split(b["value"], ","), F.lit(0)))), "draft"),
    Field("draft_round", number("value", r"(\d+)(?:st|nd|rd|th)\s+round"), "draft"),
    Field("draft_pick_in_round", number("value", r"\((\d+)(?:st|nd|rd|th)\s+pick,\s*(\d+)(?:st|nd|rd|th)\s+overall\)"), "draft"),
    Field("draft_pick_overall", number("value", r"\((\d+)(?:st|nd|rd|th)\s+pick,\s*(\d+)(?:st|nd|rd|th)\s+overall\)", 2), "draft"),
    Field("draft_year", number("value", r"(\d{4})\s+([A-Z]+)\s+Draft"), "draft"),
    Field("draft_league", found("value", r"(\d{4})\s+([A-Z]+)\s+Draft", 2), "draft"),
    Field("draft_selection_note", found("value", r"Draft\s*\(([^)]+)\)\s*$"), "draft"),
    Field("nba_debut_date", written_date, "nba_debut"),
    Field("aba_debut_date", written_date, "aba_debut"),
    Field("experience_years", number("value", r"(\d+)\s+year"), "experience"),
    Field("career_length_years", number("value", r"(\d+)\s+year"), "career_length"),
    Field("hall_of_fame_flag", lambda b: F.coalesce(b["value"].isNotNull().cast("int"), F.lit(0)), "hall_of_fame"),
    Field("hall_of_fame_role", found("value", r"Inducted as\s+(.+?)\s+in\s+(\d{4})"), "hall_of_fame"),
    Field("hall_of_fame_year", number("value", r"Inducted as\s+(.+?)\s+in\s+(\d{4})", 2), "hall_of_fame"),
    Field("hall_of_fame_raw", _value, "hall_of_fame"),
)


def _with_meta(pages: DataFrame, html_col: str) -> DataFrame:
    """Pages with `_meta`, the part that has a person's details, and `reject_reason` where it is missing."""
    meta = section(F.col(html_col), META, META_ENDS)
    return once(pages, {"_meta": meta}).withColumn("reject_reason", F.when(F.col(html_col).isNull(), NO_PAGE).when(F.col("_meta").isNull(), NO_META))


def _page_name(meta: Column) -> Column:
    return null_if_empty(visible(F.regexp_extract(meta, r"(?is)<h1[^>]*>\s*<span>(.*?)</span>\s*</h1>", 1)))


def _page_url(page: Column, url: Column) -> Column:
    link = F.regexp_extract(page, r'(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"', 1)
    return null_if_empty(F.when(link != "", unescaped(link)).otherwise(url))


def profiles(pages: DataFrame, key: str = "page_id", html_col: str = "html", url: Column | None = None, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed profile records, one a page, and rejects (key, reject_reason). `url` stands in for a page's canonical one."""
    parts = _with_meta(pages, html_col)
    rows = parts.where("reject_reason is null").select(
        key, *carry, _page_url(F.col(html_col), F.lit(None).cast("string") if url is None else url).alias("profile_url"), _page_name(F.col("_meta")).alias("page_name"),
        attribute(F.regexp_extract("_meta", r"(?is)<img[^>]+>", 0), "src").alias("headshot_url"), labelled(F.col("_meta")).alias("_blocks"),
    )
    typed = parsed(rows, "_blocks", PROFILE)
    typed = typed.withColumns({"formal_name": F.coalesce("formal_name", "page_name"), "hall_of_fame_flag": F.coalesce("hall_of_fame_flag", F.lit(0))})
    return typed, parts.where("reject_reason is not null").select(key, "reject_reason")


def season_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def awards(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Typed award records (key, page_name, award_family, league_code, season_label, team_tier, label, url, section), and rejects.

    Awards are spans in the sections of notable awards, all-star games and all-league teams; what fits none of their
    forms is no record. Of equal awards of a page (family, season, tier, reference) the first counts.
    """
    parts = _with_meta(pages, html_col)
    cut = F.filter(F.split(html_col, '(?i)(?=<div id="leaderboard_)'), lambda p: p.rlike('(?i)\\A<div id="leaderboard_(notable-awards|allstar|all_league)"'))
    rows = parts.where("reject_reason is null").select(key, _page_name(F.col("_meta")).alias("page_name"), F.posexplode(cut).alias("_s", "_section"))
    rows = rows.withColumn("_id", F.regexp_extract("_section", '(?i)\\A<div id="leaderboard_([^"]+)"', 1))
    spans = F.filter(F.split("_section", "(?i)(?=<span>)"), lambda p: p.rlike(r"(?is)\A<span>.*?</span>"))
    rows = rows.select(key, "page_name", "_id", "_s", F.posexplode(F.transform(spans, lambda p: F.regexp_extract(p, r"(?is)\A<span>(.*?)</span>", 1))).alias("_n", "_span"))
    rows = once(rows, {"label": visible(F.col("_span")), "url": null_if_empty(F.regexp_extract("_span", r"""(?i)href=['"]([^'"]+)['"]""", 1))}).where("label <> ''")
    got = lambda column, pattern, group=1: null_if_empty(F.regexp_extract(column, pattern, group))
    choose = lambda names, value: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)
    family = choose(NOTABLE, F.lower(F.regexp_extract("url", r"(?i)/awards/([a-z0-9_]+)\.html", 1)))
    year = got("label", r"^(\d{4})\b").try_cast("int")
    season = F.coalesce(got("label", r"^(\d{4}-\d{2})\b"), F.when(family == "finals_mvp", season_label(year - 1)))
    star, team = r"^(\d{4})\s+([A-Z]+)$", r"^(\d{4}-\d{2})\s+(All-NBA|All-Defensive|All-Rookie|All-ABA)\s+\((\d)(?:st|nd|rd|th)\)$"
    record = lambda family, league, season, tier, name: F.struct(family.alias("award_family"), league.alias("league_code"), season.alias("season_label"), tier.cast("int").alias("team_tier"), F.lit(name).alias("source_section"))
    kind = (
        F.when(F.col("_id") == "notable-awards", record(family, F.lit("NBA"), season, F.lit(None), "notable_awards"))
        .when(F.col("_id") == "allstar", record(F.when(F.col("label").rlike(star), "all_star"), got("label", star, 2), season_label(got("label", star).try_cast("int") - 1), F.lit(None), "all_star"))
        .otherwise(record(choose(ALL_LEAGUE, F.regexp_extract("label", team, 2)), got("url", r"(?i)/(?:leagues|allstar)/([A-Z]+)_(\d{4})\.html"), got("label", team), got("label", team, 3).try_cast("int"), "all_league"))
    )
    typed = once(rows, {"_k": kind}).select(key, "page_name", "_s", "_n", "_k.*", "label", "url").where("award_family is not null and season_label is not null")
    same = [key, "award_family", "season_label", "team_tier", "url"]
    first = typed.groupBy(*same).agg(F.min(F.struct("_s", "_n", "page_name", "league_code", "label", "source_section")).alias("_f"))
    out = first.select(key, "_f.page_name", "award_family", "_f.league_code", "season_label", "team_tier", "_f.label", "url", "_f.source_section")
    return out, parts.where("reject_reason is not null").select(key, "reject_reason")


def index_rows(pages: DataFrame, key: str = "page_id", html_col: str = "html", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed rows of index tables, and rejects: rows with a player cell but no id, name or link, with what is missing.

    A table row has cells named by data-stat; the last of a name counts. Rows without a player cell are headings.
    """
    rows = pages.select(key, *carry, F.posexplode(elements(F.col(html_col), "tr")).alias("row", "_tr"))
    cells = F.transform(F.filter(F.split("_tr", r"(?i)(?=<t[hd][\s>])"), lambda p: p.rlike(r"(?is)\A<t[hd][^>]*\sdata-stat=")), lambda p: F.struct(
        F.regexp_extract(p, r'(?i)data-stat="([^"]+)"', 1).alias("stat"), F.regexp_extract(p, r"(?s)\A(<[^>]*>)", 1).alias("head"), F.regexp_replace(F.regexp_replace(p, r"(?is)</t[hd]\s*>.*\z", ""), r"(?s)\A<[^>]*>", "").alias("html"),
    ))
    rows = rows.select(key, *carry, "row", cells.alias("_cells")).where(F.exists("_cells", lambda c: c["stat"] == "player"))
    cell = lambda name: F.try_element_at(F.filter("_cells", lambda c: c["stat"] == name), F.lit(-1))
    text = lambda name: null_if_empty(visible(cell(name)["html"]))
    link = r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    href = null_if_empty(unescaped(F.regexp_extract(cell("player")["html"], link, 1)))
    colleges = F.filter(F.transform(F.regexp_extract_all(cell("colleges")["html"], F.lit(link), F.lit(2)), visible), lambda c: c != "")
    day = F.regexp_extract(attribute(cell("birth_date")["head"], "csk"), r"^\s*(\d{8})\s*$", 1)
    typed = rows.select(
        key, *carry, "row", attribute(cell("player")["head"], "data-append-csv").alias("player_id"), null_if_empty(visible(F.regexp_extract(cell("player")["html"], link, 2))).alias("player_name"), F.concat(F.lit(SITE), href).alias("player_profile_url"),
        text("year_min").try_cast("int").alias("year_min"), text("year_max").try_cast("int").alias("year_max"), text("pos").alias("position"), text("height").alias("height_raw"),
        (F.regexp_extract(text("height"), r"^(\d+)-(\d+)$", 1).try_cast("int") * 12 + F.regexp_extract(text("height"), r"^(\d+)-(\d+)$", 2).try_cast("int")).alias("height_inches"), text("weight").try_cast("int").alias("weight_lbs"),
        F.try_to_timestamp(null_if_empty(day), F.lit("yyyyMMdd")).cast("date").alias("birth_date"), F.when(F.size(colleges) > 0, F.array_join(colleges, "|")).otherwise(text("colleges")).alias("colleges_raw"),
        F.when(F.size(colleges) > 0, F.size(colleges)).otherwise(text("colleges").isNotNull().cast("int")).alias("colleges_count"), visible(cell("player")["html"]).contains("*").cast("int").alias("hall_of_fame_flag"),
    )
    needed = ("player_id", "player_name", "player_profile_url")
    missing = F.array_join(F.array(*[F.when(F.col(c).isNull(), c) for c in needed]), ", ")
    typed = typed.withColumn("_missing", missing)
    bad = typed.where("_missing <> ''").select(key, "row", F.lit(MISSING).alias("reject_reason"), F.concat(F.lit("Missing required fields: "), "_missing").alias("detail"))
    return typed.where("_missing = ''").drop("_missing"), bad


INDEX_SCORE = ("player_name", "player_profile_url", "year_min", "year_max", "position", "height_inches", "weight_lbs", "birth_date", "colleges_raw")


def best_index_rows(rows: DataFrame, fetched: str) -> DataFrame:
    """One index row per player: the most filled, then the one fetched last, then the first in page order."""
    score = sum((F.col(c).isNotNull().cast("int") for c in INDEX_SCORE), F.lit(0))
    return best_row(rows, ["player_id"], score, [F.col(fetched).desc_nulls_last(), F.col("row")])
