"""Record linkage, value aliases and typed records from HTML pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.functions.text import alphanumeric, null_if_empty
from scorebook.operators.relational import best_row

# The weights of the evidence and the scores that decide.
DRAFT, WEIGHT, SCHOOL_SAME, SCHOOL_PART, POSITION = 100, 10, 8, 5, 3
SURE, SUPPORTED, DECISIVE = 100, 18, 15
METHOD_ORDER = ("unique_top_score_supported_by_multiple_secondary_checks", "unique_top_score_with_draft_match", "exact_full_name_unique", "exact_full_name_with_suffix_unique", "manual_override")


def aliases(rows: DataFrame, canonical: str, columns: Sequence[str], curated: DataFrame | None = None) -> DataFrame:
    """(canonical, alias, normalized) from columns of a dimension and a curated table (canonical, alias)."""
    own = rows.select(F.col(canonical).alias("canonical"), F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("alias"))
    both = own if curated is None else own.unionByName(curated.select("canonical", "alias"))
    both = both.where(null_if_empty(F.col("alias")).isNotNull()).distinct()
    return both.withColumn("normalized", alphanumeric(F.col("alias"))).where("normalized <> ''")


def ambiguous_aliases(table: DataFrame) -> DataFrame:
    """Normalized aliases of more than one canonical value."""
    return table.groupBy("normalized").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals")).where(F.size("canonicals") > 1)


def canonicalized(df: DataFrame, column: str, table: DataFrame, out: str = "canonical_value") -> DataFrame:
    """Add the canonical value of a text, matched by its unambiguous normalized alias; null if there's none."""
    one = table.groupBy("normalized").agg(F.min("canonical").alias(out), F.count_distinct("canonical").alias("_n")).where("_n = 1").drop("_n")
    return df.withColumn("normalized", alphanumeric(F.col(column))).join(one, "normalized", "left").drop("normalized")


def scored(left: DataFrame, right: DataFrame, key: str = "name_key") -> DataFrame:
    """Candidate pairs with an equal name key and their evidence.

    Both sides have name_key, exact_name_key, draft (struct, null unless whole), weight, school and positions (array);
    left_id and right_id identify them.
    """
    cols = ["exact_name_key", "draft", "weight", "school", "positions"]
    a = left.select(key, "left_id", *[F.col(c).alias(f"l_{c}") for c in cols])
    b = right.select(key, "right_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    p = a.join(b, key)
    both = lambda c: F.col(f"l_{c}").isNotNull() & F.col(f"r_{c}").isNotNull()
    gap = F.abs(F.col("l_weight") - F.col("r_weight"))
    same, part = F.col("l_school") == F.col("r_school"), F.contains("l_school", "r_school") | F.contains("r_school", "l_school")
    flags = {
        "draft_match": F.when(both("draft"), (F.col("l_draft") == F.col("r_draft")).cast("int")).otherwise(0),
        "weight_match": F.coalesce((gap <= 1).cast("int"), F.lit(0)),
        "school_match": F.coalesce((same | part).cast("int"), F.lit(0)),
        "position_match": F.coalesce(F.arrays_overlap("l_positions", "r_positions").cast("int"), F.lit(0)),
    }
    draft = F.when(both("draft"), F.when(F.col("l_draft") == F.col("r_draft"), DRAFT).otherwise(-DRAFT)).otherwise(0)
    weight = F.when(gap <= 1, WEIGHT).when(gap >= 15, -WEIGHT).otherwise(0)
    school = F.when(same, SCHOOL_SAME).when(part, SCHOOL_PART).otherwise(0)
    p = p.withColumns(flags)
    return p.withColumn("score", draft + weight + school + F.col("position_match") * POSITION)


def chosen(pairs: DataFrame, blocked: Sequence[str] = (), key: str = "name_key") -> DataFrame:
    """Pairs with the candidate that the rules accept per left row: `accepted` and `reason`; the rest are undecided.

    A single candidate with the same full name (with suffix); a single candidate at all, unless the name is blocked;
    a single top score of SURE or of SUPPORTED.
    """
    w = Window.partitionBy("left_id")
    exact = F.col("l_exact_name_key").isNotNull() & F.col("l_exact_name_key").eqNullSafe(F.col("r_exact_name_key")) & (F.col("l_exact_name_key") != F.col(key))
    p = pairs.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    p = p.withColumns({"_n": F.count(F.lit(1)).over(w), "_exacts": F.sum(F.col("_exact").cast("int")).over(w), "_top": F.max("score").over(w)})
    p = p.withColumn("_tops", F.sum((F.col("score") == F.col("_top")).cast("int")).over(w))
    free = ~F.col(key).isin(*blocked) if blocked else F.lit(True)
    at_top = F.col("score") == F.col("_top")
    reason = (
        F.when(F.col("_exacts") == 1, F.when(F.col("_exact"), "exact_full_name_with_suffix_unique"))
        .when((F.col("_n") == 1) & free, "exact_full_name_unique")
        .when((F.col("_tops") == 1) & (F.col("_top") >= SURE), F.when(at_top, "unique_top_score_with_draft_match"))
        .when((F.col("_tops") == 1) & (F.col("_top") >= SUPPORTED), F.when(at_top, "unique_top_score_supported_by_multiple_secondary_checks"))
    )
    decided = F.max(reason.isNotNull().cast("int")).over(w) == 1
    return p.withColumns({"reason": reason, "accepted": reason.isNotNull(), "decided": decided, "is_top": at_top, "top_unique": F.col("_tops") == 1, "top_score": F.col("_top")}).drop("_exact", "_n", "_exacts", "_top", "_tops")


def shared_names(undecided: DataFrame, completeness: DataFrame, key: str = "name_key") -> DataFrame:
    """Per name group: accept its one decisive row if no other has a positive score, else say why it is ambiguous.

    undecided: top candidates of undecided rows. completeness: (left_id, completeness).
    """
    top = undecided.where("is_top").join(completeness, "left_id", "left")
    rows = top.groupBy(key, "left_id").agg(
        F.max("top_score").alias("top_score"), F.bool_and("top_unique").alias("unique"), F.max("draft_match").alias("draft"), F.max("completeness").alias("completeness"), F.array_sort(F.collect_set("right_id")).alias("candidates")
    )
    g = Window.partitionBy(key)
    decisive = F.col("unique") & ((F.col("draft") == 1) | (F.col("top_score") >= DECISIVE))
    n = lambda x: F.sum(x.cast("int")).over(g)
    rows = rows.withColumns({"_d": decisive, "_nd": n(decisive), "_np": n(F.col("top_score") > 0), "_n": F.count(F.lit(1)).over(g), "_shell": F.max(F.greatest(F.col("top_score"), F.coalesce("completeness", F.lit(0)))).over(g) <= 0, "_sets": F.size(F.collect_set("candidates").over(g))})
    one = (F.col("_nd") == 1) & (F.col("_np") == 1)
    status = F.when(one, F.when(F.col("_d"), "shared_name_strongest_row_winner").otherwise("shared_name_strongest_row_winner_loser")).when((F.col("_n") >= 2) & F.col("_shell") & (F.col("_sets") == 1), "duplicate_rows_no_metadata_owner").otherwise("manual_shared_name_collision")
    return rows.select(key, "left_id", F.col("candidates")[0].alias("right_id"), status.alias("status"), (one & F.col("_d")).alias("accepted"))


def ownership(proposals: DataFrame) -> DataFrame:
    """One winner per right id by evidence, score, method, completeness and the lowest left id; `winner` names it."""
    method = F.coalesce(*[F.when(F.col("reason") == m, i) for i, m in enumerate(METHOD_ORDER)], F.lit(-1))
    by = ["draft_match", "school_match", "weight_match", "position_match", "score"]
    order = Window.partitionBy("right_id").orderBy(*[F.col(c).desc() for c in by], method.desc(), F.col("completeness").desc(), F.col("left_id"))
    return proposals.withColumns({"place": F.row_number().over(order), "winner": F.first("left_id").over(order)}).withColumn("owns", F.col("place") == 1)


def link(left: DataFrame, right: DataFrame, overrides: DataFrame | None = None, blocked: Sequence[str] = ()) -> DataFrame:
    """(left_id, right_id, status): accepted, duplicate, ambiguous, unmatched_left or unmatched_right.

    Overrides (left_id, right_id) come first, then the choice rules, then shared names, then ownership.
    """
    forced = overrides.select("left_id", "right_id") if overrides is not None else None
    open_left = left.join(forced, "left_id", "left_anti") if forced is not None else left
    pairs = chosen(scored(open_left, right), blocked)
    done = left.select("left_id", F.coalesce("completeness", F.lit(0)).alias("completeness"))
    evidence = ["draft_match", "school_match", "weight_match", "position_match", "score", "reason"]
    accepted = pairs.where("accepted").select("left_id", "right_id", *evidence)
    shared = shared_names(pairs.where("not decided"), done)
    won = shared.where("accepted").join(pairs.select("left_id", "right_id", *[e for e in evidence if e != "reason"]), ["left_id", "right_id"]).withColumn("reason", F.col("status")).select("left_id", "right_id", *evidence)
    proposals = accepted.unionByName(won)
    if forced is not None:
        proposals = proposals.unionByName(forced.select("left_id", "right_id", *[F.lit(9999 if e == "score" else 1).alias(e) for e in evidence[:-1]], F.lit("manual_override").alias("reason")))
    owned = ownership(proposals.join(done, "left_id"))
    out = owned.select("left_id", "right_id", F.when(F.col("owns"), "accepted").otherwise("duplicate").alias("status"))
    unclear = shared.where("not accepted").select("left_id", F.lit(None).cast(right.schema["right_id"].dataType).alias("right_id"), F.lit("ambiguous").alias("status"))
    seen = out.select("left_id").unionByName(unclear.select("left_id"))
    alone = left.select("left_id").join(seen, "left_id", "left_anti").select("left_id", F.lit(None).cast(right.schema["right_id"].dataType).alias("right_id"), F.lit("unmatched_left").alias("status"))
    free = right.select("right_id").join(owned.where("owns").select("right_id"), "right_id", "left_anti").select(F.lit(None).cast(left.schema["left_id"].dataType).alias("left_id"), "right_id", F.lit("unmatched_right").alias("status"))
    return out.unionByName(unclear).unionByName(alone).unionByName(free)


# ---------------------------------------------------------------- HTML records


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One typed record per page: language, title, counts of links, paragraphs and list items, and visible characters."""
    h = F.col(html)
    text = F.regexp_replace(F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return pages.select(
        key, null_if_empty(F.regexp_extract(h, r'<html[^>]*\blang="([^"]*)"', 1)).alias("lang"), null_if_empty(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        F.regexp_count(h, F.lit(r"<a ")).alias("n_links"), F.regexp_count(h, F.lit(r"<p>")).alias("n_paragraphs"), F.regexp_count(h, F.lit(r"<li>")).alias("n_items"), F.length(plain).alias("n_visible"),
    )


def page_rows(pages: DataFrame, pattern: str, fields: Sequence[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per match of `pattern` (one group per field) in a page, numbered from 0."""
    found = {f: F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i, f in enumerate(fields, 1)}
    rows = pages.select(key, *[c.alias(f) for f, c in found.items()]).select(key, F.posexplode(F.arrays_zip(*fields)).alias("n", "r"))
    return rows.select(key, "n", *[null_if_empty(F.col(f"r.{f}")).alias(f) for f in fields])


def labels(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(label, pages, occurrences, sample) of the labels that `pattern`'s group finds."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("label"))
    per_page = found.groupBy("label", key).agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("label").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("occurrences"), F.min(key).alias("sample"))


def better_duplicates(rows: DataFrame, keys: Sequence[str], prefer: Sequence[Column] = ()) -> DataFrame:
    """The most filled row per key, then by `prefer`."""
    return best_row(rows, keys, ties=prefer)
