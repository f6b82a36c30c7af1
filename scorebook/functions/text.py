"""Column helpers for conversion and text; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters and what they fold to, suffixes of names, truth words.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçčćšžđÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕØŌÚÙÛÜŪÝŸÑÇČĆŠŽĐ"
FOLDED = "aaaaaaaeeeeeiiiiiooooooouuuuuyyncccszdAAAAAAAEEEEEIIIIIOOOOOOOUUUUUYYNCCCSZD"
NAME_SUFFIXES = r"\b(jr|sr|ii|iii|iv|v)$"
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def null_if_empty(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def to_int(c: Column) -> Column:
    """Whole number of text or a number; null if it isn't one. 12.0 counts as 12."""
    return F.coalesce(c.try_cast("long"), F.floor(c.try_cast("double")).try_cast("long"))


def to_positive_int(c: Column) -> Column:
    n = to_int(c)
    return F.when(n > 0, n)


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    word = F.lower(null_if_empty(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_int_list(c: Column) -> Column:
    """array<long> of an array column; entries that aren't whole numbers are left out."""
    return F.filter(F.transform(c, to_int), lambda x: x.isNotNull())


def to_str_list(c: Column) -> Column:
    return F.filter(F.transform(c, null_if_empty), lambda x: x.isNotNull())


def normalized_game_id(c: Column) -> Column:
    """The last ten digits, zero-padded; text without a digit stays as it is."""
    text = null_if_empty(c)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(digits == "", text).otherwise(F.lpad(F.right(digits, F.lit(10)), 10, "0"))


def folded(c: Column) -> Column:
    """Without accents."""
    return F.translate(c, ACCENTED, FOLDED)


def normalized_name(c: Column, keep_suffix: bool = False) -> Column:
    """Lower-case words without accents, punctuation and (unless kept) a name suffix."""
    plain = F.regexp_replace(F.lower(folded(c)), r"[.'’]", "")
    words = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return null_if_empty(words if keep_suffix else F.trim(F.regexp_replace(words, NAME_SUFFIXES, "")))


def normalized_school(c: Column) -> Column:
    """A school's name without 'university', 'college' and filler words."""
    words = F.regexp_replace(normalized_name(c, keep_suffix=True), r"\b(university|college|the|of|at)\b", " ")
    return null_if_empty(F.regexp_replace(words, " +", " "))


def alphanumeric(c: Column) -> Column:
    """Lower-case letters and digits only: the key of aliases and action types."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def position_tokens(c: Column) -> Column:
    """Distinct positions (guard, forward, center) that a free text names."""
    names = {"guard": "guard", "g": "guard", "pg": "guard", "sg": "guard", "forward": "forward", "f": "forward", "sf": "forward", "pf": "forward", "center": "center", "c": "center"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: known[w]), lambda x: x.isNotNull())))


def position_group(c: Column) -> Column:
    """guard, forward, center, wing (guard and forward), big (forward and center) or unknown."""
    p = F.regexp_replace(F.upper(null_if_empty(c)), "[-/ ]", "")
    has = lambda x: p.contains(x)
    return (
        F.when(has("G") & has("F"), "wing").when(has("F") & has("C"), "big")
        .when(has("G"), "guard").when(has("F"), "forward").when(has("C"), "center").otherwise("unknown")
    )


def free_throw_trip(c: Column) -> Column:
    """struct(number, of) of a text such as '1 of 2'; null fields without one."""
    pattern = r"(\d+) of (\d+)"
    part = lambda i: F.regexp_extract(c, pattern, i).try_cast("int")
    return F.struct(part(1).alias("number"), part(2).alias("of"))


def replaced_name(c: Column) -> Column:
    """NAME of a description 'NAME ... replaced by NAME'."""
    return null_if_empty(F.regexp_extract(c, r"(?i)replaced by\s+([^,(]+)", 1))


def replaced_people(events: DataFrame, roster: DataFrame, by: Sequence[str], description: str = "description") -> DataFrame:
    """Add replaced_name and replaced_id: the roster's person of that name, if only one of its team (`by`) has it.

    roster: the columns `by`, name and person_id. Case and spaces around a name don't matter.
    """
    key = lambda c: F.lower(F.trim(c))
    one = roster.groupBy(*by, key(F.col("name")).alias("_name")).agg(F.min("person_id").alias("replaced_id"), F.count_distinct("person_id").alias("_n")).where("_n = 1").drop("_n")
    named = events.withColumn("replaced_name", replaced_name(F.col(description)))
    return named.withColumn("_name", key(F.col("replaced_name"))).join(one, [*by, "_name"], "left").drop("_name")


def shot_type_label(sub_type: Column, descriptor: Column) -> Column:
    return null_if_empty(F.initcap(F.concat_ws(" ", null_if_empty(descriptor), null_if_empty(sub_type))))


def shot_type_family(sub_type: Column) -> Column:
    """dunk, layup, hook, fadeaway, jump_shot or other, by the words of the sub-type."""
    t = F.lower(sub_type)
    chain = F.when(t.contains("dunk"), "dunk").when(t.contains("layup"), "layup").when(t.contains("hook"), "hook")
    return chain.when(t.contains("fade"), "fadeaway").when(t.contains("jump"), "jump_shot").otherwise("other")


def shot_type_key(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(label)), "[^a-z0-9]+", "_")


def lineup_id(people: Column) -> Column:
    """Distinct person ids, sorted as text and joined by '-'."""
    return null_if_empty(F.array_join(F.array_sort(F.array_distinct(F.transform(people, lambda x: x.cast("string")))), "-"))


def lineup_people(c: Column) -> Column:
    return F.transform(F.split(c, "-"), lambda x: x.try_cast("long"))


def has_qualifier(qualifiers: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.transform(qualifiers, alphanumeric), name), F.lit(False))


def like_pattern(text: str) -> str:
    """`text` with the wildcards of LIKE escaped, as a contains pattern."""
    return "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
