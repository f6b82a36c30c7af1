"""Personal data: format-preserving Feistel pseudonyms, in SQL functions only.

Candidates are found by pattern and validated (calendar dates, address octets, Luhn digits, number ranges). A valid value
is a number of a finite domain of u x v values; a keyed Feistel network over (a, b) with 0 <= a < u, 0 <= b < v permutes
that domain, and the result is written in the value's own format. So equal values get equal pseudonyms in all
documents, different values of a kind different ones, and whoever holds the key can invert them.

Kinds: date (1900 to 2099), ip, ssn, card (13 to 19 digits whose Luhn sum holds, before and after), phone (the country
code stays). An email is neither a number nor a date: its local part becomes a keyed token of 96 bits, which links equal
addresses but can't be inverted; the domain stays.

Null text stays null, empty text empty. What fails validation stays as it is. Repeated rows are treated alike, ties don't
arise, an empty table gives no rows. Very long texts are read whole, in time linear in their length: no pattern starts
anew within a run that it has already read. Columns of the input keep their names and values (but for the text); where
one has the name of the added column, that gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import free_name, table

#: Stands in for the secret key, which a caller passes; rounds of the Feistel network.
KEY, ROUNDS = "scorebook-demo-key", 10

# The formats, the most specific first.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
    "date": r"(?<![\d.])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?!\d|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d|-\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})(?!\d)",
}
ANY = "|".join(KINDS.values())
#: Days from 1900-01-01 to 2099-12-31 are 17 x 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def permuted(a: Column, b: Column, u: Column, v: Column, tweak: Column, key: str) -> Column:
    """struct(a, b): the keyed permutation of the pairs 0 <= a < u, 0 <= b < v; `tweak` selects it."""
    prf = lambda i, x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + prf(i, s["b"])) % s["u"]).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + prf(i, s["a"])) % s["v"]).alias("b"),
            s["u"].alias("u"),
            s["v"].alias("v"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), u.cast("long").alias("u"), v.cast("long").alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """A string of 2 to 19 digits of the same length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    part = permuted(
        F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, n).cast("long"),
        power(left), power(n - left), F.concat_ws(":", tweak, n.cast("string")), key,
    )
    text = F.transform(F.array(part), lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), n - left, "0")))
    return text[0]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted once."""
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).cast("int"))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def refilled(value: Column, digits: Column) -> Column:
    """`value` with its digits replaced, one by one, by those of `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(F.split(value, ""), start, step)["out"]


def kind_of(value: Column) -> Column:
    """The validated kind of a candidate, or null."""
    whole = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    digits = digits_of(value)
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    n = F.length(digits)
    return (
        F.when(whole("email"), "email")
        .when(whole("date"), F.when(date_of(value).isNotNull(), "date"))
        .when(whole("ip"), F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(whole("ssn"), F.when((area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000"), "ssn"))
        .when(whole("card"), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(whole("phone"), F.when(n.between(10, 15), "phone"))
    )


def date_of(value: Column) -> Column:
    """The date of a candidate in one of the three formats; null if there's no such day."""
    return (
        F.when(value.contains("-"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")))
        .when(value.contains("/"), F.try_to_timestamp(value, F.lit("MM/dd/yyyy")))
        .otherwise(F.try_to_timestamp(value, F.lit("dd.MM.yyyy")))
        .cast("date")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value; null for other kinds."""
    day = F.datediff(date_of(value), F.lit(FIRST_DAY).cast("date"))
    date_pair = permuted(F.floor(day / DAYS[1]), day % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
    new_day = F.transform(F.array(date_pair), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")))[0]
    new_date = F.when(value.contains("-"), F.date_format(new_day, "yyyy-MM-dd")).when(value.contains("/"), F.date_format(new_day, "MM/dd/yyyy")).otherwise(F.date_format(new_day, "dd.MM.yyyy"))
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    ip_pair = F.transform(
        F.array(permuted(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)),
        lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256)]),
    )[0]
    digits = digits_of(value)
    # ssn: 898 areas (001 to 899 without 666) x (99 groups x 9999 serials)
    area = F.substring(value, 1, 3).cast("long")
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    rest = (F.substring(value, 5, 2).cast("long") - 1) * 9999 + F.substring(value, 8, 4).cast("long") - 1
    new_ssn = F.transform(
        F.array(permuted(area, rest, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)),
        lambda p: F.concat_ws(
            "-",
            F.lpad((p["a"] + 1 + F.when(p["a"] + 1 >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"),
        ),
    )[0]
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key)
    new_card = F.transform(F.array(body), lambda d: F.concat(d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))[0]
    # phone: the ten last digits are permuted, what stands before them is the country code
    lead = F.length(digits) - 10
    new_phone = F.concat(F.substring(digits, F.lit(1), lead), permuted_digits(F.substring(digits, lead + 1, F.lit(10)), F.lit("phone"), key))
    token = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 24)
    return (
        F.when(kind == "email", F.concat(F.lit("u"), token, F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "date", new_date)
        .when(kind == "ip", ip_pair)
        .when(kind == "ssn", new_ssn)
        .when(kind == "card", refilled(value, new_card))
        .when(kind == "phone", refilled(value, new_phone))
    )


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, out_col: str | None = None, found_col: str = "pii") -> DataFrame:
    """`docs` with the pseudonymised text (in `text_col` or `out_col`) and `found_col`: array of (kind, pseudonym)."""
    text, work, found_col = F.col(text_col), free_name(docs.columns, "_pii"), free_name(docs.columns, found_col)
    values = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(values, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    done = F.transform(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), pseudonym(x["v"], x["kind"], key).alias("new")))
    docs = docs.withColumn(work, done)
    new = F.transform(work, lambda x: F.coalesce(x["new"], x["v"]))
    rebuilt = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    found = F.transform(F.filter(work, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym")))
    changed = F.exists(work, lambda x: x["kind"].isNotNull())
    return docs.withColumns({out_col or text_col: F.when(changed, rebuilt).otherwise(text), found_col: found}).drop(work)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    docs = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select("doc_id", "text", *[n(k) for k in KINDS], F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["pseudonym"])), ",").alias("pseudonyms"))
