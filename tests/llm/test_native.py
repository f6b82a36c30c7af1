"""Pseudonyms, mixing and sharding: the operators in SQL functions only."""

import datetime
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scorebook.llm import mixing, pii, sharding


def luhn(digits):
    d = [int(x) for x in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def values(spark, texts, key=pii.KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pii.pseudonymise(df, key=key).orderBy("doc_id").collect()]


def test_formats_hold_and_values_stay_linked(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111.", "see 192.168.0.17 and 192.168.0.17!", "born 1984-02-29 or 29.02.1984 or 02/29/1984", "call +1 (212) 555-0142 now", "ssn 123-45-6789 here",
        "mail Jane.Doe+x@mail.example.org, ok", "4111 1111 1111 1111",
    ]
    got = values(spark, texts)
    pick = lambda i, p: re.findall(p, got[i].text)
    a, b = pick(0, r"\d{4} \d{4} \d{4} \d{4}|\d{16}")
    assert a.replace(" ", "") == b and luhn(b) and b != "4111111111111111" and got[6].text == a
    ips = pick(1, r"\d+\.\d+\.\d+\.\d+")
    assert len(set(ips)) == 1 and ips[0] != "192.168.0.17" and all(int(x) < 256 for x in ips[0].split("."))
    d = [x.pseudonym for x in got[2].pii]
    one = {datetime.date.fromisoformat(d[0]), datetime.datetime.strptime(d[1], "%d.%m.%Y").date(), datetime.datetime.strptime(d[2], "%m/%d/%Y").date()}
    assert len(one) == 1 and 1900 <= one.pop().year < 2100
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", got[3].text) and got[3].text != texts[3]
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} here", got[4].text) and got[4].text != texts[4]
    assert re.fullmatch(r"mail u[0-9a-f]{24}@mail\.example\.org, ok", got[5].text)


def test_what_is_not_valid_stays(spark):
    texts = [None, "", "no digits", "ip 300.1.2.3", "date 2024-02-30", "card 4111 1111 1111 1112", "ssn 000-12-3456", "Version 4.0. and 1234 5.", "x" * 100_000 + " 12"]
    got = values(spark, texts)
    assert [r.text for r in got] == texts and not any(r.pii for r in got)


def plain_feistel(a, b, u, v, tweak, key=pii.KEY):
    """The permutation in plain Python."""
    for i in range(pii.ROUNDS):
        x = b if i % 2 == 0 else a
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
        a, b = ((a + h) % u, b) if i % 2 == 0 else (a, (b + h) % v)
    return a, b


def plain_digits(d, tweak):
    n, left = len(d), len(d) // 2
    a, b = plain_feistel(int(d[:left]), int(d[left:]), 10**left, 10 ** (n - left), f"{tweak}:{n}")
    return f"{a:0{left}d}{b:0{n - left}d}"


def plain_pseudonym(kind, value):
    """The pseudonym of one value by its kind, in plain Python."""
    digits = re.sub(r"\D", "", value)
    if kind == "date":
        day = (datetime.date.fromisoformat(value) - datetime.date(1900, 1, 1)).days
        a, b = plain_feistel(*divmod(day, 4297), 17, 4297, "date")
        return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).isoformat()
    if kind == "ip":
        x = [int(o) for o in value.split(".")]
        a, b = plain_feistel(x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536, "ip")
        return ".".join(map(str, (*divmod(a, 256), *divmod(b, 256))))
    if kind == "ssn":
        area = int(value[:3]) - 1 - (int(value[:3]) > 666)
        a, b = plain_feistel(area, (int(value[4:6]) - 1) * 9999 + int(value[7:]) - 1, 898, 99 * 9999, "ssn")
        return f"{a + 1 + (a + 1 >= 666):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "card":
        body = plain_digits(digits[:-1], "card")
        new = next(body + c for c in "0123456789" if luhn(body + c))
    else:
        new = digits[:-10] + plain_digits(digits[-10:], "phone")
    fresh = iter(new)
    return "".join(next(fresh) if c.isdigit() else c for c in value)


def test_pseudonyms_are_those_of_plain_python(spark):
    rng, cases = random.Random(12), []
    for _ in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 15, 18])))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        cases += [
            ("date", (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(17 * 4297))).isoformat()), ("ip", ".".join(str(rng.randrange(256)) for _ in range(4))), ("card", card),
            ("ssn", f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"), ("phone", f"+{rng.randrange(1, 999)} {rng.randrange(100, 1000)} {rng.randrange(100, 1000)} {rng.randrange(1000, 10000)}"),
        ]
    got = values(spark, [f"see {v} there" for _, v in cases])
    for (kind, v), r in zip(cases, got, strict=True):
        assert [(x.kind, x.pseudonym) for x in r.pii] == [(kind, plain_pseudonym(kind, v))] and r.text == f"see {plain_pseudonym(kind, v)} there", (kind, v)


def test_unbroken_texts_take_linear_time(spark):
    for n in (20_000, 200_000):
        texts = [c * n + " 12" for c in ("x", "x.", "7", "1.", "a@", "-", "+1 ", "x@y.")] + ["a@" + "b." * n]
        start = time.time()
        got = values(spark, texts)
        assert len(got) == len(texts) and time.time() - start < 60, n
    assert values(spark, ["x" * 300_000 + " and me@mail.example.org"])[0].text.endswith(".example.org")


def test_own_columns_stay_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "at 10.1.2.3", "mine", "x")], "doc_id long, text string, PII string, _pii string")
    r = pii.pseudonymise(df).collect()[0]
    assert (r.PII, r._pii, [x.kind for x in r.pii_]) == ("mine", "x", ["ip"])
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_permutation_has_no_collisions(spark):
    n = 3000
    df = spark.range(n).select(F.concat_ws(".", *[F.lit("10"), F.lit("0"), F.floor(F.col("id") / 256), F.col("id") % 256]).alias("text"), F.col("id").alias("doc_id"))
    assert pii.pseudonymise(df).select("text").distinct().count() == n
    days = spark.range(n).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days).select("text").distinct().count() == n
    small = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert small.select(pii.permuted_digits(F.col("d"), F.lit("t"), "k").alias("p")).where(F.col("p").rlike("^[0-9]{3}$")).distinct().count() == 1000


def test_keys_differ_and_extra_columns(spark):
    a, b = (values(spark, ["at 10.1.2.3"], key=k)[0].text for k in ("one", "two"))
    assert a != b
    df = spark.createDataFrame([(1, "at 10.1.2.3", "keep")], "doc_id long, text string, kind string")
    assert pii.pseudonymise(df).collect()[0].kind == "keep"


def check_mix(got, block, weights):
    """Every prefix of slots gives each source its share to within less than one block, as long as all last."""
    source = {}
    for r in got:
        assert source.setdefault(r.mix_slot, r.source) == r.source
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    assert sorted(source) == list(range(len(source)))
    left = Counter(source.values())
    active, done, start = {s: weights[s] for s in left}, Counter(), 0
    for slot in range(len(source)):
        done[source[slot]] += 1
        left[source[slot]] -= 1
        total = sum(active.values())
        for s, w in active.items():
            assert abs(done[s] - w * (slot + 1 - start) / total) < 1
        if not left[source[slot]]:
            active.pop(source[slot])
            done, start = Counter(), slot + 1
    sizes = Counter(r.mix_slot for r in got)
    assert max(sizes.values()) <= block


def test_mixing_lag_is_under_one_block(spark):
    sizes = {"a": 700, "b": 90, "c": 33, None: 10}
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string, s string")
    weights = {"a": 5, "b": 3, "c": 1}
    got = mixing.mix(df, weights, block_rows=4).select("doc_id", F.coalesce("source", F.lit("(null)")).alias("source"), "mix_slot", "mix_release", "mix_deadline", "mix_position").collect()
    assert len(got) == 833 and len({r.mix_position for r in got}) == 833 and {r.doc_id for r in got} == set(range(833))
    check_mix(got, 4, weights | {"(null)": 1})


def check_schedule(blocks, weights):
    """Each block in its window, all slots filled, and each source's lag under one block in each phase."""
    got = list(mixing.schedule(blocks, weights))
    assert [x[2] for x in got] == list(range(sum(blocks))) and all(r <= slot < d for _, _, slot, r, d in got)
    left, active = list(blocks), [s for s, n in enumerate(blocks) if n]
    done, start = [0] * len(blocks), 0
    for s, j, slot, _, _ in got:
        assert j == blocks[s] - left[s]
        done[s] += 1
        left[s] -= 1
        total = sum(weights[x] for x in active)
        assert all(abs(done[x] * total - weights[x] * (slot + 1 - start)) < total for x in active)
        if not left[s]:
            active.remove(s)
            done, start = [0] * len(blocks), slot + 1


def test_schedules_meet_windows():
    rng = random.Random(2)
    check_schedule([5], [1])
    check_schedule([], [])
    check_schedule([3, 0, 4], [1, 1, 1])
    for _ in range(40):
        n = rng.randrange(1, 30)
        sizes = [rng.choice([1, rng.randrange(1, 5), rng.randrange(1, 60)]) for _ in range(n)]
        check_schedule(sizes, [rng.choice([1, rng.randrange(1, 10), rng.randrange(1, 10**12)]) for _ in range(n)])
    check_schedule([30] * 9 + [300], mixing.whole_weights([x**0.5 for x in [30] * 9 + [300]]))


def test_mixing_of_many_sources(spark, monkeypatch):
    """More sources than blocks, most of them smaller than one, a hot one with a third of all rows, fractional weights."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 1000)
    names = ["hot"] * 2000 + [f"mid{i % 330}" for i in range(3300)] + [f"tiny{i}" for i in range(700)]
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    got = mixing.mix(df, block_rows=8).collect()
    assert len(got) == 6000 and len({r.mix_position for r in got}) == 6000 and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    slots = defaultdict(set)
    for r in got:
        slots[r.mix_slot].add("tiny" if r.source.startswith("tiny") else r.source)
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    # as long as all last, the hot source has its share to within one block
    shares = {"hot": 2000**0.5, "mid": 330 * 10**0.5, "tiny": 700.0}
    ends = min(max(k for k, s in slots.items() if x in s) for x in {r.source for r in got if not r.source.startswith("tiny")} | {"tiny"})
    for k in range(ends):
        hot = sum("hot" in slots[x] for x in range(k + 1))
        assert abs(hot - (k + 1) * shares["hot"] / sum(shares.values())) < 1


def test_mixing_of_sources_under_a_block(spark):
    """Few small sources are scheduled each on its own: weights decide which comes first."""
    df = spark.createDataFrame([(i, f"s{i % 300}") for i in range(900)], "doc_id long, source string")
    for first in ("s7", "s123"):
        got = mixing.mix(df, {first: 1000}).collect()
        assert len({(r.source, r.mix_slot) for r in got}) == 300 and {r.source for r in got if r.mix_slot == 0} == {first}


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(empty).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, source string")
    assert sorted(r.mix_position for r in mixing.mix(same).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        mixing.mix(same, {"a": 0})
    own = spark.createDataFrame([(i, None if i % 2 else "(none)", "mine", 7, 8) for i in range(40)], "doc_id long, source string, mix_slot string, block long, sid long")
    got = mixing.mix(own, {None: 3, "(none)": 1}, block_rows=4)
    assert got.columns == [*own.columns, "mix_block", "mix_slot_", "mix_release", "mix_deadline", "mix_position"]
    got = sorted(got.collect(), key=lambda r: r.mix_position)
    assert all((r.mix_slot, r.block, r.sid) == ("mine", 7, 8) for r in got) and sum(r.source is None for r in got[:16]) == 12


def test_shards_are_even_and_slots_gapless(spark):
    texts = ["same text of a hot group " * 4] * 900 + [f"text {i} " * (1 + i % 40) for i in range(3000)] + [None, "", "é"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    got = sharding.shard_by_bytes(df).collect()
    slots, size = defaultdict(list), Counter()
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert len(got) == len(texts) and set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.05 * min(size.values())
    of = defaultdict(set)
    for r in got:
        of[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in of.values()) <= 1  # only the hot group may be cut


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string")
    got = sharding.shard_by_bytes(df).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_many_sources_take_linear_time():
    """131,072 sources that run out one after the other, each scheduled on its own, in a few seconds, none off by a block."""
    import time

    start, n = time.time(), 1 << 17
    blocks, weights = [1 + i % 3 for i in range(n)], [1 + i % 7 for i in range(n)]
    plan = list(mixing.schedule(blocks, weights))
    assert time.time() - start < 20 and [slot for _, _, slot, _, _ in plan] == list(range(sum(blocks)))
    assert Counter(s for s, *_ in plan) == Counter({s: b for s, b in enumerate(blocks)})
    assert all(release <= slot < deadline for _, _, slot, release, deadline in plan)
    equal = list(mixing.schedule([2] * 3000, [1] * 3000))
    assert [s for s, *_ in equal[:3000]] == list(range(3000)) and all(release <= slot < deadline for _, _, slot, release, deadline in equal)
