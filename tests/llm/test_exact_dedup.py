"""Exact deduplication: brute force, collisions, hot keys, edges."""

import hashlib
from collections import defaultdict

import pytest

from scorebook.llm import common, exact_dedup

SCHEMA = "doc_id long, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    """(id, text) -> what each row should get, as a sorted list."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (max(known) if known else None), True
        for i in sorted(ids, key=lambda i: (i is not None, i), reverse=True):
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in df.collect()), key=str)


ROWS = [
    (1, "Same TEXT"), (2, "same text"), (3, "SAME text "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000),
    (10, "once"), (11, "a"), (12, "A"), (12, "a"), (12, "a"), (None, "a"), (None, "only nulls"), (None, "only nulls"), (13, "\x00"), (14, "tab\t"),
]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_against_brute_force(spark, bits):
    """With few bits of the hash, most keys collide and chains have many links."""
    assert found(exact_dedup.copies(spark.createDataFrame(ROWS, SCHEMA), key_bits=bits)) == brute(ROWS)


@pytest.mark.parametrize("bits", [64, 2])
def test_hot_group(spark, monkeypatch, bits):
    """A third of all rows hold one text: its key is hot, its copies are compared where they lie."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 150}") for i in range(900)]
    monkeypatch.setattr(exact_dedup, "least_hot", lambda n: 100)
    assert found(exact_dedup.copies(spark.createDataFrame(rows, SCHEMA), key_bits=bits)) == brute(rows)


def test_directory_doubles_until_buckets_fit(spark):
    """Buckets are disjoint key ranges; each fits, and the range that it was split from didn't."""
    keys = [(((i * 2654435761) % (1 << 20)) << 44, 100) for i in range(500)] + [((5 << 44) + i, 100) for i in range(50)]
    keys = [(k - (1 << 64) if k >= 1 << 63 else k, b) for k, b in keys]
    got = exact_dedup.directory(spark.createDataFrame(keys, "key long, bytes long"), least=1000).collect()
    most = exact_dedup.MOST_DOUBLINGS
    size = defaultdict(int)
    for k, b in keys:
        size[(k % (1 << 64)) >> (64 - most)] += b
    assert {r.slot for r in got} == set(size)

    def held(bucket, depth):
        return sum(b for s, b in size.items() if s >> (most - depth) == bucket >> (most - depth))

    for r in got:
        assert r.bucket == r.slot >> (most - r.depth) << (most - r.depth)
        assert held(r.bucket, r.depth) <= 1000 or r.depth == most
        assert r.depth == 0 or held(r.bucket, r.depth - 1) > 1000
    assert len({r.depth for r in got}) > 1


def test_bitmap_loses_no_key(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) as key")
    marks, bits = common.bitmap(keys, "key", 3000)
    assert common.may_have(keys, "key", marks, bits).count() == 3000
    others = spark.range(10_000, 30_000).selectExpr("xxhash64(id) as key", "id as marks", "id as part")
    passed = common.may_have(others, "key", marks, bits)
    assert passed.count() < 3000 and passed.columns == others.columns


def test_empty_and_clashing_names(spark):
    assert exact_dedup.copies(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a", "x", "p"), (2, "A", "y", "q"), (3, "b", None, "r")], "row long, key string, norm string, n string")
    assert sorted(map(tuple, exact_dedup.keep_last(docs, "row", "key").collect())) == [(2, "A", "y", "q"), (3, "b", None, "r")]
    assert exact_dedup.keep_last(docs, "row", "key").columns == docs.columns


def test_ids_of_other_types(spark):
    got = exact_dedup.copies(spark.createDataFrame([("b", "t"), ("a", "T"), ("c", "u")], "doc_id string, text string")).collect()
    assert {(r.id, r.keep_id, r.kept) for r in got} == {("b", "b", True), ("a", "b", False), ("c", "c", True)}
