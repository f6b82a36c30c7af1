"""Phrase collocations: brute force over shards, orders and shares; edges."""

import random
import re
from collections import Counter, defaultdict

import pytest

from scorebook.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top=phrases.TOP):
    f, size = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items())
            if not covered:
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, size[lang], -s))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def prose(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "naïve", "x\x0by", "new\tyork", "Los Angeles"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "!", ";;", "\r\n"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends[:3] * 4 + ends) for _ in range(rng.randint(0, 60)))
        out.append((i, text + (" of the United States of " * rng.randint(0, 2)), rng.choice(["en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 25, 4000, 1])
def test_against_brute_force(spark, shard_bytes):
    """One shard, some shards with shares over one, and shards so small that every share is under one."""
    rows = prose(300)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=6, shard_bytes=shard_bytes)
    assert found(got) == brute(rows, 6) and len(brute(rows, 6)) > 30


def test_hot_rows_and_ties(spark):
    """A third of the rows repeat one text; phrases of equal score and count are ranked by bytes."""
    rows = prose(60, 5) + [(99, "the same line again, The Same line again b a c", "en")] * 60
    assert found(phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=20, shard_bytes=3000)) == brute(rows, 5, 20)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .,\t", "en"), (4, "a b", "en")], SCHEMA)).count() == 0
    long = "a b c d " * 40_000
    rows = [(1, long, "en"), (2, None, "en")]
    named = spark.createDataFrame([(i, t, g, 1, 2) for i, t, g in rows], "n long, phrase string, rank string, h long, whole long")
    assert found(phrases.collocations(named, "phrase", "rank", shard_bytes=1000)) == brute(rows, 30)


def test_counts_past_64_bits(spark):
    """2000000 a may pass 64 bits; the quotient is exact."""
    row = spark.sql("select cast(5000000000000 as bigint) as a, cast(4999999999999 as bigint) as l, cast(1 as bigint) as r")
    out = row.selectExpr(f"cast((cast(a as decimal(19, 0)) * {phrases.SCALE}) div (cast(l as decimal(19, 0)) + r) as long) as s").first().s
    assert out == 5_000_000_000_000 * 2_000_000 // 5_000_000_000_000


def test_marks_lose_nothing(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) as h")
    marks = phrases.Marks(phrases.marks_of(rows))
    import numpy as np

    mine = np.array([r.h for r in rows.collect()], dtype=np.int64).view(np.uint64)
    other = np.array([r.h for r in spark.range(10_000, 20_000).selectExpr("xxhash64(id) as h").collect()], dtype=np.int64).view(np.uint64)
    assert marks.test(mine).all() and marks.test(other).mean() < 0.05
