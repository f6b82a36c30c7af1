"""Prefix trie: brute force at several crowds, edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scorebook.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:]) if rebuilt else tuple(ts)
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if paths[c] == p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def talks(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 and c % 3 else rng.choice(["yes", "no", f"é{c % 7}", ""])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [64, 1, 5])
@pytest.mark.parametrize("rebuilt", [True, False])
def test_against_brute_force(spark, crowd, rebuilt):
    """A common first turn; with a small crowd most inner nodes are crowded ones."""
    rows = talks(120)
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), least_crowd=crowd, rebuilt=rebuilt)) == brute(rows, rebuilt)


def test_copies_and_long_conversations(spark):
    """A third of the conversations are equal and end at one crowded node; some are deep; ids are negative or large."""
    rows = [(c, t, "user", f"same {t}") for c in range(-30, 60) for t in range(4)]
    rows += [(10**12 + c, t, "user", f"deep {t if t < 150 else (t, c)}") for c in range(4) for t in range(200)]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), least_crowd=8))
    assert got == brute(rows)


def test_edges(spark, monkeypatch):
    """Null turn, role, text and id; repeated rows; turnless conversations; a missing base; clashing names."""
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 2)
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 2, "", ""), (None, 0, "user", "lost"), (7, 0, "user", "x" * 200_000), (8, 0, "u", "v"), (8, 0, "u", "v"), (8, 0, "u", "w")]
    rows += [(c, 0, "user", "only") for c in range(11, 40)]  # base 10 has no rows
    assert found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), least_crowd=3)) == brute(rows)
    named = spark.createDataFrame([(*r, "z") for r in rows], "keys long, sizes long, conv string, depth string, base string")
    assert found(prefix_trie.trie(named, "keys", "sizes", "conv", "depth", least_crowd=3)) == brute(rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_role_and_text_keep_apart(spark):
    """The same characters, cut differently into role and text, are different turns."""
    rows = [(0, 0, "ab", "c"), (1000, 0, "a", "bc"), (2000, 0, "a1:b", "c")]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), rebuilt=False))
    assert got == brute(rows, False) and sum(r[1] == 1 for r in got) == 3
