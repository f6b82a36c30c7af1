import random

import numpy as np

from scorebook.llm import minhash


def shingles(text, k):
    w = minhash.words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def variants(seed, groups, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \t\n", "one", "ONE", "one two three", "one two three"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_against_brute_force(docs, rows):
    texts = variants(3, 25, 9)
    for k in (4, 5):
        assert rows(minhash.near_duplicates(docs(texts), k=k)) == sorted(brute(texts, k), key=lambda r: str(r[0]))


def test_large_bucket_goes_through_local_leaders(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "FAN", 3)
    monkeypatch.setattr(minhash, "OUTSIDERS", 4)
    monkeypatch.setattr(minhash, "INSIDERS", 5)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    assert rows(minhash.near_duplicates(docs(texts), k=4)) == sorted(brute(texts, 4), key=lambda r: str(r[0]))


def test_components(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 102), (101, 102), (7, 30)], "a long, b long")
    want = [(i, 1) for i in range(2, 41)] + [(101, 100), (102, 100)]
    assert rows(minhash.components(minhash.written(edges)), "id", "root") == sorted(want, key=lambda r: str(r[0]))


def test_pruning_bound():
    least = minhash.least_matches()
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * minhash.HASHES
    rng = np.random.default_rng(2)  # a pair at the bound survives
    kept = 0
    for _ in range(400):
        m = np.cumsum(rng.random(minhash.HASHES) < 0.8)
        kept += all(m[n * minhash.BATCH - 1] >= least[n] for n in range(1, len(least)))
    assert kept == 400


def test_block_links_match_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(40)] + [np.unique(pool), np.unique(pool[:270])]
    raw = [s.tobytes() for s in sets]
    got = minhash.linked_in_block(np.ones((42, 42), dtype=bool), raw, raw, 80)
    want = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert got.tolist() == want


def test_keep_first_and_extra_columns(spark, rows):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "q", "w")], "doc_id long, text string, root string")
    got = minhash.keep_first(df)
    assert got.columns == df.columns and [r for r in rows(got, "doc_id") if r[0] is not None] == [(1,), (3,)]


def test_empty(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
