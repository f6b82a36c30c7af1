import itertools
import math
import zlib
from collections import Counter

import numpy as np

from scorebook.llm import lattice_lm as lm

BYTES = [f"<0x{b:02X}>" for b in range(256)]
SMALL = [*"▁abc", "▁a", "ab", "▁ab", "bc", "abc", "▁b", *BYTES]


def enumerated(pieces, word):
    """Log of the sum over all segmentations, by trying every way to cut the word."""
    chars = lm.START + word
    index = {p: i for i, p in enumerate(pieces.text)}
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(chars) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(chars[start:i])
                start = i
        parts.append(chars[start:])
        p = 1.0
        for x in parts:
            own = math.exp(pieces.log_p[index[x]]) if x in index else 0.0
            if len(x) == 1:
                own += math.exp(sum(pieces.log_p[pieces.n + b] for b in x.encode()))
            p *= own
        total += p
    return math.log(total)


def chars_of(words):
    return np.frombuffer("".join(lm.START + w for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def test_forward_is_the_sum_over_segmentations():
    pieces = lm.Pieces(SMALL)
    for words in (["abcabc", "cccccc", "abxabé"], ["a"], ["aé"]):
        got = lm.marginals(pieces, chars_of(words))
        assert np.allclose(got, [enumerated(pieces, w) for w in words])


def test_long_words_go_block_by_block(monkeypatch):
    pieces = lm.Pieces(SMALL)
    word = "abcabbccaéb" * 7
    whole = lm.marginals(pieces, chars_of([word]))
    for size in (2, 5, 9, 76, 77, 78):
        monkeypatch.setattr(lm, "LONG_WORD", size)
        assert np.allclose(lm.marginals(pieces, chars_of([word])), whole)

def test_long_words_are_counted_exactly(monkeypatch):
    pieces = lm.Pieces(SMALL)
    word = "abcabbccaéb" * 7
    whole = lm.expected(pieces, chars_of([word, word[::-1]]), np.array([2.0, 1.0]))
    for size in (2, 5, 9, 76, 77, 78):
        monkeypatch.setattr(lm, "LONG_WORD", size)
        assert np.allclose(lm.expected(pieces, chars_of([word, word[::-1]]), np.array([2.0, 1.0])), whole)


def test_batches_hold_all_words(monkeypatch):
    monkeypatch.setattr(lm, "HELD_CHARS", 40)
    monkeypatch.setattr(lm, "BATCH_CHARS", 25)
    words = [b"a" * (1 + i * 7 % 9) for i in range(200)] + [b"x" * 3000]
    got = [r for chars, rows in lm.by_length(iter([(w, i) for i, w in enumerate(words)])) for r in rows if chars.shape == (len(rows), len(rows[0][0]) + 1)]
    assert sorted(got, key=lambda r: r[1]) == [(w, i) for i, w in enumerate(words)]


def test_expected_counts_and_em():
    pieces = lm.Pieces(SMALL)
    words, counts = ["abcabc", "abcbcb", "cbabab"], np.array([5.0, 2.0, 1.0])
    before = counts @ lm.marginals(pieces, chars_of(words))
    for _ in range(4):
        uses = lm.expected(pieces, chars_of(words), counts)
        spelled = sum(u * len(p) for p, u in zip(pieces.text, uses, strict=False)) + sum(uses[pieces.n + b] for b in range(256) if b < 128)
        assert spelled <= counts.sum() * 7 + 1e-6
        pieces.set(uses + 1e-9)
        after = counts @ lm.marginals(pieces, chars_of(words))
        assert after >= before - 1e-6
        before = after


def test_tokens_are_a_distribution():
    pieces = lm.Pieces(SMALL)
    total = pieces.end_probability()
    for n in range(1, 7):
        words = ["".join(w) for w in itertools.product("abc", repeat=n)]
        total += np.exp(lm.marginals(pieces, chars_of(words))).sum()
    assert total < 1.0


def plain_scores(c):
    """token -> log10 probability by the formula, with pieces re-estimated word by word."""
    words, n = [w for w in c if w != "\0"], Counter(c[w] for w in c if w != "\0")
    d, back = n[1] / (n[1] + 2 * n[2]), len(c) / sum(c.values())
    pieces = lm.load_pieces()
    for _ in range(lm.EM_ROUNDS):
        weights = np.full(pieces.n + 257, lm.PIECE_PRIOR)
        for w in words:
            weights += lm.expected(pieces, chars_of([w]), np.ones(1))
        weights[-1] += 1
        pieces.set(weights)
    m = lambda w: pieces.end_probability() if w == "\0" else math.exp(lm.marginals(pieces, chars_of([w]))[0])
    return lambda w: math.log10(max(c[w] - d, 0) / sum(c.values()) + d * back * m(w)) if c[w] > 1 or m(w) > 1e-290 else None


def test_scores_against_plain_counts(spark):
    texts = [f"The cat {i % 7} sat on mat{i % 5}, THE end é{i}" for i in range(60)] + ["", None, " \t\n\x0b ", "x" * 2500, "a b a"]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, x, "k") for i, (t, x) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean, score string")
    for top in (250_000, 3):  # with almost no common-word table, all go through the join
        got = {r.doc_id: r for r in lm.score_documents(df, top_words=top).collect()}
        words = [[w.lower() for w in (t or "").split()] + ["\0"] for t in texts]
        c = Counter(w for ws, x in zip(words, train, strict=True) if x for w in ws)
        total, distinct = sum(c.values()), len(c)
        plain = plain_scores(c)
        for i, ws in enumerate(words):
            base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
            own = [plain(w) for w in ws]
            assert None in own or math.isclose(r.score, sum(own), rel_tol=1e-6)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and r.lattice_score < 0
        assert len(got) == len(texts)


def test_top_words_do_not_change_scores(spark):
    df = spark.createDataFrame([(i, f"one two three {i % 4} two", i % 3 != 0) for i in range(30)], "doc_id long, text string, train boolean")
    a, b = ({r.doc_id: r.score for r in lm.score_documents(df, top_words=n).collect()} for n in (250_000, 1))
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in lm.score_documents(df).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0 and got[1].score < got[2].score < 0
    assert lm.score_documents(df.limit(0)).count() == 0
