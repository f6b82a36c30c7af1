import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scorebook.llm import decontaminate as dc


def distance(item, text):
    """Least edits of item to any substring, by the plain table; and the first end that has it."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    best = min(row)
    return best, row.index(best)


def near(item, text):
    """Least edits of item to a substring that begins and ends at edges of words, by the plain table."""
    row = []
    for j in range(len(text) + 1):
        row.append(0 if dc.is_edge(text, j) else row[-1] + 1)
    for i, a in enumerate(item, 1):
        new = [row[0] + 1]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(d for j, d in enumerate(row) if dc.is_edge(text, j))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abcd", max_size=60))
def test_myers_is_the_edit_distance(item, text):
    scores = dc.Pattern(1, item, 0.1).scores(text)
    assert (min(scores), scores.index(min(scores))) == distance(item, text)
    assert dc.Pattern(1, item, 0.1).scores(text, anchored=True) == [table_distance(item, text[:j]) for j in range(len(text) + 1)]


def test_one_rule_for_all_lengths():
    """Items of 5 to 40 characters in Latin and Chinese text, edited, glued and cut, against the plain table."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    seen = set()
    for round_ in range(900):
        chinese = round_ % 3 == 0
        letters = (lambda n: "".join(rng.choice("天地玄黄宇宙洪荒") for _ in range(n))) if chinese else (lambda n: " ".join(word() for _ in range(n))[:n])
        item = dc.normalise(letters(rng.randrange(5, 41)))
        glue = lambda: rng.choice(["", " ", ", ", "x", "天"])
        inner = edited(rng, item, rng.choice([0, 0, 1, 2, 3])) if item else ""
        text = dc.normalise(letters(20) + glue() + inner + glue() + letters(20))
        hits = dc.Matcher([(1, item)]).matches(text)
        best = near(item, text) if item else 99
        assert ([h[1] for h in hits] == [best]) == (best <= int(dc.ERROR_RATE * len(item))) and len(hits) <= 1, (item, text, hits, best)
        seen.add((chinese, bool(hits), len(item) // 14))
    assert len(seen) >= 10


def test_measured_losses_are_found():
    question = "中国的首都在什么地方呢请回答我"
    assert dc.Matcher([(1, question)]).matches("他问" + question + "然后走了")[0][1] == 0
    item = "what is six times seven"
    assert len(item) == 23 and [h[1] for h in dc.Matcher([(1, item)]).matches("so what is six time seven ok")] == [1]
    assert not dc.Matcher([(1, "art of war")]).matches("smart of war") and not dc.Matcher([(1, "art of war")]).matches("art of warfare")


def test_pieces_cover_the_item():
    for n in (0, 3, 10):
        got = dc.pieces("abcdefghijklmnopqrstuvwxyz", n)
        assert len(got) == n + 1 and "".join(p for _, p in got) == "abcdefghijklmnopqrstuvwxyz" and all(x == "abcdefghijklmnopqrstuvwxyz"[o : o + len(x)] for o, x in got)


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        what = rng.randrange(3)
        t[at : at + (what != 1)] = [] if what == 0 else [rng.choice("abcxyz")]
    return "".join(t)


def test_all_within_budget_are_found(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    items = [(i, phrase(20)) for i in range(8)] + [(8, None), (9, "short"), (10, ""), (11, "What is 6 by 7, again?"), (12, "天地玄黄"), (13, "?")]
    texts = [None, "", "?!", phrase(300), "shorter shortshort", "A SHORT", "so, what is 6 by 7 again", "what is 6 by 77 again", "what is 6 by 7 againt", "天地玄黄。宇宙", "大天地玄黄"]
    for _, item in items[:8]:
        n = dc.normalise(item)
        for e in (0, 1, int(dc.ERROR_RATE * len(n)) // 2, int(dc.ERROR_RATE * len(n)), int(dc.ERROR_RATE * len(n)) + 20):
            texts.append(f"{phrase(30)} {edited(rng, n, e)}, {phrase(30)}")
    texts.append(items[0][1].upper().replace(" ", "  ,") + "\n" + items[1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, item in items:
            n = dc.normalise(item)
            if n and near(n, dc.normalise(t)) <= int(dc.ERROR_RATE * len(n)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    assert got == want and len(want) >= 24
    kept = {r.doc_id for r in dc.drop_leaks(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


def test_items_that_repeat_themselves():
    """A first piece that comes again within the item must not hide the item's own place."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for _ in range(60):
        n = 100
        k = int(dc.ERROR_RATE * n)
        piece = letters(n // (k + 1) + 1)
        at = rng.randrange(15, 70)
        item = (piece + letters(n))[:at] + piece + letters(n)
        item = item[:n]
        t = list(item)
        for i in range(k):  # one edit in each piece but the last
            t[n * i // (k + 1) + rng.randrange(n // (k + 1))] = "z"
        text = letters(40) + " " + "".join(t) + " " + letters(40)
        hits = [(i, d) for i, d, _, _ in dc.Matcher([(1, item)]).matches(text)]
        assert (near(item, text) <= k) == bool(hits), (item, text)


def test_starts_are_those_of_the_nearest_match():
    rng = random.Random(3)
    for _ in range(15):
        item = "".join(rng.choice("abcdefg") for _ in range(60))
        lead = "".join(rng.choice("tuvw") for _ in range(rng.randrange(1, 30)))
        text = dc.normalise(lead + " " + edited(rng, item[:25] + " " + item[25:], rng.randrange(3)) + " " + "tuvw " * 3)
        ((_, d, start, _),) = dc.Matcher([(1, item[:25] + " " + item[25:])]).matches(text)
        edges = [at for at in range(len(text) + 1) if dc.is_edge(text, at)]
        assert (d, start) == min((table_distance(item[:25] + " " + item[25:], text[s:e]), s) for s in edges for e in edges if s + 50 <= e <= s + 70)
    assert dc.Matcher([(1, "two words")]).matches("Say: two words.") == [(1, 0, 4, 1)]


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_blocks_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(i, "item number %d with enough characters to count" % i) for i in range(5)], "item_id long, text string")
    assert [len(b) for b in dc.blocks(bench, most=100)] == [2, 2, 1]
    docs = spark.createDataFrame([(1, "Item number 3, with enough characters to count!")], "doc_id long, text string")
    monkeypatch.setattr(dc.blocks, "__defaults__", ("item_id", "text", 60))
    assert 3 in {r.item_id for r in dc.find_leaks(docs, bench).collect()}
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0 and dc.drop_leaks(docs, bench.limit(0)).count() == 1
    assert dc.find_leaks(docs.limit(0), bench).count() == 0
