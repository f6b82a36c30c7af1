"""Secret scans, WARC archives and language mixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scorebook.llm import langid, secrets, warc


def naive_base(text):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 8:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", "Passwd", " = ", ":", "=", '"', "'", "abcdefgh", "short", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", " ", "\n", "deadbeef" * 5, "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert secrets.base_spans(text) == naive_base(text), text


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_windows_are_those_of_plain_entropy():
    rng = random.Random(5)
    for _ in range(300):
        run = "".join(rng.choice("abcdef0123456789"[: rng.randrange(2, 17)]) for _ in range(rng.randrange(10, 80)))
        width, least = 16, rng.choice([2.0, 2.5, 3.0])
        hit = [entropy(run[i : i + width]) >= least - 1e-9 for i in range(len(run) - width + 1)]
        covered = {j for i, h in enumerate(hit) if h for j in range(i, i + width)}
        got = list(secrets.windows(run, width, least))
        assert {j for s, e in got for j in range(s, e)} == covered
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_entropy_finds_keys_and_leaves_plain_text():
    key = "x7Kp2mQ9vT4zR8wL1nB6yD3s"
    base, spans = secrets.scan(f"key {key} end")
    assert not base and any(k == "entropy_alnum" for _, _, k in spans)
    for plain in ("an ordinary sentence of ordinary words", "123e4567-e89b-12d3-a456-426614174000", "internationalisation-of-something-2024", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "/usr/share/some/path/to/file", "1234567890123456789012345678", "", "z" * 500):
        assert secrets.scan(plain) == ([], []), plain


def test_entropy_finds_keys_without_digits():
    for key in ("xKpQmRvTzWwLnBgDsYhJ", "QwErTyUiOpAsDfGhJkLzXc", "aBcDeFgHiJkLmNoPqRsTuVwX2024", "AbCdEfGhIjKlMnOpQrStUvWx" * 4 + "7"):
        assert any(k == "entropy_alnum" for _, _, k in secrets.scan(f"key {key} end")[1]), key
    for plain in ("internationalization", "some-long-hyphenated-chain/of_plain.Words", "COUNTERREVOLUTIONARIES", "uncopyrightable-documents2024"):
        assert secrets.scan(plain) == ([], []), plain


HARMLESS = (
    "see https://example.org/Some/Path/toThe/PageOfThings/index.html now", "http://a.example.com/download/2024/ReleaseNotes.pdf", "/usr/local/share/applications/mimeinfo.cache", "src/main/java/com/acme/billing/InvoiceServiceImpl.java",
    "org.springframework.beans.factory.annotation", "com.example.project.SomeLongClassName", "AbstractSingletonProxyFactoryBean", "getElementsByClassNameAndParent", "parseHTMLDocumentFromString", "some_very_long_snake_case_variable_name",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "123e4567-e89b-12d3-a456-426614174000", "docs/2023/annual-report/figures", "CONSTANT_NAMES_ARE_UPPER_CASE",
)


def test_allow_list_does_what_it_says():
    """Paths, names and URLs are left alone; what follows a URL's question mark isn't."""
    for text in HARMLESS:
        assert secrets.scan(text) == ([], []), text
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    assert secrets.scan(f"https://example.org/page?x={key}")[1] and secrets.scan(f"path/to/{key}")[1] and not secrets.scan(f"https://example.org/{key}")[1]


def test_long_runs_take_linear_time():
    import time

    start = time.time()
    for text in ("a" * 200_000, "aB" * 100_000, "AbcDef/" * 30_000 + "é", "ABC-" * 50_000 + "9a9", "/" * 100_000, "aa.Bb/" * 40_000 + "Q1x", "a" * 100_000 + "B", "A2" * 100_000):
        secrets.scan(text)
    assert time.time() - start < 20


def test_recall_on_random_keys():
    """The losses that the module states, on keys drawn from each alphabet."""
    rng = random.Random(77)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lost = lambda chars, n, trials=3000: sum(not secrets.scan("".join(rng.choice(chars) for _ in range(n)))[1] for _ in range(trials)) / trials
    got = {"alnum 20": lost(alnum, 20), "alnum 32": lost(alnum, 32), "base32 32": lost(alnum[:26] + "234567", 32), "lower base32 32": lost(alnum[26:52] + "234567", 32), "hex 40": lost("0123456789abcdef", 40), "base64 40": lost(alnum + "+/", 40)}
    assert got["alnum 20"] < 0.03 and max(v for k, v in got.items() if k != "alnum 20") < 0.012, got


def plain_entropy_spans(text):
    """Candidate by candidate and window by window, with the entropy worked out anew each time."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=.-]+", text):
        if len(m[0]) < 20 or secrets.allowed(m[0].strip(".-_=+")):
            continue
        base32 = r"[A-Z2-7]{24,}|[a-z2-7]{24,}"
        for name, chars, width, least in (("entropy_hex", "[0-9a-fA-F]+", 24, 3.0), ("entropy_base32", base32, 24, 3.4), ("entropy_alnum", "[A-Za-z0-9]+", 20, 3.7), ("entropy_base64", "[A-Za-z0-9+/_=-]+", 24, 4.1)):
            for run in re.finditer(chars, m[0]):
                if name == "entropy_base32" and not re.search("[2-7]", run[0]):
                    continue
                if len(run[0]) < width or secrets.allowed(run[0]):
                    continue
                covered = set()
                for i in range(len(run[0]) - width + 1):
                    if entropy(run[0][i : i + width]) >= least - 1e-10:
                        covered |= set(range(i, i + width))
                at = m.start() + run.start()
                for j in sorted(covered):
                    if j - 1 not in covered:
                        end = next(k for k in range(j, len(run[0]) + 1) if k not in covered)
                        out.append((at + j, at + end, name))
    return sorted(out)


def test_entropy_spans_are_those_of_plain_windows():
    rng, alphabet = random.Random(15), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    cases = [pick(alphabet, 120) + "7", "7" + pick(alphabet[:52], 120), pick(alphabet[:52], 100) + "7" + pick(alphabet[:52], 20), pick(alphabet[:52], 121)]
    for _ in range(150):
        cases.append(" ".join(rng.choice([pick(alphabet, rng.randrange(60)), pick("0123456789abcdef", rng.randrange(80)), pick(alphabet + "+/_=-.", rng.randrange(90)), "plain", "some/path/of-words", "é", "aB1" * rng.randrange(20)]) for _ in range(rng.randrange(1, 6))))
    assert all(plain_entropy_spans(c) for c in cases[:4])
    for text in cases:
        assert sorted(secrets.entropy_spans(text)) == plain_entropy_spans(text), text


def test_secret_rows(spark):
    df = spark.createDataFrame([(1, 'token = "' + "ab12" * 10 + '"', "s"), (2, None, "s"), (2, "", "s")], "doc_id long, text string, spans string")
    got = secrets.find_secrets(df).orderBy("doc_id").collect()
    assert [len(r.base) for r in got] == [2, 0, 0] and [x.kind for x in got[0].spans][:2] == ["assign", "hex"]
    assert secrets.find_secrets(df.limit(0)).count() == 0


PAGES = [(1, "http://a", "x" * 1000), (2, "http://b\r\nX: y", "x" * 1000), (7, None, "x" * 1000), (3, "http://c", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 " * 60), (None, "n", "lone")]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "other") for p in PAGES], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = {r.page_id: r for r in warc.resolve_read(warc.written(warc.read_archives(spark, path))).collect()}
    assert len(got) == len(PAGES)
    best = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 1000:
            best[h] = max(i, best.get(h, -1))
    for i, _, h in PAGES:
        raw, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        want = ("response", None) if best.get(h, i) == i else ("revisit", best[h])
        assert (r.record_type, r.refers_to) == want
    text = spark.read.format("binaryFile").load(path).collect()
    assert sum(x.content.count(b"WARC-Type: revisit") for x in text) == 3 and not any(b"\r\nX: y" in x.content for x in text)
    assert sum(x.content.count(b"WARC-Refers-To-Target-URI: u\r\n") for x in text) == 1


def test_archive_files_are_bounded(spark, tmp_path, monkeypatch):
    """Each size class has its own records per file; ids may be text; a digest of half the rows is no obstacle."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (2000, 10_000, 1 << 31))
    pages = [(f"p{i:03d}", "u", "hot" * 400) for i in range(150)] + [(f"q{i:03d}", "u", f"{i}" * n) for i, n in enumerate([100, 1500, 9000, 50_000] * 20)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").coalesce(1)
    path = str(tmp_path / "b")
    warc.write_archives(df, path)
    sizes = [len(x.content) for x in spark.read.format("binaryFile").load(path).collect()]
    assert all(n < 30_000 or n < 160_000 for n in sizes) and len(sizes) > 60
    got = {r.page_id: r for r in warc.resolve_read(warc.written(warc.read_archives(spark, path, "string"))).collect()}
    assert {k: r.payload_digest for k, r in got.items()} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in pages}
    assert {r.refers_to for k, r in got.items() if k < "p149"} == {"p149"} and all(r.record_type == "response" for k, r in got.items() if k >= "p149")


def test_empty_pages_and_cut_archives(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))


LANGS = {"xx": "kala talo maja sula rava ", "yy": "strum blick thorn wedge ", "zz": "quioea eauio uoiea "}


def sample(rng, lang, n=60):
    words = LANGS[lang].split()
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_mixtures(spark):
    rng = random.Random(6)
    data = [(i, sample(rng, lang), lang) for i, lang in enumerate(sorted(LANGS) * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learnt = langid.model(langid.train(df))
    assert learnt.langs == sorted(LANGS)
    tests = [sample(rng, "xx"), sample(rng, "yy", 3), sample(rng, "xx", 40) + " " + sample(rng, "zz", 80), None, "", "123 !?", sample(rng, "zz", 9000)]
    got = langid.identify(spark.createDataFrame([(i, t, "c") for i, t in enumerate(tests)], "doc_id long, text string, lang_pred string"), learnt).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["xx", "yy", "zz", "und", "und", "und", "zz"]
    assert got[2].languages.count(":") == 2 and 0.5 < got[2].score < 0.9 and got[3].score == 0 and all(0 <= r.score <= 1 for r in got)


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(7)
    p, n = rng.random((50, 4)) + 1e-3, rng.integers(1, 9, 50).astype(float)
    values = [langid.em(p, n, r)[1] for r in range(12)]
    assert all(a <= b + 1e-9 for a, b in zip(values, values[1:], strict=False))
    assert abs(langid.em(p, n)[0].sum() - 1) < 1e-9


def test_no_training_labels(spark):
    df = spark.createDataFrame([(1, "words here", None), (2, None, "en")], "doc_id long, text string, lang string")
    learnt = langid.model(langid.train(df))
    assert [r.lang_pred for r in langid.identify(df, learnt).collect()] == ["und", "und"]
    assert langid.identify(df.limit(0), learnt).count() == 0
    assert [r.doc_id for r in langid.keep_identified(df).collect()] == [1] and langid.keep_identified(df.limit(0)).count() == 0


def plain_mixture(rows, text):
    """(language, share) by the plain procedure: dictionaries of trigram bins, the same set rule, plain sums."""
    langs = sorted({lang for _, lang in rows})
    counts = {x: Counter() for x in langs}
    for t, lang in rows:
        counts[lang].update(langid.trigram_bins(t).tolist())
    p = {x: lambda b, c=c, n=sum(c.values()): (c[b] + langid.SMOOTHING) / (n + langid.SMOOTHING * langid.BINS) for x, c in counts.items()}
    seen = Counter(langid.trigram_bins(text).tolist())
    total = sum(seen.values())

    def em(some):
        pi = [1 / len(some)] * len(some)
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(some)
            for b, n in seen.items():
                own = [x * p[s](b) for x, s in zip(pi, some, strict=True)]
                new = [v + n * o / sum(own) for v, o in zip(new, own, strict=True)]
            pi = [x / total for x in new]
        return pi, sum(n * math.log(sum(x * p[s](b) for x, s in zip(pi, some, strict=True))) for b, n in seen.items())

    alone = {s: em([s])[1] for s in langs}
    chosen = [max(langs, key=lambda s: alone[s])]
    shares, best = [1.0], alone[chosen[0]]
    full = dict(zip(langs, em(langs)[0], strict=True))
    for s in sorted(langs, key=lambda s: -full[s]):
        if s not in chosen:
            pi, likelihood = em([*chosen, s])
            if likelihood - best <= langid.PENALTY * 0.5 * math.log(total + 1):
                break
            chosen, shares, best = [*chosen, s], pi, likelihood
    return max(zip(chosen, shares, strict=True), key=lambda x: x[1])


def test_mixtures_are_those_of_plain_sums(spark):
    rng = random.Random(16)
    rows = [(sample(rng, lang, 30), lang) for lang in sorted(LANGS) * 5]
    learnt = langid.model(langid.train(spark.createDataFrame(rows, "text string, lang string")))
    tests = [" ".join(sample(rng, rng.choice(sorted(LANGS)), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))) for _ in range(25)] + ["qqq www", "kala"]
    got = langid.identify(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), learnt).orderBy("doc_id").collect()
    for text, r in zip(tests, got, strict=True):
        lang, share = plain_mixture(rows, text)
        assert r.lang_pred == lang and abs(r.score - share) < 1e-4, text


def test_many_languages(spark):
    """More languages than a task holds at once."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(17)
    words = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(6)] for i in range(300)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    learnt = langid.model(langid.train(spark.createDataFrame([(text(x), x) for x in words for _ in range(3)], "text string, lang string").repartition(2)))
    assert learnt.langs == sorted(words)
    tests = [(i, text(x), x) for i, x in enumerate(rng.sample(sorted(words), 25))]
    got = langid.identify(spark.createDataFrame(tests, "doc_id long, text string, score string"), learnt, carry=("score",))
    assert got.columns == ["doc_id", "score", "lang_pred", "score_", "languages"] and all(r.lang_pred == r.score for r in got.collect())


def test_kept_rows_and_columns(spark):
    rng = random.Random(8)
    data = [(i, sample(rng, lang), lang, "s") for i, lang in enumerate(sorted(LANGS) * 10)] + [(100, "1 2 3", "xx", "s"), (101, None, "xx", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(30))
