"""The registered opN_ queries on the smallest table: columns and types of their contracts, and what can be worked out anew."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from scorebook.llm import decontaminate, mixing, secrets
from test_decontaminate import near as nearest
from test_phrases import brute as phrase_rows
from test_prefix_trie import COLUMNS as TRIE
from test_prefix_trie import brute as trie_rows
from test_text_ops import naive_base

FOLDER = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_gif": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_decontaminate": "doc_id bigint, item_id bigint",
    "op4_pii": "doc_id bigint, text string",
    "op5_mixing": "doc_id bigint, mix_slot bigint, mix_position bigint",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_lattice_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op12_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def got(spark):
    """Query -> its rows by document, after a check of its columns; each query runs once."""
    held = {}

    def run(name):
        if name not in held:
            df = __spark_entry__.queries()[name](spark, FOLDER)
            kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            for field in CONTRACT[name].split(", "):
                column, kind = field.split()
                assert kinds.get(column) == kind, (name, column, kinds.get(column))
            held[name] = df.collect()
        return held[name]

    return run


def raw(r):
    return (r.text or "").encode()


def words(r):
    return raw(r).lower().split()


def test_op1(got, docs):
    rows = {r.doc_id: r for r in got("op1_gif")}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        payload = raw(docs[i])
        n = len(payload)
        payload += b"\0" * (64 * max(1, -(-n // 64)) - n)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op2(got, docs):
    rows = {r.doc_id: r for r in got("op2_minhash")}
    sets = {i: set(zip(*(words(d)[k:] for k in range(4)), strict=False)) if len(words(d)) >= 4 else ({tuple(words(d))} if words(d) else set()) for i, d in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows.values()} == {(i, len(sets[i]), find(i), find(i) == i) for i in docs} and len(rows) == len(docs)


def test_op3(got, docs, spark):
    """Items in documents, by the plain table of edits at the edges of words."""
    items = [(r.item_id, decontaminate.normalise(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = {(r.doc_id, r.item_id): (r.distance, r.start) for r in got("op3_decontaminate")}
    texts = {i: decontaminate.normalise(d.text) for i, d in docs.items()}
    exact = {(i, k) for i, t in texts.items() for k, x in items if x and any(decontaminate.is_edge(t, m.start()) and decontaminate.is_edge(t, m.end()) for m in re.finditer(re.escape(x), t))}
    assert exact <= set(rows) and all(rows[p][0] == 0 for p in exact)
    of = dict(items)
    for (i, k), (distance, start) in rows.items():
        part = texts[i][max(0, start - 5) : start + 2 * len(of[k])]
        assert (i, k) in exact or 0 < distance <= int(decontaminate.ERROR_RATE * len(of[k])) and nearest(of[k], part) <= distance
    # what shares a quarter of an item's words without being a match is worked out with the table
    for i, t in texts.items():
        for k, x in items:
            words = set(x.split())
            if (i, k) not in rows and x and 4 * len(words & set(t.split())) >= 3 * len(words) and len(t) < 4000:
                assert nearest(x, t) > int(decontaminate.ERROR_RATE * len(x)), (i, k)


def test_op4(got, docs):
    """Texts change only where something private stood, equal values alike everywhere, and stay valid in form."""
    rows = {r.doc_id: r.text for r in got("op4_pii")}
    assert set(rows) == set(docs)
    mail, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    seen, changed = {}, 0
    for i, d in docs.items():
        before, after = d.text, rows[i]
        if before is None:
            assert after is None
            continue
        if before == after:
            continue
        changed += 1
        a, b = mail.findall(before), mail.findall(after)
        assert len(a) == len(b) and len(ip.findall(before)) == len(ip.findall(after))
        for x, y in zip(a, b, strict=True):
            assert x != y and seen.setdefault(x.lower(), y.lower()) == y.lower()
        strip = lambda t: re.sub(r"[0-9]+", "0", mail.sub("@", t))
        assert strip(before) == strip(after)
    assert changed


def test_op5(got, docs):
    """Every source's blocks come in its windows, so that it is never a block off; places are gapless within blocks."""
    rows = got("op5_mixing")
    assert {r.doc_id for r in rows} == set(docs) and len({r.mix_position for r in rows}) == len(docs) == len(rows)
    assert {r.doc_id: r.source for r in rows} == {i: d.source for i, d in docs.items()}
    blocks, sizes = {}, Counter()
    for r in rows:
        assert blocks.setdefault((r.source, r.mix_block), (r.mix_slot, r.mix_release, r.mix_deadline)) == (r.mix_slot, r.mix_release, r.mix_deadline)
        assert r.mix_release <= r.mix_slot < r.mix_deadline and r.mix_position // mixing.BLOCK_ROWS == r.mix_slot
        sizes[r.source, r.mix_block] += 1
    assert sorted(s for s, _, _ in blocks.values()) == list(range(len(blocks)))
    last = {}
    for source, block in blocks:
        last[source] = max(block, last.get(source, -1))
    assert all(n == mixing.BLOCK_ROWS for (source, block), n in sizes.items() if block < last[source])
    names = sorted(last, key=lambda s: (s is not None, s))
    weights = mixing.whole_weights([sum(d.source == s for d in docs.values()) ** 0.5 for s in names])
    plan = {(names[s], b): (slot, release, deadline) for s, b, slot, release, deadline in mixing.schedule([last[s] + 1 for s in names], weights)}
    assert plan == blocks


def test_op6(got, docs):
    rows, slots, size = got("op6_sharding"), defaultdict(list), Counter()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw(docs[r.doc_id])) + 1, zlib.crc32(raw(docs[r.doc_id])), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(got, docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(w for i, d in docs.items() if not held[i] for w in [*words(d), "\0"])
    total = sum(c.values())
    for r in got("op7_lattice_lm"):
        tokens = [*words(docs[r.doc_id]), "\0"]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0


def test_op8(got, docs):
    for r in got("op8_secrets"):
        base = naive_base(docs[r.doc_id].text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k in base) for x in secrets.KINDS)
        assert {f"{k}:{s}:{e}" for s, e, k in base} <= set(r.spans.split(",")) | {""}


def test_op9(got, spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    best = {h: max(i for i, x in pages.items() if x == h) for h in pages.values() if len(h) >= 1000}
    want = {(i, len(h), hashlib.sha1(h).hexdigest(), "response" if best.get(h, i) == i else "revisit", None if best.get(h, i) == i else best[h]) for i, h in pages.items()}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got("op9_warc")} == want


def test_op10(got, docs):
    rows = got("op10_langid")
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    langs = {d.lang for d in docs.values()} - {None}
    for r in rows:
        assert (r.lang_pred == "und") == (not any(x.isalpha() for x in docs[r.doc_id].text or "")) and r.lang_pred in langs | {"und"} and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op11(got, docs):
    groups = defaultdict(list)
    for i, d in docs.items():
        groups[raw(d).lower()].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}
    rows = got("op11_exact_dedup")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want and len(rows) == len(docs)


def test_op12(got, docs):
    want = phrase_rows([(i, d.text, d.lang) for i, d in docs.items()], 30)
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got("op12_phrases")) == want


def test_op13(got, spark):
    want = trie_rows([(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()])
    assert sorted((tuple(r[c] for c in TRIE) for r in got("op13_prefix_trie")), key=str) == want
