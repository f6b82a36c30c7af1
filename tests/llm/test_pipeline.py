"""The corpus pipeline on the smallest table, against brute force."""

import zlib
from collections import defaultdict

import corpus_pipeline
from scorebook.llm import decontaminate, registry

FOLDER = "/root/testdata/sf0.001"


def test_stages_name_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "drop_benchmark_leaks", "mix_sources", "shard"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets, root = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(kept)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {i for i in kept if find(i) == i}
    clean = {i for i in first if not any(x in decontaminate.normalise(kept[i]) for x in items)}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_mixing_stage_orders_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "ab"[i % 3 == 0], 2) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, FOLDER)
    order = [r.source for r in got.collect()]
    runs = [order[i] for i in range(900) if i == 0 or order[i] != order[i - 1]]
    assert got.columns == docs.columns and len(order) == 900 and len(runs) > 5


def test_the_mix_decides_the_slots(spark, monkeypatch):
    """On a hot source, slots within each shard are in mixing order, and other weights give other slots."""
    rows = [(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 7}", 2) for i in range(3000)] + [(7, "same id, other text", "en", "hot", 2), (7, None, "en", "hot", 2), (7, None, "en", "hot", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline.sharding, "LEAST_SPAN", 200)
    got = {}
    for name, weights in (("rows", None), ("hot last", {"hot": 1, **{f"s{k}": 50 for k in range(7)}})):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        order = [(r.doc_id, zlib.crc32((r.text or "").encode())) for r in corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()]
        out = corpus_pipeline.shard(spark, docs, FOLDER).collect()
        assert len(out) == len(rows)
        by_shard = defaultdict(list)
        for r in sorted(out, key=lambda r: (r.shard, r.slot)):
            assert r.slot == len(by_shard[r.shard])
            by_shard[r.shard].append((r.doc_id, r.text_crc32))
        at = defaultdict(list)
        for place, key in enumerate(order):
            at[key].append(place)
        for keys in by_shard.values():
            places = [at[k][-1] for k in keys]
            assert places == sorted(places)
        got[name] = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in out}
    assert got["rows"] != got["hot last"] and {x[:3] for x in got["rows"]} == {x[:3] for x in got["hot last"]}


def test_run_changes_with_the_weights(spark, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect())
    plain = rows()
    source = spark.read.parquet(f"{FOLDER}/documents.parquet").first().source
    monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {source: 40})
    other = rows()
    assert plain != other and [r[:4] for r in plain] == [r[:4] for r in other]


def test_slots_follow_the_stage_before(spark, monkeypatch):
    """Another order of the mixing stage's rows gives other slots, and they follow it."""
    run = lambda: {r.doc_id: (r.shard, r.slot) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    plain = run()
    for order, stage in ((1, lambda spark, docs, d: docs.orderBy("doc_id")), (-1, lambda spark, docs, d: docs.orderBy(docs.doc_id.desc()))):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage if n == "mix_sources" else f) for n, f in corpus_pipeline.STAGES])
        got = run()
        by_shard = defaultdict(list)
        for i, (shard, _) in sorted(got.items(), key=lambda x: x[1]):
            by_shard[shard].append(i * order)
        assert got != plain and all(ids == sorted(ids) for ids in by_shard.values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_on(spark, tmp_path, rows, items, schema=SCHEMA):
    """The pipeline over tables of its own."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def prose(n):
    """Different sentences with letters, none a near copy of another."""
    return [(i, " ".join(f"{w}{(i * 7 + k) % 1000}" for k, w in enumerate("the quick brown fox jumps over lazy dogs and runs far away from home".split())), "en", f"s{i % 3}", 1) for i in range(n)]


def test_empty_documents(spark, tmp_path):
    assert run_on(spark, tmp_path, [], [(1, "an item")]) == []


def test_empty_benchmark_drops_nothing(spark, tmp_path):
    rows = prose(40)
    got = run_on(spark, tmp_path, rows, [])
    assert sorted(r.doc_id for r in got) == list(range(40))


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    """Null ids, texts, languages and sources; repeated rows; a very long text; texts without letters."""
    rows = prose(30)
    words = "the quick brown fox jumps over lazy dogs and runs far away from home".split()
    long = " ".join(f"{words[i % 14]}{i}" for i in range(60_000))
    rows += [(100, None, "en", "s1", 0), (101, "", None, None, 0), (102, "12345 !!", None, "s1", 0), (103, long, None, None, 9), (104, rows[3][1].upper(), "en", None, 2)]
    rows += [(105, "a document that says its piece twice over and over again", None, "s2", 3)] * 2 + [(None, "a document of nobody in particular but with words", None, "s0", 3)]
    rows += [(106, "before it: " + "the exact benchmark question that must not be here at all" + " after", "en", "s0", 3)]
    got = run_on(spark, tmp_path, rows, [(1, "the exact benchmark question that must not be here at all"), (2, None), (3, "")])
    ids = sorted((r.doc_id for r in got), key=lambda i: (i is None, i))
    assert ids == [*range(30), 103, 105, 105, None]
    assert {r.size for r in got if r.doc_id == 103} == {len(long) + 1}
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_columns_whose_names_clash(spark, tmp_path):
    """Columns named like those that the stages add."""
    rows = [(*r, 7, "x", 1, 2) for r in prose(25)]
    got = run_on(spark, tmp_path, rows, [(1, "an item that is nowhere")], SCHEMA + ", mix_position long, _id string, n_shingles int, size int")
    assert sorted(r.doc_id for r in got) == list(range(25))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_position", "_id", "n_shingles", "size"]
