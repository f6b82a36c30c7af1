"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian pruning, exact verification, components.

Documents are sets of word shingles. Equal sets are collapsed first. Bands of the MinHash signature propose candidates;
their signatures are compared a batch of hashes at a time, and a pair is dropped as soon as the posterior probability
that it reaches the similarity bound falls below MISS. What survives is verified on the real words of both texts.

Buckets are never expanded to all pairs. Every member is first compared with its bucket's leader; in a large bucket with
a local leader of about FAN members, the local leaders with leaders of their own, and so on, so nobody leads many.
Those links give components. Only where a bucket still spans
several components are the members outside its main component compared with all members of other components, in blocks
of sets, so that no link between components is lost to the short cut.

Words are split at ASCII white space after lower-casing A-Z. Null, empty and wordless texts: an empty set, linked with
nothing. Fewer words than a shingle: the whole sequence is the one shingle. Equal ids: rows are handled by id, so such
rows share component and flag. A null id: the component of an equal set, and no links of its own. An empty table gives no rows. Very long texts are read whole; hashing goes in slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import bitmap, join_unique, least_hot, map_rows, may_have, table, written

#: A pair at the similarity bound 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature values compared at once; posterior probability under which a candidate is dropped.
BATCH, MISS = 16, 1e-6
#: Members that one leader is compared with; cached word hashes; sets of the two sides of a block pair.
FAN, CACHE, OUTSIDERS, INSIDERS = 64, 50_000, 512, 1024
#: Bytes of the sets of a block pair's side.
BLOCK_BYTES = 16 << 20
#: Similarity bound in percent: links have 100 * intersection >= PERCENT * union.
PERCENT = 80

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * _POSITION[i % len(_POSITION)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, of multiply-shift hashes of the shingles."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, ((part[:, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band, the band's number hashed in."""
    raw = sig.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[i * ROWS * 4 : (i + 1) * ROWS * 4], seed=i) - (1 << 63) for i in range(BANDS)]


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, digest, bands, sig): set size, digest of the set (null if empty), band keys, a byte for each minimum."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        for key, text in rows:
            shingles = shingle_hashes(words_of(text), k, hashes)
            if not len(shingles):
                yield key, 0, None, None, None
                continue
            sig = signature(shingles)
            yield key, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), band_keys(sig), (sig & np.uint32(255)).astype(np.uint8).tobytes()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), run, f"id {kind}, n long, digest binary, bands array<long>, sig binary")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 0, BATCH, 2 BATCH ... compared values: the fewest matches with which a candidate stays.

    With a uniform prior, after m matches in n values P(c >= t) is P(Binomial(n + 1, t) <= m); c is the chance that two
    signature bytes agree, the similarity plus the odd agreement of one in 256.
    """
    s = percent / 100
    t = s + (1 - s) / 256
    out = []
    for n in range(0, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def prune(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs (a, b, sig_a, sig_b) that survive all batches."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            for step in range(1, len(least)):
                part = slice((step - 1) * BATCH, step * BATCH)
                matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least[step]]
            yield batch.select([0, 1]).take(pa.array(alive))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, pairs.select("a", "b").schema)


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): one text of each of the ids. A bitmap of the ids keeps the other texts from being shuffled."""
    ids = written(ids.distinct())
    marks, bits = bitmap(ids.select(F.xxhash64("id").alias("key")), "key", ids.count())
    few = may_have(texts.select("id", "text", F.xxhash64("id").alias("key")), "key", marks, bits).drop("key")
    return few.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def exact(pairs: DataFrame, texts: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the stored pairs whose shingle sets reach the bound, decided on the words themselves."""
    texts = written(texts_of(texts, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        def shingles(text: str) -> set[tuple[bytes, ...]]:
            w = words_of(text)
            n = min(k, len(w))
            return set(zip(*(w[i:] for i in range(n)), strict=False))

        for a, b, text_a, text_b in rows:
            x, y = shingles(text_a), shingles(text_b)
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                yield a, b

    kind = pairs.schema["a"].dataType.simpleString()
    return map_rows(both.select("a", "b", "text_a", "text_b"), run, f"a {kind}, b {kind}")


def set_sketch(texts: DataFrame, k: int) -> DataFrame:
    """(id, shingles, sig): the whole set as sorted 64-bit hashes, and a byte for each signature value."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        for key, text in rows:
            shingles = shingle_hashes(words_of(text), k, hashes)
            yield key, shingles.tobytes(), (signature(shingles) & np.uint32(255)).astype(np.uint8).tobytes()

    kind = texts.schema["id"].dataType.simpleString()
    return map_rows(texts.select("id", "text"), run, f"id {kind}, shingles binary, sig binary")


def linked_in_block(alive: np.ndarray, xs: list[bytes], ys: list[bytes], percent: int) -> np.ndarray:
    """Which of the pairs [x, y] that are still alive reach the bound, on the full sets (64-bit shingle hashes).

    Intersection sizes of all pairs are one product of incidence matrices over the shingles that both sides have, taken
    in slices, so memory stays bounded for long texts too.
    """
    at_x, at_y = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    out = np.zeros(alive.shape, dtype=bool)
    if not len(at_x):
        return out
    x, y = ([np.frombuffer(side[n], dtype=np.uint64) for n in at] for side, at in ((xs, at_x), (ys, at_y)))
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    for cut in range(0, len(shared), 4096):
        part = shared[cut : cut + 4096]

        def incidence(sets: list[np.ndarray], part=part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), dtype=np.float32)
            for n, own in enumerate(sets):
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], side="right")]
                hit = np.minimum(np.searchsorted(part, own), len(part) - 1)
                m[n, hit[part[hit] == own]] = 1
            return m

        common += incidence(x) @ incidence(y).T
    size = lambda sets: np.array([len(s) for s in sets])
    union = size(x)[:, None] + size(y)[None, :] - common
    out[np.ix_(at_x, at_y)] = (100 * common >= percent * union) & alive[np.ix_(at_x, at_y)]
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component of stored edges (a, b), a < b; nodes without edges don't appear.

    Alternates the large-star and small-star steps until nothing changes; hubs never meet in one task (join_unique).
    """

    def stars(links: DataFrame, large: bool) -> DataFrame:
        """Stored links (u, v): re-hang each node's neighbours (large: the larger ones) on its smallest neighbour."""
        least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = join_unique(links, least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    links = written(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), edges.count())
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = written(stars(both, large=True), 2 * before[0])
        # every link now points to a smaller id
        links = written(stars(links, large=False), 4 * before[0])
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("root"))


def candidates(members: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each bucket member with its leader, the smallest id; in a large bucket a tree of leaders.

    members, stored: (key, id, n, size). A level groups what is left of a bucket by hash, about FAN at a time, and its
    leaders form the next level, so a bucket of any size takes few levels and no group is large.
    """
    me, out, level = F.struct("id", "n"), None, members
    most, depth = members.agg(F.max("size")).first()[0] or 0, 0
    while True:
        groups = F.greatest(F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / FAN))), F.lit(1)).cast("long")
        level = level.withColumn("groups", groups).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(depth)), "groups"))
        led = level.withColumn("lead", F.min(me).over(Window.partitionBy("key", "salt"))).where("lead.id < id")
        pairs = led.select(F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"))
        out = pairs if out is None else out.unionByName(pairs)
        if most <= FAN:
            return out.distinct()
        level = level.where("groups > 1").groupBy("key", "salt").agg(F.min(me).alias("m"), F.first("groups").alias("size"))
        level = written(level.select("key", "m.id", "m.n", "size"))
        most, depth = 2 ** math.ceil(math.log2(most / FAN)), depth + 1


def across_components(members: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between components, found where buckets still span several.

    A cluster is what shares buckets with one main component: outsiders (other components) and insiders (all). Outsiders
    meet insiders in blocks of sets; a block pair is compared in place, and only one link for each outsider and other
    component leaves it. So no pair of a group becomes a row, and the work spreads over as many tasks as block pairs.
    """
    placed = written(members.join(labels, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")))
    per_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    spans = per_root.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    spans = spans.where("roots > 1").select("key", "main")
    cluster = written(join_unique(placed, spans, "key", "inner").select("main", "id", "n", "root").distinct())
    out = F.col("root") != F.col("main")
    sizes = cluster.groupBy("main").agg(F.sum(out.cast("long")).alias("outside"), F.count(F.lit(1)).alias("inside"), F.sum(F.when(out, F.col("n"))).alias("out_n"), F.sum("n").alias("in_n"))
    # blocks hold so many sets at most, and so many bytes on average; a set has 8 bytes a shingle
    blocks = lambda n, most, shingles: F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(shingles) * 8 / BLOCK_BYTES))
    sizes = sizes.select("main", blocks("outside", OUTSIDERS, "out_n").alias("n_out"), blocks("inside", INSIDERS, "in_n").alias("n_in"))
    sets = written(set_sketch(texts_of(texts, cluster.select("id")), k))
    rows = join_unique(cluster.drop("n"), sizes, "main", "inner").join(sets, "id")
    block, other = lambda n: F.pmod(F.xxhash64("id"), F.col(n)), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    keep = ["main", "id", "root", "shingles", "sig"]
    outside = rows.where("root != main").select(*keep, F.lit(True).alias("out"), block("n_out").alias("i"), F.explode(other("n_in")).alias("j"))
    inside = rows.select(*keep, F.lit(False).alias("out"), block("n_in").alias("j"), F.explode(other("n_out")).alias("i"))
    least = least_matches(percent)

    def links(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        xs, ys = ([n for n, o in enumerate(t["out"]) if o is side] for side in (True, False))
        sig = np.frombuffer(b"".join(t["sig"]), dtype=np.uint8).reshape(-1, HASHES)
        root = np.array(t["root"])
        alive = root[xs][:, None] != root[ys][None, :]
        matches = np.zeros(alive.shape, dtype=np.int16)
        for step in range(1, len(least)):
            for n in range((step - 1) * BATCH, step * BATCH):
                matches += sig[xs, n][:, None] == sig[ys, n][None, :]
            alive &= matches >= least[step]
        found = linked_in_block(alive, [t["shingles"][n] for n in xs], [t["shingles"][n] for n in ys], percent)
        once = {(t["id"][xs[x]], root[ys[y]]): t["id"][ys[y]] for x, y in zip(*np.nonzero(found), strict=True)}
        a, b = [min(x, y) for (x, _), y in once.items()], [max(x, y) for (x, _), y in once.items()]
        return pa.table({"a": pa.array(a, schema.field("id").type), "b": pa.array(b, schema.field("id").type)})

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(cluster.select("id").schema)
    kind = cluster.schema["id"].dataType.simpleString()
    return written(outside.unionByName(inside).groupBy("main", "i", "j").applyInArrow(links, f"a {kind}, b {kind}").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`."""
    sketches = written(sketch(docs, id_col, text_col, k))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    reps = sketches.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "n", "bands", "sig")).alias("r"))
    reps = written(reps.select("digest", "r.*"))
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    hot = buckets.where(F.col("size") >= least_hot(reps.count() * BANDS)).select("key")
    members = written(join_unique(banded, buckets, "key", "inner", hot))
    alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent  # else the sizes alone forbid a link
    sigs = reps.select("id", "sig")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.select("a", "b"))
        signed = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
        signed = signed.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return written(exact(written(prune(signed, percent)), texts, k, percent))

    edges = linked(candidates(members).where(alike))
    first = components(edges)
    more = across_components(members, first, texts, k, percent)
    if not more.isEmpty():
        first = components(first.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(more))
    of_set = reps.join(first, "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    out = join_unique(sketches.select("id", "n", "digest"), written(of_set), "digest")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """The rows of `docs` that are the first of their group, with all their columns; null ids stay."""
    dropped = near_duplicates(docs, id_col, text_col, k).where(~F.col("kept")).select(id_col)
    return docs.join(written(dropped), id_col, "left_anti").select(docs.columns)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)
