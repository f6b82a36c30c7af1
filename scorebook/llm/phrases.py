"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. A phrase
has two to four words of one piece; all counts are per language and include overlaps. A task's texts are mined in shards
of bounded bytes. In a shard, a phrase has to reach its share of the support: the least count times the shard's part of
the language's bytes, rounded up. Shares add up to the support, so a phrase that has it reaches its share in some shard.
Shards send hashes and counts of what reaches the share; a phrase stays in the union if that and the most that all others
may have of it unsaid can make up the support. The union is counted again everywhere, exactly, by the phrases themselves.

Mining goes by orders, which keeps it small when shards are many and shares are one: words are counted first, then
pairs of frequent words are mined and counted, then phrases of three and four words whose pairs are all frequent. Tasks
learn the union from bitmaps of a bounded size; what those let through by mistake is counted exactly and falls out.

A phrase is scored at each cut into a first part and a rest: floor(2000000 a / (l + r)) for its count a and the counts of
the parts; the least score holds, ties go to the shortest first part. A phrase that lies within a longer frequent one
with at least 80 % of its count is dropped.

Null text: empty. Null language: `und`. Words of any length and characters count; a very long text is read whole into a
shard of its own size. Repeated rows count each. Ties in rank: score, count, phrase by bytes. An empty table or one
without frequent phrases gives no rows. Other columns may have any names; only the two named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import BITS_PER_KEY, LEAST_BITS, MOST_BITS, ROW_SHIFT, table, written

#: Least count of a phrase, most words in it, rows a language, percent of its count with which a longer one covers it.
LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SCALE = 2_000_000
#: Bytes of text of a shard, those of a task's shards, and those for which it is worth having one more task.
SHARD_BYTES, TASK_BYTES, LEAST_BYTES = 4 << 20, 32 << 20, 2 << 20
#: Phrases sent on at once.
PHRASES_AT_ONCE = 50_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(BREAKS) + b" ")
#: Shifts of a phrase's hash that give its places in a bitmap.
SHIFTS = (0, 17, 35)


class Words(dict):
    """word -> its number from 1 on, in order of arrival; a break between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(text: bytes, words: Words) -> np.ndarray:
    """The numbers of a text's words, with 0 at the ends of pieces."""
    parts = text.translate(_TABLE).replace(b".", b" . ").split()
    parts.append(b".")
    return np.fromiter(map(words.__getitem__, parts), dtype=np.uint32, count=len(parts))


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases `h` continued by the words hashed as `more`."""
    out = (h * np.uint64(0x9E3779B97F4A7C15)) ^ more
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


class Marks:
    """Phrase hashes that may be wanted."""

    def __init__(self, raw: bytes):
        self.raw, self.mask = np.frombuffer(raw, dtype=np.uint8), np.uint64(8 * len(raw) - 1)

    def test(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), dtype=bool)
        for shift in SHIFTS:
            at = (h >> np.uint64(shift)) & self.mask
            ok &= (self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def marks_of(hashes: DataFrame) -> bytes:
    """The bitmap of hashes (h), on the driver: 16 MB at most, however many there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * max(hashes.count(), 1) - 1).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS]))
    rows = hashes.select(at.alias("at")).select(F.shiftright("at", ROW_SHIFT).alias("part"), (F.col("at") % (1 << ROW_SHIFT)).alias("at"))
    out = bytearray(bits // 8)
    size = (1 << ROW_SHIFT) // 8
    for part, marks in rows.groupBy("part").agg(F.bitmap_construct_agg("at")).toLocalIterator():
        out[part * size : (part + 1) * size] = marks[:size]
    return bytes(out)


def counted(ids: np.ndarray, hashes: np.ndarray, orders: range, mined: range, marks: dict[int, Marks], needed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, words, hashes, counts) of a shard's phrases: all of `orders`, and those of `mined` that occur `needed` times.

    ids: numbered words with 0 between pieces. An order is built on places at which the shorter phrases here and one
    further on are still alive; `marks` of an order must allow a phrase. Phrases are told apart by their word numbers.
    """
    at = np.flatnonzero(ids)
    # of each place: its phrase's rank and, as long as marks will ask for it, its hash; of each rank: its words and hash
    rank, h, names, of_rank = ids[at].astype(np.uint64), hashes[ids[at]], np.arange(len(hashes), dtype=np.uint32)[:, None], hashes
    longest, word = max(orders.stop, mined.stop) - 1, np.uint64(0xFFFFFFFF)
    for order in range(1, longest + 1):
        if order > 1:
            alive = np.zeros(len(ids) + 1, dtype=bool)
            alive[at] = True
            keep = alive[at + 1]
            at, rank = at[keep], rank[keep]
            last = ids[at + order - 1]
            rank = (rank << np.uint64(32)) | last
            if any(n >= order for n in marks):
                h = mixed(h[keep], hashes[last])
        if order in marks:
            ok = marks[order].test(h)
            at, rank, h = at[ok], rank[ok], h[ok]
        if order == 1 and order not in orders:
            continue
        if order < longest:
            codes, inverse, counts = np.unique(rank, return_inverse=True, return_counts=True)
        else:
            codes, counts = np.unique(rank, return_counts=True)
        if order == 1:
            names, of_rank = names[codes], of_rank[codes]
        else:
            first, end = codes >> np.uint64(32), (codes & word).astype(np.uint32)
            names, of_rank = np.hstack([names[first], end[:, None]]), mixed(of_rank[first], hashes[end])
        if order in orders:
            yield order, names, of_rank, counts
        elif order in mined:
            enough = counts >= needed
            yield order, names[enough], of_rank[enough], counts[enough]
        if order < longest:
            if order in mined:
                ok = enough[inverse]
                at, inverse = at[ok], inverse[ok]
                if any(n > order for n in marks):
                    h = h[ok]
            rank = inverse.astype(np.uint64)


NONE = range(0)


def shards(texts: DataFrame, totals: dict[str, int], marks: dict[int, bytes], orders: range = NONE, mined: range = NONE, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, h, n) of texts (lang, text), shard by shard.

    Phrases of `orders` with all their occurrences. For `mined` orders, hashes h alone (they tell languages apart too) of
    what reaches the shard's share of `least`, with what it has beyond the most that a phrase can have without reaching
    it; a row with a language alone has that.
    totals: each language's bytes. marks: bitmaps by order.
    """
    sent = texts.sparkSession.sparkContext.broadcast(marks)  # a few bitmaps of 16 MB at most
    columns = ["lang", "phrase", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = {order: Marks(raw) for order, raw in sent.value.items()}
        held, words, size = {}, Words({b".": 0}), 0

        def shard() -> Iterator[pa.RecordBatch]:
            names = pa.array(words, pa.binary())
            of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
            for lang in list(held):
                own, parts = held.pop(lang)
                needed = max(1, -(-least * own // totals[lang]))
                hashes = of_word ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))
                batch = lambda lang, text, h, n: pa.RecordBatch.from_arrays([lang, text, h, pa.array(n, pa.int64())], columns)
                if len(mined):
                    yield batch(pa.array([lang]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), [needed - 1])
                for order, phrases, h, n in counted(np.concatenate(parts), hashes, orders, mined, tests, needed):
                    for cut in range(0, len(n), PHRASES_AT_ONCE):
                        some = slice(cut, cut + PHRASES_AT_ONCE)
                        key = pa.array(h[some].view(np.int64))
                        if order in orders:
                            text = pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in phrases[some].T], b" ").cast(pa.string())
                            yield batch(pa.repeat(lang, len(key)), text, key, n[some])
                        else:
                            none = pa.nulls(len(key), pa.string())
                            yield batch(none, none, key, n[some] - (needed - 1))
            words.clear()
            words[b"."] = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py()
                own = held.setdefault(lang, [0, []])
                own[0] += len(raw)
                own[1].append(numbered(raw, words))
                size += len(raw)
                if size >= shard_bytes:
                    yield from shard()
                    size = 0
        yield from shard()

    return texts.mapInArrow(run, "lang string, phrase string, h long, n long")


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all words and phrases with at least `least` occurrences; (lang, n) all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = dict(map(tuple, texts.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long"))).collect()))  # one row a language
    total = sum(totals.values())
    context = docs.sparkSession.sparkContext
    texts = texts.where("text != ''").coalesce(max(1, -(-total // TASK_BYTES), min(context.defaultParallelism, total // LEAST_BYTES)))
    of = lambda marks, **more: shards(texts, totals, marks, least=least, shard_bytes=shard_bytes, **more)
    enough = F.col("n") >= least

    def summed(rows: DataFrame) -> DataFrame:
        """Each phrase or hash once, summed by tasks before the shuffle and stored; a phrase always has one hash."""
        return written(rows.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n")))

    def union(found: DataFrame) -> bytes:
        """The bitmap of what may be frequent: what shards have found, and what they may have of it without telling."""
        mined = found.where("phrase is null")
        unsaid = mined.where("h is null").agg(F.max("n")).first()[0] or 0  # of the language in which it is most
        return marks_of(mined.where(F.col("h").isNotNull() & (F.col("n") >= least - unsaid)).select("h"))

    words = summed(of({}, orders=range(1, 2)))
    single = words.where(enough)
    pairs_of = {2: union(summed(of({1: marks_of(single.select("h"))}, mined=range(2, 3))))}
    both = summed(of(pairs_of, orders=range(2, 3), mined=range(3, LONGEST + 1)))
    pairs = both.where(F.col("phrase").isNotNull() & enough)
    longer_of = union(both)
    longer = summed(of(pairs_of | dict.fromkeys(range(3, LONGEST + 1), longer_of), orders=range(3, LONGEST + 1))).where(enough)
    return single.unionByName(pairs).unionByName(longer).select("lang", "phrase", "n"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    counts, sizes = frequent(docs, text_col, lang_col, least, shard_bytes)
    counts = written(counts.withColumn("words", F.split("phrase", " ")))
    longer = counts.where(F.size("words") > 1).select("lang", "phrase", F.col("n").alias("a"), "words")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = longer.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    # parts of frequent phrases are frequent, so both are found
    parts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(19, 0)) * {SCALE}) div (cast(l as decimal(19, 0)) + r)").cast("long")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    within = longer.where(F.size("words") > 2).select("lang", F.col("a").alias("n"), "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("k"))
    within = within.select("lang", "n", "words", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("i"))
    covers = within.select("lang", part(F.col("i"), F.col("k")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    covered = F.expr(f"cast(most as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {COVERED}")
    kept = scored.join(covers, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # the best of each task go on
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece
  FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
spans AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS k FROM starts),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM spans WHERE i + k - 1 <= len(w) GROUP BY ALL),
size AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM cand),
parts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:k], ' ') AS q FROM cuts),
scored AS (
  SELECT x.lang, x.phrase, x.a, c, l.n AS l, r.n AS r, {SCALE}::HUGEINT * x.a // (l.n + r.n) AS score
  FROM parts x JOIN f l ON l.lang = x.lang AND l.phrase = x.p JOIN f r ON r.lang = x.lang AND r.phrase = x.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
placed AS (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM inner_),
cover AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM placed GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.most IS NULL OR 100::HUGEINT * c.most < {COVERED}::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT x.lang, rank, phrase, a, l, r, s.n::BIGINT AS n, score::BIGINT AS score
FROM ranked x JOIN size s ON s.lang = x.lang WHERE rank <= {TOP}
"""
