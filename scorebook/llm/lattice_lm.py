"""Language-model scores from a subword lattice.

A token (a word, or the end of a text) has all segmentations into pieces of an existing subword vocabulary as paths of a
lattice. Every piece has a unigram score; the forward recursion adds up the paths in log space, so a token's probability
is the marginal over its segmentations. The public vocabularies at hand were made by merging and carry ranks instead of
probabilities: the scores start from the ranks (Zipf) and are re-estimated by EM_ROUNDS rounds of forward-backward over
the distinct words of the training documents. The pieces themselves stay as they are.

Words seen in training join the lattice as one-piece paths of their own, by absolute discounting:
P(token) = max(c - D, 0) / N + (D V / N) M(token), with M the marginal over the subword paths. Both parts are
distributions over tokens, so P is one. M has to foretell new words, so each distinct word counts once for its scores,
as in Kneser-Ney smoothing; D = n1 / (n1 + 2 n2), from the numbers of words seen once and twice (DISCOUNT if none is
seen once). A text's score is the sum of log10 P over its tokens.

Word counts cover all documents. The commonest words (at most TOP_WORDS) are looked up in a broadcast table; all others
are joined to the full word table, so no word is left out and no join key is hot.

Beside that score, `lattice_score` is the text's marginal by the subword lattice alone.

Null text is empty: its only token is the end. Empty training data: N = 0 and the subword paths alone. Repeated rows
are scored each on their own; ties don't arise. An empty table gives no rows. Words over LONG_WORD characters are scored
and counted exactly, block by block, with one number per character in memory. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import crc_mod, map_rows, table, written
from scorebook.llm.minhash import words_of

#: Subword vocabulary: a public file, read on the driver (bounded by its number of pieces).
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: EM rounds; discount where no word is seen once; words in the broadcast table; distinct words counted before a task passes them on.
EM_ROUNDS, DISCOUNT, TOP_WORDS, HELD_WORDS = 2, 0.75, 250_000, 400_000
#: Characters of a batch of equally long words, and of all such batches at once; the word length from which words go one
#: at a time, in blocks; bytes of the longest word of the broadcast table.
BATCH_CHARS, HELD_CHARS, LONG_WORD, TOP_BYTES = 60_000, 2_000_000, 2000, 64
#: Added to each piece's expected count.
PIECE_PRIOR = 0.1
START = "▁"  # fixed value: the vocabulary's mark of a word's start
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A subword vocabulary with log probabilities; lookups are by hash, for whole arrays of substrings."""

    def __init__(self, pieces: list[str]):
        """`pieces` in rank order; byte pieces are written <0x00> to <0xFF>."""
        is_byte = lambda p: len(p) == 6 and p.startswith("<0x")
        usable = lambda p: not any("A" <= c <= "Z" for c in p) and not p.startswith("<")
        weights = {p: 1 / (10 + rank) for rank, p in enumerate(pieces) if usable(p)}
        self.text = list(weights)
        self.n = len(self.text)  # then 256 byte pieces and the end
        zipf = np.array([*weights.values(), *[1e-5] * 256, 1e-3])
        assert sum(map(is_byte, pieces)) in (0, 256)
        self.starts = np.array([p.startswith(START) for p in self.text] + [False] * 257)
        self.set(zipf)
        self.tables = {}
        for size in range(1, max(map(len, self.text)) + 1):
            own = [i for i, p in enumerate(self.text) if len(p) == size]
            if own:
                chars = np.frombuffer("".join(self.text[i] for i in own).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size)
                h = np.zeros(len(own), dtype=np.uint64)
                for j in range(size):
                    h = self.extend(h, chars[:, j])
                order = np.argsort(h)
                self.tables[size] = h[order], np.array(own)[order]

    @staticmethod
    def extend(h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        h = (h + chars.astype(np.uint64) + np.uint64(1)) * _STEP
        return h ^ h >> np.uint64(29)

    def set(self, weights: np.ndarray) -> None:
        self.log_p = np.log(weights / weights.sum())

    def end_probability(self) -> float:
        """M(end): a text ends where the next word could start."""
        p = np.exp(self.log_p)
        return float(p[-1] / (p[-1] + p[:-1][self.starts[:-1]].sum()))

    def byte_log_p(self, chars: np.ndarray) -> np.ndarray:
        """Log probability of each character's way through byte pieces."""
        own = {c: sum(self.log_p[self.n + b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in np.unique(chars).tolist()}
        unique = np.array(sorted(own), dtype=np.uint32)
        return np.array([own[c] for c in unique.tolist()])[np.searchsorted(unique, chars)]

    def arcs(self, chars: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """size -> (log probabilities, pieces) of the substrings [word, start]; -inf where there is no such piece."""
        out, h = {}, np.zeros(chars.shape, dtype=np.uint64)
        for size in range(1, min(chars.shape[1], max(self.tables)) + 1):
            h = self.extend(h[:, : chars.shape[1] - size + 1], chars[:, size - 1 :])
            if size in self.tables:
                keys, ids = self.tables[size]
                at = np.minimum(np.searchsorted(keys, h.ravel()), len(keys) - 1).reshape(h.shape)
                hit = keys[at] == h
                if hit.any():
                    piece = np.where(hit, ids[at], 0)
                    out[size] = np.where(hit, self.log_p[piece], -np.inf), piece
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(terms)
    top = stack.max(axis=0)
    return top + np.log(np.exp(stack - top).sum(axis=0))


def forward(arcs: dict, by_bytes: np.ndarray) -> np.ndarray:
    """Log alpha [word, position]; the byte route spans one character and keeps every alpha finite."""
    n, length = by_bytes.shape
    alpha = np.zeros((n, length + 1))
    for j in range(1, length + 1):
        terms = [alpha[:, j - 1] + by_bytes[:, j - 1]]
        terms += [alpha[:, j - s] + lp[:, j - s] for s, (lp, _) in arcs.items() if s <= j]
        alpha[:, j] = _log_sum(terms)
    return alpha


def backward(arcs: dict, by_bytes: np.ndarray) -> np.ndarray:
    n, length = by_bytes.shape
    beta = np.zeros((n, length + 1))
    for i in range(length - 1, -1, -1):
        terms = [beta[:, i + 1] + by_bytes[:, i]]
        terms += [beta[:, i + s] + lp[:, i] for s, (lp, _) in arcs.items() if i + s <= length]
        beta[:, i] = _log_sum(terms)
    return beta


def by_length(rows: Iterator[tuple]) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """(characters [word, place], rows) for batches of equally long words; each row's first field is the word's bytes."""
    held: dict[int, list[tuple[str, tuple]]] = {}
    size = 0

    def batch(length: int) -> tuple[np.ndarray, list[tuple]]:
        own = held.pop(length)
        chars = np.frombuffer("".join(w for w, _ in own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(own), length)
        return chars, [r for _, r in own]

    for row in rows:
        word = START + row[0].decode("utf-8", "surrogatepass")
        own = held.setdefault(len(word), [])
        own.append((word, row))
        size += len(word)
        if len(own) * len(word) >= BATCH_CHARS or len(word) >= LONG_WORD:
            size -= len(own) * len(word)
            yield batch(len(word))
        elif size >= HELD_CHARS:
            yield from map(batch, list(held))
            size = 0
    for length in list(held):
        yield batch(length)


def long_forward(pieces: Pieces, chars: np.ndarray) -> np.ndarray:
    """All alphas of one long word [1, place]; arcs are looked up block by block."""
    most, length = max(pieces.tables), chars.shape[1]
    alpha = np.zeros(length + 1)
    for at in range(0, length, LONG_WORD):
        low, end = max(0, at - most), min(length, at + LONG_WORD)
        arcs, by_bytes = pieces.arcs(chars[:, low:end]), pieces.byte_log_p(chars[:, low:end])
        for j in range(at + 1, end + 1):
            terms = [alpha[j - 1] + by_bytes[0, j - 1 - low]]
            terms += [alpha[j - s] + lp[0, j - s - low] for s, (lp, _) in arcs.items() if j - s >= low]
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in terms))
    return alpha


def long_expected(pieces: Pieces, chars: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one long word [1, place]: alphas forward, then betas and uses block by block back."""
    most, length = max(pieces.tables), chars.shape[1]
    alpha, beta = long_forward(pieces, chars), np.zeros(length + 1)
    uses = np.zeros(pieces.n + 257)
    for low in range((length - 1) // LONG_WORD * LONG_WORD, -1, -LONG_WORD):
        end = min(length, low + LONG_WORD)
        part = chars[:, low : min(length, end + most)]
        arcs, by_bytes = pieces.arcs(part), pieces.byte_log_p(part)
        for i in range(end - 1, low - 1, -1):
            terms = [beta[i + 1] + by_bytes[0, i - low]]
            terms += [beta[i + s] + lp[0, i - low] for s, (lp, _) in arcs.items() if i - low < lp.shape[1]]
            top = max(terms)
            beta[i] = top + math.log(sum(math.exp(x - top) for x in terms))
        for s, (lp, piece) in arcs.items():
            n = min(end - low, lp.shape[1])
            share = np.exp(alpha[low : low + n] + lp[0, :n] + beta[low + s : low + s + n] - alpha[-1])
            uses += np.bincount(piece[0, :n], weights=share, minlength=len(uses))
        share = np.exp(alpha[low:end] + by_bytes[0, : end - low] + beta[low + 1 : end + 1] - alpha[-1])
        add_bytes(pieces, uses, chars[:, low:end], share)
    return uses


def marginals(pieces: Pieces, chars: np.ndarray) -> np.ndarray:
    """Natural log of M for equally long words."""
    if chars.shape[1] > LONG_WORD:
        return np.array([long_forward(pieces, row[None, :])[-1] for row in chars])
    return forward(pieces.arcs(chars), pieces.byte_log_p(chars))[:, -1]


def add_bytes(pieces: Pieces, uses: np.ndarray, chars: np.ndarray, share: np.ndarray) -> None:
    """Add the uses of characters' byte pieces."""
    unique, inverse = np.unique(chars, return_inverse=True)
    for c, x in zip(unique.tolist(), np.bincount(inverse.ravel(), weights=share.ravel()).tolist(), strict=True):
        for b in chr(c).encode("utf-8", "surrogatepass"):
            uses[pieces.n + b] += x


def expected(pieces: Pieces, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of every piece in `counts` copies of the words."""
    if chars.shape[1] > LONG_WORD:
        return sum(n * long_expected(pieces, row[None, :]) for row, n in zip(chars, counts, strict=True))
    arcs, by_bytes = pieces.arcs(chars), pieces.byte_log_p(chars)
    alpha, beta = forward(arcs, by_bytes), backward(arcs, by_bytes)
    base = np.log(counts)[:, None] - alpha[:, -1:]
    uses = np.zeros(pieces.n + 257)
    for s, (lp, piece) in arcs.items():
        hit = lp > -np.inf
        share = np.exp(alpha[:, : lp.shape[1]] + lp + beta[:, s:] + base)
        uses += np.bincount(piece[hit], weights=share[hit], minlength=len(uses))
    add_bytes(pieces, uses, chars, np.exp(alpha[:, :-1] + by_bytes + beta[:, 1:] + base))
    return uses


def load_pieces(path: str = VOCABULARY) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = sorted(range(model.get_piece_size()), key=lambda i: -model.get_score(i))
    return Pieces([model.id_to_piece(i) for i in ranked if not (model.is_control(i) or model.is_unknown(i))])


def count_words(docs: DataFrame, text_col: str = "text", train_col: str = "train") -> DataFrame:
    """(word, c, n): occurrences of every word in the training rows and in all rows, counted map-side first."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts = {True: Counter(), False: Counter()}

        def drained() -> Iterator[tuple]:
            for train, own in counts.items():
                yield from ((w, n if train else 0, n) for w, n in own.items())
                own.clear()

        for text, train in rows:
            counts[bool(train)].update(words_of(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from drained()
        yield from drained()

    partial = map_rows(docs.select(text_col, train_col), run, "word binary, c long, n long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, pieces: Pieces, rounds: int = EM_ROUNDS) -> Pieces:
    """Re-estimate the piece scores on the distinct words; each round returns one number per piece to the driver."""
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def run(rows: Iterator[tuple], shared=shared) -> Iterator[tuple]:
            uses = np.zeros(shared.value.n + 257)
            for chars, own in by_length(rows):
                uses += expected(shared.value, chars, np.ones(len(own)))
            at = np.flatnonzero(uses)
            yield from zip(at.tolist(), uses[at].tolist(), strict=True)

        uses = map_rows(words.where("c > 0").select("word"), run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        weights = np.full(pieces.n + 257, PIECE_PRIOR)
        got = uses.toPandas()  # at most one row per piece
        weights[got["piece"].to_numpy()] += got["uses"].to_numpy()
        weights[-1] += 1  # the end is one of the distinct tokens
        pieces.set(weights)
        shared.unpersist()
    return pieces


def commonest(words: DataFrame, most: int) -> DataFrame:
    """All words with at least so many occurrences that no more than `most` words have them.

    The bound comes from a histogram of the counts' logarithms (a thousand bins at most), so no task sends its words.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(words.groupBy(level.alias("l")).count().toPandas().itertuples(index=False), reverse=True)
    total, least = 0, None
    for x, n in bins:
        total += n
        if total > most:
            break
        least = x
    return words.where(level >= least) if least is not None else words.limit(0)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", path: str = VOCABULARY, top_words: int = TOP_WORDS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of all `docs`; scores are log10."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).alias("_id"), F.col(train_col).alias("_train"), F.col(text_col).alias("_text"))
    words = written(count_words(docs, "_text", "_train"))
    ends = docs.where("_train").count()
    seen_in = lambda n: F.count_if(F.col("c") == n)
    total, distinct, once, twice = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), seen_in(1), seen_in(2)).first()
    total, distinct = total + ends, distinct + (ends > 0)
    discount = once / (once + 2 * twice) if once else DISCOUNT
    pieces = fit_pieces(words, load_pieces(path))
    shared = sc.broadcast(pieces)
    back = discount * distinct / total if total else 1.0

    def logs(c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, score, lattice) in log10 for tokens with training counts c and log marginals m."""
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        seen = np.maximum(c - discount, 0) / max(total, 1)
        sub = np.log(back) + m
        return base, np.where(seen > 0, np.logaddexp(np.log(np.maximum(seen, 1e-300)), sub), sub) / math.log(10), m / math.log(10)

    def weigh(rows: Iterator[tuple]) -> Iterator[tuple]:
        for chars, own in by_length(rows):
            c = np.array([r[1] for r in own], dtype=np.float64)
            parts = logs(c, marginals(shared.value, chars))
            yield from ((r[0], r[1] > 0, r[2], *x) for r, *x in zip(own, *(p.tolist() for p in parts), strict=True))

    weighed = written(map_rows(words.select("word", "c", "n"), weigh, "word binary, known boolean, n long, base double, score double, lattice double"))
    top = commonest(weighed, top_words).where(F.octet_length("word") <= TOP_BYTES).toPandas()  # bounded by top_words x TOP_BYTES
    lookup = sc.broadcast(({w: i for i, w in enumerate(top["word"].map(bytes))}, *(top[c].to_numpy() for c in ("known", "base", "score", "lattice"))))
    ends_at = [float(x[0]) for x in logs(np.array([float(ends)]), np.log([pieces.end_probability()]))]

    def first(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, known, *scores = lookup.value
        get = place.get
        for key, row, train, text in rows:
            words = words_of(text)
            ids = list(map(get, words))
            at = np.fromiter((i for i in ids if i is not None), dtype=np.int64)
            rest = Counter(w for w, i in zip(words, ids, strict=True) if i is None) if len(at) < len(ids) else {}
            tail = [{"word": w, "k": k} for w, k in rest.items()]
            yield key, row, bool(train), len(words) + 1, int(known[at].sum()) + (ends > 0), *(float(x[at].sum()) + e for x, e in zip(scores, ends_at, strict=True)), tail

    kind = docs.schema["_id"].dataType.simpleString()
    fields = f"_id {kind}, row long, train boolean, n_tokens long, n_known long, base double, score double, lattice double, tail array<struct<word:binary,k:long>>"
    heads = written(map_rows(docs.select("_id", F.monotonically_increasing_id().alias("row"), "_train", "_text"), first, fields))
    tail = heads.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k").join(weighed.drop("n"), "word")
    k = F.col("k")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("known"), k).otherwise(0)).alias("k2"), F.sum(k * F.col("base")).alias("b2"), F.sum(k * F.col("score")).alias("s2"), F.sum(k * F.col("lattice")).alias("l2"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return heads.drop("tail").join(tail, "row", "left").select(
        F.col("_id").alias(id_col),
        "train",
        "n_tokens",
        plus("n_known", "k2").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "b2").alias("base_score"),
        plus("score", "s2").alias("score"),
        plus("lattice", "l2").alias("lattice_score"),
    )


def op7_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from those outside the held-out fold (crc32 of the id as text, modulo 5, is 1)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 5) != 1, F.lit(False)).alias("train"))
    out = score_documents(docs)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
