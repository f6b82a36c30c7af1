"""Language identification with a per-document mixture of languages.

Training counts hashed letter trigrams per language. A document is a mixture of languages: expectation-maximisation
estimates the proportions from the trigrams' likelihoods, and the set of languages is grown from the best single one
for as long as the log likelihood gains more than a penalty per language. The language with the largest proportion in
the chosen set is the prediction, its proportion the score.

Any number of languages will do: counts pass on from a task before they fill its memory, the driver reads them language
by language, and the model holds only the trigrams that a language has.

Null text and text without letters: `und`, score 0. Empty training data: every row is `und`. Ties: the language that
sorts first. Repeated rows count and are identified each on their own. An empty table gives no rows. Very long texts are
counted whole; state is bounded by the number of hash bins. Other columns are carried only if asked for; an added column
whose name is taken gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import crc_mod, free_name, keep_rows, map_rows, table

#: Hash bins of the trigrams; languages that a task counts at once.
BINS, HELD_LANGUAGES = 1 << 16, 64
#: Added to every count; EM rounds; penalty for one more language, in units of log(trigrams) / 2.
SMOOTHING, ROUNDS, PENALTY = 0.5, 15, 6.0
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> is it a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigram_bins(text: str | None) -> np.ndarray:
    """Hash bins of the trigrams of the lower-cased text, in which each run of non-letters is one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[np.minimum(points, 0x10FFFF)]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    p = points[keep]
    h = p[:-2] * np.uint32(0x9E3779B1) ^ p[1:-1] * np.uint32(0x85EBCA77) ^ p[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bin, n): trigram counts per language over all rows with text and language, summed map-side first."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict[str, np.ndarray] = {}

        def drained() -> Iterator[tuple]:
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield from zip([lang] * len(at), at.tolist(), c[at].tolist(), strict=True)
            counts.clear()

        for text, lang in rows:
            bins = trigram_bins(text)
            if len(bins):
                if lang not in counts:
                    if len(counts) == HELD_LANGUAGES:
                        yield from drained()
                    counts[lang] = np.zeros(BINS, dtype=np.int64)
                counts[lang] += np.bincount(bins, minlength=BINS)
        yield from drained()

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    return map_rows(rows, run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log probabilities of trigram bins by language; a bin's entries are those of `start`, all others have `default`."""

    langs: list[str]
    default: np.ndarray  # [language]
    start: np.ndarray  # [bin + 1]
    lang: np.ndarray  # [entry]
    log_p: np.ndarray  # [entry]

    def of(self, bins: np.ndarray) -> np.ndarray:
        """Log probabilities [bin, language]."""
        out = np.repeat(self.default[None, :], len(bins), axis=0)
        first, n = self.start[bins], self.start[bins + 1] - self.start[bins]
        row = np.repeat(np.arange(len(bins)), n)
        entry = np.arange(len(row)) + np.repeat(first - (np.cumsum(n) - n), n)
        out[row, self.lang[entry]] = self.log_p[entry]
        return out


def model(counts: DataFrame) -> Model:
    """The model of counts (lang, bin, n); the driver reads one language at a time, at most BINS numbers."""
    by_lang = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("c"))
    langs, default, bins, values = [], [], [], []
    for lang, c in by_lang.select("lang", F.struct("c.bin", "c.n")).orderBy("lang").toLocalIterator():
        own = np.array(c[1], dtype=np.float64) + SMOOTHING
        total = own.sum() + SMOOTHING * (BINS - len(own))
        langs.append(lang)
        default.append(np.log(SMOOTHING / total))
        bins.append(np.array(c[0], dtype=np.int32))
        values.append(np.log(own / total).astype(np.float32))
    if not langs:
        return Model([], np.zeros(0, np.float32), np.zeros(BINS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    every, lang = np.concatenate(bins), np.repeat(np.arange(len(langs), dtype=np.int32), [len(b) for b in bins])
    order = np.argsort(every, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(every, minlength=BINS))))
    return Model(langs, np.array(default, dtype=np.float32), start, lang[order], np.concatenate(values)[order])


def em(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of likelihoods `p` [trigram, language] and the log likelihood, for counts `n`."""
    pi, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        mix = p @ pi
        pi = pi * (p.T @ (n / mix)) / total
    return pi, float(n @ np.log(p @ pi))


def proportions(log_p: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Languages (column numbers) of the set with the best penalised likelihood, and their proportions."""
    p = np.exp((log_p - log_p.max(axis=1, keepdims=True)).astype(np.float64))
    single = n @ np.log(p)
    chosen, pi = [int(np.argmax(single))], np.ones(1)
    best, cost = single[chosen[0]], PENALTY * 0.5 * np.log(n.sum() + 1)
    if p.shape[1] > 1:
        full, _ = em(p, n)
        for j in np.argsort(-full, kind="stable"):
            if j in chosen:
                continue
            shares, likelihood = em(p[:, [*chosen, j]], n)
            if likelihood - best <= cost:
                break
            chosen, pi, best = [*chosen, int(j)], shares, likelihood
    return chosen, pi


def identify(df: DataFrame, learnt: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, lang_pred, score, languages): the prediction, its share, and all shares as `lang:share` text."""
    shared = df.sparkSession.sparkContext.broadcast(learnt)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        learnt = shared.value
        langs = learnt.langs
        for key, text, *rest in rows:
            bins, n = np.unique(trigram_bins(text), return_counts=True)
            if not langs or not len(bins):
                yield (key, *rest, UNDETERMINED, 0.0, "")
                continue
            chosen, pi = proportions(learnt.of(bins), n.astype(np.float64))
            order = sorted(range(len(chosen)), key=lambda i: (-pi[i], chosen[i]))
            said = ",".join(f"{langs[chosen[i]]}:{pi[i]:.4f}" for i in order)
            yield (key, *rest, langs[chosen[order[0]]], min(1.0, float(pi[order[0]])), said)

    kinds = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate((id_col, *carry))]
    out = map_rows(df.select(id_col, text_col, *carry), run, ", ".join([*kinds, "lang_pred string, score double, languages string"]))
    return out.toDF(id_col, *carry, *(free_name((id_col, *carry), c) for c in ("lang_pred", "score", "languages")))


def with_fold(docs: DataFrame) -> DataFrame:
    """The held-out fold: crc32 of the id as text is a multiple of 5; a null id is held out."""
    return docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True)))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the documents outside the held-out fold."""
    docs = with_fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    learnt = model(train(docs.where(~F.col("held_out"))))
    return identify(docs.select("doc_id", "text", "held_out"), learnt, carry=("held_out",))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is identified, with all their columns; learns from the labelled rows.

    Rejected are texts without letters, and texts that no mixture of the learnt languages explains better than noise
    does, that is trigrams drawn evenly from all bins. Without any labelled text there is no language to compare with:
    then all texts with letters stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model(train(docs)))

    def identified(text: str | None) -> bool:
        learnt = shared.value
        bins, n = np.unique(trigram_bins(text), return_counts=True)
        if not learnt.langs or not len(bins):
            return bool(len(bins))
        log_p = learnt.of(bins)
        chosen, pi = proportions(log_p, n.astype(np.float64))
        likelihood = n @ np.log(np.exp(log_p[:, chosen].astype(np.float64)) @ pi)
        return bool(likelihood > -n.sum() * np.log(BINS))

    return keep_rows(docs, "text", lambda: identified)
