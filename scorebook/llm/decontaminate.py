"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised to lower-case words with single spaces. An item of m characters may differ by
k = floor(ERROR_RATE * m) edits; cut into k + 1 pieces, an occurrence within k edits holds one piece unchanged. One
automaton finds all pieces in a text, and each hit's neighbourhood is verified with Myers' bit-parallel distance.

One rule holds for items of all lengths: a match may not begin or end inside a word. A word goes on where two letters or
digits of a script that puts spaces between words stand side by side; Chinese, Japanese, Thai and the like may be matched
from any place. So a short item needs whole words around it, and what is glued to a long one costs edits.

The items are a query set: they go to the tasks in blocks of at most BLOCK_CHARS characters (one, for usual benchmarks),
and each block is compared with all documents. Each Python worker makes a block's automaton once and holds one at a time.

Null and empty texts match nothing; nor do null items and those without a letter or digit. Repeated items and documents
are matched each on their own; ties in distance give the first place. An empty table on either side gives no matches.
Very long texts are searched whole, with memory for one text and its hits. Other columns of the inputs aren't read, and
`drop_leaks` keeps all of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import free_name, keep_rows, map_rows, table, written

#: Edits allowed per character; characters of items broadcast at once.
ERROR_RATE, BLOCK_CHARS = 0.08, 8 << 20
#: First and last characters of scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, ideographs.
UNSPACED = (("\u0e00", "\u0fff"), ("\u1000", "\u109f"), ("\u1780", "\u17ff"), ("\u3040", "\u30ff"), ("\u3400", "\u9fff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff"))

_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower-case words of letters and digits, joined by single spaces."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): `item` cut into budget + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bit_masks(text: str) -> dict[str, int]:
    """Character -> the places that have it, as bits."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def spaced(ch: str) -> bool:
    """A letter or digit of a script that puts spaces between words."""
    return ch != " " and (ch < "\u0e00" or not any(a <= ch <= b for a, b in UNSPACED))


def is_edge(text: str, at: int) -> bool:
    """Whether a match may begin or end at this place of a normalised text."""
    return at in (0, len(text)) or not (spaced(text[at - 1]) and spaced(text[at]))


class Pattern:
    """An item with the bit masks of Myers' algorithm."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text, self.budget = item_id, text, int(rate * len(text))
        self.masks, self.back = bit_masks(text), None

    def scores(self, window: str, anchored: bool = False) -> list[int]:
        """For each place of `window`, the least edits between the item and a substring that ends there.

        Column by column: vp and vn hold where the distance rises and falls down the column. `anchored`: the substring
        starts where the window does.
        """
        m, top = len(self.text), int(anchored)
        every, last = (1 << m) - 1, 1 << m - 1
        vp, vn, score = every, 0, m
        out = [m]
        get = self.masks.get
        for ch in window:
            eq = get(ch, 0)
            xv = eq | vn
            xh = ((eq & vp) + vp ^ vp) | eq
            hp = vn | ~(xh | vp) & every
            hn = vp & xh
            if hp & last:
                score += 1
            elif hn & last:
                score -= 1
            hp = (hp << 1 | top) & every  # if a match may start anywhere, the top row stays zero
            hn = hn << 1 & every
            vp = hn | ~(xv | hp) & every
            vn = hp & xv
            out.append(score)
        return out

    def nearest(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """(distance, place) of the nearest match within the budget between two places of `text`, the first if tied.

        Ends come from a search from left to right, the starts of each from one from right to left.
        """
        best, most = None, self.budget
        ends = sorted((d, e) for e, d in enumerate(self.scores(text[start:stop])) if d <= most and is_edge(text, start + e))
        for d, e in ends:
            if best is not None and d > best[0]:
                break
            if self.back is None:
                self.back = Pattern(self.item_id, self.text[::-1], 0)
            reach = text[max(start, start + e - len(self.text) - most) : start + e][::-1]
            for n, x in enumerate(self.back.scores(reach, anchored=True)):
                at = start + e - n
                if x <= most and (best is None or (x, at) < best) and is_edge(text, at):
                    best = x, at
        return best


class Matcher:
    """All patterns of one block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.patterns = [Pattern(i, t, rate) for i, t in ((i, normalise(t)) for i, t in items) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for offset, piece in pieces(p.text, p.budget):
                places.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, where its first match with that starts, hits within budget) of the items in `text`.

        Places count in the normalised text.
        """
        if not self.patterns:
            return []
        t = normalise(text)
        found: dict[int, list[int]] = {}
        seen: dict[int, tuple[int, int]] = {}  # pattern -> its last verified window
        for end, (size, places) in self.automaton.iter(t):
            for n, offset in places:
                p = self.patterns[n]
                start = max(0, end + 1 - size - offset - p.budget)
                stop = min(len(t), end + 1 - size - offset + len(p.text) + p.budget)
                if n in seen and seen[n][0] <= start and stop <= seen[n][1]:
                    continue  # hits of one place share their window
                seen[n] = start, stop
                match = p.nearest(t, start, stop)
                if match is None:
                    continue
                got = found.setdefault(n, [*match, 0])
                got[:2] = min(got[:2], [*match])
                got[2] += 1
        return [(self.patterns[n].item_id, d, s, hits) for n, (d, s, hits) in sorted(found.items())]


_held: dict[str, Matcher] = {}


def matcher_of(name: str, items, rate: float) -> Matcher:
    """The matcher of a broadcast block; each Python worker makes it once and holds the last one."""
    if name not in _held:
        _held.clear()
        _held[name] = Matcher(items.value, rate)
    return _held[name]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of at most `most` characters (or one item), streamed through the driver."""
    held, size = [], 0
    for key, text in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col).toLocalIterator():
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(doc id, item_id, distance, start, n_hits): every item that occurs in a document within its error budget.

    If the documents' id has one of the other names, that one gets an underscore.

    `start` is where the nearest match (the first, if tied) starts in the normalised text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks(items):
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

        def run(rows: Iterator[tuple], name=name, shared=shared) -> Iterator[tuple]:
            matcher = matcher_of(name, shared, rate)
            for key, text in rows:
                for item, distance, start, hits in matcher.matches(text):
                    yield key, item, distance, start, hits

        part = map_rows(docs.select(id_col, text_col), run, f"id {kind}, item_id {item_kind}, distance int, start int, n_hits int")
        out = part if out is None else out.unionByName(part)
    names = [id_col]
    for name in ("item_id", "distance", "start", "n_hits"):
        names.append(free_name(names, name))
    return out.toDF(*names)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of `docs` in which no item occurs, with all their columns; a narrow filter for each block of items.

    Between blocks the rows are stored, so that no task holds two automata.
    """
    first = True
    for block in blocks(items):
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)

        def clean(name=name, shared=shared):
            matcher = matcher_of(name, shared, rate)
            return lambda text: not matcher.matches(text)

        docs, first = keep_rows(docs if first else written(docs), text_col, clean), False
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark items found in the documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
