"""Secret scans: fixed patterns plus sliding-window Shannon entropy over candidate strings.

For each candidate string (a run of key-like characters) and each character class, a window slides over the longest
runs of that class; character counts and the entropy's sum are updated by the character that enters and the one that
leaves. Windows at or above the class's threshold are merged to spans. Candidates on the allow-list are suppressed: UUIDs,
digests in lock files, alphabets, the host and path of a URL (what follows its `?` or `#` is looked at), file paths,
dotted names, and plain words, which may be joined (camel case is split at its capitals). So are spans inside a pattern
match. A random key may look like one of those by chance: of keys drawn from letters and digits, 2.6 % of 20 characters,
0.6 % of 24 and 0.1 % of 32 are lost; of base32 keys of 32 characters 0.01 %.

Null text is an empty text; both give no spans. Ties and repeated rows are scanned independently of each other. Very
long texts are scanned whole; the windows keep constant state.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import map_rows, table

# The base patterns and their shortest accepted lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex")

#: Character class: (name, its characters, window, bits per character from which a window is suspicious).
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0),
    ("entropy_base32", re.compile(r"[A-Z2-7]{24,}|[a-z2-7]{24,}"), 24, 3.4),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.7),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.1),
)
#: What a run must hold besides to be of a class: long words have no digits.
HOLDS = {"entropy_base32": re.compile("[2-7]")}
#: Candidate strings: key-like runs, with or without digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
#: A word: letters of one case, or capitalised, of natural length; or such words joined in camel case, of three letters at
#: least but for the common ones of two and for abbreviations before a capital. Other mixed case is left to its entropy.
_PART = r"(?:[A-Z][a-z]{2,20}|(?:As|At|By|Db|Go|Id|If|In|Io|Is|It|My|No|Of|On|Or|To|Up)(?![a-z])|[A-Z]{2,4}(?=[A-Z][a-z]|[^A-Za-z]|\Z))"
WORD = rf"(?>[a-z]{{2,20}}{_PART}{{1,8}}|{_PART}{{2,9}}|[A-Z]?[a-z]{{1,27}}|[A-Z]{{1,28}})"  # the longest form first, without going back
#: What stands before a candidate that is the host and path of a URL.
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}:\Z")
#: What looks random but is no secret.
ALLOWED = (
    re.compile(r"[0-9.]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:sha1|sha256|sha384|sha512|md5)-[A-Za-z0-9+/=]+"),
    re.compile(rf"/*+{WORD}(?:[-_./+=]++(?:{WORD}|[0-9]{{1,4}}))*+[-_./]?[0-9]{{0,4}}/?"),
    re.compile(r"0123456789(?:abcdef|ABCDEF|[A-Za-z]*)"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches; leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def windows(run: str, width: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Merged spans of `run` in which every window of `width` characters has at least `threshold` bits a character.

    H = log2(w) - sum(c * log2 c) / w, so one step changes two terms of the sum.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, most = 0.0, (math.log2(width) - threshold) * width + 1e-9
    start = end = -1
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= width:
            old = run[i - width]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
        if i >= width - 1 and total <= most:
            if i - width + 1 > end:
                if end > 0:
                    yield start, end
                start = i - width + 1
            end = i + 1
    if end > 0:
        yield start, end


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOWED)


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of high-entropy spans that no allow-list entry explains."""
    out = []
    for candidate in CANDIDATE.finditer(text):
        word = candidate[0]
        if allowed(word.strip(".-_=+")) or word.startswith("//") and SCHEME.search(text, max(0, candidate.start() - 17), candidate.start()):
            continue
        for name, pattern, width, threshold in CLASSES:
            for run in pattern.finditer(word):
                if name in HOLDS and not HOLDS[name].search(run[0]) or allowed(run[0]):
                    continue
                for s, e in windows(run[0], width, threshold):
                    at = candidate.start() + run.start()
                    out.append((at + s, at + e, name))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(pattern spans, all spans in order); entropy spans that a longer or earlier span covers are left out."""
    base = base_spans(text or "")
    kept, at, reach = list(base), 0, -1  # reach: the furthest end of a span that starts no later
    for s, e, kind in sorted(entropy_spans(text or ""), key=lambda x: (x[0], -x[1])):
        while at < len(base) and base[at][0] <= s:
            reach = max(reach, base[at][1])
            at += 1
        if e > reach:
            kept.append((s, e, kind))
            reach = e
    order = {k: i for i, k in enumerate((*KINDS, *(c[0] for c in CLASSES)))}
    return base, sorted(kept, key=lambda x: (x[0], order[x[2]], x[1]))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, base array<struct>, spans array<struct>) with start, end (code points) and kind."""
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        as_dicts = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        for key, text in rows:
            base, spans = scan(text)
            yield key, as_dicts(base), as_dicts(spans)

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
