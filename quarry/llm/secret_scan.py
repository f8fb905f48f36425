"""Secrets in texts: fixed shapes, and values whose cheapest way to be guessed is dear.

Fixed shapes (`assign`, `access`, `hex`) are found by their patterns. The method adds `guess`: what follows a credential
word ("password is ...", "pwd=...", "Bearer ...", a URL's user:value@) is cut into segments in the cheapest way that
someone who guesses could take: dictionary words, dates, repeats, keyboard walks, and brute force for the rest. Costs
are log10 of guesses and add up, with a charge for each segment, so the least sum over all cuts is a dynamic program
over places, linear in the value's length. A value of STRONG or more is a secret; "token: authentication" is not.

The dictionary is the corpus' own: all words of all texts but those in credential values, by how often they occur; the
WORDS most frequent ones are broadcast with their ranks, whatever the corpus' size, and a few words that are COMMON in
passwords. Texts are read twice, by the task that
reads them, and never shuffled: only counts of words are, added up in each task before.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses that a secret takes at least; words of the dictionary, of 3 to LONGEST letters.
STRONG, WORDS, LONGEST = 8.0, 20_000, 24
#: Characters that a value has at least.
LEAST = 6
#: Distinct words that a task counts before it passes the counts on.
HELD = 200_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, what joins it to its value, and the value (group 1); or a value in a URL (group 2).
_CONTEXT = re.compile(
    r"""(?:(?:password|passwd|secret|token|api[_-]?key|passphrase|passcode|credentials?|(?:access|private|secret|auth|signing)[_-]?key|(?<![a-z])(?:pwd|pass))
    ["']?\s{0,9}(?:[:=]>?|:=|\bis\b)\s{0,9}["'`]?|(?<![a-z])bearer\x20{1,9})([^\s"'`<>]{6,})|://[^\s:/@"'<>]{1,99}:([^\s/@"'<>]{6,})@""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
#: One of these is in every lower-cased text that has an `assign` or a context.
_HINTS = ("pass", "secret", "token", "key", "credential", "pwd", "bearer", "://")
_WORD = re.compile(r"[^\W\d_]+")
#: Words that people choose for passwords and writers of examples for secrets, likely ones first.
COMMON = (
    "password", "admin", "welcome", "letmein", "qwerty", "dragon", "monkey", "master", "login", "secret", "changeme", "default", "example", "test",
    "guest", "root", "user", "token", "sunshine", "princess", "football", "shadow", "superman", "iloveyou", "abc", "your", "key", "value",
    "placeholder", "none", "null", "undefined", "hidden", "redacted", "private", "public", "server", "database", "temp", "hello", "trustno",
)


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    guesses: float | None


# Guessing costs, log10 ------------------------------------------------------------------------------------------------

#: Rows of a keyboard, each a half key to the right of the one above, and the alphabet as one more.
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = dict(zip('!@#$%^&*()_+{}:"<>?', "1234567890-=[];',./", strict=True))
#: What stands for a letter.
_LEET = str.maketrans("4@83610!5$7+2", "aabegioissttz")
_DATE = re.compile(r"(?:19|20)\d\d([-./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-./]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
_REPEAT = re.compile(r"(.{1,8}?)\1+", re.DOTALL)
#: Guesses for a segment more, for a year, for a day, for the first key of a walk, for a turn in it.
_SEGMENT, _YEAR, _DAY, _KEY, _TURN = (math.log10(n) for n in (3, 120, 365, 47, 6))


def _adjacent() -> dict[tuple[str, str], int]:
    """Neighbouring keys, and the direction from the first to the second."""
    at = {key: (2 * x + y, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row)}
    keys = {(a, b): (xb - xa, yb - ya) for a, (xa, ya) in at.items() for b, (xb, yb) in at.items()}
    steps = [(2, 0), (-2, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)]
    out = {pair: steps.index(d) for pair, d in keys.items() if d in steps}
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {**{(b, a): 7 for a, b in zip(letters, letters[1:], strict=False)}, **{(a, b): 6 for a, b in zip(letters, letters[1:], strict=False)}, **out}


_STEPS = _adjacent()


def _brute(c: str) -> float:
    return 1.0 if "0" <= c <= "9" else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def _cased(word: str) -> float:
    """Ways in which a word's letters could be upper and lower case."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and (word[0].isupper() or word[-1].isupper())):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), i) for i in range(1, min(upper, len(word) - upper) + 1)) or 2)


def segments(value: str, ranks: Mapping[str, int]) -> list[tuple[int, int, float, str]]:
    """(start, end, cost, kind) of all words, dates, repeats and keyboard walks in a value."""
    out = []
    low = value.lower()
    if len(low) != len(value):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    for i in range(len(value) - 2):
        for j in range(i + 3, min(i + LONGEST, len(value)) + 1):
            rank, leet = ranks.get(low[i:j]), 0.0
            if rank is None and low[i:j] != plain[i:j]:
                rank, leet = ranks.get(plain[i:j]), math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
            if rank is not None:
                out.append((i, j, math.log10(rank + 1) + _cased(value[i:j]) + leet, "word"))
    for i in range(len(value)):
        if m := _DATE.match(value, i):
            out.append((i, m.end(), _YEAR + (_DAY if m.end() - i > 4 else 0) + (0.5 if m.group(1) or m.group(2) else 0), "date"))
    for m in _REPEAT.finditer(value):
        if m.end() - m.start() >= 3:
            block = m.group(1)
            cost = sum(map(_brute, block)) if len(block) < 3 else guesses(block, ranks)
            out.append((m.start(), m.end(), cost + math.log10((m.end() - m.start()) // len(block)), "repeat"))
    keys = "".join(_SHIFTED.get(c, c) for c in low)
    i = 0
    while i < len(keys) - 1:
        j, turns, last = i, 0, None
        while j + 1 < len(keys) and (step := _STEPS.get((keys[j], keys[j + 1]))) is not None:
            turns += step != last
            j, last = j + 1, step
        if j - i >= 2:
            out.append((i, j + 1, _KEY + _TURN * turns + math.log10(j + 1 - i), "walk"))
        i = max(j, i + 1)
    return out


def guesses(value: str, ranks: Mapping[str, int]) -> float:
    """log10 of the guesses of the cheapest cut of a value into segments."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost, _ in segments(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    best = [0.0]  # the least cost of what comes before each place, a charge included for each segment
    brute = math.inf  # of those that end in brute force
    for j, c in enumerate(value, 1):
        brute = min(brute, best[-1] + _SEGMENT) + _brute(c)
        best.append(min([brute, *(best[i] + cost + _SEGMENT for i, cost in ends.get(j, ()))]))
    return max(best[-1] - _SEGMENT, 0.0)


# Texts ----------------------------------------------------------------------------------------------------------------


def _values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands where a credential's value does."""
    for m in _CONTEXT.finditer(text):
        group = 1 if m.group(1) is not None else 2
        start, end = m.span(group)
        end -= len(m.group(group)) - len(m.group(group).rstrip(".,;:!?)]}"))
        if end - start >= LEAST:
            yield start, end


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in _HINTS)


def scan(text: str, ranks: Mapping[str, int], strong: float = STRONG) -> list[Found]:
    """What a text holds, by start, then kind. Values inside a fixed shape are not told again, but its guesses are."""
    hinted = _hinted(text)
    spans = [("assign", *m.span(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST] if hinted else []
    spans += [(kind, *m.span(), m.group()) for kind, shape in (("access", _ACCESS), ("hex", _HEX)) for m in shape.finditer(text)]
    out = [Found(kind, a, b, guesses(value, ranks)) for kind, a, b, value in spans]
    covered = sorted((a, b) for _, a, b, _ in spans)
    at, reached = 0, 0
    for a, b in _values(text) if hinted else ():
        while at < len(covered) and covered[at][0] <= a:
            reached = max(reached, covered[at][1])
            at += 1
        if reached < b and (cost := guesses(text[a:b], ranks)) >= strong:
            out.append(Found("guess", a, b, cost))
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often words occur outside credential values."""
    n: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for x in batch.column("text"):
            text = x.as_py()
            if text is None:
                continue
            at = 0
            for a, b in [*(_values(text) if _hinted(text) else ()), (len(text), len(text))]:
                n.update(w for w in _WORD.findall(text[at:a].lower()) if 3 <= len(w) <= LONGEST)
                at = b
            if len(n) > HELD:
                yield out()
                n.clear()
    yield out()


def dictionary(docs: DataFrame, text: Column, words: int = WORDS) -> dict[str, int]:
    """The most frequent words of all texts with their ranks from 1, ties by code point."""
    counts = docs.select(text.alias("text")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(words).collect()  # `words` rows, as a parameter says
    return {r["word"]: i for i, r in enumerate(top, 1)}


_FOUND = "array<struct<kind: string, start: int, end: int, guesses: double>>"


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: int = WORDS, strong: float = STRONG) -> DataFrame:
    """The columns `keep` (all by default) of docs and `found`: what each whole text holds, by start, then kind (those
    of KINDS in order), with start and end in code points, end exclusive, and log10 of the guesses.

    A null or empty text holds nothing. Repeated rows are all scanned. Values of any length are scored whole. An input's
    column named `found` is left out; other names do not clash. Empty input gives an empty result.
    """
    own = dictionary(docs, F.col(f"`{text_col}`"), words)
    ranks = docs.sparkSession.sparkContext.broadcast({**own, **{w: min(i, own.get(w, i)) for i, w in enumerate(COMMON, 1)}})
    rows, back = carried(docs, F.col(f"`{text_col}`"), keep, ["found"])
    kind = rows.schema["kept"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f._asdict() for f in scan(x.as_py() or "", ranks.value, strong)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found, found_type)], names=["kept", "found"])

    return rows.mapInArrow(run, f"kept {kind}, found {_FOUND}").select(*back, "found")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans of each text, see scan_secrets."""
    found = scan_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda f: f["kind"] != "guess")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
