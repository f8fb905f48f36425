"""Byte-level BPE encoding and decoding in padded numpy matrices.

Texts are cut into chunks at spaces, and chunks into the pattern's matches. A chunk's ids are kept for the texts to come,
in bounded number; each distinct match of a batch's new chunks is encoded once. Matches are put into buckets by length, and a bucket is one matrix of token ids, a row for each match. In every round each row merges
its leftmost pair of minimum rank, found in a hash table of pairs, and closes the gap. A row of more than WIDE bytes would
be moved once for each of its merges, so such matches (a page without a space, an encoded blob) merge the same pairs in
the same order from a heap instead, in time that grows little faster than their length.
Ids then go back to the texts by index. Texts never mix: a text's ids depend on the text alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import carried, tidied

#: Bytes of text that are encoded at once, and the cells of a matrix.
CHUNK_BYTES, CELLS = 1 << 20, 1 << 18
#: Chunks whose ids a worker keeps (about 20 MB), and the characters of the longest.
MEMO, KEPT_CHARS = 100_000, 64
#: Bytes of the widest row of a matrix.
WIDE = 512
#: The rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max
# Fixed value: a pattern whose matches take one leading space at most, with a run of white space up to its last
# character as a match.
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# White space as str.isspace() has it: a space inside white space or at the end after some, and one between other characters.
IN_SPACE, LONE_SPACE = re.compile(r"\s (?:\s|\Z)"), re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


class Vocabulary:
    """Ranks of byte strings, and the table of pairs of tokens that merge.

    Every way to split a token in two tokens is a pair with the whole's rank, as in encoders that look up the joined
    bytes.
    """

    def __init__(self, ranks: list[tuple[bytes, int]]):
        of = dict(ranks)
        self.size = max(of.values()) + 1
        self.first = np.array([of[bytes([b])] for b in range(256)], np.int32)
        keys, ranks_ = [], []
        for token, rank in of.items():
            for cut in range(1, len(token)):
                a, b = of.get(token[:cut]), of.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks_.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self._fill(np.array(keys, np.int64)[order], np.array(ranks_, np.int32)[order])
        self.whole = of
        spelled = [b""] * self.size
        for token, rank in of.items():
            spelled[rank] = token
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(x) for x in spelled])))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open hash table of the pairs: slots probed one after the other."""
        bits = max(4, int(np.ceil(np.log2(len(keys) * 3 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            take = left[free]
            first = take[np.unique(at[take], return_index=True)[1]]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair joins to, NONE without one. A negative id is padding."""
        keys = left.astype(np.int64) * self.size + right
        at = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        found = self.keys[at]
        hit = (found == keys) & (right >= 0) & (left >= 0)
        out[hit] = self.ranks[at[hit]]
        todo = np.flatnonzero(((found != keys) & (found != -1) & (right >= 0) & (left >= 0)).ravel())
        flat, keys, at = out.reshape(-1), keys.ravel(), at.ravel()
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            flat[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): rows of byte tokens padded with -1, merged until no pair of a row joins."""
        n, width = rows.shape
        done, lengths = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        ids, who, size = rows.copy(), np.arange(n), (rows >= 0).sum(axis=1)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while len(who):
            if not rank.shape[1]:
                done[who, : ids.shape[1]], lengths[who] = ids, size
                break
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(who)), at]
            open_ = best != NONE
            if not open_.all():
                end = ~open_
                done[who[end], : ids.shape[1]], lengths[who[end]] = ids[end], size[end]
                ids, who, size, rank, at, best = ids[open_], who[open_], size[open_], rank[open_], at[open_], best[open_]
                if not len(who):
                    break
            r = np.arange(len(who))
            place = np.arange(ids.shape[1])
            ids[r, at] = best
            # Close the gap at at + 1 in ids, and at `at` in the ranks, whose neighbours are looked up anew.
            shifted = np.concatenate((ids[:, 1:], np.full((len(who), 1), -1, np.int32)), axis=1)
            ids = np.where(place > at[:, None], shifted, ids)
            size = size - 1
            moved = np.concatenate((rank[:, 1:], np.full((len(who), 1), NONE, np.int32)), axis=1)
            rank = np.where(place[:-1] > at[:, None], moved, rank)
            right = np.where(at + 1 < ids.shape[1], ids[r, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            inside = at < rank.shape[1]
            rank[r[inside], at[inside]] = self.rank_of(ids[r, at], right)[inside]
            left = at > 0
            rank[r[left], at[left] - 1] = self.rank_of(ids[r[left], at[left] - 1], ids[r[left], at[left]])
            widest = int(size.max())
            if widest < ids.shape[1]:
                ids, rank = ids[:, :widest], rank[:, : max(widest - 1, 0)]
        return done, lengths

    def merge_wide(self, piece: bytes) -> np.ndarray:
        """The ids of one long match: the leftmost pair of minimum rank first, as merge() does, from a heap."""
        n = len(piece)
        tokens = self.first[np.frombuffer(piece, np.uint8)]
        rank = self.rank_of(tokens[:-1], tokens[1:]).astype(np.int64)
        open_ = np.flatnonzero(rank != NONE)
        heap = ((rank[open_] << 40) | open_).tolist()  # rank, then place: one integer each
        heapq.heapify(heap)
        # Parts by the place of their first byte: where they end, where the part before begins, rank with the next.
        end, before, now = list(range(1, n + 1)), list(range(-1, n)), rank.tolist() + [NONE]
        token, whole, place = tokens.tolist(), self.whole, (1 << 40) - 1
        while heap:
            top = heapq.heappop(heap)
            i, r = top & place, top >> 40
            if now[i] != r:
                continue  # one of the two has merged since
            j = end[i]
            e = end[i] = end[j]
            token[i], now[j] = r, -1
            before[e] = i
            now[i] = NONE
            if e < n and (new := whole.get(piece[i : end[e]])) is not None:
                now[i] = new
                heapq.heappush(heap, new << 40 | i)
            if (b := before[i]) >= 0:
                now[b] = NONE
                if (new := whole.get(piece[b:e])) is not None:
                    now[b] = new
                    heapq.heappush(heap, new << 40 | b)
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = end[i]
        return np.array(out, np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each)."""
        ranks = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int32, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known, wide = np.flatnonzero(ranks >= 0), np.flatnonzero((ranks < 0) & (sizes > WIDE))
        rest = np.flatnonzero((ranks < 0) & (sizes <= WIDE))
        # Ids in the order in which they are found: which pieces, how many of each, and the ids.
        which, counts, found = [known], [np.ones(len(known), np.int64)], [ranks[known]]
        for k in wide.tolist():
            found.append(self.merge_wide(pieces[k]))
            which.append(np.array([k]))
            counts.append(np.array([len(found[-1])]))
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        size = sizes[rest]
        i = 0
        while i < len(rest):
            # A bucket: lengths that are alike, and as many rows as fit into CELLS.
            j = int(np.searchsorted(size, max(size[i] + 1, size[i] * 1.25), "right"))
            j = min(j, i + max(1, CELLS // int(size[min(j, len(size)) - 1])))
            width = int(size[j - 1])
            flat = np.frombuffer(b"".join([pieces[k] for k in rest[i:j].tolist()]), np.uint8)
            rows = np.full((j - i, width), -1, np.int32)
            rows[np.arange(width) < size[i:j, None]] = self.first[flat]
            ids, n = self.merge(rows)
            which.append(rest[i:j])
            counts.append(n)
            found.append(ids[np.arange(width) < n[:, None]])
            i = j
        place = np.argsort(np.concatenate(which))
        n = np.concatenate(counts)
        return _gathered(np.concatenate(found), np.cumsum(n) - n, n, place)[0], n[place]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(self.offsets[ids] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(ids) else np.zeros(0, np.int64)
        return self.spelling[at].tobytes()


class Splitter:
    """Cuts texts into chunks that no match of a pattern crosses, and chunks into the matches.

    Words between single spaces repeat a lot, so texts are cut before each space. No match crosses that unless a space
    stands between other white space and white space or the end: those texts are cut before spaces between other
    characters only. It holds for SPACED_PATTERN; with another one a text is one chunk.
    """

    def __init__(self, pattern: str):
        self.spaced = pattern == SPACED_PATTERN
        self.find = regex.compile(pattern).findall

    def cut(self, text: str) -> list[str]:
        """The chunks, all but the first without the space they begin with."""
        if not self.spaced:
            return [text]
        return LONE_SPACE.split(text) if IN_SPACE.search(text) else text.split(" ")


class Encoder:
    """Ids of texts by a vocabulary and a pattern. Those of short chunks are kept for the texts to come, MEMO at most."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.splitter = Vocabulary(load_ranks(path)), Splitter(pattern)
        #: Ids of chunks at the start of a text, and of those after a space, as bytes of int32.
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.first) + len(self.spaced) > MEMO:
            self.first.clear()
            self.spaced.clear()
        cut = [self.splitter.cut(t) for t in texts]
        first = {c[0] for c in cut}.difference(self.first)
        spaced = set().union(*(c[1:] for c in cut)).difference(self.spaced)
        long = self._learn(list(first), self.first, "") + self._learn(list(spaced), self.spaced, " ")
        out = [np.frombuffer(self.first[c[0]] + b"".join(map(self.spaced.__getitem__, c[1:])), np.int32) for c in cut]
        for memo, chunk in long:
            del memo[chunk]
        return out

    def _learn(self, chunks: list[str], memo: dict[str, bytes], before: str) -> list[tuple[dict[str, bytes], str]]:
        """Adds the chunks to memo; those too long to be kept."""
        # Chunks that white space does not begin or end meet the pattern together: no match crosses the spaces between them.
        plain = [before and c != "" and not c[0].isspace() and not c[-1].isspace() for c in chunks]
        chunks = [c for c, p in zip(chunks, plain, strict=True) if p] + [c for c, p in zip(chunks, plain, strict=True) if not p]
        together = sum(map(bool, plain))
        found = self.splitter.find(" " + " ".join(chunks[:together])) if together else []
        stop = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), np.cumsum([len(c) + 1 for c in chunks[:together]])) + 1
        stops = stop.tolist() if together else []
        for chunk in chunks[together:]:
            found += self.splitter.find(before + chunk)
            stops.append(len(found))
        pieces: dict[str, int] = {}
        of = np.array([pieces.setdefault(x, len(pieces)) for x in found], np.int64)
        ids, n = self.vocabulary.encode_pieces([p.encode("utf-8") for p in pieces])
        flat, ends = _gathered(ids, np.cumsum(n) - n, n, of)
        flat, ends = flat.tobytes(), (4 * np.append(0, ends)[stops]).tolist()
        for chunk, i, j in zip(chunks, [0, *ends], ends):
            memo[chunk] = flat[i:j]
        return [(memo, chunk) for chunk in chunks if len(chunk) > KEPT_CHARS]


def _gathered(ids: np.ndarray, at: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `of` of ids one after the other, run k being the n[k] from at[k], and where each of them ends."""
    m = n[of]
    ends = np.cumsum(m)
    return ids[np.repeat(at[of] - ends + m, m) + np.arange(ends[-1] if len(ends) else 0)], ends


_loaded: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """Kept for the life of the Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(path, pattern)
    return _loaded[path, pattern]


def encoder(path: str, pattern: str) -> tuple[Vocabulary, Splitter]:
    own = _encoder(path, pattern)
    return own.vocabulary, own.splitter


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[np.ndarray]:
    """The token ids of each text. A null text is an empty one."""
    own = _encoder(path, pattern)
    texts = [t or "" for t in texts]
    i = 0
    while i < len(texts):
        size, j = len(texts[i]), i + 1
        while j < len(texts) and size + len(texts[j]) < CHUNK_BYTES:
            size += len(texts[j])
            j += 1
        yield from own.encode(texts[i:j])
        i = j


def _encoded(path: str, pattern: str, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = encoder(path, pattern)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                n, a, b, tokens, same = [], [], [], [], []
                texts = part.column("text").to_pylist()
                for text, ids in zip(texts, encode_texts(texts, path, pattern), strict=True):
                    n.append(len(ids))
                    if digests:
                        b.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                        a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    else:
                        tokens.append(ids)
                        same.append(vocabulary.decode(ids) == (text or "").encode("utf-8"))
                columns = {"kept": part.column("kept"), "n_tokens": pa.array(n, pa.int64())}
                columns |= {"ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())} if digests else {"tokens": pa.array(tokens, pa.list_(pa.int32())), "round_trip": pa.array(same, pa.bool_())}
                out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                del part, texts, text, ids, n, a, b, tokens, same, columns
                yield out
                del out
            del batch  # before the next one is read

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with `n_tokens` (long) and `tokens` (array<int>) of the whole text, and `round_trip`
    (boolean), whether they decode to its bytes.

    path: a file of base64 byte strings and ranks, at the same place on all executors; every byte has to be in it.
    No special tokens. Null and empty texts have no tokens. No row meets another, so there is no shuffle. A column
    of docs named like a new one gives way to it; empty input gives an empty result.
    """
    return _run(docs, path, pattern, text_col, keep, False, "tokens array<int>, round_trip boolean")


def bpe_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As bpe_encode, but with digests in place of the tokens: ids_sha256 of the ids as little-endian unsigned 32-bit
    integers, and decoded_sha256 of the bytes that decoding the ids gives."""
    return _run(docs, path, pattern, text_col, keep, True, "ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, path: str, pattern: str, text_col: str, keep: list[str] | None, digests: bool, added: str) -> DataFrame:
    new = ["n_tokens", *(x.split()[0] for x in added.split(", "))]
    rows, kept = carried(docs, docs[text_col].cast("string"), keep, new)
    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL(f"n_tokens long, {added}")])
    return rows.mapInArrow(tidied(_encoded(path, pattern, digests)), schema).select(*kept, *new)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, tokens_col: str = "tokens") -> DataFrame:
    """encoded with `decoded` (string) for its token ids; invalid UTF-8 decodes with replacement characters, null ids to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = encoder(path, pattern)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(tokens_col).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    rows = encoded.drop("decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["decoded string"])
    return rows.mapInArrow(run, schema)
