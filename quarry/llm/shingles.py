"""Word shingles of whole texts as sorted 64-bit hashes, a batch of documents at a time.

Words are runs of bytes other than space and TAB .. CR; A-Z is lower-cased first. All work is on the UTF-8 bytes
of an Arrow string array, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 5
#: Bytes of text that are worked on at once. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1 & 2**64 - 1
_PLACE = _rng.integers(0, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(0, 2**64, K, np.uint64, endpoint=False)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
        if n > SLICE_BYTES + 4096:
            return have  # of a very long text: not kept
        _powers[name] = have
    return have


_UNBASE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of pieces of about SLICE_BYTES; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of all words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SEP[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word
    end[:-1] &= ~word[1:] | cut[1:-1]
    # `end` shares memory with `word`, and reads one place ahead of what it writes.
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct k-word shingle hashes of each text, one after the other.

    A text with 1 to k - 1 words has one token for the whole sequence, one without words none.
    """
    s, e, first = word_spans(buf, offs)
    n_docs = len(offs) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    with np.errstate(over="ignore"):
        # A word's hash: its polynomial, taken out of the running sum and moved to place 0.
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * _power(_BASE, len(buf), "up")[: len(buf)], out=total[1:])
        w = mix((total[e] - total[s]) * _power(_UNBASE, len(buf), "down")[s] + (e - s).astype(np.uint64))
        m = len(w) - k + 1
        run = np.zeros(max(m, 0), np.uint64)
        for j in range(k):
            run += w[j : j + max(m, 0)] * _PLACE[j % len(_PLACE)]
        run = mix(run)
        count = np.diff(first)
        per = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        out = np.zeros(n_docs + 1, np.int64)
        np.cumsum(per, out=out[1:])
        tokens = np.empty(out[-1], np.uint64)
        full = np.flatnonzero(count >= k)
        if len(full):
            lens = per[full]
            at = np.repeat(first[full] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            to = np.repeat(out[full] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
            tokens[to] = run[at]
        for d in np.flatnonzero((count > 0) & (count < k)):
            ws = w[first[d] : first[d + 1]]
            tokens[out[d]] = mix((ws * _PLACE[: len(ws)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(ws)])[0]
    for d in full[lens > 1] if len(full) else ():
        tokens[out[d] : out[d + 1]].sort()
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = tokens[1:] != tokens[:-1]
    heads = out[:-1][per > 0]
    fresh[heads] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))[out]
    return tokens[fresh], kept
