"""Word shingles as sorted arrays of 64-bit hashes, computed over blocks of text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once; bytes of a word beyond which it is hashed by itself.
BLOCK, LONGEST = 1 << 20, 64
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The lowest 0 to 8 bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word; words are runs of bytes other than ASCII white space."""
    hashes, starts, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # words stay whole
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        h, s = _block_hashes(data[at:end], seed)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _block_hashes(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes of all words at a time are mixed into the hashes, which begin with the word's length; the few words
    longer than LONGEST bytes are hashed by XXH3. Mixing is not linear, so no family of words shares a hash."""
    import xxhash

    padded = data + bytes(LONGEST + 8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = size - start
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = _mixed(size.astype(_U) * _BASE + _U(seed))
    left, at, rows = size, start, slice(None)
    for _ in range(LONGEST // 8):
        if not len(left):
            break
        lane = lanes[at] & _MASKS[np.minimum(left, 8)]
        out[rows] = _mixed(out[rows] * _BASE + lane)
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        left, at = left[more] - 8, at[more] + 8
    for k in np.flatnonzero(size > LONGEST).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]], seed)
    return out, start


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; fewer words are one shingle; no words are none."""
    n = len(words)
    if n == 0:
        return words
    take = min(size, n)
    out = np.full(n - take + 1, take, _U)
    for i in range(take):
        out = _mixed(out * _BASE + words[i : n - take + 1 + i])
    return out


def words_of_each(texts: Iterable[str | None], seed: int = 0) -> Iterator[np.ndarray]:
    """The word hashes of each text, A-Z lower-cased; short texts are hashed together."""
    held: list[bytes] = []
    total = 0
    for text in texts:
        held.append(normal(text))
        total += len(held[-1])
        if total >= BLOCK:
            yield from _split(held, seed)
            held, total = [], 0
    yield from _split(held, seed)


def _split(texts: list[bytes], seed: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    words, starts = word_hashes(b"\n".join(texts), seed)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, begin).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield words[a:b]


def shingle_sets(texts: Iterable[str | None], size: int = 5, seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for words in words_of_each(texts, seed):
        yield np.unique(shingle_hashes(words, size))
