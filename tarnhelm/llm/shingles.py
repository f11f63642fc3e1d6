"""Word shingles of whole texts as sets of 64-bit digests.

Words are runs of bytes other than ASCII white space, after A-Z are lower-cased.  A text's
set holds its distinct runs of ``k`` words; a text of fewer words has its whole sequence as
the one member, and a text without words has the empty set.

A word of up to 16 bytes is two 64-bit numbers, mixed into one with its length; a longer one
gets 64 bits of BLAKE2b.  A run's digest mixes those of its words, and a sequence of words
is known by BLAKE2b of their digests.  Two different words or runs agree with a probability
of about 2**-64 (texts made against the fixed constants aside); that is the one way in which
a set can be wrong.

Texts are read in blocks of about CHUNK bytes, a longer one in chunks cut at white space:
beside the texts and their digests (8 bytes a word) only a block's arrays are held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tarnhelm.llm.common import mix64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP, _LOW, _HIGH = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: By how many of eight bytes belong to a word: those bytes (little-endian).
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
CHUNK = 1 << 20


def bytes_of(col: pa.Array) -> list[bytes]:
    """A text column's UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


def _chunks(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > CHUNK:
        cut = _SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _digests(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a block's words in order, and where they start."""
    raw = b" " + block.translate(_LOWER) + b" " * 17
    data = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    size = last - first
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    low = eight[first] & _BYTES[np.minimum(size, 8)]
    high = eight[first + 8] & _BYTES[np.clip(size - 8, 0, 8)]
    out = mix64(mix64(low * _LOW + size.astype(np.uint64)) ^ high * _HIGH)
    for i in np.flatnonzero(size > 16):
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]], digest_size=8).digest(), "little")
    return out, first - 1


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words, and the bounds of each text."""
    parts, counts, block, size = [], [0], [], 0

    def flush() -> None:
        word, first = _digests(b" ".join(block))
        starts = np.cumsum([0, *[len(t) + 1 for t in block]])
        parts.append(word)
        counts.extend(np.diff(np.searchsorted(first, starts)).tolist())
        block.clear()

    for t in texts:
        if len(t) > CHUNK:
            if block:
                flush()
            many = [_digests(c)[0] for c in _chunks(t)]
            parts.extend(many)
            counts.append(sum(map(len, many)))
            size = 0
            continue
        block.append(t)
        size += len(t)
        if size > CHUNK:
            flush()
            size = 0
    if block:
        flush()
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def sets_of(texts: list[bytes], k: int, keyed: bool = False) -> tuple[list[np.ndarray], list[bytes | None]]:
    """For each text its sorted distinct shingle digests, and (``keyed``) a digest of its word sequence (None without words)."""
    word, at = _words(texts)
    keys = [hashlib.blake2b(word[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:])] if keyed else []
    run = word
    for j in range(1, k):  # all texts at once; runs that cross from one text to the next are never used
        run = mix64(run[: len(word) - j] * _STEP + word[j:]) if len(word) > j else run[:0]
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            h = np.sort(run[a : b - k + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            h = word[a : a + 1]
            for j in range(a + 1, b):
                h = mix64(h * _STEP + word[j : j + 1])
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, keys
