"""Exact byte-pair encoding of a public tokenizer file, in batches.

``Bpe`` reads a ``tokenizers`` JSON file (byte-level BPE, or BPE with word ends over
NFC-normalised lower case), cuts texts into words, and merges distinct words in numpy:
all words of a batch take their next merge (lowest rank, leftmost) together.  ``Encoder``
adds a bounded memory of words.  Results equal the library's ``encode`` without special
tokens being added; special tokens written out in a text become their ids, as there.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np

from tarnhelm.llm.common import PIECE, gather, kept, pieces

#: Letters and numbers below U+0180, where Unicode versions agree; other texts take the library's own rules.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_BEYOND = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")
_END = "(?:[stmd]|re|ve|ll)"
_NONE = np.iinfo(np.int32).max


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    LONG = 64  # longer words are merged one by one

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)  # a byte inside a word
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)  # the byte that ends it
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        # a pair that is listed twice keeps its last rank, as a map would
        self.pair_of = {int(k): (r, vocab[a + b]) for r, (k, (a, b)) in enumerate(zip(keys, pairs, strict=True))}
        order = np.array(sorted(self.pair_of), np.int64)
        self.keys = order
        self.ranks = np.array([self.pair_of[int(k)][0] for k in order], np.int32)
        self.made = np.array([self.pair_of[int(k)][1] for k in order], np.int32)
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for t, i in vocab.items():
            end, core = (b" ", t[: -len(self.suffix)]) if self.suffix and t.endswith(self.suffix) else (b"", t)
            self.token_bytes[i] = bytes(back[c] for c in core) + end
        for t, i in self.specials.items():
            self.token_bytes[i] = t.encode()
        import regex

        if self.suffix:
            self._slow = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
            self._fast = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'{_END}|[^\s{_LETTERS}{_NUMBERS}]+")
        else:
            self._slow = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self._fast = re.compile(rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'{_END}| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
        self._library = None

    def library(self):
        """The library's own tokenizer, used where this Python's Unicode tables may differ from its."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _cut(self, text: str) -> list[str]:
        if self.suffix:
            if not _BEYOND.search(text):
                return self._fast.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
            text = self.library().normalizer.normalize_str(text)
        elif not _BEYOND.search(text):
            return self._fast.findall(text)
        chars = self.library().pre_tokenizer.pre_tokenize_str(text)
        table = self._from_chars
        return [bytes(map(table.__getitem__, w)).decode("utf-8") for w, _ in chars]

    @property
    def _from_chars(self) -> dict[str, int]:
        if not hasattr(self, "_chars"):
            self._chars = {c: b for b, c in enumerate(byte_chars())}
        return self._chars

    def words(self, text: str) -> list[str | int]:
        """The words of a text in order; a special token is its id."""
        if self._special is None or "<" not in text or not self._special.search(text):
            return self._cut(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._cut(text[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._cut(text[at:])

    # -- merging
    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _NONE), at

    def merge_one(self, word: bytes) -> list[int]:
        """One word of any length, by a queue of its mergeable pairs: n log n."""
        ids = [int(x) for x in self.first[list(word)]]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i):
            j = nxt[i]
            if j < n and (hit := self.pair_of.get((ids[i] << 32) | ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = c, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [x for x in ids if x >= 0]

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: flat ids and bounds."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        for i in np.flatnonzero(lens > self.LONG):
            out[i] = np.array(self.merge_one(words[i]), np.int32)
        for lo, hi in ((1, 4), (4, 8), (8, 12), (12, 20), (20, 36), (36, self.LONG + 1)):
            pick = np.flatnonzero((lens >= lo) & (lens < hi))
            for a in range(0, len(pick), 8192):
                self._merge_block(words, pick[a : a + 8192], lens, out)
        counts = np.fromiter((0 if x is None else len(x) for x in out), np.int64, len(out))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return (np.concatenate([x for x in out if x is not None]) if bounds[-1] else np.zeros(0, np.int32)).astype(np.int32), bounds

    def _merge_block(self, words, pick, lens, out) -> None:
        n, width = len(pick), int(lens[pick].max())
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in pick]), np.uint8).reshape(n, width)
        col = np.arange(width)
        size = lens[pick]
        ids = np.where(col < size[:, None], self.first[raw], -1)
        row = np.arange(n)
        ids[row, size - 1] = self.last[raw[row, size - 1]]
        rank = self._pairs(ids[:, :-1], ids[:, 1:])[0]
        live = row
        while width > 1 and len(live):
            p = rank.argmin(1)
            r = np.arange(len(live))
            going = rank[r, p] != _NONE
            if not going.all():
                for i in np.flatnonzero(~going):
                    x = ids[i]
                    out[pick[live[i]]] = x[x >= 0]
                live, ids, rank, p = live[going], ids[going], rank[going], p[going]
                r = np.arange(len(live))
                if not len(live):
                    return
            merged = self.made[self._pairs(ids[r, p], ids[r, p + 1])[1]]
            width -= 1
            left = np.arange(width) <= p[:, None]
            ids = np.where(left, ids[:, :width], ids[:, 1:])
            ids[r, p] = merged
            if width == 1:
                break
            rank = np.where(left[:, : width - 1], rank[:, : width - 1], rank[:, 1:])
            q = np.minimum(p, width - 2)
            rank[r, q] = self._pairs(ids[r, q], ids[r, q + 1])[0]
            q = np.maximum(p - 1, 0)
            rank[r, q] = self._pairs(ids[r, q], ids[r, q + 1])[0]
        for i, w in enumerate(live):
            x = ids[i]
            out[pick[w]] = x[x >= 0]


class _Memory(dict):
    """Word to row; an unknown word gets the next row and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        row = self[word] = len(self)
        self.new.append(word)
        return row


class Encoder:
    """Encodes batches; remembers up to ``remember`` words between them (a speed limit only)."""

    def __init__(self, bpe: Bpe, remember: int = 600_000, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.bpe, self.remember = bpe, remember
        self.resolve = resolve or bpe.merge
        self._forget()

    def _forget(self) -> None:
        self.memory, self.ids, self.bounds = _Memory(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _shrink(self) -> None:
        """Keep the words that were met first; frequent words are among them."""
        keep = self.remember // 3
        old, self.memory = self.memory, _Memory()
        self.memory.update(islice(old.items(), keep))
        self.bounds = self.bounds[: keep + 1].copy()
        self.ids = self.ids[: self.bounds[-1]].copy()

    def _learn(self) -> None:
        new, self.memory.new = self.memory.new, []
        if not new:
            return
        flat, bounds = self.resolve([b"" if isinstance(w, int) else w.encode("utf-8") for w in new])
        special = [i for i, w in enumerate(new) if isinstance(w, int)]
        if special:  # an empty row becomes the id itself
            parts = np.split(flat, bounds[1:-1])
            for i in special:
                parts[i] = np.array([new[i]], np.int32)
            flat = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the bounds of each text; a long text is encoded in pieces."""
        if all(len(t) <= PIECE for t in texts):
            return self._block(texts)
        flats, lens, block = [], [], []

        def flush() -> None:
            flat, bounds = self._block(block)
            flats.append(flat)
            lens.extend(np.diff(bounds).tolist())
            block.clear()

        for t in texts:
            if len(t) <= PIECE:
                block.append(t)
                continue
            flush()
            parts = [self._block([p])[0] for p in pieces(t)]
            flats += parts
            lens.append(sum(map(len, parts)))
        flush()
        return np.concatenate(flats), np.cumsum([0, *lens])

    def _block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memory) > self.remember:
            self._shrink()
        rows, counts, get = [], np.zeros(len(texts) + 1, np.int64), self.memory.__getitem__
        for i, t in enumerate(texts):
            ws = self.bpe.words(t)
            counts[i + 1] = len(ws)
            rows.append(np.fromiter(map(get, ws), np.int32, len(ws)))
        self._learn()
        at, words = gather(self.bounds, np.concatenate(rows) if rows else np.zeros(0, np.int32))
        return self.ids[at], words[np.cumsum(counts)]


_BPES: dict[str, Bpe] = {}
REMEMBER = 600_000


def bpe_of(path: str) -> Bpe:
    """One per Python worker."""
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def encoder_of(path: str, remember: int = REMEMBER) -> Encoder:
    mine = kept("encoder")
    if (path, remember) not in mine:
        mine.clear()
        mine[path, remember] = Encoder(bpe_of(path), remember)
    return mine[path, remember]
