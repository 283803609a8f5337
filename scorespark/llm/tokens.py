"""Texts to ids by the files of public tokenizers; each worker remembers what it has encoded."""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's memories, and the characters of their longest keys: bounds for any corpus.
MEMORY, LONGEST_KEPT = 200_000, 64
#: Python counts these as blank, the libraries' patterns do not: such texts go to the library whole.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: A text falls into these parts before any merge; the split of each part depends on nothing outside it.
PARTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def file_of(name: str) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file_of(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def ranks(name: str) -> dict[bytes, int]:
    with open(file_of(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def keep(memory: dict, new: dict, most: int) -> None:
    """Adds what is short to a memory; one that would grow beyond most entries starts anew."""
    if len(memory) + len(new) > most:
        memory.clear()
    memory.update({k: v for k, v in new.items() if len(k) <= LONGEST_KEPT})


class Remembering(dict):
    """part of a text -> what encode(list of parts) gives for it.

    Holds the first `most` short parts that come, which word frequencies make the common ones; rarer and longer parts are
    encoded as they come. When those have become many times `most`, the texts have changed, and it starts anew.
    """

    def __init__(self, encode, most: int = MEMORY):
        super().__init__()
        self.encode, self.most, self.missed = encode, most, 0

    def values_of(self, parts: list[str]) -> list:
        out = list(map(self.get, parts))
        if None not in out:
            return out
        new = list({p for p, x in zip(parts, out, strict=True) if x is None})
        found = dict(zip(new, self.encode(new), strict=True))
        if len(self) < self.most:
            self.update({p: x for p, x in found.items() if len(p) <= LONGEST_KEPT})
        else:
            self.missed += len(new)
            if self.missed > 20 * self.most:
                self.clear()
                self.missed = 0
        return [found[p] if x is None else x for p, x in zip(parts, out, strict=True)]


#: Kinds of bytes: white space, letters (ASCII and Latin-1), digits, points, and bytes whose words the library must split.
SPACE, LETTER, DIGIT, POINT, HARD = range(5)
#: Letters that may follow an apostrophe in the tokenizer's pattern ('s, 't, 're, 've, 'm, 'll, 'd).
SHORTENED = b"stmdrvlSTMDRVL"


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each byte by itself."""
    kind, low = np.full(256, HARD, np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(b" \t\n\x0b\x0c\r")] = SPACE
    kind[33:127] = POINT
    kind[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    kind[[b for b in range(128) if chr(b).isdigit()]] = DIGIT
    low[65:91] += 32
    return kind, low


KIND, LOW = _kinds()


def units(raw: np.ndarray, begins: np.ndarray, kinds: np.ndarray = KIND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a word tokenizer splits UTF-8 texts into before it merges: (bytes, first byte of each unit, whether it is hard,
    first unit of each text). raw holds the texts one after the other, beginning at begins.

    A unit is a run of letters or of points, or a digit, in lower case; or a whole word with a HARD byte, as it is.
    """
    kind, low = kinds[raw], LOW[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # of Latin-1 letters
    tail = raw[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead + 1] += np.where(raw[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
    if kinds[ord("'")] == POINT:
        quote = np.flatnonzero(raw[:-1] == ord("'"))
        kind[quote[np.isin(raw[quote + 1], np.frombuffer(SHORTENED, np.uint8))]] = HARD

    used = np.flatnonzero(kind != SPACE)
    first = np.searchsorted(used, begins)  # of each text, among the bytes used
    begin = np.concatenate(([True], np.diff(used) != 1))[: len(used)]
    begin[first[first < len(used)]] = True
    kind, raw, low = kind[used], raw[used], low[used]
    words = np.flatnonzero(begin)
    if not len(words):
        return raw, words, words.astype(bool), np.zeros(len(begins), np.int64)
    hard = np.repeat(np.logical_or.reduceat(kind == HARD, words), np.diff(np.append(words, len(used))))
    cut = (kind == DIGIT) | np.concatenate(([True], kind[1:] != kind[:-1]))
    starts = begin | (cut & ~hard)
    at = np.flatnonzero(starts)
    return np.where(hard, raw, low), at, hard[at], np.searchsorted(at, first)


class WordIds:
    """Ids of a byte-level tokenizer that drops case and white space and marks the ends of words, for many texts at once.

    Each distinct unit of a batch is encoded once: its merges are made for all units of a length together, one merge a
    unit in each step. Words that are not plainly ASCII or Latin-1, and long units, go to the library.
    """

    def __init__(self, name: str):
        self.tok = library(name)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(file_of(name)) as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab().values()) < 1 << 16 else "<u4")
        shown = byte_signs()
        self.inner = np.array([vocabulary[c] for c in shown], np.int64)
        self.last = np.array([vocabulary[c + end] for c in shown], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocabulary[a + b] for a, b in merges] + [0], np.int64)
        self.ranks = Numbers(np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64))
        self.hard: dict[bytes, bytes] = {}

    def merged(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of each row of data, units of one length in bytes; ids beyond that number mean nothing."""
        n, width = data.shape
        ids, sizes = np.zeros((n, width), np.int64), np.full(n, width)
        now = self.inner[data]
        now[:, -1] = self.last[data[:, -1]]
        rank, rows = self.ranks(now[:, :-1] << 32 | now[:, 1:]), np.arange(n)
        while len(rows):
            width = now.shape[1]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.ranks.none)
            if (done := best == self.ranks.none).any():
                ids[rows[done], :width], sizes[rows[done]] = now[done], width
                now, rank, at, best, rows = now[~done], rank[~done], at[~done], best[~done], rows[~done]
            if not len(rows):
                break
            every, after = np.arange(len(rows)), np.arange(width - 1)[None] > at[:, None]
            now = np.where(after, now[:, 1:], now[:, :-1])
            now[every, at] = self.made[best]
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            for side in (at - 1, at):  # the pairs that the new token is part of
                k = np.flatnonzero((side >= 0) & (side < width - 2))
                rank[k, side[k]] = self.ranks(now[k, side[k]] << 32 | now[k, side[k] + 1])
        return ids, sizes

    def _by_library(self, new: list[bytes]) -> dict[bytes, bytes]:
        got = self.tok.encode_batch([w.decode() for w in new], add_special_tokens=False)
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(new, got, strict=True)}

    def _of_units(self, data: np.ndarray, at: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of distinct units, one after the other."""
        size = np.diff(np.append(at, len(data)))
        hard = hard | (size > LONGEST_KEPT)
        counts, parts = np.zeros(len(at), np.int64), []
        for width in np.unique(size[~hard]).tolist():
            for rows in np.array_split(own := np.flatnonzero((size == width) & ~hard), 1 + len(own) // 20_000):
                ids, n = self.merged(data[at[rows][:, None] + np.arange(width)])
                counts[rows] = n
                parts.append((rows, ids[np.arange(width) < n[:, None]].astype(self.kind)))
        if hard.any():
            rows = np.flatnonzero(hard)
            words = [data[at[k] : at[k] + size[k]].tobytes() for k in rows.tolist()]
            new = self._by_library([w for w in words if w not in self.hard])
            found = [new[w] if w in new else self.hard[w] for w in words]
            keep(self.hard, new, MEMORY)
            counts[rows] = [len(x) // self.kind.itemsize for x in found]
            parts.append((rows, np.frombuffer(b"".join(found), self.kind)))
        begins = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), self.kind)
        for rows, ids in parts:
            out[ranges(begins[rows], counts[rows])] = ids
        return out, counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text). Null is empty."""
        texts, whole = pc.fill_null(texts, ""), np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        u = Units(plain)
        store, counts = self._of_units(u.data, u.ends[:-1], u.hard)
        lengths = counts[u.codes]
        flat = store[ranges((np.cumsum(counts) - counts)[u.codes], lengths)]
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.append(u.first, len(u.codes))]
        sizes = np.diff(upto)
        if whole.any():  # rare: texts with the special tokens' strings
            parts = np.split(flat, upto[1:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, self.kind)
            flat, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, sizes


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of the lengths, one after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def byte_signs() -> list[str]:
    """The character that stands for each byte in the vocabularies of byte-level tokenizers: itself where it is printable,
    else the next unused one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    sign = dict(zip(seen, seen, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}
    return [chr(sign[b]) for b in range(256)]


class Numbers:
    """64-bit keys to their numbers (place in keys), looked up for many keys at once in open addressing."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, keys: np.ndarray):
        self.none, self.bits = len(keys), max(4, (16 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.number = np.full(1 << self.bits, self.none, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.number[slot[left]] == self.none]
            self.number[slot[free]] = free  # of several one stays
            put = left[self.number[slot[left]] == left]
            self.keys[slot[put]] = keys[put]
            left = left[self.number[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(self.FACTOR)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, `none` where it is not known."""
        flat = keys.ravel()
        slot = self._slot(flat)
        found = self.number[slot]
        left = np.flatnonzero((self.keys[slot] != flat) & (found != self.none))
        found[left] = self.none
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            used = self.number[at] != self.none
            hit = used & (self.keys[at] == flat[left])
            found[left[hit]] = self.number[at[hit]]
            left = left[used & ~hit]
        return found.reshape(keys.shape)


class Units:
    """The units of a batch of texts, each distinct one once."""

    def __init__(self, texts: pa.Array, kinds: np.ndarray = KIND):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        data, at, hard, self.first = units(raw, offsets[:-1] - offsets[0], kinds)
        cuts = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, cuts, pa.py_buffer(data)]).dictionary_encode()
        #: Distinct units, and where in them each unit of the texts is.
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.ends = np.append(0, np.cumsum(pc.binary_length(self.distinct).to_numpy())).astype(np.int64)
        self.data = np.frombuffer(self.distinct.buffers()[2] or b"", np.uint8)[: self.ends[-1]]
        self.hard = np.zeros(len(self.distinct), bool)
        self.hard[self.codes] = hard


class Counter:
    """Numbers of tokens by a byte-level tokenizer's library, special strings handled as it does by default."""

    def __init__(self, name: str):
        self.tok = library(name)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memory = Remembering(lambda new: [len(e.ids) for e in self.tok.encode_batch(new, add_special_tokens=False)])

    def __call__(self, text: str) -> int:
        if ODD_BLANKS.search(text) or any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return sum(self.memory.values_of(PARTS.findall(text)))


class PieceCounter:
    """Numbers of pieces by a sentencepiece model, text by text."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file_of(name))

    def __call__(self, text: str) -> int:
        return len(self.model.encode(text))


@lru_cache(maxsize=4)
def counter(name: str):
    return PieceCounter(name) if name.endswith(".model") else Counter(name)


@lru_cache(maxsize=4)
def word_ids(name: str) -> WordIds:
    return WordIds(name)
