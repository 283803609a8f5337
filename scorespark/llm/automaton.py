"""BPE as a deterministic automaton over tokens, made from the merges by one gadget each."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scorespark.llm.common import map_batches
from scorespark.llm.tokens import LONGEST_KEPT, MEMORY, ODD_BLANKS, PARTS, Remembering, byte_signs, file_of, library, ranges

#: Words whose ids a worker keeps.
MOST_WORDS = 400_000


class Automaton:
    """The automaton that accepts exactly the token sequences which merging by rank gives.

    It begins with one state and an arc for each byte. The merge of u and v is a gadget: wherever an arc of u leads to a
    state with an arc of v, that state is copied without v, the arc of u leads to the copy, and a new arc of u v leads
    where v led. All arcs of a token lead to one state, so there are as many gadgets as merges and at most one state more.

    A state is kept as what its copies took away. Tokens are numbered so that a token comes before all that begin with it
    by their merges, the latest first: then what a gadget takes away, v and what later merges made of v, is one range of
    numbers. A row of the table is the sorted bounds of such ranges; a token has no arc where its number lies in one.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        made = [(ids[u], ids[v], ids[u + v]) for u, v in merges]
        count = max(ids.values()) + 1
        self.longest = max(map(len, ids))
        self.number = self._numbers(ids, made, count)
        later = np.array(self._sizes(made, count)) - 1  # tokens that merges not yet made will begin with this one
        size = later + 1
        above, taken = [-1], [(0, 0)]  # of each state: the one it was copied from, and the range it lost
        leads = [0] * count
        dead = set()
        for u, v, w in made:
            if u in dead or v in dead or not self._open(above, taken, leads[u], int(self.number[v])):
                dead.add(w)  # no sequence ever has u before v
                continue
            begin = int(self.number[v])
            above.append(leads[u])
            taken.append((begin, begin + 1 + int(later[v])))
            leads[w], leads[u] = leads[v], len(above) - 1
            later[u] -= size[w]
        #: Tokens by their bytes; those that no sequence has are left out.
        self.ids = {t: i for t, i in ids.items() if i not in dead}
        rows: dict[int, array] = {}
        self.row = [rows[s] if s in rows else rows.setdefault(s, self._bounds(above, taken, s)) for s in leads]
        self.size = {i: len(t) for t, i in ids.items()}
        #: What is the end of a longer token.
        self.tails = {t[i:] for t in self.ids for i in range(1, len(t))}
        self.number = self.number.tolist()

    @staticmethod
    def _sizes(made: list[tuple[int, int, int]], count: int) -> list[int]:
        size = [1] * count
        for u, _, w in reversed(made):
            size[u] += size[w]
        return size

    def _numbers(self, ids: dict[bytes, int], made: list[tuple[int, int, int]], count: int) -> np.ndarray:
        size, number = self._sizes(made, count), np.zeros(count, np.int64)
        products, at = {w for _, _, w in made}, 0
        for i in sorted(set(ids.values()) - products):
            number[i], at = at, at + size[i]
        ends = number + size  # where the next product that begins with the token ends: the earliest lies last
        for u, _, w in made:
            number[w] = ends[u] - size[w]
            ends[u], ends[w] = number[w], number[w] + size[w]
        return number

    @staticmethod
    def _open(above: list[int], taken: list[tuple[int, int]], state: int, number: int) -> bool:
        while state:
            if taken[state][0] <= number < taken[state][1]:
                return False
            state = above[state]
        return True

    @staticmethod
    def _bounds(above: list[int], taken: list[tuple[int, int]], state: int) -> array:
        spans, out = [], array("i")
        while state:
            spans.append(taken[state])
            state = above[state]
        for begin, end in sorted(spans):
            if out and begin <= out[-1]:
                out[-1] = max(out[-1], end)
            else:
                out.extend((begin, end))
        return out

    def arc(self, token: int, following: int) -> bool:
        """Whether the state after token has an arc for the following one."""
        return not bisect_right(self.row[token], self.number[following]) & 1

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The only sequence of arcs from the start whose labels spell word.

        Each prefix of word has one such sequence; its last arc is found from those of the shorter prefixes.
        """
        ids, tails, row, number = self.ids, self.tails, self.row, self.number
        if (whole := ids.get(word)) is not None:  # the start has an arc for every token
            return (whole,)
        last, longest = [-1], self.longest
        for end in range(1, len(word) + 1):
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                part = word[begin:end]
                token = ids.get(part)
                if token is not None and (begin == 0 or not bisect_right(row[last[begin]], number[token]) & 1):
                    last.append(token)
                    break
                if part not in tails:
                    raise ValueError(f"no token ends {word[:end]!r}")
            else:
                raise ValueError(f"no token ends {word[:end]!r}")
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(reversed(out))


class AutomatonCodec:
    """Whole texts to ids and back, with the file of a byte-level tokenizer, as its library does."""

    def __init__(self, name: str):
        self.tok = library(name)
        with open(file_of(name)) as f:
            model = json.load(f)["model"]
        byte = {s: b for b, s in enumerate(byte_signs())}
        raw = lambda token: bytes([byte[c] for c in token])
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        table = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        self.automaton = Automaton(table, [(raw(a), raw(b)) for a, b in merges])
        labels = {i: t for t, i in table.items()} | {i: t.encode() for t, i in added.items()}
        self.size = np.array([len(labels.get(i, b"")) for i in range(max(labels) + 1)] + [0], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.labels = np.frombuffer(b"".join(labels.get(i, b"") for i in range(max(labels) + 1)), np.uint8)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # The library's \s is Unicode White_Space.
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.memory = Remembering(lambda new: [self._both(self._ids(p)) for p in new], MEMORY)
        self.words: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _both(ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), ",".join(map(str, ids))

    def _split(self, text: str) -> list[str]:
        """text split before merging. Of characters that are in no Unicode table of this Python's, only the library knows
        what it takes them for."""
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, text: str) -> list[int]:
        out, known = [], self.words
        for word in self._split(text):
            if (ids := known.get(word)) is None:
                ids = self.automaton.encode(word.encode())
                if len(known) < MOST_WORDS and len(word) <= LONGEST_KEPT:
                    known[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as unsigned 32-bit numbers, and as decimals joined by commas."""
        if self.special and any(s in text for s in self.added):
            ids: list[int] = []
            for k, part in enumerate(self.special.split(text)):
                ids += [self.added[part]] if k % 2 else self._ids(part)
            return self._both(ids)
        if ODD_BLANKS.search(text):
            return self._both(self._ids(text))
        found = self.memory.values_of(PARTS.findall(text))
        return b"".join([x[0] for x in found]), ",".join([x[1] for x in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the ids' arcs, one after the other. An id without an arc has none."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1).astype(np.int64)
        return self.labels[ranges(self.begin[ids], self.size[ids])].tobytes()


@lru_cache(maxsize=2)
def automaton_codec(name: str) -> AutomatonCodec:
    return AutomatonCodec(name)


def automaton_encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every whole text; strings of special tokens become these.

    Null text counts as empty: no ids. doc_id may be null or repeated; other columns are ignored; an empty table gives an
    empty result. No shuffle: each row is encoded where it is read.
    """

    def make():
        codec = automaton_codec(tokenizer)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [np.frombuffer(codec.encode(t or "")[0], np.uint32).astype(np.int32) for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array(map(len, ids), pa.int64())}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>, n_tokens long")


def automaton_decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """encoded (doc_id, ids array<int>) back to doc_id, text. Null ids count as none, ids that the tokenizer lacks spell
    nothing, and bytes that are no UTF-8 become replacement characters."""

    def make():
        codec = automaton_codec(tokenizer)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [np.array([-1 if x is None else x for x in i or []], np.int64) for i in batch["ids"].to_pylist()]
            return {"doc_id": batch["doc_id"], "text": pa.array([codec.decode(i).decode(errors="replace") for i in ids], pa.string())}

        return work

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def automaton_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Encodes and decodes every whole text; doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in automaton_encode()."""

    def make():
        codec, sha = automaton_codec(tokenizer), hashlib.sha256

        def work(batch: pa.RecordBatch) -> dict:
            n, ids_sha, text_sha = [], [], []
            for t in batch["text"].to_pylist():
                raw, said = codec.encode(t or "")
                n.append(len(raw) // 4)
                ids_sha.append(sha(said.encode()).hexdigest())
                text_sha.append(sha(codec.decode(np.frombuffer(raw, np.uint32)).decode(errors="replace").encode()).hexdigest())
            return {"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
