"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from scorespark.llm.common import map_batches
from scorespark.llm.tokens import LONGEST_KEPT, MEMORY, ODD_BLANKS, PARTS, Remembering, ranks

#: Transducer states that a worker keeps, the first that come and so the common ones; later ones are made in passing.
MOST_STATES = 250_000
#: Pieces whose ids a worker keeps.
MOST_PIECES = 900_000


class State(dict):
    """Bytes read since the last token that is certain, and the token before them.

    Maps a byte to (tokens out, next state); a move that has not been taken before is made when it is asked for.
    ends[i] is the last token of the encoding of the first i + 1 pending bytes.
    """

    __slots__ = ("before", "ends", "flushed", "machine", "pending")

    def __init__(self, machine: Transducer, before: bytes | None, pending: bytes, ends: tuple[bytes, ...]):
        super().__init__()
        self.machine, self.before, self.pending, self.ends = machine, before, pending, ends
        self.flushed: tuple[int, ...] | None = None

    def __missing__(self, byte: int) -> tuple[tuple[int, ...], State]:
        move = self.machine.advance(self, byte)
        if self.machine.room:
            self[byte] = move
        return move


class Transducer:
    """Compiles BPE merges (ranks of byte strings) into a transducer, state by state as texts need them.

    The encoding of a prefix ends in exactly one token t such that t is the encoding of its own bytes and, with the
    token u before it, u t is the encoding of their bytes together. So the last tokens of all prefixes can be found
    from left to right. A prefix matters as long as the bytes after it begin a longer token; tokens that lie on the
    paths of all prefixes that matter are emitted. Lookahead is thus bounded by the longest token.
    """

    def __init__(self, table: dict[bytes, int]):
        self.rank = table
        self.begins = {t[:i] for t in table for i in range(1, len(t))}
        self.longest = max(map(len, table))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._known: dict[bytes, tuple | None] = {}
        self.start = State(self, None, b"", ())
        self.states = {(None, b""): self.start}
        self.room = True

    def _edges(self, t: bytes) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]] | None:
        """(rank, part) of the parts that touch the left and the right end of t, one after the other as its merges
        make them; None if merging the bytes of t does not give t."""
        if t in self._known:
            return self._known[t]
        halves = self._last_merge(t)
        if halves is None:
            found = ([(-1, t)], [(-1, t)]) if len(t) == 1 else None
        else:
            a, b = (self._edges(x) for x in halves)
            found = None if a is None or b is None else ([*a[0], (self.rank[t], t)], [*b[1], (self.rank[t], t)])
        self._known[t] = found
        return found

    def _last_merge(self, t: bytes) -> tuple[bytes, bytes] | None:
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in self.rank:
                return None
            parts[best : best + 2] = [joined]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _fits(self, u: bytes | None, t: bytes) -> bool:
        """Whether t stands alone, or u and t side by side, as tokens of the encoding of their bytes.

        Merges come by rank. So the parts on either side of the border grow in order of rank, and the two tokens stay
        apart if at no time the pair across the border has a lower rank than the next merge on either side; a merge
        across comes before one of the same rank to its right.
        """
        if u is None:
            return self._edges(t) is not None
        if (ok := self._pairs.get((u, t))) is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            left, right = self._edges(u), self._edges(t)
            ok = self._pairs[u, t] = left is not None and right is not None and self._apart(left[1], right[0])
        return ok

    def _apart(self, left: list[tuple[int, bytes]], right: list[tuple[int, bytes]]) -> bool:
        i = j = 0
        never = 1 << 60
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else never
            next_right = right[j + 1][0] if j + 1 < len(right) else never
            across = self.rank.get(left[i][1] + right[j][1], never)
            if across < next_left and across <= next_right and across < never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def advance(self, s: State, byte: int) -> tuple[tuple[int, ...], State]:
        pending, rank = s.pending + bytes((byte,)), self.rank
        n = len(pending)
        begins, end = self.begins, None
        # Prefixes that matter are those after which a longer token may begin.
        alive = {n}
        for i in range(max(0, n - self.longest), n):  # the longest first
            rest = pending[i:]
            if rest in begins:
                alive.add(i)
            if end is None and rest in rank and self._fits(s.ends[i - 1] if i else s.before, rest):
                end = rest
        if end is None:
            raise ValueError(f"no token ends {pending!r}")
        ends = (*s.ends, end)
        # Where their paths meet: the largest place steps back until one is left.
        while len(alive) > 1:
            i = max(alive)
            alive.discard(i)
            alive.add(i - len(ends[i - 1]))
        cut = alive.pop()
        out: tuple[int, ...] = ()
        before = s.before
        if cut:
            i, tokens = cut, []
            before = ends[cut - 1]
            while i:
                tokens.append(ends[i - 1])
                i -= len(ends[i - 1])
            out = tuple(rank[t] for t in reversed(tokens))
            pending, ends = pending[cut:], ends[cut:]
        key = (before, pending)
        if (state := self.states.get(key)) is None:
            state = State(self, before, pending, ends)
            if self.room:
                self.states[key] = state
                self.room = len(self.states) < MOST_STATES
        return out, state

    def _flush(self, s: State) -> tuple[int, ...]:
        i, tokens = len(s.pending), []
        while i:
            tokens.append(s.ends[i - 1])
            i -= len(s.ends[i - 1])
        s.flushed = tuple(self.rank[t] for t in reversed(tokens))
        return s.flushed

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        state, out = self.start, []
        for byte in piece:
            tokens, state = state[byte]
            if tokens:
                out += tokens
        out += self._flush(state) if state.flushed is None else state.flushed
        return out


def _utf8_moves() -> np.ndarray:
    """Next state of the UTF-8 machine by (state, byte). 0: between characters; 1-3: so many bytes are missing;
    4-7: one of them with a narrower second byte (after E0, ED, F0, F4); 8: malformed."""
    m = np.full((9, 256), 8, np.uint8)
    m[0, :0x80] = 0
    m[0, 0xC2:0xE0] = 1
    m[0, 0xE1:0xF0] = 2
    m[0, 0xE0], m[0, 0xED] = 4, 5
    m[0, 0xF1:0xF4] = 3
    m[0, 0xF0], m[0, 0xF4] = 6, 7
    for state in (1, 2, 3):
        m[state, 0x80:0xC0] = state - 1
    m[4, 0xA0:0xC0] = 1
    m[5, 0x80:0xA0] = 1
    m[6, 0x90:0xC0] = 2
    m[7, 0x80:0x90] = 2
    return m


class StreamDecoder:
    """Ids to text, as they come: feed() gives the characters that are complete, keeping the rest for later."""

    MOVES = _utf8_moves()

    def __init__(self, table: dict[bytes, int]):
        self.bytes_of: list[bytes] = [b""] * (max(table.values()) + 1)
        for t, i in table.items():
            self.bytes_of[i] = t
        # Tokens that are whole characters when they come between characters.
        self.whole = np.array([self._through(0, t) == (0, len(t)) for t in self.bytes_of])
        self._run: dict[tuple[int, int], tuple[int, int]] = {}
        self.restart()

    def restart(self) -> None:
        self.state, self.held = 0, b""

    def _through(self, state: int, token: bytes) -> tuple[int, int]:
        """State after the token, and how many of its bytes complete characters."""
        done = 0
        for k, byte in enumerate(token, 1):
            state = int(self.MOVES[state, byte])
            if state == 8:
                break
            if state == 0:
                done = k
        return state, done

    def _step(self, token: int, out: list[bytes]) -> None:
        piece = self.bytes_of[token]
        if (known := self._run.get((self.state, token))) is None:
            known = self._run[self.state, token] = self._through(self.state, piece)
        self.state, done = known
        if self.state == 8:
            raise ValueError("the ids do not spell UTF-8")
        if done:
            out.append(self.held + piece[:done])
            self.held = piece[done:]
        else:
            self.held += piece

    def feed(self, ids: list[int] | np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        out: list[bytes] = []
        at, of = 0, self.bytes_of.__getitem__
        for k in np.flatnonzero(~self.whole[ids]).tolist():
            while at < k and self.state:
                self._step(int(ids[at]), out)
                at += 1
            if at < k:
                out.append(b"".join(map(of, ids[at:k].tolist())))
            self._step(int(ids[k]), out)
            at = k + 1
        while at < len(ids) and self.state:
            self._step(int(ids[at]), out)
            at += 1
        out.append(b"".join(map(of, ids[at:].tolist())))
        return b"".join(out).decode()

    def close(self) -> str:
        """What is left of an unfinished character, as the replacement character."""
        rest, self.state, self.held = self.held, 0, b""
        return rest.decode(errors="replace")


class Codec:
    """Encoding and decoding of whole texts with one vocabulary; remembers parts of texts."""

    def __init__(self, name: str):
        table = ranks(name)
        self.machine, self.decoder = Transducer(table), StreamDecoder(table)
        # The library's \s is Unicode White_Space.
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.memory = Remembering(self._parts, MEMORY)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _ids(self, text: str) -> list[int]:
        out, known = [], self.pieces
        for piece in self.pattern.findall(text):
            if (ids := known.get(piece)) is None:
                ids = tuple(self.machine.encode(piece.encode()))
                if len(known) < MOST_PIECES and len(piece) <= LONGEST_KEPT:
                    known[piece] = ids
            out += ids
        return out

    def _parts(self, new: list[str]) -> list[tuple[bytes, str]]:
        return [(array("I", ids).tobytes(), " ".join(map(str, ids))) for ids in map(self._ids, new)]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids, and the same as decimals joined by blanks."""
        if ODD_BLANKS.search(text):
            ids = self._ids(text)
            return np.array(ids, "<u4"), " ".join(map(str, ids))
        found = self.memory.values_of(PARTS.findall(text))
        return np.frombuffer(b"".join([x[0] for x in found]), "<u4"), " ".join([x[1] for x in found])

    def decode(self, ids: np.ndarray) -> bytes:
        self.decoder.restart()
        return (self.decoder.feed(ids) + self.decoder.close()).encode()


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


def bpe_encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every whole text.

    Null text counts as empty: no ids. Other columns are ignored; repeated rows give repeated results; an empty table
    an empty result. No shuffle: each row is encoded where it is read.
    """

    def make():
        c = codec(vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [c.encode(t or "")[0].astype(np.int32) for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array(map(len, ids), pa.int64())}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>, n_tokens long")


def bpe_decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """encoded (doc_id, ids array<int>) back to doc_id, text. Null ids count as none; unfinished characters at the end
    become the replacement character, ids that spell no UTF-8 are an error."""

    def make():
        c = codec(vocabulary)
        return lambda batch: {"doc_id": batch["doc_id"], "text": pa.array([c.decode(np.asarray(i or [], np.int64)).decode() for i in batch["ids"].to_pylist()], pa.string())}

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encodes and decodes every whole text; doc_id, n_tokens, ids_sha256, decoded_sha256. Cases as in bpe_encode()."""

    def make():
        c, sha = codec(vocabulary), hashlib.sha256

        def work(batch: pa.RecordBatch) -> dict:
            n, ids_sha, text_sha = [], [], []
            for t in batch["text"].to_pylist():
                ids, said = c.encode(t or "")
                n.append(len(ids))
                ids_sha.append(sha(said.encode()).hexdigest())
                text_sha.append(sha(c.decode(ids)).hexdigest())
            return {"doc_id": batch["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
