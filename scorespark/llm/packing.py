"""Packing of documents into sequences whose sources keep their target shares of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import map_batches, parts, running_sum, saved, spread
from scorespark.llm.tokens import word_ids

WINDOW = 4096
#: Tokens that a queue must have earned before it is served; smaller claims are carried on to later rounds.
QUANTUM = 64
#: Documents of a stretch of a source's queue, about; stretches are the unit of distribution.
STRETCH = 2_000
#: Quanta of a stretch that are put into rounds at once.
QUANTA_AT_ONCE = 100_000
END = 2

IDS = "doc_id long, source string, row long, n long, ids binary"
SERVED = "queue string, stretch long, round double, first long, size long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def encode(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, source, row, n, ids (with end) of every whole text; null text is empty. Ids are little-endian, unsigned,
    of 16 bits where the vocabulary allows it and else of 32."""

    def make():
        ids_of = word_ids(tokenizer)
        kind = ids_of.kind if end < 1 << 8 * ids_of.kind.itemsize else np.dtype("<u4")

        def work(batch: pa.RecordBatch) -> dict:
            flat, sizes = ids_of(batch["text"])
            ends = np.cumsum(sizes + 1)
            ids = np.full(ends[-1] if len(ends) else 0, end, kind)
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = flat
            offsets = np.append(0, ends * kind.itemsize).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            return {c: batch[c] for c in ("doc_id", "source", "row")} | {"n": pa.array(sizes + 1, pa.int64()), "ids": out}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.monotonically_increasing_id().alias("row"))
    return map_batches(rows, make, IDS)


def _weight(weights: dict[str, float] | None) -> Column:
    """A queue's target share, up to a factor: given, or its number of tokens. 0 for sources that are not mentioned."""
    if weights is None:
        return F.col("total").cast("double")
    known = [F.lit(x) for name, w in sorted(weights.items()) for x in ("=" + name, float(w))]
    return F.coalesce(F.create_map(*known)[F.col("queue")], F.lit(0.0)) if known else F.lit(0.0)


def _rounds(window: int, quantum: int):
    """Stretches of queues (place of the first token, tokens, share) -> the runs of tokens that each round serves.

    After r rounds a queue has been served quantum * floor(r * share * window / quantum) tokens, as long as it has any. So the
    round of each quantum is told by itself, whatever the share: the work grows with the stretch's tokens. Queues without a
    share are served after all rounds.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queue, stretch, at, n, share in zip(*(batch[c].to_pylist() for c in ("queue", "stretch", "at", "n", "share")), strict=True):
                end, rate = at + n, share * window / quantum
                if not rate:
                    yield _served(queue, stretch, [float("inf")], [at], [n])
                    continue
                for k in range(at // quantum, -(-end // quantum), QUANTA_AT_ONCE):
                    quanta = np.arange(k, min(k + QUANTA_AT_ONCE, -(-end // quantum)))
                    rounds = round_of(quanta, rate)
                    first = np.flatnonzero(np.diff(rounds, prepend=-1.0))
                    begin = np.maximum(quanta[first] * quantum, at)
                    size = np.append(begin[1:], min((int(quanta[-1]) + 1) * quantum, end)) - begin
                    yield _served(queue, stretch, rounds[first], begin, size)

    return each


def round_of(quanta: np.ndarray, rate: float) -> np.ndarray:
    """The first round (from 0) after which so many quanta and one more have been served, floor((round + 1) * rate)."""
    rounds = np.maximum(np.ceil((quanta + 1) / rate) - 1, 0)
    while (early := np.floor((rounds + 1) * rate) <= quanta).any():  # rounding, by one or two
        rounds[early] = np.maximum(rounds[early] + 1, np.nextafter(rounds[early], np.inf))
    while (late := (rounds > 0) & (np.floor(rounds * rate) > quanta)).any():
        rounds[late] = np.minimum(rounds[late] - 1, np.nextafter(rounds[late], 0))
    return rounds


def _served(queue: str, stretch: int, rounds, first, size) -> pa.RecordBatch:
    n = len(rounds)
    return pa.RecordBatch.from_pydict({"queue": pa.array([queue] * n, pa.string()), "stretch": pa.array([stretch] * n, pa.int64()), "round": pa.array(rounds, pa.float64()), "first": pa.array(first, pa.int64()), "size": pa.array(size, pa.int64())})


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, quantum: int = QUANTUM, weights: dict[str, float] | None = None) -> DataFrame:
    """Cuts all documents into pieces of sequences of at most window tokens.

    Input: doc_id, text, source. Output for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source. Null text is empty (its end token is still packed), a null source is a queue of its own; a null
    doc_id and repeated rows are packed like any other; an empty table gives an empty result.

    Deficit round-robin over the queues of the sources: in each round a queue earns its target share of window tokens,
    and is served in multiples of quantum as soon as its deficit allows; the rest of the deficit is carried to the next
    round, across windows and partitions. weights gives the targets by source (any positive numbers; without it, the
    sources' own shares of all tokens). A queue that has run dry is passed over: the others go on earning in the same
    proportions, so they share its part; rounds are then shorter than windows, which lie up to a turn off the targets.
    Sources without a weight follow when all others are done.

    When each run of tokens is served depends on its place in its queue and on the queue's share alone, so the runs are
    made stretch by stretch, sorted by round and queue, and placed by running sums of their lengths: nothing is gathered
    for each source. Runs follow each other without gaps, and every sequence is a full window; the last one's remainder
    is cut into sequences whose lengths are powers of two, so that nothing is padded.

    Token ids are written once and shuffled once, with the stretch of the queue that they belong to.
    """
    ids = saved(encode(docs, tokenizer), "ids")
    stretches = max(1, -(-ids.count() // STRETCH))
    # A stretch: an even hash of the row, so that one hot source is as many tasks as its share needs.
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue")
    ids = ids.select("*", queue, F.pmod(F.xxhash64("row"), F.lit(stretches)).alias("stretch"))
    sums = running_sum(ids.groupBy("queue", "stretch").agg(F.sum("n").alias("n")), ["queue", "stretch"], "n")
    sums = saved(sums, "stretches")
    queues = sums.groupBy("queue").agg(F.sum("n").alias("total"), F.min("before").alias("base")).withColumn("weight", _weight(weights))
    all_weights = queues.agg(F.sum("weight").alias("weights"))
    dealt = sums.join(queues, "queue").crossJoin(F.broadcast(all_weights))  # one row
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0)
    dealt = dealt.select("queue", "stretch", (F.col("before") - F.col("base")).alias("at"), "n", share.alias("share"))
    served = spread(dealt, "queue", "stretch").mapInArrow(_rounds(window, quantum), SERVED)
    placed = running_sum(served, ["round", "queue", "first"], "size", "place")
    total = placed.agg(F.max(F.col("place") + F.col("size"))).first()[0] or 0

    # The runs of a stretch come before its documents, in which they are then found in passing.
    nothing = lambda kind: F.lit(None).cast(kind)
    runs = placed.select("queue", "stretch", F.lit(-1).cast("long").alias("row"), "first", "size", "place", nothing("long").alias("doc_id"), nothing("string").alias("source"), nothing("binary").alias("ids"), nothing("long").alias("n"))
    texts = ids.select("queue", "stretch", "row", nothing("long").alias("first"), nothing("long").alias("size"), nothing("long").alias("place"), "doc_id", "source", "ids", "n")
    both = spread(runs.unionByName(texts), "queue", "stretch").sortWithinPartitions("queue", "stretch", "row", "first")
    return both.mapInArrow(_cutter(total, window), PIECES)


def sequence(place: int, total: int, window: int) -> tuple[int, int, int]:
    """(sequence, offset in it, tokens left in it) of a place among total tokens."""
    k, offset = divmod(place, window)
    if k < total // window:
        return k, offset, window - offset
    rest = total % window
    size = 1 << (rest.bit_length() - 1)
    while offset >= size:
        offset, rest, k = offset - size, rest - size, k + 1
        size = 1 << (rest.bit_length() - 1)
    return k, offset, size - offset


def _cutter(total: int, window: int):
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "source": pa.string()}

    def pieces(run: list[tuple[int, int]], at: int, k: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the n tokens that begin with token at of run k."""
        start, last = 0, None
        while start < n:
            place, size = run[k]
            s, offset, left = sequence(place + at, total, window)
            take = min(n - start, size - at, left)
            if last and last[2] == s and last[3] + last[1] == offset:
                last = (last[0], last[1] + take, s, last[3])
            else:
                if last:
                    yield last
                last = (start, take, s, offset)
            start, at = start + take, at + take
            if at == size:
                k, at = k + 1, 0
        if last:
            yield last

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[int, int]] = []
        key, k, at = None, 0, 0
        for batch in (p for b in batches for p in parts(b)):
            out: dict[str, list] = {c: [] for c in kinds}
            for queue, stretch, row, size, place, doc, source, ids, n in zip(*(batch[c].to_pylist() for c in ("queue", "stretch", "row", "size", "place", "doc_id", "source", "ids", "n")), strict=True):
                if (queue, stretch) != key:
                    key, run, k, at = (queue, stretch), [], 0, 0
                if row < 0:
                    run.append((place, size))
                    continue
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                for start, length, s, offset in pieces(run, at, k, n):
                    crc = zlib.crc32(wide[4 * start : 4 * (start + length)])
                    for column, value in zip(out.values(), (doc, start, length, crc, n, s, offset, source), strict=True):
                        column.append(value)
                at += n
                while k < len(run) and at >= run[k][1]:
                    at, k = at - run[k][1], k + 1
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return each
