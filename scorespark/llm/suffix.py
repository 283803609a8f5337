"""Repeated byte strings by backward extension of intervals on a Burrows-Wheeler order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import join_counted, map_batches, saved, split_by_filter, spread
from scorespark.llm.substring import merged, outside

LENGTH = 200
#: Bytes of a gram. Every string of LENGTH bytes is found by its anchor: its gram with the smallest hash.
GRAM = 48
#: Bytes of text that are hashed at once, about.
BLOCK = 1 << 19
#: String starts of a text that are hashed at once at most; places share 64 bits with hashes.
WHOLE = 1 << 27
#: Bits of the filters that go to the workers: about 8 a key, up to 16 MB at any input size.
MOST_BITS = 1 << 27
#: Contexts that are compared together; groups with more are parted further.
MOST_CONTEXTS = 4096
#: Contexts that are sorted at once.
ROUND = 20_000

_BYTES = np.random.default_rng(2).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 28) - 1)


#: Columns of a context, and of what repeated strings cover of it.
CONTEXT = ("key", "context", "count", "before", "bytes", "n")
STRETCHES = "key long, context binary, a int, b int"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hash of data[i : i + gram] for every i, by doubling, then mixed."""
    sizes, whole, length = {1: _BYTES[data]}, None, 0
    span = 1
    while span * 2 <= gram:
        h = sizes[span]
        sizes[span * 2] = h[:-span] * _power(span) + h[span:]
        span *= 2
    for span in sorted((s for s in sizes if gram & s), reverse=True):
        h = sizes[span]
        if whole is None:
            whole, length = h, span
        else:
            n = len(data) - length - span + 1
            whole, length = whole[:n] * _power(span) + h[length : length + n], length + span
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, most: int = WHOLE) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of texts: (text, key, anchor, first, count) of every run of string starts with one anchor.

    Strings of length bytes start at first .. first + count - 1, places within the text. A string's anchor depends on
    its own bytes only (of equal hashes the rightmost), so equal strings have equal keys at equal offsets. Texts are taken
    in parts of at most `most` string starts; a run that goes over from one to the next is two.
    """
    parts = ((i, lo) for i, t in enumerate(texts) for lo in range(0, len(t) - length + 1, most))
    use, total = [], 0
    for i, lo in parts:
        use.append((i, lo, texts[i][lo : lo + most + length - 1]))
        total += len(use[-1][2])
        if total >= BLOCK:
            yield _anchored(use, length, gram)
            use, total = [], 0
    if use:
        yield _anchored(use, length, gram)


def _anchored(use: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors() of parts of texts (text, place, bytes), together less than 2^28 bytes."""
    data = np.frombuffer(b"".join([x[2] for x in use]), np.uint8)
    sizes = np.array([len(x[2]) for x in use])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = gram_hashes(data, gram)
    mark = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    low = _sliding_min(mark, length - gram + 1)
    anchor = (_LOW - (low & _LOW)).astype(np.int64)
    owner = np.repeat(np.arange(len(use)), sizes)[: len(anchor)]
    good = np.arange(len(anchor)) + length <= (begins + sizes)[owner]
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    run_of = np.cumsum(np.isin(np.arange(len(anchor)), change, assume_unique=True)) - 1
    counts = np.bincount(run_of, weights=good, minlength=len(change)).astype(np.int64)
    keep = np.flatnonzero(counts)  # the good starts of a text come first, so a run begins with them
    first = change[keep]
    o = owner[first]
    shift = np.array([x[1] for x in use])[o] - begins[o]
    return np.array([x[0] for x in use])[o], h[anchor[first]].astype(np.int64), anchor[first] + shift, first + shift, counts[keep]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch["text"].to_pylist()]


def _keys(length: int, gram: int):
    def work(batch: pa.RecordBatch) -> dict:
        got = [key for _, key, _, _, _ in anchors(_texts(batch), length, gram)]
        return {"key": pa.array(np.concatenate(got) if got else [], pa.int64())}

    return lambda: work


def filter_words(keys: DataFrame, spark) -> np.ndarray:
    """A bitmap of the keys (64-bit hashes), sized by their number up to MOST_BITS; beyond that more rows pass it."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (8 * keys.count()).bit_length()))
    words = (
        keys.selectExpr(f"pmod(key, {bits}) AS p")
        .selectExpr("cast(p div 32 AS int) AS w", "shiftleft(1, cast(p % 32 AS int)) AS b")
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(bits // 32, np.uint32)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint32)
    return out


def _passes(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    p = np.mod(key, 32 * len(words))
    return (words[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1


def _context(raw: bytes, first: int, count: int, anchor: int, length: int) -> tuple[bytes, bytes]:
    """(digest, bytes) of all strings of a run; the digest also holds where the anchor lies."""
    context = raw[first : first + count - 1 + length]
    return xxhash.xxh3_128_digest(context + (anchor - first).to_bytes(4, "little")), context


def _occurrences(shared, length: int, gram: int, with_text: bool):
    """Runs whose key (or, with text, whose context) passes the filter."""

    def make():
        words = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            texts, rows = _texts(batch), batch["row"].to_pylist()
            out: list[tuple] = []
            for text, key, anchor, first, count in anchors(texts, length, gram):
                some = []
                for k in np.flatnonzero(_passes(words, key)) if not with_text else range(len(key)):
                    i, a, f, c = int(text[k]), int(anchor[k]), int(first[k]), int(count[k])
                    digest, context = _context(texts[i], f, c, a, length)
                    some.append((int(key[k]), digest, rows[i], f, c, a - f, context if with_text else None))
                if with_text:
                    hashed = np.array([int.from_bytes(x[1][:8], "big", signed=True) for x in some], np.int64)
                    some = [some[k] for k in np.flatnonzero(_passes(words, hashed))]
                out += some
            cols = list(zip(*out, strict=True)) or [()] * 7
            made = {"key": pa.array(cols[0], pa.int64()), "context": pa.array(cols[1], pa.binary())}
            if with_text:
                return made | {"count": pa.array(cols[4], pa.int32()), "before": pa.array(cols[5], pa.int32()), "bytes": pa.array(cols[6], pa.binary())}
            return made | {"row": pa.array(cols[2], pa.int64()), "first": pa.array(cols[3], pa.int32()), "count": pa.array(cols[4], pa.int32()), "before": pa.array(cols[5], pa.int32())}

        return work

    return make


def extend(groups: np.ndarray, rights: list[bytes], lefts: list[bytes], before: np.ndarray, count: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(context, from, to): stretches of bytes, relative to the anchor, that repeated strings cover.

    All contexts are aligned at their anchors, and ordered by what follows the anchor's start: within a group (equal
    keys, or a part of such a group whose contexts agree in the lo bytes before the anchor), a Burrows-Wheeler order whose neighbours' common prefixes are known. The intervals of contexts that agree
    are then extended backwards, all at once, by the bytes that precede the anchor: after t extensions an interval
    holds the contexts that agree in t bytes before and at least length - t bytes from the anchor on, a common prefix
    of length bytes; with a weight of two or more, these are repeats of the string that starts t bytes before the
    anchor. Contexts alone in their interval are left; it ends at the largest offset an anchor can have. A group is
    extended from lo to hi bytes.
    """
    n = len(groups)
    wide = np.full((n, length), 0xFF, np.uint8)  # no byte of UTF-8
    for i, r in enumerate(rights):
        wide[i, : min(length, len(r))] = np.frombuffer(r, np.uint8, min(length, len(r)))
    depth = length - gram + 1
    back = np.full((n, depth), 0xFF, np.uint8)
    for i, s in enumerate(lefts):
        tail = np.frombuffer(s, np.uint8)[::-1][:depth]
        back[i, : len(tail)] = tail
    order = np.lexsort((*wide.T[::-1], groups)) if n < 3 else _sorted(groups, wide)
    groups, wide, back, before, count, weight, lo, hi = (x[order] for x in (groups, wide, back, before, count, weight, lo, hi))
    same = groups[1:] == groups[:-1]
    differ = wide[1:] != wide[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common[~same] = -1
    group = np.concatenate(([0], np.cumsum(~same)))
    active = np.zeros(0, np.int64)
    lefts_id = group.copy()
    hits: list[tuple[np.ndarray, int]] = []
    for t in range(depth):
        if len(active):
            code = lefts_id[active] * 256 + back[active, t - 1]
            _, lefts_id[active] = np.unique(code, return_inverse=True)
            lefts_id[active] += n  # apart from groups that begin later
        active = np.concatenate((active, np.flatnonzero(lo == t)))
        if not len(active):
            continue
        rights_id = np.concatenate(([0], np.cumsum(common < length - t)))
        _, both = np.unique(lefts_id[active] * np.int64(n + 1) + rights_id[active], return_inverse=True)
        heavy = np.bincount(both, weights=weight[active])[both] >= 2
        owned = (before[active] >= t) & (t >= before[active] - count[active] + 1)
        hits.append((active[heavy & owned], t))
        # Left neighbours part for good: a context alone on its left side can match no more.
        left = np.bincount(lefts_id[active], weights=weight[active])[lefts_id[active]] >= 2
        active = active[left & (hi[active] > t)]
    out: dict[int, list[list[int]]] = {}
    for who, t in hits:
        for i in who.tolist():
            runs = out.setdefault(i, [])
            if runs and runs[-1][0] == 1 - t:
                runs[-1][0] = -t
            else:
                runs.append([-t, length - t])
    return [(int(order[i]), a, b) for i, runs in out.items() for a, b in runs]


def _sorted(groups: np.ndarray, wide: np.ndarray) -> np.ndarray:
    rows = np.concatenate((groups.astype(">u8").view(np.uint8).reshape(-1, 8), wide), axis=1)
    return np.argsort(np.ascontiguousarray(rows).view([("", f"S{rows.shape[1]}")]).ravel()["f0"], kind="stable")


def _compare(length: int, gram: int):
    """Contexts in order of key -> stretches, many keys at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            group = np.cumsum([k > 0 and r[0] != rows[k - 1][0] for k, r in enumerate(rows)])
            count, before, weight, lo, hi = (np.array([r[k] for r in rows]) for k in (3, 4, 6, 7, 8))
            got = extend(group, [r[5][r[4] :] for r in rows], [r[5][: r[4]] for r in rows], before, count, weight, lo, hi, length, gram)
            got = [(*rows[i][1:3], a, b) for i, a, b in got if rows[i][6] == 1]
            cols = list(zip(*got, strict=True)) or [()] * 4
            return pa.RecordBatch.from_pydict({"key": pa.array(cols[0], pa.int64()), "context": pa.array(cols[1], pa.binary()), "a": pa.array(cols[2], pa.int32()), "b": pa.array(cols[3], pa.int32())})

        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("grp", "key", "context", "count", "before", "bytes", "n", "lo", "hi")), strict=True)
            if len(held) >= ROUND:
                last = held[-1][0]
                k = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
                if k:
                    yield settle(held[:k])
                    held = held[k:]
        if held:
            yield settle(held)

    return each


def _parted(hot: DataFrame, length: int) -> DataFrame:
    """Groups that are too large, each by halves of its range of extensions.

    Contexts that meet in an interval after lo to hi extensions agree in the lo bytes before the anchor and in the
    length - hi bytes from it on, so each half is grouped by these bytes, which are more than before. A context goes to
    the halves in which strings of its own start.
    """
    middle = F.expr("(lo + hi) div 2")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("l"), middle.cast("int").alias("h")), F.struct((middle + 1).cast("int").alias("l"), F.col("hi").alias("h"))))
    apart = hot.withColumn("half", halves).where("half.l <= before AND half.h > before - count")
    shared = F.expr(f"substring(bytes, before - half.l + 1, half.l + {length} - half.h)")
    own = F.md5(F.concat(F.concat_ws(":", "grp", "half.l", "half.h").cast("binary"), shared))
    return apart.select(own.alias("grp"), *CONTEXT, F.col("half.l").alias("lo"), F.col("half.h").alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, spans) of the bytes of docs (row, text) that strings of length bytes which start elsewhere too cover."""
    spark = docs.sparkSession
    keys = map_batches(docs.select("text"), _keys(length, gram), "key long")
    repeated = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    shared = spark.sparkContext.broadcast(filter_words(repeated, spark))
    runs = map_batches(docs.select("row", "text"), _occurrences(shared, length, gram, False), "key long, context binary, row long, first int, count int, before int")
    runs = saved(runs, "runs")

    classes = saved(runs.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n")), "classes")
    per_key = saved(classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "per-key")
    open_ = saved(join_counted(classes, per_key, ["key"], "m").select("key", "context", "n"), "open")

    # The contexts that must be compared, each once; their bytes are read again rather than kept for all.
    prefix = open_.select(F.expr("cast(conv(hex(substring(context, 1, 8)), 16, -10) AS long)").alias("key"))
    chosen = spark.sparkContext.broadcast(filter_words(prefix, spark))
    again = map_batches(docs.select("row", "text"), _occurrences(chosen, length, gram, True), "key long, context binary, count int, before int, bytes binary")
    contexts = again.dropDuplicates(["key", "context"]).join(open_, ["key", "context"])
    todo = saved(contexts.select(F.col("key").cast("string").alias("grp"), *CONTEXT, F.lit(0).alias("lo"), F.lit(length - gram).alias("hi")), "contexts")
    found = spark.createDataFrame([], STRETCHES)
    while True:
        sizes = saved(todo.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("rows", F.col("m")), "sizes")
        sized = join_counted(todo, sizes, ["grp"], "rows")
        usual = sized.where(f"m <= {MOST_CONTEXTS}").drop("m")
        found = found.unionByName(saved(spread(usual, "grp").sortWithinPartitions("grp").mapInArrow(_compare(length, gram), STRETCHES), "stretches"))
        hot = saved(sized.where(f"m > {MOST_CONTEXTS}").drop("m"), "hot")
        # One extension is left and all bytes agree: these contexts are one interval.
        whole = hot.where("lo = hi AND n = 1").select("key", "context", (-F.col("lo")).alias("a"), (F.lit(length) - F.col("lo")).alias("b"))
        found = found.unionByName(whole)
        hot = hot.where("lo < hi")
        if hot.isEmpty():
            break
        todo = saved(_parted(hot, length), "parted")
    parts = runs.join(found, ["key", "context"]).select("row", (F.col("first") + F.col("before") + F.col("a")).alias("start"), (F.col("first") + F.col("before") + F.col("b")).alias("end"))
    # A context that many rows have is hot here; one that is alone (n = 1), as in found, is not.
    twice = join_counted(runs, classes.where("n > 1").select("key", "context", "n"), ["key", "context"], "n").select("row", F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + length).alias("end"))
    return parts.unionByName(twice).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a string of length bytes that also starts anywhere else in the texts.

    Input: doc_id, text; other columns are ignored. Output for each row: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (the removed runs of bytes, array of start, end), row.

    Texts are UTF-8 bytes; null counts as empty. Matches never cross rows, may overlap, and may lie within one text;
    all copies are removed, none stays. Repeated rows are copies of each other. Texts shorter than length lose
    nothing; an empty table gives an empty result. docs must be a stable scan.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = saved(repeated_spans(rows, length, gram), "spans")
    suspects, clean = split_by_filter(rows, "row", found.select("row"))
    none = F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    both = suspects.join(found, "row", "left").select("doc_id", "row", "text", "spans").unionByName(clean.select("doc_id", "row", "text", none))

    def work(batch: pa.RecordBatch) -> dict:
        size, gone, runs, sha = [], [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            raw = (text or "").encode()
            use = merged([(x["start"], x["end"]) for x in spans or ()])
            left = outside(raw, use) if use else raw
            size.append(len(raw))
            gone.append(len(raw) - len(left))
            runs.append([{"start": s, "end": e} for s, e in use])
            sha.append(hashlib.sha256(left).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return {"doc_id": batch["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(map(len, runs), pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(runs, kind), "row": batch["row"]}

    return map_batches(both, lambda: work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, row long")


#: For LENGTH bytes. Texts as hex digits, two a byte; strings are compared by 64-bit hashes of their digits.
SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (  -- blocks of 400 starts with what follows them
  SELECT r, o, substr(h, 2 * o + 1, 2 * 599) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2, 400)) AS o FROM d)
), k AS (
  SELECT r, o + p AS p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, o, h, unnest(range(0, least(400, len(h) // 2 - 199))) AS p FROM b WHERE len(h) >= 400)
), twice AS (
  SELECT k FROM k GROUP BY k HAVING count(*) > 1
), s AS (
  SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM k WHERE k IN (SELECT k FROM twice)
), g AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s
), spans AS (
  SELECT r, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, run
), pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS before FROM pieces JOIN d USING (r) GROUP BY r
)
SELECT doc_id, cast(len(h) // 2 AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
