"""Substring dedup by content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import ROW, join_counted, map_batches, saved, split_by_filter

#: Bytes that the gear hash sees (a power of two).
GEAR_BYTES = 16
#: A cut lies where the hash is the largest within so many bytes on either side: chunks of about twice that size.
REACH = 24
LONGEST = 1024
#: Shortest repeated stretch that is removed, in bytes; and bytes on either side that a cut depends on.
LEAST_RUN, CONTEXT = 150, REACH + GEAR_BYTES

_GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum of the last GEAR_BYTES bytes' gears, each shifted by its age."""
    h = _GEAR[data]
    span = 1
    while span < GEAR_BYTES:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is complete before the left is changed
        span *= 2
    return h


def _sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """max of x[i : i + width] for every i, cut off at the end."""
    span, m = 1, x
    while span * 2 <= width:
        m = np.concatenate((np.maximum(m[:-span], m[span:]), m[-span:])) if span < len(m) else m
        span *= 2
    if (rest := width - span) and rest < len(m):
        m = np.concatenate((np.maximum(m[:-rest], m[rest:]), m[-rest:]))
    return m


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of text. They depend on the bytes around them only, so insertions move them along; but for those
    forced after LONGEST bytes without a peak."""
    return all_cuts(text)[0]


def all_cuts(text: bytes) -> tuple[list[int], list[int]]:
    """Ends of the chunks of text, and those of them that are not forced."""
    n = len(text)
    if not n:
        return [], []
    if n <= REACH:
        return [n], [n]
    h = gear(np.frombuffer(text, np.uint8)).astype(np.int64)
    after = _sliding_max(h, REACH + 1)
    before = np.concatenate((np.full(REACH, -1), _sliding_max(h, REACH)[: n - REACH]))
    before[:REACH] = np.concatenate(([-1], np.maximum.accumulate(h[: REACH - 1])))
    # Larger than all before within reach, no smaller than any after: of equals, the first.
    peaks = np.flatnonzero((h > before) & (h >= after)) + 1
    out, last = [], 0
    own = [*peaks[(peaks > REACH) & (peaks < n)].tolist(), n]
    for cut in own:
        while cut - last > LONGEST:
            last += LONGEST
            out.append(last)
        out.append(cut)
        last = cut
    return out, own


def _chunks(batch: pa.RecordBatch) -> dict:
    digest = xxhash.xxh3_128_intdigest
    low, high, rows, docs, starts, sizes, nth, before, after = [], [], [], [], [], [], [], [], []
    mask, half = (1 << 64) - 1, 1 << 63
    for row, doc, text in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
        raw, at, seen = (text or "").encode(), 0, set()
        ends, own = all_cuts(raw)
        begins = [0, *ends[:-1]]
        # To the nearest cut on either side that is not forced: what chunks there share with others can go so far.
        before += [a - own[k - 1] if k else a for a, k in zip(begins, np.searchsorted(own, begins).tolist(), strict=False)] if ends else []
        after += [own[k] - b if k < len(own) else 0 for b, k in zip(ends, np.searchsorted(own, ends, "right").tolist(), strict=True)]
        for end in ends:
            d = digest(raw[at:end])
            low.append((d & mask) - half)
            high.append((d >> 64) - half)
            nth.append(d in seen)
            seen.add(d)
            rows.append(row)
            docs.append(doc)
            starts.append(at)
            sizes.append(end - at)
            at = end
    return {"hi": pa.array(high, pa.int64()), "lo": pa.array(low, pa.int64()), "row": pa.array(rows, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int32()), "size": pa.array(sizes, pa.int32()), "again": pa.array(nth, pa.bool_()), "before": pa.array(before, pa.int32()), "after": pa.array(after, pa.int32())}


CHUNKS = "hi long, lo long, row long, doc_id long, start int, size int, again boolean, before int, after int"


def merged(spans: list[tuple[int, int]], least: int = 1) -> list[tuple[int, int]]:
    """Union of (start, end), without runs shorter than least."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= least]


def outside(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts)


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans narrowed to the borders of UTF-8 characters."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if e > s:
            out.append((s, e))
    return out


def _runs(batch: pa.RecordBatch) -> dict:
    """Chunks of a row that lie side by side as one run, with the places of its two ends in the texts that keep them, and how
    many bytes beyond each end can be shared with those."""
    out: list[tuple] = []
    for row, spans in zip(batch["row"].to_pylist(), batch["spans"].to_pylist(), strict=True):
        last = None
        for x in sorted(spans, key=lambda x: x["start"]):
            if last is None or x["start"] != last[2]:
                if last:
                    out.append(last)
                last = (row, x["start"], x["end"], x["owner"], x["at"], x["owner"], x["at"] + x["end"] - x["start"], x["before"] + CONTEXT, x["after"] + CONTEXT)
            else:
                last = (*last[:2], x["end"], *last[3:5], x["owner"], x["at"] + x["end"] - x["start"], last[7], x["after"] + CONTEXT)
        if last:
            out.append(last)
    columns = list(zip(*out, strict=True)) or [()] * 9
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return {n: pa.array(c, k) for n, c, k in zip(("row", "start", "end", "l_row", "l_at", "r_row", "r_at", "l_need", "r_need"), columns, kinds, strict=True)}


def _edges(batch: pa.RecordBatch) -> dict:
    """The bytes before (side -1) or after (side 1) the places of a text that are asked for."""
    rows, places, sides, found, times = [], [], [], [], []
    for row, text, asked in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), batch["asked"].to_pylist(), strict=True):
        raw = text.encode()
        for x in asked:
            at, side, need = x["at"], x["side"], x["need"]
            rows.append(row)
            places.append(at)
            sides.append(side)
            times.append(x["n"])
            found.append(raw[at : at + need] if side > 0 else raw[max(0, at - need) : at])
    return {"row": pa.array(rows, pa.int64()), "at": pa.array(places, pa.int32()), "side": pa.array(sides, pa.int32()), "bytes": pa.array(found, pa.binary()), "n": pa.array(times, pa.int64())}


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row, spans): for each row of docs (row, doc_id, text) the runs of chunks that another place has first, with the
    bytes on either side of that place (struct of start, end, left, right, and how many bytes on either side to look at).

    The place that keeps a chunk is the first in the document with the smallest doc_id (null last; of rows with equal
    doc_id the first row). Chunks are counted by digest with partial sums, so that a chunk which very many documents
    share is no hot key, and only chunks that a bounded filter suspects are shuffled a second time.
    """
    chunks = map_batches(docs.select("row", "doc_id", "text"), lambda: _chunks, CHUNKS)
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    counted = chunks.groupBy("hi", "lo").agg(F.min(last).alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = saved(counted, "repeats")
    suspects, _ = split_by_filter(chunks, "hi", counted.select("hi"))
    dups = saved(join_counted(saved(suspects, "suspects"), counted, ["hi", "lo"], "n"), "places")
    first = dups.where(last == F.col("first_doc")).groupBy("hi", "lo").agg(F.min(F.struct("row", "start")).alias("own"))
    owners = saved(first.join(counted.select("hi", "lo", "n"), ["hi", "lo"]), "owners")
    gone = join_counted(dups, owners, ["hi", "lo"], "n").where("again OR row <> own.row")
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"), F.col("own.row").alias("owner"), F.col("own.start").alias("at"), "before", "after")
    runs = saved(map_batches(gone.groupBy("row").agg(F.collect_list(span).alias("spans")), lambda: _runs, "row long, start int, end int, l_row long, l_at int, r_row long, r_at int, l_need int, r_need int"), "runs")

    # Chunks lose both edges of a passage: the bytes around each kept place are fetched, each place once.
    ask = lambda s, side: runs.select(F.col(f"{s}_row").alias("row"), F.col(f"{s}_at").alias("at"), F.lit(side).alias("side"), F.col(f"{s}_need").alias("need"))
    asked = ask("l", -1).unionByName(ask("r", 1)).groupBy("row", "at", "side").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    asked = saved(asked.groupBy("row").agg(F.collect_list(F.struct("at", "side", "n", "need")).alias("asked")), "asked")
    keepers, _ = split_by_filter(docs.select("row", "text"), "row", asked.select("row"))
    edges = saved(map_batches(keepers.join(asked, "row"), lambda: _edges, "row long, at int, side int, bytes binary, n long"), "edges")
    side = lambda s, c: edges.where(f"side = {s}").select(F.col("row").alias(f"{c}_row"), F.col("at").alias(f"{c}_at"), F.col("bytes").alias(c), "n")
    left = saved(join_counted(runs, side(-1, "l"), ["l_row", "l_at"], "n"), "left")
    told = join_counted(left, side(1, "r"), ["r_row", "r_at"], "n")
    return told.groupBy("row").agg(F.collect_list(F.struct("start", "end", F.col("l").alias("left"), F.col("r").alias("right"), "l_need", "r_need")).alias("spans"))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def extended(raw: bytes, runs: list[dict]) -> list[tuple[int, int]]:
    """Runs, longer by the bytes on either side that equal those beside the kept place."""
    out = []
    for x in runs:
        start, end, before, after = x["start"], x["end"], x["l_need"], x["r_need"]
        out.append((start - _common(raw[max(0, start - before) : start][::-1], x["left"][-before:][::-1]), end + _common(raw[end : end + after], x["right"][:after])))
    return out


def _cut_out(least: int, keep: list[str]):
    def work(batch: pa.RecordBatch) -> dict:
        kept, size, gone, runs, sha = [], [], [], [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            raw = (text or "").encode()
            use = whole_characters(raw, merged(extended(raw, spans or []), least))
            left = outside(raw, use) if use else raw
            kept.append(text if not use else left.decode())
            size.append(len(raw))
            gone.append(len(raw) - len(left))
            runs.append(len(use))
            sha.append(hashlib.sha256(left).hexdigest())
        made = {"kept_text": pa.array(kept, pa.string()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return {c: batch[c] for c in keep} | made

    return lambda: work


def substring_dedup(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """Removes text that another place of the corpus has first.

    Input: doc_id, text; other columns are ignored. Output for each row: doc_id, kept_text, n_bytes, n_removed,
    n_spans, kept_sha256, row (the number in docs, a stable scan).

    Content-defined chunks are compared by 128-bit digest. Runs of repeated chunks are extended on both sides by the bytes
    that equal those of the place that keeps them, to CONTEXT bytes beyond the next cut that is not forced, where chunks
    would be equal if more were; what then has least_run bytes is removed, cut to whole
    characters. So of a passage that two texts share, all is found if at least one chunk lies inside it; where texts have
    no peaks to cut at (a letter repeated), chunks are forced at LONGEST bytes and do not move with insertions. One copy of
    everything stays. Null text counts as empty and stays null; repeated rows are copies of each other, ties go to the
    first; texts shorter than least_run lose nothing; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = saved(repeated_runs(rows), "spans")
    suspects, clean = split_by_filter(rows, "row", found.select("row"))
    none = F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    both = suspects.join(found, "row", "left").select("doc_id", "row", "text", "spans").unionByName(clean.select("doc_id", "row", "text", none))
    return map_batches(both, _cut_out(least_run, ["doc_id", "row"]), "doc_id long, row long, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """docs, all columns, with what substring_dedup() keeps as text; documents of which nothing is left go.

    n_chars, where there is one, is counted anew. Null texts stay, as do empty ones that were empty before; of repeated
    rows the first keeps its text; an empty table stays empty.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    found = saved(repeated_runs(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))), "spans").withColumnRenamed("row", ROW)
    suspects, clean = split_by_filter(rows, ROW, found.select(ROW))
    spans = "_scorespark_spans"
    told = suspects.join(found.withColumnRenamed("spans", spans), ROW, "left")

    columns = docs.columns

    def work(batch: pa.RecordBatch) -> dict:
        out = {c: batch[c] for c in columns}
        texts = []
        for text, found in zip(batch["text"].to_pylist(), batch[spans].to_pylist(), strict=True):
            raw = (text or "").encode()
            use = whole_characters(raw, merged(extended(raw, found or []), least_run))
            texts.append(text if not use else outside(raw, use).decode())
        return out | {"text": pa.array(texts, pa.string())}

    cut = map_batches(told, lambda: work, docs.schema).where("text IS NULL OR text <> ''")  # clean rows are not among these
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).unionByName(cut.select(*docs.columns))


_DIFFERS = "list_filter(range(0, least(len({a}), len({b})) // 2), lambda k: substr({a}, {x}, 2) <> substr({b}, {y}, 2))[1]"
_BEFORE = _DIFFERS.format(a="ol", b="ml", x="len(ol) - 2 * k - 1", y="len(ml) - 2 * k - 1")
_AFTER = _DIFFERS.format(a="orr", b="mr", x="2 * k + 1", y="2 * k + 1")
_INNER = "('8', '9', 'A', 'B')"  # first hex digits of bytes inside characters

#: The same over the whole table: gear hashes as sums over windows, peaks, chunks as strings, runs, edges, whole characters.
#: Texts as hex digits, two a byte.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), y AS (
  SELECT r, n, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS i FROM (SELECT r, n, regexp_extract_all(h, '..') AS bs FROM d WHERE n > {REACH})
), g AS (
  SELECT r, n, i, ([{", ".join(map(str, _GEAR.tolist()))}])[('0x' || b)::INTEGER + 1]::BIGINT AS g FROM y
), e AS (
  SELECT r, n, i, ({" + ".join(f"coalesce(lag(g, {a}) OVER w, 0) * {1 << a}" for a in range(GEAR_BYTES))}) % {1 << 32} AS v FROM g WINDOW w AS (PARTITION BY r ORDER BY i)
), k AS (
  SELECT r, n, i + 1 AS cut, v > coalesce(max(v) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), -1) AND v >= coalesce(max(v) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING), -1) AS peak FROM e
), nat AS (
  SELECT r, cut, coalesce(lag(cut) OVER (PARTITION BY r ORDER BY cut), 0) AS since FROM (SELECT r, cut FROM k WHERE peak AND cut > {REACH} AND cut < n UNION ALL SELECT r, n FROM d WHERE n > 0)
), ends AS (
  SELECT r, cut AS b FROM nat UNION ALL SELECT r, unnest(range(since + {LONGEST}, cut, {LONGEST})) FROM nat
), c AS (
  SELECT r, doc_id, a, b, substr(h, 2 * a + 1, 2 * (b - a)) AS c FROM (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY b), 0) AS a, b FROM ends) JOIN d USING (r)
), own AS (
  SELECT c, min({{'z': doc_id IS NULL, 'd': doc_id, 'r': r, 'a': a}}) AS o FROM c GROUP BY c
), gone AS (
  SELECT r, a, b, o.r AS q, o.a AS place, CASE WHEN lag(b) OVER (PARTITION BY r ORDER BY a) = a THEN 0 ELSE 1 END AS new FROM c JOIN own USING (c) WHERE o.r <> r OR o.a <> a
), run0 AS (
  SELECT *, sum(new) OVER (PARTITION BY r ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM gone
), runs AS (
  SELECT r, min(a) AS a, max(b) AS b, arg_min(q, a) AS lq, arg_min(place, a) AS lat, arg_max(q, a) AS rq, arg_max(place + b - a, a) AS rat FROM run0 GROUP BY r, run
), need AS (
  SELECT runs.*, a - coalesce((SELECT max(cut) FROM nat WHERE nat.r = runs.r AND cut < a), 0) + {CONTEXT} AS lo, coalesce((SELECT min(cut) FROM nat WHERE nat.r = runs.r AND cut > b), b) - b + {CONTEXT} AS hi FROM runs
), sides AS (
  SELECT need.*, substr(d.h, 2 * greatest(0, a - lo) + 1, 2 * least(lo, a)) AS ml, substr(d.h, 2 * b + 1, 2 * hi) AS mr, substr(x.h, 2 * greatest(0, lat - lo) + 1, 2 * least(lo, lat)) AS ol, substr(z.h, 2 * rat + 1, 2 * hi) AS orr
  FROM need JOIN d USING (r) JOIN d x ON x.r = lq JOIN d z ON z.r = rq
), wide AS (
  SELECT r, a - coalesce({_BEFORE}, least(len(ol), len(ml)) // 2) AS a, b + coalesce({_AFTER}, least(len(orr), len(mr)) // 2) AS b FROM sides
), m0 AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM wide
), m1 AS (
  SELECT *, sum(new) OVER (PARTITION BY r ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m0
), m AS (
  SELECT r, min(a) AS a, max(b) AS b FROM m1 GROUP BY r, run HAVING max(b) - min(a) >= {LEAST_RUN}
), spans AS (
  SELECT r, h, a + list_filter(range(0, 4), lambda k: substr(h, 2 * (a + k) + 1, 1) NOT IN {_INNER})[1] AS a, b - list_filter(range(0, 4), lambda k: substr(h, 2 * (b - k) + 1, 1) NOT IN {_INNER})[1] AS b FROM m JOIN d USING (r)
), pieces AS (
  SELECT r, h, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans WHERE b > a
), cut AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS before FROM pieces GROUP BY r
)
SELECT doc_id, cast(n AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
