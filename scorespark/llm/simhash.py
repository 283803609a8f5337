"""SimHash near-dedup; fingerprints are compared bit-sliced."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import ROW, components, join_counted, map_batches, map_runs, saved, split_by_filter, tiles, without_rows
from scorespark.llm.xxh64_sql import xxh64

#: Widths of the six blocks of a fingerprint. Two fingerprints that differ in at most three bits agree in three blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 3
#: Fingerprints of a slot of a hot bucket; a tile holds two slots.
SLOT = 1024
SEED = 42


def _masks() -> list[int]:
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    parts = [((1 << w) - 1) << s for s, w in zip(starts, BLOCKS, strict=True)]
    return [sum(c) for c in combinations(parts, len(BLOCKS) - RADIUS)]


MASKS = _masks()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, width: int) -> bytes:
    """XXH64 of every word shingle, 8 bytes each; of the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, SEED) for s in shingles])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash over word shingles, repeats included; 0 where there are no words."""
    return of_hashes(shingle_hashes(text, width))


def of_hashes(flat: bytes) -> int:
    bits = np.zeros(64, np.int64)
    step = 1 << 16
    for at in range(0, len(flat), 8 * step):
        part = np.frombuffer(flat, np.uint8, min(8 * step, len(flat) - at), at).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(flat) // 8).tobytes(), "big")


def _fingerprints(width: int):
    def work(batch: pa.RecordBatch) -> dict:
        prints = [signed(fingerprint(t, width)) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "_rid": batch["_rid"], "fp": pa.array(prints, pa.int64())}

    return lambda: work


class BitSlices:
    """Bit planes of a block of fingerprints: plane b holds bit b of all of them, one beside the other."""

    def __init__(self, prints: list[int], used: list[int], radius: int = RADIUS):
        raw = np.array(prints, np.uint64)
        width = radius.bit_length() if radius & (radius + 1) == 0 else (radius + 1).bit_length()
        self.full = (1 << len(prints)) - 1
        self.used = used
        # Counters begin so high that they overflow at radius + 1.
        self.begin = [self.full if (1 << width) - 1 - radius >> k & 1 else 0 for k in range(width)]
        self.planes = [int.from_bytes(np.packbits(((raw >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for b in used]

    def near(self, probe: int) -> int:
        """A bit for each fingerprint within the radius of probe.

        The distances of the whole block are counted at once, each bit of the counters in a word of its own: a plane is
        added by carry-save steps. A carry out of the last one is set for good: that distance has passed the radius.
        The block is left as soon as that holds for all.
        """
        counters, over, full = self.begin.copy(), 0, self.full
        places = range(len(counters))
        for b, plane in zip(self.used, self.planes, strict=True):
            carry = plane ^ full if probe >> b & 1 else plane
            for k in places:
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if over == full:
                return 0
        return full & ~over


def _links_of_tile(run: pd.DataFrame) -> pd.DataFrame | None:
    """A spanning forest of the links among one tile's fingerprints."""
    used = [b for b in range(64) if not MASKS[int(run["t"].iloc[0])] >> b & 1]
    signed_prints = run["fp"].tolist()
    prints = [x & 0xFFFFFFFFFFFFFFFF for x in signed_prints]
    slices = BitSlices(prints, used)
    unseen, out = slices.full, []
    while unseen:
        root = (unseen & -unseen).bit_length() - 1
        unseen &= ~(1 << root)
        todo = [root]
        while todo and unseen:
            found = slices.near(prints[todo.pop()]) & unseen
            unseen &= ~found
            while found:
                i = (found & -found).bit_length() - 1
                found &= found - 1
                out.append((signed_prints[root], signed_prints[i]))
                todo.append(i)
    return pd.DataFrame(out, columns=["a", "b"]) if out else None


def simhash_dedup(docs: DataFrame, width: int = 3, slot: int = SLOT) -> DataFrame:
    """Fingerprints of whole texts and the components of fingerprints that differ in at most RADIUS bits.

    Input: doc_id, text; other columns are ignored. Output for each row: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable), _rid (the row's number in docs, a stable scan).

    Null text, empty text and text without words get fingerprint zero, which links like any other. Fewer words than
    the shingle's width form one shingle. Repeated rows share a fingerprint; null doc_ids are never a component_id
    unless the whole component has none. An empty table gives an empty result.

    Search is exact: equal fingerprints are one node; each of 20 tables groups nodes by three of six blocks; a bucket
    is compared bit-sliced in tiles, so that a hot bucket is spread over many tasks, and each tile yields a spanning
    forest of its links instead of all pairs.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_rid"))
    prints = saved(map_batches(rows, _fingerprints(width), "doc_id long, _rid long, fp long"), "simhash")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(MASKS)]))
    entries = nodes.select("fp", table.alias("e")).select("e.t", "e.key", "fp")
    edges = map_runs(tiles(entries, ["t", "key"], "fp", slot), ["t", "key", "_a", "_b"], _links_of_tile, "a long, b long")
    labels = components(edges)
    named = saved(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "rep", "n", F.coalesce("label", "fp").alias("label")), "named")
    smallest = saved(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m")), "smallest")
    of_print = saved(join_counted(named, smallest, ["label"], "m").select("fp", "component_id", "n"), "components")
    return join_counted(prints, of_print, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_rid")


#: The contract over the whole table: shingles, their XXH64, bits that are set in over half of them, links and what they reach.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), t AS (
  SELECT DISTINCT s FROM w
), x AS (
  SELECT s, g::UBIGINT AS g FROM {xxh64("t", SEED)}
), b AS (
  SELECT r, {" + ".join(f"CASE WHEN 2 * sum((g >> {k}) & 1) > count(*) THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))} AS fp FROM w JOIN x USING (s) GROUP BY r
), p AS (
  SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN b USING (r)
), u AS (
  SELECT DISTINCT fp FROM p
), l AS (
  SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= {RADIUS}
), c AS (
  SELECT fp AS a, fp AS b FROM u UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a
), m AS (
  SELECT c.a AS fp, min(p.doc_id) AS component_id FROM c JOIN p ON p.fp = c.b GROUP BY c.a
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM p JOIN m USING (fp)
"""

#: Blocks of texts for near_texts(): BANDS keys of two minima each. A pair at 0.8 shares none with probability
#: (1 - 0.8^2)^16, less than one in ten million.
BANDS = 16
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, 2 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Marks of one set in _similar_in_tile(), and shingles of other sets that are looked up in them at once.
MARKS, LOOKED_UP = 1 << 20, 1 << 20


def _least(h: np.ndarray) -> list[int]:
    """The minima of the hashes under each factor."""
    step = 1 << 12
    return np.min([(_FACTORS[:, None] * h[at : at + step]).min(axis=1) for at in range(0, len(h), step)], axis=0).tolist()


def _blocks(width: int):
    """row, bands of every text that has words."""

    def work(batch: pa.RecordBatch) -> dict:
        rows, bands = [], []
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
            flat = shingle_hashes(text, width)
            if not flat:
                continue
            least = _least(np.frombuffer(flat, ">u8").astype(np.uint64))
            rows.append(row)
            bands.append([xxhash.xxh64_intdigest(f"{k}:{least[2 * k]}:{least[2 * k + 1]}") - (1 << 63) for k in range(BANDS)])
        return {"row": pa.array(rows, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))}

    return lambda: work


def _numbered(h: np.ndarray) -> np.ndarray:
    """Sorted hashes with a hash's second, third, ... occurrence made other values, so that sets of them compare repeats."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return h + nth.astype(np.uint64) * _FACTORS[0]


def _sets(width: int, repeats: bool = False):
    """row, shingles (sorted 64-bit hashes of the set, little-endian; with repeats each occurrence is an element)."""

    def work(batch: pa.RecordBatch) -> dict:
        hashes = (np.frombuffer(shingle_hashes(t, width), ">u8").astype("<u8") for t in batch["text"].to_pylist())
        sets = [np.unique(_numbered(np.sort(h)) if repeats else h).tobytes() for h in hashes]
        return {"row": batch["row"], "shingles": pa.array(sets, pa.binary())}

    return lambda: work


def _similar_in_tile(similarity: float):
    """A spanning forest of the links among one tile's sets.

    A set is compared with all sets of the tile whose sizes allow the similarity: its shingles are marked by their low
    bits, and the marked shingles of another set are at least as many as the common ones. Where they suffice, the sets
    themselves decide, so nothing that is similar is passed over.
    """

    def work(run: pd.DataFrame) -> pd.DataFrame | None:
        order = sorted(zip((len(x) // 8 for x in run["shingles"]), run["row"].tolist(), run["shingles"], strict=True))
        rows = [r for _, r, _ in order]
        sets = [np.frombuffer(x, "<u8") for _, _, x in order]
        sizes = np.array([n for n, _, _ in order])
        flat = np.concatenate(sets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        unseen, marks, out = np.ones(len(rows), bool), np.zeros(MARKS, bool), []

        def near(i: int) -> list[int]:
            lo = int(np.searchsorted(sizes, int(similarity * sizes[i] - 1e-6)))
            hi = int(np.searchsorted(sizes, int(sizes[i] / similarity) + 1, side="right"))
            places, found = sets[i] & np.uint64(MARKS - 1), []
            marks[places] = True
            while lo < hi:
                to = min(hi, max(lo + 1, int(np.searchsorted(starts, starts[lo] + LOOKED_UP, side="right")) - 1))
                if unseen[lo:to].any():
                    hits = marks[flat[starts[lo] : starts[to]] & np.uint64(MARKS - 1)]
                    most = np.add.reduceat(hits, starts[lo:to] - starts[lo], dtype=np.int64)
                    able = most + 1e-6 >= similarity * (sizes[i] + sizes[lo:to] - most)  # 4 of 5 are 0.8
                    for j in (lo + np.flatnonzero(able & unseen[lo:to])).tolist():
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both + 1e-6 >= similarity * (len(sets[i]) + len(sets[j]) - both):
                            found.append(j)
                lo = to
            marks[places] = False
            return found

        for root in range(len(rows)):
            if not unseen[root]:
                continue
            unseen[root] = False
            todo = [root]
            while todo and unseen.any():
                for j in near(todo.pop()):
                    unseen[j] = False
                    out.append((rows[root], rows[j]))
                    todo.append(j)
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return work


def _links_in_blocks(docs: DataFrame, entries: DataFrame, sets: Callable, similarity: float, slot: int) -> DataFrame:
    """(a, b): a spanning forest of the links among rows of a block (band, row; cheap to read twice), decided by their sets."""
    entries = saved(tiles(entries, ["band"], "row", slot), "tiles")
    # Sets are made for texts that share a block only, and nothing else of the corpus is shuffled.
    suspects, _ = split_by_filter(docs.select("row", "text"), "row", entries.select("row"))
    members = entries.join(map_batches(suspects, sets, "row long, shingles binary"), "row")
    return map_runs(members, ["band", "_a", "_b"], _similar_in_tile(similarity), "a long, b long")


def fingerprint_links(docs: DataFrame, width: int = 5, similarity: float = 0.8, slot: int = SLOT // 2) -> DataFrame:
    """(a, b): links among the rows of docs (row, text) that operator 1 finds, a spanning forest of each tile's.

    simhash_dedup() gives the components of fingerprints that differ in at most RADIUS bits. Over half of a text's
    shingles may be one and the same, and then its fingerprint is that shingle's whatever else it says. So each component
    is compared exactly, in tiles: the Jaccard similarity of the shingles of width words has to be at least similarity,
    where each repeat counts as it does in a fingerprint. Texts without words link with nothing.
    """
    said = docs.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    prints = simhash_dedup(said.select(F.col("row").alias("doc_id"), "text"))
    entries = saved(prints.select(F.col("component_id").alias("band"), F.col("doc_id").alias("row")), "prints")
    return _links_in_blocks(docs, entries, _sets(width, repeats=True), similarity, slot)


def near_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, slot: int = SLOT // 2) -> DataFrame:
    """(row, label) of the rows of docs (row, text) that set_links() joins; label is the smallest row reachable."""
    return components(set_links(docs, width, similarity, slot)).select(F.col("node").alias("row"), "label")


def set_links(docs: DataFrame, width: int = 5, similarity: float = 0.8, slot: int = SLOT // 2) -> DataFrame:
    """(a, b): links among the rows of docs (row, text) by sets of shingles, a spanning forest of each tile's.

    Texts are linked when the Jaccard similarity of their sets of word shingles is at least similarity; how often a
    shingle is repeated does not matter. At that similarity fingerprints differ in about ten bits, too many for blocks
    of equal bits. So texts are blocked by minima of their shingle hashes (a pair at 0.8 shares a block with probability
    0.9999999), and inside a block, in tiles, the sets themselves are compared, as 64-bit hashes. Texts without words link
    with nothing; rows that repeat are copies of each other; an empty table gives an empty result.
    """
    blocks = map_batches(docs.select("row", "text"), _blocks(width), "row long, bands array<long>")
    entries = saved(blocks.select("row", F.explode("bands").alias("band")), "blocks")
    # Copies share many blocks: of blocks that hold the same rows, one is enough.
    mark = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    held = entries.groupBy("band").agg(F.count(F.lit(1)).alias("m"), mark(1).alias("p"), mark(2).alias("q")).where("m > 1")
    alone = saved(held.groupBy("m", "p", "q").agg(F.min("band").alias("band")).select("band", "m"), "alone")
    return _links_in_blocks(docs, join_counted(entries, alone, ["band"], "m"), _sets(width), similarity, slot)


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: that with the smallest doc_id (null last; of equal
    ones the first row). Texts that are null or have no words stay; an empty table stays empty.

    Links are those of operator 1's search (fingerprint_links(): at most RADIUS bits, confirmed by the shingles) and those
    of texts whose fingerprints lie further apart while their sets of shingles are similar (set_links()); groups are the
    components of both.
    """
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    light = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    links = fingerprint_links(light, width, similarity).unionByName(set_links(light, width, similarity))
    found = saved(components(links).select(F.col("node").alias("row"), "label"), "near")
    named = saved(light.select("doc_id", "row").join(found, "row"), "named")
    first = saved(named.groupBy("label").agg(F.expr("min(struct(doc_id IS NULL AS n, doc_id, row)).row").alias("keep"), F.count(F.lit(1)).alias("m")), "first")
    gone = saved(join_counted(named, first, ["label"], "m").where("row <> keep").select(F.col("row").alias(ROW)), "gone")
    return without_rows(rows, ROW, gone).select(*docs.columns)
