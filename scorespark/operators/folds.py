"""Ordered folds: greedy matching, suppression, clusters, alignment, exact fill.

Rows that can influence each other are first brought down to small groups (islands, measures, orders). Groups are dealt by
a hash of their key and read in sorted order as Arrow batches; each is folded as a list of plain tuples, so a task holds
one group at a time and no frame is made for a group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from math import ceil, floor, frexp, log2
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scorespark.operators.association import islands, strips

#: Rows that are handed back to Spark at once.
OUT_ROWS = 10_000


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _dealt(df: DataFrame, by: list[str], order: list[str], dealt: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return (df if dealt else df.repartition(*by)).sortWithinPartitions(*by, *order).select(*by, *rest)


def fold_groups(df: DataFrame, by: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """fold(key, rows of the group in order) -> tuples of the schema. A row has the columns of df that are not in by.

    dealt says that rows of equal keys are in one partition already.
    """
    n, kinds = len(by), to_arrow_schema(StructType.fromDDL(schema))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, []
        for row in _tuples(batches):
            if row[:n] != key:
                if held:
                    yield from fold(key, held)
                key, held = row[:n], []
            held.append(row[n:])
        if held:
            yield from fold(key, held)

    return _dealt(df, by, order, dealt).mapInArrow(lambda batches: _batches(out(batches), kinds), schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of rows with equal keys (not null), and where each group begins, ended by the number of
    rows; batches are sorted by the keys. A table is about a batch, or one group if that is larger."""
    keys = lambda b, k: [b.column(c)[k].as_py() for c in by]

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.concatenate([[0], _changes(t, by), [t.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and keys(batch, 0) != keys(held[-1], held[-1].num_rows - 1):
            yield joined(held)
            held = []
        begins = _changes(batch, by)
        if len(begins):
            yield joined([*held, batch.slice(0, begins[-1])])
            held = []
        held.append(batch.slice(begins[-1]) if len(begins) else batch)
    if held:
        yield joined(held)


def _changes(rows: pa.RecordBatch | pa.Table, by: list[str]) -> np.ndarray:
    """Rows whose key is not that of the row before."""
    columns = [rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in by]
    return np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1


def scan_groups(df: DataFrame, by: list[str], order: list[str], step: Callable[[object, tuple, tuple], tuple[object, tuple | None]], schema: str) -> DataFrame:
    """step(state, key, row) -> (state, tuple of the schema or None) over the rows of each group in order; state begins as
    None. Only the state is kept, so a group of any size takes no more memory than a batch."""
    n, kinds = len(by), to_arrow_schema(StructType.fromDDL(schema))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key = state = None
        for row in _tuples(batches):
            if row[:n] != key:
                key, state = row[:n], None
            state, one = step(state, key, row[n:])
            if one is not None:
                yield one

    return _dealt(df, by, order, False).mapInArrow(lambda batches: _batches(out(batches), kinds), schema)


def _typed(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def greedy_match(left: DataFrame, right: DataFrame, on: list[str], x: str, tol: float, order: str | None = None, equal: str | None = None) -> DataFrame:
    """One-to-one matches (on..., left_id, right_id, gap): each left row, by rising `order` (x if none) and id, takes the
    nearest unused right row within tol (ties: the smaller x, then the smaller id); left and right have id and x.

    With `equal`, right rows whose column of that name is the same as the left row's come first. Rows further apart than
    tol from any other are split off beforehand, so a fold sees one island of interacting rows.
    """
    first, sign = F.col(order or x).cast("double").alias("_order"), (F.col(equal) if equal else F.lit(0)).cast("string").alias("_sign")
    both = left.select(*on, F.col(x).cast("double").alias(x), "id", first, sign, F.lit(0).alias("_side"))
    both = both.unionByName(right.select(*on, F.col(x).cast("double").alias(x), "id", F.lit(None).cast("double").alias("_order"), sign, F.lit(1).alias("_side")))
    split = islands(both, on, x, tol, ["_side", "id"])

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        free = [r for r in rows if r[4]]
        places, out = [r[0] for r in free], []
        for at, ident, _, sign, _ in sorted((r for r in rows if not r[4]), key=lambda r: (r[2], r[1])):
            near = range(bisect_left(places, at - tol), bisect_right(places, at + tol))
            best = min(((bool(equal) and free[k][3] != sign, abs(places[k] - at), places[k], free[k][1], k) for k in near), default=None)
            if best:
                out.append((*key[:-1], ident, best[3], best[1]))
                del free[best[4]], places[best[4]]
        return out

    return fold_groups(split, [*on, "island"], [x, "_side", "id"], fold, _typed(both, on) + ", left_id long, right_id long, gap double", dealt=True)


def suppress(df: DataFrame, by: list[str], x: str, score: str, reach: float) -> DataFrame:
    """1-D suppression: rows by falling score (ties: the smaller id) are kept unless a kept row lies within reach.

    df has id; the result is the kept rows (by..., id, x).
    """

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        kept: list[float] = []
        out = []
        for ident, at, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
            k = bisect_left(kept, at)
            if (k == len(kept) or kept[k] - at > reach) and (k == 0 or at - kept[k - 1] > reach):
                kept.insert(k, at)
                out.append((*key[:-1], ident, at))
        return out

    split = islands(df.select(*by, "id", F.col(x).cast("double").alias(x), score), by, x, reach, ["id"])
    return fold_groups(split, [*by, "island"], [x, "id"], fold, _typed(df, by) + f", id long, {x} double", dealt=True)


def keep_first(df: DataFrame, by: list[str], x: str, reach: float) -> DataFrame:
    """Rows in order of x (then id) that do not lie within reach of the last kept row of their group."""

    def step(last: float | None, key: tuple, row: tuple) -> tuple[float, tuple | None]:
        ident, at = row
        return (last, None) if last is not None and at - last <= reach else (at, (*key, ident, at))

    return scan_groups(df.select(*by, "id", F.col(x).cast("double").alias(x)), by, [x, "id"], step, _typed(df, by) + f", id long, {x} double")


def median_clusters(df: DataFrame, by: list[str], x: str, reach: float) -> DataFrame:
    """Rows in order join the last cluster while they lie within reach of its median; (by..., id, cluster)."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, r[0], c) for r, c in zip(rows, median_groups([r[1] for r in rows], reach), strict=True)]

    return fold_groups(df.select(*by, "id", F.col(x).cast("double").alias(x)), by, [x, "id"], fold, _typed(df, by) + ", id long, cluster long")


def median_groups(xs: list[float], reach: float) -> list[int]:
    """Numbers of clusters of ordered places: a place joins the last one while within reach of its median so far."""
    out, members = [], []
    for x in xs:
        if members and abs(x - _middle(members)) <= reach:
            out.append(out[-1])
        else:
            out.append(out[-1] + 1 if out else 0)
            members = []
        members.append(x)
    return out


def _middle(ordered: list[float]) -> float:
    """Median of a list that is in order already."""
    k = len(ordered) // 2
    return ordered[k] if len(ordered) % 2 else (ordered[k - 1] + ordered[k]) / 2


def mean_groups(xs: list[float], reach: float) -> list[int]:
    """Numbers of groups of ordered places: a place joins the last group while within reach of its mean so far."""
    out, total, n = [], 0.0, 0
    for x in xs:
        if n and abs(x - total / n) <= reach:
            out.append(out[-1])
        else:
            out.append(out[-1] + 1 if out else 0)
            total, n = 0.0, 0
        total, n = total + x, n + 1
    return out


def anchored_groups(df: DataFrame, by: list[str], x: str, reach: float) -> DataFrame:
    """Rows in order share a group while they lie within reach of the group's first row; (by..., id, grp)."""

    def step(state: tuple[float, int] | None, key: tuple, row: tuple) -> tuple[tuple[float, int], tuple]:
        ident, at = row
        head, number = state or (at, 0)
        if at - head > reach:
            head, number = at, number + 1
        return (head, number), (*key, ident, number)

    return scan_groups(df.select(*by, "id", F.col(x).cast("double").alias(x)), by, [x, "id"], step, _typed(df, by) + ", id long, grp long")


MATCH, DELETE, INSERT = range(3)


def cheapest_path(n: int, m: int, cost: Callable[[int, int], float], delete: float, insert: float) -> list[tuple[int | None, int | None]]:
    """Order-keeping alignment of n and m items at the least cost; of equal costs a match, then a deletion, then an
    insertion. The costs of a row are kept, and one byte for each cell."""
    last, steps = [j * insert for j in range(m + 1)], np.zeros((n + 1, m + 1), np.uint8)
    steps[:, 0], steps[0, 1:] = DELETE, INSERT
    for i in range(1, n + 1):
        row = [i * delete]
        for j in range(1, m + 1):
            options = (last[j - 1] + cost(i - 1, j - 1), last[j] + delete, row[j - 1] + insert)
            least = min(options)
            row.append(least)
            steps[i, j] = options.index(least)
        last = row
    out, i, j = [], n, m
    while i or j:
        step = steps[i, j]
        i, j = i - (step != INSERT), j - (step != DELETE)
        out.append((i if step != INSERT else None, j if step != DELETE else None))
    return out[::-1]


def monotone_pairs(expected: list[float], found: list[float], skip_expected: float = 0.16, skip_found: float = 0.11, most: float = 0.22) -> list[tuple[int, int]]:
    """Order-keeping alignment of two lists of normalised positions; equal counts are paired one by one."""
    if len(expected) == len(found):
        return [(i, i) for i in range(len(expected))]
    path = cheapest_path(len(expected), len(found), lambda i, j: abs(expected[i] - found[j]), skip_expected, skip_found)
    return [(i, j) for i, j in path if i is not None and j is not None and abs(expected[i] - found[j]) <= most]


def common_of(a: list, b: list) -> int:
    """Size of the intersection of two multisets."""
    return (Counter(a) & Counter(b)).total()


def event_cost(a: tuple, b: tuple) -> float:
    """Cost of taking one event (state, rhythm, notes) for another: .65 for unlike notes, .2 for another state and .075 for
    another rhythm. Two events without notes have like notes."""
    both = common_of(a[2], b[2])
    union = len(a[2]) + len(b[2]) - both
    notes = 1.0 - (both / union if union else 1.0)
    return 0.65 * notes + 0.20 * (a[0] != b[0]) + 0.15 * (0.0 if a[:2] == b[:2] else 0.5)


def edit_pairs(a: list[tuple], b: list[tuple], cost: Callable[[tuple, tuple], float] = event_cost) -> list[tuple[int | None, int | None]]:
    """Edit alignment of two lists of events with gaps of cost 1."""
    return cheapest_path(len(a), len(b), lambda i, j: cost(a[i], b[j]), 1.0, 1.0)


def cheapest_fill(options: list[list[tuple[int, float]]], target: int) -> tuple[float, tuple[int, ...]] | None:
    """One option (size, cost) for each event so that the sizes, whole and not negative, add up to target at the least cost;
    of equal costs the first options, compared from the first event on. None if there is no such choice.

    ahead[k][t]: least cost of events k and after, where those before add up to t; so the first option that keeps to it is
    the right one at each event.
    """
    ahead = [np.where(np.arange(target + 1) == target, 0.0, np.inf)]
    for choices in reversed(options):
        now = np.full(target + 1, np.inf)
        for size, cost in choices:
            if size <= target:
                now[: target + 1 - size] = np.minimum(now[: target + 1 - size], ahead[-1][size:] + cost)
        ahead.append(now)
    ahead.reverse()
    if ahead[0][0] == np.inf:
        return None
    total, picks = 0, []
    for k, choices in enumerate(options):
        picks.append(next(i for i, (size, cost) in enumerate(choices) if total + size <= target and ahead[k + 1][total + size] + cost == ahead[k][total]))
        total += choices[picks[-1]][0]
    return float(ahead[0][0]), tuple(picks)


#: Cells of the tables that cheapest_fills() fills in at once.
CELLS = 4_000_000


def cheapest_fills(begins: np.ndarray, counts: np.ndarray, sizes: np.ndarray, costs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cheapest_fill() for many groups at once: the cost of each (inf: none), and the place of each event's option among all.

    Group g has the events begins[g] to begins[g + 1]; event e has counts[e] of the options (sizes, costs), which lie one
    after the other. Groups of like numbers of events and like targets, by powers of two, are filled together.
    """
    n, first = np.diff(begins), np.cumsum(counts) - counts
    best, picks = np.full(len(n), np.inf), np.zeros(len(counts), dtype=np.int64)
    bits = lambda v: np.frexp(np.maximum(v, 1))[1]
    kinds = bits(n) * 64 + bits(targets)
    for kind in np.unique(kinds):
        like = np.flatnonzero(kinds == kind)
        most = max(1, CELLS // ((int(n[like].max()) + 1) * (int(targets[like].max()) + 2)))
        for k in range(0, len(like), most):
            g = like[k : k + most]
            best[g] = _fill_alike(begins[g], n[g], counts, first, sizes, costs, targets[g], picks)
    return best, picks


def _fill_alike(begins, n, counts, first, sizes, costs, targets, picks) -> np.ndarray:
    rows, top, events = np.arange(len(n)), int(targets.max()), int(n.max())

    def options(k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The first options of all groups' k-th events, their second ones, and so on: place, size, cost (inf where none)."""
        e = np.where(k < n, begins + k, -1)
        many = np.where(e >= 0, counts[e], 0)
        if not many.any():
            return
        for o in range(int(many.max())):
            at = np.where(o < many, first[e] + o, 0)
            yield at, np.where(o < many, np.minimum(sizes[at], top + 1), 0), np.where(o < many, costs[at], np.inf)

    # ahead[k][g, t]: as in cheapest_fill(); the last column is for sums beyond all targets.
    ahead = np.full((events + 1, len(n), top + 2), np.inf)
    ahead[events][rows, targets] = 0.0
    places = np.arange(top + 1)
    for k in reversed(range(events)):
        now = ahead[k][:, :-1]
        for _, size, cost in options(k):
            np.minimum(now, np.take_along_axis(ahead[k + 1], np.minimum(places + size[:, None], top + 1), 1) + cost[:, None], out=now)
        over = k >= n  # groups that are shorter
        ahead[k][over] = ahead[k + 1][over]
    total, out = np.zeros(len(n), dtype=np.int64), ahead[0][:, 0]
    found = np.isfinite(out)
    for k in range(events):
        open_, step = found & (k < n), np.zeros(len(n), dtype=np.int64)
        for at, size, cost in options(k):
            hit = open_ & (ahead[k + 1][rows, np.minimum(total + size, top + 1)] + cost == ahead[k][rows, total])
            picks[begins[hit] + k], step[hit] = at[hit], size[hit]
            open_ &= ~hit
        total += step
    return out


def iou(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Intersection over union of two boxes (x, y, w, h)."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


_BOX = ("id", "side", "score", "x", "y", "w", "h")


class BoxGrid:
    """Boxes by place and size, for those that overlap a given one by at least `least` (above 0).

    Such boxes are alike in width and height, up to the factor 1 / least. So boxes are kept by the powers of two of their
    sides, each class in a grid of such cells, and a query looks at the cells around it in the classes near its own.
    """

    def __init__(self, least: float):
        self.reach, self.classes = ceil(log2(1 / least)), {}

    def _place(self, box: tuple) -> tuple[tuple[int, int], tuple[int, int]]:
        kx, ky = frexp(box[2])[1], frexp(box[3])[1]
        return (kx, ky), (floor(box[0] / 2.0**kx), floor(box[1] / 2.0**ky))

    def add(self, box: tuple, item: tuple) -> None:
        if box[2] > 0 and box[3] > 0:
            kind, cell = self._place(box)
            self.classes.setdefault(kind, {}).setdefault(cell, []).append(item)

    def remove(self, box: tuple, item: tuple) -> None:
        if box[2] > 0 and box[3] > 0:
            kind, cell = self._place(box)
            self.classes[kind][cell].remove(item)

    def near(self, box: tuple) -> Iterator[tuple]:
        if not (box[2] > 0 and box[3] > 0):
            return
        (own_x, own_y), _ = self._place(box)
        for (kx, ky), cells in self.classes.items():
            if abs(kx - own_x) <= self.reach and abs(ky - own_y) <= self.reach:
                for i in range(floor(box[0] / 2.0**kx) - 1, floor((box[0] + box[2]) / 2.0**kx) + 1):
                    for j in range(floor(box[1] / 2.0**ky) - 1, floor((box[1] + box[3]) / 2.0**ky) + 1):
                        yield from cells.get((i, j), ())


class CentreGrid:
    """Boxes by their centres, for those whose centre is at most `most` from that of a given one."""

    def __init__(self, most: float):
        self.side, self.cells = most if most > 0 else 1.0, {}

    def _place(self, box: tuple) -> tuple[int, int]:
        return floor((box[0] + box[2] / 2) / self.side), floor((box[1] + box[3] / 2) / self.side)

    def add(self, box: tuple, item: tuple) -> None:
        self.cells.setdefault(self._place(box), []).append(item)

    def remove(self, box: tuple, item: tuple) -> None:
        self.cells[self._place(box)].remove(item)

    def near(self, box: tuple) -> Iterator[tuple]:
        x, y = self._place(box)
        for i in (x - 1, x, x + 1):
            for j in (y - 1, y, y + 1):
                yield from self.cells.get((i, j), ())


def _distance(a: tuple, b: tuple) -> float:
    return ((a[0] + a[2] / 2 - b[0] - b[2] / 2) ** 2 + (a[1] + a[3] / 2 - b[1] - b[3] / 2) ** 2) ** 0.5


def _box_islands(df: DataFrame, by: list[str], grow: float | None) -> DataFrame:
    """df with _i and _j: boxes of a group that lie in different strips, of x or of y within those, have nothing in common.
    grow: centres count, with so much on either side."""
    span = lambda at, size: (F.col(at), F.col(at) + F.col(size)) if grow is None else (F.col(at) + F.col(size) / 2 - grow, F.col(at) + F.col(size) / 2 + grow)
    return strips(strips(df, by, *span("x", "w"), "_i"), [*by, "_i"], *span("y", "h"), "_j")


def _match_islands(df: DataFrame, by: list[str], grow: float | None) -> DataFrame:
    """As _box_islands(), with all truths of one id in one island: where an id has several boxes, each spans them all."""
    span = lambda at, size: (F.col(at), F.col(at) + F.col(size)) if grow is None else (F.col(at) + F.col(size) / 2 - grow, F.col(at) + F.col(size) / 2 + grow)
    w, truth, ends = W.partitionBy(*by, "side", "id"), F.col("side") == 0, {}
    for at, size in ("xw", "yh"):
        lo, hi = span(at, size)
        ends |= {f"_{at}0": F.when(truth, F.min(lo).over(w)).otherwise(lo), f"_{at}1": F.when(truth, F.max(hi).over(w)).otherwise(hi)}
    parted = strips(df.withColumns(ends), by, F.col("_x0"), F.col("_x1"), "_i")
    return strips(parted, [*by, "_i"], F.col("_y0"), F.col("_y1"), "_j").drop(*ends)


def match_boxes(df: DataFrame, by: list[str], least_iou: float | None = 0.3, most_distance: float | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Boxes of two sides (side 0: truth, 1: found, with score) matched one to one within each group.

    Found boxes by falling score (then id, the columns `ties` and label) take the unused truth of the highest overlap, at least least_iou (above 0); or,
    with most_distance, the one with the nearest centre; of equals the smaller id, then label. df has id, side, score, x, y,
    w, h and label; groups are (image, class). `same` says whether the two boxes have the same label. Truths of one id are
    one truth with several boxes: the best counts, and all are used with it. Groups are parted into islands first, and a box
    is compared with those in the grid cells around it.
    """

    def rank(r: tuple) -> tuple:
        return *r[:2], r[2][7] is None, r[2][7]

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        grid, boxes = BoxGrid(least_iou) if most_distance is None else CentreGrid(most_distance), defaultdict(list)
        for t in rows:
            if t[1] == 0:
                grid.add(t[3:7], t)
                boxes[t[0]].append(t)
        out = []
        for ident, _, _, *box, label in sorted((r[:8] for r in rows if r[1] == 1), key=lambda r: (-r[2], r[0])):
            if most_distance is None:
                ranked = ((-iou(box, t[3:7]), t[0], t) for t in grid.near(box))
                best = min((r for r in ranked if -r[0] >= least_iou), default=None, key=rank)
            else:
                ranked = ((_distance(box, t[3:7]), t[0], t) for t in grid.near(box))
                best = min((r for r in ranked if r[0] <= most_distance), default=None, key=rank)
            if best:
                for t in boxes.pop(best[1]):
                    grid.remove(t[3:7], t)
                out.append((*key[:-2], ident, best[1], abs(best[0]), label == best[2][7]))
        return out

    split = _match_islands(df.select(*by, *_BOX, "label", *ties), by, most_distance)
    return fold_groups(split, [*by, "_i", "_j"], ["side", "id", *ties, "label"], fold, _typed(df, by) + ", found_id long, truth_id long, measure double, same boolean")


def suppress_boxes(df: DataFrame, by: list[str], least_iou: float = 0.4) -> DataFrame:
    """Non-maximum suppression: boxes by falling score (then id) stay unless a kept box of the group overlaps them by at
    least least_iou (above 0). Islands and cells as in match_boxes()."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        kept, out = BoxGrid(least_iou), []
        for r in sorted(rows, key=lambda r: (-r[2], r[0])):
            if all(iou(r[3:], k[3:]) < least_iou for k in kept.near(r[3:])):
                kept.add(r[3:], r)
                out.append((*key[:-2], r[0]))
        return out

    split = _box_islands(df.select(*by, *_BOX), by, None)
    return fold_groups(split, [*by, "_i", "_j"], ["id"], fold, _typed(df, by) + ", id long")


def join_digits(digits: list[tuple[float, int]], gap: float, most: int = 36) -> list[tuple[float, int]]:
    """Digits (x, value) in order joined in twos: the first 1 to 3, the number 10 to `most`, closer than gap."""
    out, i = [], 0
    while i < len(digits):
        x, v = digits[i]
        if i + 1 < len(digits) and 1 <= v <= 3 and digits[i + 1][0] - x < gap and 10 <= 10 * v + digits[i + 1][1] <= most:
            out.append(((x + digits[i + 1][0]) / 2, 10 * v + digits[i + 1][1]))
            i += 2
        else:
            out.append((x, v))
            i += 1
    return out


def anchored_pairs(a: list[tuple[str, float]], b: list[tuple[str, float]]) -> tuple[list[tuple[int, int]], str]:
    """Alignment pinned by prints that occur once on either side, as far as they rise on both; stretches between are
    monotone."""
    counts = Counter(p for p, _ in a), Counter(p for p, _ in b)
    places = {p: j for j, (p, _) in enumerate(b)}
    pins, last = [], -1
    for i, (p, _) in enumerate(a):
        if counts[0][p] == counts[1][p] == 1 and places[p] > last:
            last = places[p]
            pins.append((i, last))
    out, i0, j0 = [], 0, 0
    for i, j in [*pins, (len(a), len(b))]:
        out += [(i0 + p, j0 + q) for p, q in monotone_pairs([x for _, x in a[i0:i]], [x for _, x in b[j0:j]])]
        if i < len(a) and j < len(b):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out, "anchors" if pins else "monotone"


def windows_of_markers(events: list[float], markers: list[tuple[float, int, tuple[float, float] | None]], spacing: float, most: int = 7) -> list[tuple[int, list[int]]]:
    """(marker, its events) for markers (x, expected number, bracket) in order, of events in order.

    A marker with a bracket takes the free events in it, if they are two or more. Else it takes the run of 2 to `most`
    free neighbours whose middle lies nearest, with .12 for each event more or less than expected; of equals the shortest,
    then the first. All runs are made once, as arrays in that order, and scored together.
    """
    x, n = np.asarray(events, float), len(events)
    lengths = range(2, min(most, n) + 1)
    starts = np.array([i for k in lengths for i in range(n - k + 1)], int)
    sizes = np.array([k for k in lengths for _ in range(n - k + 1)], int)
    if not len(starts):
        return []
    middles, free, out = (x[starts] + x[starts + sizes - 1]) / 2, np.ones(n, bool), []
    for m, (at, expected, bracket) in enumerate(markers):
        taken = np.append(0, np.cumsum(~free))
        runs = taken[starts + sizes] == taken[starts]
        margin = max(2.0, spacing * 0.12)
        inside = np.flatnonzero(free & (x >= bracket[0] - margin) & (x <= bracket[1] + margin)) if bracket else []
        if len(inside) >= 2:
            chosen = inside
        elif runs.any():
            best = np.where(runs, np.abs(middles - at) / max(spacing, 1.0) + 0.12 * np.abs(sizes - expected), np.inf).argmin()
            chosen = starts[best] + np.arange(sizes[best])
        else:
            continue
        free[chosen] = False
        out.append((m, chosen.tolist()))
    return out


class StaffInk:
    """Ink along a staff: values sampled every `step` from `top` downwards, and where notes are written on it.

    A note sounds an octave below where it is written; its height is told by its diatonic step from the top line, F5. The
    head of a new attack hides a candidate: one that lies within .75 of the lines' spacing of an attacked note is taken for
    that note, if no more notes are counted than attacks and the tie itself is not seen well (under .5).
    """

    DEGREES = (0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6)
    TOP_LINE = 5 * 7 + 3
    HIDES, SEEN = 0.75, 0.5

    def __init__(self, tuning: list[int], top_line: float, spacing: float, values: list[float], top: float, step: float, counted: int, seen: float):
        self.tuning, self.top_line, self.spacing = tuning, top_line, spacing
        self.values, self.top, self.step, self.counted, self.seen = values, top, step, counted, seen

    def height(self, string: int, fret: int) -> float | None:
        if not 0 <= string < len(self.tuning):
            return None
        octave, degree = divmod(self.tuning[string] + fret + 12, 12)
        return self.top_line + (self.TOP_LINE - (octave - 1) * 7 - self.DEGREES[degree]) * self.spacing / 2

    def at(self, string: int, fret: int) -> float:
        y = self.height(string, fret)
        if y is None or self.step <= 0:
            return 0.0
        k = round((y - self.top) / self.step)
        return self.values[k] if 0 <= k < len(self.values) else 0.0

    def covered(self, string: int, fret: int, attacks: list[tuple[int, int]]) -> bool:
        y, heads = self.height(string, fret), [h for s, f in attacks if (h := self.height(s, f)) is not None]
        near = y is not None and self.spacing > 0 and any(abs(y - h) <= self.HIDES * self.spacing for h in heads)
        return near and self.counted <= len(heads) and self.seen < self.SEEN


class Continuations:
    """Resolves the notes that sound on without a new attack, event by event of one document.

    An event says which strings it attacks (with their pitches), how many notes seem to be missing, on which strings ink is
    seen where a sounding note would be printed, and at which strings or pitches its ties point. Sources are asked in
    order: ink, string targets, pitch targets, the recent chain, the event before. A result counts only if it has as many
    notes as are missing; a fresh attack ends the chain of its string.
    """

    RECENT, REMEMBERED, FAR, INK = 2, 8, 1.5, 0.28

    def __init__(self) -> None:
        self.serial = 0
        self.last: dict[int, tuple[int, int, int]] = {}  # string -> (event, pitch, serial)
        self.tied: dict[int, tuple[int, int, int]] = {}
        self.before: list[tuple[int, int, int]] = []  # notes (string, event, pitch) of the event before

    def skip(self, event: int, attacks: list[tuple[int, int]]) -> None:
        """An event that was suppressed or is empty: it resolves nothing and ends no chain, but it is the event before."""
        self.serial += 1
        self.before = [(s, event, p) for s, p in sorted(attacks)]

    def step(self, event: int, attacks: list[tuple[int, int]], dead: bool, missing: int, ink: dict[int, float] | StaffInk, strings: list[int], pitches: list[int]) -> tuple[str, list[tuple[int, int, int]]]:
        """(method or why not, continued notes (string, source event, pitch)). Ink is given by string, or read from the
        event's profile where the note would be written."""
        self.serial += 1
        attacked = {s for s, _ in attacks}
        held = [(s, *self.tied[s][:2]) for s in sorted(self.tied) if s not in attacked and self.serial - self.tied[s][2] <= self.RECENT]
        seen_at = ink if isinstance(ink, StaffInk) else None
        inked = lambda n: (seen_at.at(n[0], n[2]) if seen_at else ink.get(n[0], 0.0)) >= self.INK
        chosen, method = [n for n in held if inked(n) and not (seen_at and seen_at.covered(n[0], n[2], attacks))], "ink"
        if missing and not attacked:
            seen, room = {n[0] for n in chosen}, max(0, missing - len(chosen))
            for n in self.before:
                if (room > 0 or len(self.before) >= 2) and n[0] not in seen and inked(n):
                    chosen.append(n)
                    room -= 1
        if chosen:
            missing = len(chosen)
        elif missing:
            if strings:
                chosen = [(s, *self.last[s][:2]) for s in sorted(set(strings)) if s not in attacked and s in self.last]
                method = "string target"
            if not chosen and pitches:
                chosen, method = self._by_pitch(attacked, pitches, missing), "pitch target"
            if not chosen and len(held) == missing:
                chosen, method = held, "recent chain"
            if len(chosen) != missing:
                chosen, method = [n for n in self.before if n[0] not in attacked], "adjacent"
        if not missing:
            method, chosen = "none", []
        elif len(chosen) != missing:
            method, chosen = "unresolved", []
        self._remember(event, attacks, dead, chosen)
        return method, chosen

    def _by_pitch(self, attacked: set[int], pitches: list[int], missing: int) -> list[tuple[int, int, int]]:
        free = [(s, *x[:2]) for s, x in sorted(self.last.items()) if s not in attacked and self.serial - x[2] <= self.REMEMBERED]
        out, far = [], 0
        for p in pitches:
            if free:
                best = min(free, key=lambda n: (abs(n[2] - p), n[0]))
                free.remove(best)
                out.append(best)
                far = max(far, abs(best[2] - p))
        return out if len(out) == missing and far <= self.FAR else []

    def _remember(self, event: int, attacks: list[tuple[int, int]], dead: bool, chosen: list[tuple[int, int, int]]) -> None:
        for s, pitch in attacks if not dead else ():
            self.last[s] = (event, pitch, self.serial)
            self.tied.pop(s, None)
        for s, _, pitch in chosen:
            self.last[s] = self.tied[s] = (event, pitch, self.serial)
        self.before = [(s, event, p) for s, p in sorted([*attacks, *((s, p) for s, _, p in chosen)])]


class Glyphs:
    """Printed glyphs of one measure to notes of events.

    Glyphs (x, string, character) of a string that follow each other within gap make a token, which is a number of at most
    36 or x; tokens of all strings are clustered by the running median of the last cluster; a cluster belongs to the
    nearest unused event within radius, or makes a new one; of several tokens of a string in a cluster the first counts.
    """

    def __init__(self, gap: float, reach: float, radius: float, most: int = 36):
        self.gap, self.reach, self.radius, self.most = gap, reach, radius, most

    def tokens(self, glyphs: list[tuple[float, int, str]]) -> list[tuple[float, int, str]]:
        out = []
        for string in sorted({s for _, s, _ in glyphs}):
            run: list[tuple[float, str]] = []
            for x, c in [*sorted((x, c) for x, s, c in glyphs if s == string), (float("inf"), "")]:
                if run and x - run[-1][0] > self.gap:
                    text = "".join(c for _, c in run)
                    if text == "x" or (text.isdigit() and int(text) <= self.most):
                        out.append(((run[0][0] + run[-1][0]) / 2, string, text if text == "x" else str(int(text))))
                    run = []
                run.append((x, c))
        return sorted(out)

    def notes(self, glyphs: list[tuple[float, int, str]], events: list[tuple[float, int]]) -> list[tuple[int | None, float, int, str, str]]:
        """(event, its x, string, token, outcome); event is None where a new one is made."""
        tokens, free, out = self.tokens(glyphs), sorted(events), []
        groups = median_groups([t[0] for t in tokens], self.reach)
        for g in dict.fromkeys(groups):
            cluster = [t for t, k in zip(tokens, groups, strict=True) if k == g]
            middle = median(t[0] for t in cluster)
            best = min(free, key=lambda e: (abs(e[0] - middle), *e), default=None)
            if best is not None and abs(best[0] - middle) <= self.radius:
                free.remove(best)
                x, event, outcome = best[0], best[1], "associated"
            else:
                x, event, outcome = middle, None, "created"
            seen = set()
            for _, string, text in sorted(cluster, key=lambda t: (t[1], t[0])):
                out.append((event, x, string, text, "duplicate" if string in seen else outcome))
                seen.add(string)
        return out
