"""Queries whose rows depend on an order within a group: matching, suppression, clusters, alignment, fills.

Their SQL is recursive: one row of state for each group and step.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import folds, timeline
from scorespark.plans.base import BOXES, EVENTS, Registry, boxes, events, table
from scorespark.plans.sequences import gap_rows

query = Registry()
QUERIES, SQL = query.queries, query.sql

ON = ["user_id", "day"]


def _sides(spark, d):
    """Truth: views; predictions: clicks, with value as confidence."""
    e = events(spark, d).select("user_id", "day", "event_id", "event_type", "x", "v", (F.col("v") % 3).alias("kind"))
    side = lambda t: e.where(F.col("event_type") == t).select("user_id", "day", F.col("event_id").alias("id"), "x", (-F.col("v")).alias("worse"), "kind")
    return side("view"), side("click")


def _greedy_sql(left: str, right: str, tol: int, order: str = "x", other: str = "0") -> str:
    """Common tables up to m, the matches: rows of the left type, by order and id, take the best row of the right type."""
    return f"""WITH RECURSIVE {EVENTS},
l AS (SELECT user_id, day, list({{'id': event_id, 'x': x, 'k': v % 3}} ORDER BY {order}, event_id) AS ls FROM events_x WHERE event_type = '{left}' GROUP BY ALL),
r AS (SELECT user_id, day, list({{'id': event_id, 'x': x, 'k': v % 3}}) AS rs FROM events_x WHERE event_type = '{right}' GROUP BY ALL),
f AS (SELECT user_id, day, ls, rs, 0 AS k, CAST(NULL AS BIGINT) AS left_id, CAST(NULL AS BIGINT) AS right_id, CAST(NULL AS DOUBLE) AS gap FROM l JOIN r USING (user_id, day)
UNION ALL SELECT user_id, day, ls, list_filter(rs, lambda q: best IS NULL OR q.id <> best.id), k + 1, ls[k + 1].id, best.id, cast(best.gap AS DOUBLE)
FROM (SELECT *, list_sort(list_transform(list_filter(rs, lambda q: abs(q.x - ls[k + 1].x) <= {tol}), lambda q: {{'o': {other}, 'gap': abs(q.x - ls[k + 1].x), 'x': q.x, 'id': q.id}}))[1] AS best FROM f WHERE k < len(ls))),
m AS (SELECT user_id, day, left_id, right_id, gap FROM f WHERE right_id IS NOT NULL)"""


@query(_greedy_sql("view", "click", 900) + " SELECT * FROM m")
def greedy_match_truth(spark, d):
    """Truths in order of x take the nearest prediction within 900 s."""
    truth, pred = _sides(spark, d)
    return folds.greedy_match(truth, pred, ON, "x", 900)


@query(_greedy_sql("click", "view", 900, "-v") + " SELECT * FROM m")
def greedy_match_conf(spark, d):
    """Predictions by falling confidence take the nearest truth."""
    truth, pred = _sides(spark, d)
    return folds.greedy_match(pred, truth, ON, "x", 900, "worse")


@query(_greedy_sql("click", "view", 900, "x", "CASE WHEN q.k = ls[k + 1].k THEN 0 ELSE 1 END") + " SELECT * FROM m")
def greedy_match_signature(spark, d):
    """Predictions in order take a truth of the same kind first, then the nearest."""
    truth, pred = _sides(spark, d)
    return folds.greedy_match(pred, truth, ON, "x", 900, None, "kind")


@query(_greedy_sql("click", "view", 900, "event_id") + " SELECT * FROM m")
def greedy_match_input(spark, d):
    """Predictions in input order."""
    truth, pred = _sides(spark, d)
    return folds.greedy_match(pred, truth, ON, "x", 900, "id")


@query(_greedy_sql("view", "click", 300) + " SELECT user_id, day, count(*) AS matched FROM m GROUP BY ALL")
def match_positions(spark, d):
    """How many positions match within 300 s, for each user and day."""
    truth, pred = _sides(spark, d)
    return folds.greedy_match(truth, pred, ON, "x", 300).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("matched"))


@query(_greedy_sql("view", "click", 900) + """ SELECT e.user_id, e.day, e.event_id AS id, m.left_id AS event, CASE WHEN m.left_id IS NULL THEN 'orphan' ELSE 'matched' END AS status
FROM events_x e LEFT JOIN m ON m.right_id = e.event_id WHERE e.event_type = 'click'""")
def associate_events(spark, d):
    """Left-driven association with the leftovers of the right side kept as orphans."""
    truth, pred = _sides(spark, d)
    m = folds.greedy_match(truth, pred, ON, "x", 900).select(F.col("right_id").alias("id"), F.col("left_id").alias("event"))
    return pred.select("user_id", "day", "id").join(m, "id", "left").select("user_id", "day", "id", "event", F.when(F.col("event").isNull(), "orphan").otherwise("matched").alias("status"))


def _placed(spark, d):
    return events(spark, d).select("user_id", "day", F.col("event_id").alias("id"), "x", "v", "event_type")


@query(f"""WITH RECURSIVE {EVENTS}, g AS (SELECT user_id, day, list({{'id': event_id, 'x': x}} ORDER BY v DESC, event_id) AS ls FROM events_x GROUP BY ALL),
f AS (SELECT user_id, day, ls, 0 AS k, CAST([] AS BIGINT[]) AS kept, false AS ok FROM g
UNION ALL SELECT user_id, day, ls, k + 1, CASE WHEN good THEN list_append(kept, ls[k + 1].x) ELSE kept END, good FROM (SELECT *, len(list_filter(kept, lambda q: abs(q - ls[k + 1].x) <= 600)) = 0 AS good FROM f WHERE k < len(ls)))
SELECT user_id, day, ls[k].id AS id, cast(ls[k].x AS DOUBLE) AS x FROM f WHERE ok""")
def merge_columns(spark, d):
    """1-D suppression: of events within 600 s of each other the largest value stays."""
    return folds.suppress(_placed(spark, d), ON, "x", "v", 600)


def _numbered(by: str = "user_id, day") -> str:
    return f"n AS (SELECT *, event_id AS id, row_number() OVER (PARTITION BY {by} ORDER BY x, event_id) AS r FROM events_x)"


@query(f"""WITH RECURSIVE {EVENTS}, {_numbered("user_id, day, event_type")},
f AS (SELECT user_id, day, event_type, id, r, x AS last, true AS keep FROM n WHERE r = 1
UNION ALL SELECT n.user_id, n.day, n.event_type, n.id, n.r, CASE WHEN n.x - f.last > 600 THEN n.x ELSE f.last END, n.x - f.last > 600 FROM f JOIN n ON n.user_id = f.user_id AND n.day = f.day AND n.event_type = f.event_type AND n.r = f.r + 1)
SELECT user_id, day, event_type, id, cast(last AS DOUBLE) AS x FROM f WHERE keep""")
def near_dedupe(spark, d):
    """Markers of one class within 600 s of a kept one go."""
    return folds.keep_first(_placed(spark, d), [*ON, "event_type"], "x", 600)


@query(f"""WITH RECURSIVE {EVENTS}, {_numbered()},
f AS (SELECT user_id, day, id, r, x AS head, 0::BIGINT AS grp FROM n WHERE r = 1
UNION ALL SELECT n.user_id, n.day, n.id, n.r, CASE WHEN n.x - f.head > 1200 THEN n.x ELSE f.head END, f.grp + CASE WHEN n.x - f.head > 1200 THEN 1 ELSE 0 END FROM f JOIN n ON n.user_id = f.user_id AND n.day = f.day AND n.r = f.r + 1)
SELECT user_id, day, id, grp FROM f""")
def anchored_groups(spark, d):
    return folds.anchored_groups(_placed(spark, d), ON, "x", 1200)


@query(f"""WITH RECURSIVE {EVENTS}, {_numbered()},
f AS (SELECT user_id, day, id, r, [x] AS members, 0::BIGINT AS cluster FROM n WHERE r = 1
UNION ALL SELECT user_id, day, id, r, CASE WHEN near THEN list_append(members, x) ELSE [x] END, cluster + CASE WHEN near THEN 0 ELSE 1 END
FROM (SELECT n.user_id, n.day, n.id, n.r, n.x, f.members, f.cluster, abs(n.x - list_aggregate(f.members, 'median')) <= 1800 AS near FROM f JOIN n ON n.user_id = f.user_id AND n.day = f.day AND n.r = f.r + 1))
SELECT user_id, day, id, cluster FROM f""")
def median_clusters(spark, d):
    """Events of a user and day, clustered by the running median of the last cluster."""
    return folds.median_clusters(_placed(spark, d), ON, "x", 1800)


@query(f"""WITH RECURSIVE {EVENTS}, {_numbered()},
f AS (SELECT user_id, day, id, r, cast(x AS DOUBLE) AS total, 1 AS members, 0::BIGINT AS grp FROM n WHERE r = 1
UNION ALL SELECT user_id, day, id, r, CASE WHEN near THEN total + x ELSE x END, CASE WHEN near THEN members + 1 ELSE 1 END, grp + CASE WHEN near THEN 0 ELSE 1 END
FROM (SELECT n.user_id, n.day, n.id, n.r, n.x, f.total, f.members, f.grp, abs(n.x - f.total / f.members) <= 900 AS near FROM f JOIN n ON n.user_id = f.user_id AND n.day = f.day AND n.r = f.r + 1))
SELECT user_id, day, id AS event_id, grp FROM f""")
def group_onsets(spark, d):
    """Events of a user and day grouped by the running mean of the last group."""
    fold = lambda key, rows: [(*key, r[0], g) for r, g in zip(rows, folds.mean_groups([float(r[1]) for r in rows], 900.0), strict=True)]
    return folds.fold_groups(_placed(spark, d).select(*ON, "id", "x"), ON, ["x", "id"], fold, "user_id long, day string, event_id long, grp long")


@query(f"""WITH RECURSIVE {EVENTS}, n AS (SELECT user_id, day, event_id, x, x + v % 2000 AS e, row_number() OVER (PARTITION BY user_id, day ORDER BY x, event_id) AS r FROM events_x),
f AS (SELECT user_id, day, event_id, r, e AS cursor, true AS ok FROM n WHERE r = 1 UNION ALL SELECT n.user_id, n.day, n.event_id, n.r, CASE WHEN n.x >= f.cursor THEN n.e ELSE f.cursor END, n.x >= f.cursor FROM f JOIN n ON n.user_id = f.user_id AND n.day = f.day AND n.r = f.r + 1)
SELECT event_id FROM f WHERE ok""")
def non_overlapping(spark, d):
    e = events(spark, d).select("user_id", "day", "event_id", "x", (F.col("x") + F.col("v") % 2000).alias("e"))

    def step(cursor: int | None, key: tuple, row: tuple) -> tuple[int, tuple | None]:
        ident, x, end = row
        cursor = -1 if cursor is None else cursor
        return (end, (ident,)) if x >= cursor else (cursor, None)

    return folds.scan_groups(e, ON, ["x", "event_id"], step, "event_id long")


_SCALED = f"""{EVENTS}, s AS (SELECT *, CASE WHEN count(*) OVER g <= 1 THEN 0.5::DOUBLE WHEN max(x) OVER g > min(x) OVER g THEN (x - min(x) OVER g) / cast(max(x) OVER g - min(x) OVER g AS DOUBLE)
ELSE (row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY x, event_id) - 1) / cast(count(*) OVER g - 1 AS DOUBLE) END AS scaled FROM events_x WHERE event_type IN ('view', 'click') WINDOW g AS (PARTITION BY user_id, day, event_type))"""


def _scaled(spark, d):
    e = events(spark, d).where(F.col("event_type").isin("view", "click"))
    return timeline.minmax(e, [*ON, "event_type"], ["x", "event_id"], "x")


def _path_sql(keys: str, cost: str, delete: float, insert: float) -> str:
    """Common tables c, t and pairs (keys, a, b, i, j): the cheapest alignment of the lists a and b of each row of g, cell
    by cell and back. cost is that of a[i] and b[j]; i and j are null at gaps."""
    return f"""c AS (SELECT {keys}, a, b, 0 AS p, CAST([] AS DOUBLE[]) AS cs, CAST([] AS INTEGER[]) AS st FROM g
UNION ALL SELECT {keys}, a, b, p + 1, list_append(cs, CASE WHEN i = 0 THEN j * {insert}::DOUBLE WHEN j = 0 THEN i * {delete}::DOUBLE ELSE least(mt, dl, ins) END), list_append(st, CASE WHEN i = 0 THEN 2 WHEN j = 0 THEN 1 WHEN mt <= dl AND mt <= ins THEN 0 WHEN dl <= ins THEN 1 ELSE 2 END)
FROM (SELECT *, CASE WHEN i > 0 AND j > 0 THEN cs[p - w] + {cost} END AS mt, CASE WHEN i > 0 THEN cs[p + 1 - w] + {delete}::DOUBLE END AS dl, CASE WHEN j > 0 THEN cs[p] + {insert}::DOUBLE END AS ins
FROM (SELECT *, p // (len(b) + 1) AS i, p % (len(b) + 1) AS j, len(b) + 1 AS w FROM c WHERE p < (len(a) + 1) * (len(b) + 1)))),
t AS (SELECT {keys}, a, b, st, len(a) AS i, len(b) AS j, CAST(NULL AS INTEGER) AS s FROM c WHERE p = (len(a) + 1) * (len(b) + 1)
UNION ALL SELECT {keys}, a, b, st, i - CASE WHEN n <> 2 THEN 1 ELSE 0 END, j - CASE WHEN n <> 1 THEN 1 ELSE 0 END, n FROM (SELECT *, st[i * (len(b) + 1) + j + 1] AS n FROM t WHERE i > 0 OR j > 0)),
pairs AS (SELECT {keys}, a, b, CASE WHEN s <> 2 THEN i + 1 END AS i, CASE WHEN s <> 1 THEN j + 1 END AS j FROM t WHERE s IS NOT NULL)"""


_MONOTONE = ("abs(a[i].x - b[j].x)", 0.16, 0.11)


@query(f"""WITH RECURSIVE {_SCALED}, q AS (SELECT user_id, day, list({{'id': event_id, 'x': scaled}} ORDER BY scaled, event_id) FILTER (event_type = 'view') AS a, list({{'id': event_id, 'x': scaled}} ORDER BY scaled, event_id) FILTER (event_type = 'click') AS b FROM s GROUP BY ALL),
g AS (SELECT * FROM q WHERE len(a) <> len(b)), {_path_sql("user_id, day", *_MONOTONE)}
SELECT user_id, day, a[i].id AS view_id, b[j].id AS click_id FROM pairs WHERE i IS NOT NULL AND j IS NOT NULL AND abs(a[i].x - b[j].x) <= 0.22::DOUBLE
UNION ALL SELECT user_id, day, unnest(list_transform(a, lambda y: y.id)), unnest(list_transform(b, lambda y: y.id)) FROM q WHERE len(a) = len(b)""")
def align_monotone(spark, d):
    """Views and clicks of a user and day aligned in order by their normalised positions."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        a, b = ([r for r in rows if r[0] == t] for t in ("view", "click"))
        return [(*key, a[i][1], b[j][1]) for i, j in folds.monotone_pairs([r[2] for r in a], [r[2] for r in b])]

    e = _scaled(spark, d).select(*ON, "event_type", "event_id", "scaled")
    return folds.fold_groups(e, ON, ["event_type", "scaled", "event_id"], fold, "user_id long, day string, view_id long, click_id long")


@query(f"""WITH RECURSIVE {_SCALED}, u AS (SELECT user_id, day, event_type, event_id, scaled, v % 40 AS print, count(*) OVER (PARTITION BY user_id, day, event_type, v % 40) AS same, row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY scaled, event_id) AS r FROM s),
a1 AS (SELECT * FROM u WHERE event_type = 'view'), b1 AS (SELECT * FROM u WHERE event_type = 'click'),
k AS (SELECT a1.user_id, a1.day, a1.r AS i, b1.r AS j, row_number() OVER (PARTITION BY a1.user_id, a1.day ORDER BY a1.r) AS n FROM a1 JOIN b1 ON a1.user_id = b1.user_id AND a1.day = b1.day AND a1.print = b1.print WHERE a1.same = 1 AND b1.same = 1),
h AS (SELECT user_id, day, i, j, n, j AS last, true AS pin FROM k WHERE n = 1
UNION ALL SELECT k.user_id, k.day, k.i, k.j, k.n, greatest(h.last, k.j), k.j > h.last FROM h JOIN k ON k.user_id = h.user_id AND k.day = h.day AND k.n = h.n + 1),
pin AS (SELECT * FROM h WHERE pin),
a2 AS (SELECT a1.user_id, a1.day, (SELECT count(*) FROM pin WHERE pin.user_id = a1.user_id AND pin.day = a1.day AND pin.i < a1.r) AS seg, list({{'id': event_id, 'x': scaled}} ORDER BY r) AS a FROM a1 WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.user_id = a1.user_id AND pin.day = a1.day AND pin.i = a1.r) GROUP BY ALL),
b2 AS (SELECT b1.user_id, b1.day, (SELECT count(*) FROM pin WHERE pin.user_id = b1.user_id AND pin.day = b1.day AND pin.j < b1.r) AS seg, list({{'id': event_id, 'x': scaled}} ORDER BY r) AS b FROM b1 WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.user_id = b1.user_id AND pin.day = b1.day AND pin.j = b1.r) GROUP BY ALL),
q AS (SELECT * FROM a2 JOIN b2 USING (user_id, day, seg)), g AS (SELECT * FROM q WHERE len(a) <> len(b)), {_path_sql("user_id, day, seg", *_MONOTONE)},
o AS (SELECT user_id, day, a[i].id AS view_id, b[j].id AS click_id FROM pairs WHERE i IS NOT NULL AND j IS NOT NULL AND abs(a[i].x - b[j].x) <= 0.22::DOUBLE
UNION ALL SELECT user_id, day, unnest(list_transform(a, lambda y: y.id)), unnest(list_transform(b, lambda y: y.id)) FROM q WHERE len(a) = len(b)
UNION ALL SELECT pin.user_id, pin.day, a1.event_id, b1.event_id FROM pin JOIN a1 ON a1.user_id = pin.user_id AND a1.day = pin.day AND a1.r = pin.i JOIN b1 ON b1.user_id = pin.user_id AND b1.day = pin.day AND b1.r = pin.j)
SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM pin WHERE pin.user_id = o.user_id AND pin.day = o.day) THEN 'anchors' ELSE 'monotone' END AS method FROM o""")
def align_anchored(spark, d):
    """Views and clicks of a user and day, pinned by rare values and aligned in order between."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        a, b = ([r for r in rows if r[0] == t] for t in ("view", "click"))
        pairs, method = folds.anchored_pairs([(r[3], r[2]) for r in a], [(r[3], r[2]) for r in b])
        return [(*key, a[i][1], b[j][1], method) for i, j in pairs]

    e = _scaled(spark, d).select(*ON, "event_type", "event_id", "scaled", (F.col("v") % 40).cast("string").alias("print"))
    return folds.fold_groups(e, ON, ["event_type", "scaled", "event_id"], fold, "user_id long, day string, view_id long, click_id long, method string")


# Events as a score has them: a rest or one to two notes ("string:fret", fret 11 printed as X), a rhythm, techniques.
_NOTE_SQL = "(v // {a} % 6 + 1) || ':' || CASE WHEN v // {b} % 12 = 11 THEN 'X' ELSE cast(v // {b} % 12 AS VARCHAR) END"
_SCORED = f"""{EVENTS}, n0 AS (SELECT *, CASE WHEN event_type = 'error' THEN 'rest' ELSE 'note' END AS state, cast(v % 3 AS VARCHAR) AS rhythm,
CASE WHEN event_type = 'error' THEN CAST([] AS VARCHAR[]) WHEN v % 2 = 0 THEN [{_NOTE_SQL.format(a=1, b=7)}] ELSE [{_NOTE_SQL.format(a=1, b=7)}, {_NOTE_SQL.format(a=3, b=11)}] END AS notes FROM events_x),
n1 AS (SELECT *, list_concat(CASE WHEN event_type IN ('signup', 'purchase') THEN [event_type] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(list_filter(notes, lambda z: z LIKE '%X')) > 0 THEN ['muted'] ELSE CAST([] AS VARCHAR[]) END) AS effects FROM n0)"""


def _scored(spark, d):
    """Events with state, rhythm, notes and effects."""
    v = F.col("v")
    fret = lambda b: F.when(F.floor(v / b) % 12 == 11, F.lit("X")).otherwise((F.floor(v / b) % 12).cast("string"))
    note = lambda a, b: F.concat((F.floor(v / a) % 6 + 1).cast("string"), F.lit(":"), fret(b))
    none = F.array().cast("array<string>")
    rest = F.col("event_type") == "error"
    e = events(spark, d).withColumn("notes", F.when(rest, none).when(v % 2 == 0, F.array(note(1, 7))).otherwise(F.array(note(1, 7), note(3, 11))))
    muted = F.exists("notes", lambda z: z.endswith("X"))
    effects = F.concat(F.when(F.col("event_type").isin("signup", "purchase"), F.array("event_type")).otherwise(none), F.when(muted, F.array(F.lit("muted"))).otherwise(none))
    return e.select(*ON, "event_id", "x", F.when(rest, "rest").otherwise("note").alias("state"), (v % 3).cast("string").alias("rhythm"), "notes", effects.alias("effects"))


def _common_sql(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda z: least(len(list_filter({a}, lambda y: y = z)), len(list_filter({b}, lambda y: y = z))))), 0)"


_UNION_SQL = f"(len(a[i].notes) + len(b[j].notes) - {_common_sql('a[i].notes', 'b[j].notes')})"
_COST_SQL = f"""(0.65::DOUBLE * (1.0::DOUBLE - CASE WHEN {_UNION_SQL} = 0 THEN 1.0::DOUBLE ELSE {_common_sql('a[i].notes', 'b[j].notes')} / cast({_UNION_SQL} AS DOUBLE) END)
+ 0.2::DOUBLE * CASE WHEN a[i].state <> b[j].state THEN 1 ELSE 0 END + 0.15::DOUBLE * CASE WHEN a[i].state = b[j].state AND a[i].rhythm = b[j].rhythm THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)"""
_EVENT_SQL = "{'id': event_id, 'state': state, 'rhythm': rhythm, 'notes': notes, 'effects': effects}"
_NO_EVENTS = "CAST([] AS STRUCT(id BIGINT, state VARCHAR, rhythm VARCHAR, notes VARCHAR[], effects VARCHAR[])[])"
_EDIT = f"""{_SCORED}, ea AS (SELECT user_id, day, list({_EVENT_SQL} ORDER BY x, event_id) AS a FROM n1 GROUP BY ALL), eb AS (SELECT user_id - 1 AS user_id, day, list({_EVENT_SQL} ORDER BY x, event_id) AS b FROM n1 GROUP BY ALL),
g AS (SELECT user_id, day, coalesce(a, {_NO_EVENTS}) AS a, coalesce(b, {_NO_EVENTS}) AS b FROM ea FULL JOIN eb USING (user_id, day)), {_path_sql("user_id, day", _COST_SQL, 1.0, 1.0)},
o AS (SELECT user_id, day, a[i].id AS expected_id, b[j].id AS found_id, i IS NOT NULL AND j IS NOT NULL AS matched, i IS NULL AS extra, j IS NULL AS missed, a[i].state = b[j].state AND a[i].rhythm = b[j].rhythm AS rhythm_exact, list_sort(a[i].notes) = list_sort(b[j].notes) AS notes_exact,
coalesce(a[i].notes, CAST([] AS VARCHAR[])) AS en, coalesce(b[j].notes, CAST([] AS VARCHAR[])) AS an, coalesce(a[i].effects, CAST([] AS VARCHAR[])) AS ee, coalesce(b[j].effects, CAST([] AS VARCHAR[])) AS ae FROM pairs)"""


def _aligned(spark, d):
    """Each user's days (expected) aligned with the next user's (found), one row for each pair or gap."""
    e = _scored(spark, d).withColumn("side", F.lit(0))
    e = e.unionByName(e.withColumn("user_id", F.col("user_id") - 1).withColumn("side", F.lit(1)))
    columns = ["side", "event_id", "state", "rhythm", "notes", "effects", "x"]

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        a, b = ([r for r in rows if r[0] == side] for side in (0, 1))
        empty, out = (None, None, None, None, [], []), []
        for i, j in folds.edit_pairs([r[2:5] for r in a], [r[2:5] for r in b]):
            p, q = (empty if i is None else a[i]), (empty if j is None else b[j])
            out.append((*key, p[1], q[1], None if i is None or j is None else p[2:4] == q[2:4], p[4], q[4], p[5], q[5]))
        return out

    schema = "user_id long, day string, expected_id long, found_id long, rhythm_exact boolean, en array<string>, an array<string>, ee array<string>, ae array<string>"
    o = folds.fold_groups(e.select(*ON, *columns), ON, ["side", "x", "event_id"], fold, schema)
    extra, missed = F.col("expected_id").isNull(), F.col("found_id").isNull()
    return o.select("*", extra.alias("extra"), missed.alias("missed"), (~extra & ~missed).alias("matched"), (F.sort_array("en") == F.sort_array("an")).alias("notes_exact"))


def _common(a, b):
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, z: F.size(F.filter(xs, lambda y: y == z))
    return F.aggregate(F.transform(F.array_distinct(a), lambda z: F.least(count(a, z), count(b, z))), F.lit(0), lambda acc, n: acc + n)


@query(f"WITH RECURSIVE {_EDIT} SELECT user_id, day, expected_id, found_id, CASE WHEN extra THEN 'extra' WHEN missed THEN 'missed' WHEN rhythm_exact AND notes_exact THEN 'exact' ELSE 'differs' END AS kind FROM o")
def align_edit(spark, d):
    """Events of each user's day aligned with the next user's by edit distance over notes, state and rhythm."""
    kind = F.when(F.col("extra"), "extra").when(F.col("missed"), "missed").when(F.col("rhythm_exact") & F.col("notes_exact"), "exact").otherwise("differs")
    return _aligned(spark, d).select("user_id", "day", "expected_id", "found_id", kind.alias("kind"))


_RATIO = "CASE WHEN {b} > 0 THEN round({a} / cast({b} AS DOUBLE), 9) ELSE 0.0::DOUBLE END"
_X = "list_filter({}, lambda y: y LIKE '%X')"


@query(f"""WITH RECURSIVE {_EDIT}, m AS (SELECT user_id, day, bool_and(matched AND rhythm_exact AND notes_exact) AS exact FROM o GROUP BY ALL),
s AS (SELECT count(*) FILTER (NOT extra) AS expected, count(*) FILTER (NOT missed) AS found, count(*) FILTER (matched) AS matched, count(*) FILTER (missed) AS missed, count(*) FILTER (extra) AS extra, count(*) FILTER (matched AND rhythm_exact) AS rhythm_exact, count(*) FILTER (matched AND notes_exact) AS notes_exact,
count(*) FILTER (matched AND notes_exact AND rhythm_exact) AS event_exact, cast(sum(len(en)) AS BIGINT) AS expected_notes, cast(sum(len(an)) AS BIGINT) AS found_notes, cast(sum({_common_sql('en', 'an')}) AS BIGINT) AS correct_notes,
cast(sum(len({_X.format('en')})) FILTER (matched) AS BIGINT) AS expected_muted, cast(sum(len({_X.format('an')})) FILTER (matched) AS BIGINT) AS found_muted, cast(sum({_common_sql(_X.format('en'), _X.format('an'))}) FILTER (matched) AS BIGINT) AS correct_muted FROM o)
SELECT *, (SELECT count(*) FROM m) AS measures, (SELECT count(*) FROM m WHERE exact) AS exact_measures, {_RATIO.format(a='correct_notes', b='found_notes')} AS note_precision, {_RATIO.format(a='correct_notes', b='expected_notes')} AS note_recall, {_RATIO.format(a='2 * correct_notes', b='(found_notes + expected_notes)')} AS note_f1,
{_RATIO.format(a='correct_muted', b='found_muted')} AS muted_precision, {_RATIO.format(a='correct_muted', b='expected_muted')} AS muted_recall FROM s""")
def event_evaluation(spark, d):
    """Scores of the edit alignment over all measures: events, rhythms, notes, muted notes, measures without a difference.
    Muted notes count on matched events only."""
    o = _aligned(spark, d)
    matched, rhythm, notes = F.col("matched"), F.col("rhythm_exact"), F.col("notes_exact")
    x = lambda c: F.filter(c, lambda y: y.endswith("X"))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("long")
    a = o.groupBy(*ON).agg(  # first by measure: whether it is exact; the sums add up
        F.bool_and(matched & F.coalesce(rhythm, F.lit(False)) & notes).alias("exact"), F.count_if(~F.col("extra")).alias("expected"), F.count_if(~F.col("missed")).alias("found"), F.count_if(matched).alias("matched"), F.count_if("missed").alias("missed"), F.count_if("extra").alias("extra"),
        F.count_if(matched & rhythm).alias("rhythm_exact"), F.count_if(matched & notes).alias("notes_exact"), F.count_if(matched & notes & rhythm).alias("event_exact"), total(F.size("en")).alias("expected_notes"), total(F.size("an")).alias("found_notes"), total(_common(F.col("en"), F.col("an"))).alias("correct_notes"),
        total(F.size(x("en")), matched).alias("expected_muted"), total(F.size(x("an")), matched).alias("found_muted"), total(_common(x("en"), x("an")), matched).alias("correct_muted"),
    )
    sums = [F.sum(c).alias(c) for c in a.columns if c not in {*ON, "exact"}]
    s = a.agg(*sums, F.count(F.lit(1)).alias("measures"), F.count_if("exact").alias("exact_measures"))
    ratio = lambda p, q: F.when(q > 0, F.round(p / q, 9)).otherwise(0.0)
    c, f, e = F.col("correct_notes"), F.col("found_notes"), F.col("expected_notes")
    return s.select("*", ratio(c, f).alias("note_precision"), ratio(c, e).alias("note_recall"), ratio(2 * c, f + e).alias("note_f1"), ratio(F.col("correct_muted"), F.col("found_muted")).alias("muted_precision"), ratio(F.col("correct_muted"), F.col("expected_muted")).alias("muted_recall"))


@query(f"""WITH RECURSIVE {_EDIT}, e AS (SELECT split_part(z, ':', 1) AS string, 'expected' AS kind FROM (SELECT unnest(en) AS z FROM o)), f AS (SELECT split_part(z, ':', 1) AS string FROM (SELECT unnest(an) AS z FROM o)),
k AS (SELECT string, sum(least(p, q)) AS correct FROM (SELECT split_part(z, ':', 1) AS string, len(list_filter(en, lambda y: y = z)) AS p, len(list_filter(an, lambda y: y = z)) AS q FROM (SELECT en, an, unnest(list_distinct(en)) AS z FROM o)) GROUP BY ALL),
s AS (SELECT string, count(*) AS expected FROM e GROUP BY ALL), r AS (SELECT string, count(*) AS found FROM f GROUP BY ALL)
SELECT string, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, cast(coalesce(correct, 0) AS BIGINT) AS correct, round(coalesce(correct, 0) / cast(greatest(1, coalesce(found, 0)) AS DOUBLE), 9) AS "precision", round(coalesce(correct, 0) / cast(greatest(1, coalesce(expected, 0)) AS DOUBLE), 9) AS recall FROM s FULL JOIN r USING (string) LEFT JOIN k USING (string)""")
def event_evaluation_strings(spark, d):
    """Notes expected, found and right, for each string."""
    o = _aligned(spark, d).select("en", "an", F.explode(F.array_union("en", "an")).alias("z"))
    n = lambda xs: F.size(F.filter(xs, lambda y: y == F.col("z")))
    g = o.select(F.split("z", ":")[0].alias("string"), n("en").alias("p"), n("an").alias("q")).groupBy("string")
    s = g.agg(F.sum("p").alias("expected"), F.sum("q").alias("found"), F.sum(F.least("p", "q")).alias("correct"))
    rate = lambda c: F.round(F.col("correct") / F.greatest(F.lit(1), F.col(c)), 9)
    return s.select("*", rate("found").alias("precision"), rate("expected").alias("recall"))


@query(f"""WITH RECURSIVE {_EDIT}, z AS (SELECT unnest(list_distinct(list_concat(ee, ae))) AS technique, ee, ae FROM o WHERE matched),
s AS (SELECT technique, count(*) FILTER (list_contains(ee, technique) AND list_contains(ae, technique)) AS tp, count(*) FILTER (NOT list_contains(ee, technique)) AS fp, count(*) FILTER (NOT list_contains(ae, technique)) AS fn, count(*) FILTER (list_contains(ee, technique)) AS support FROM z GROUP BY ALL)
SELECT *, round(tp / cast(greatest(1, tp + fp) AS DOUBLE), 9) AS "precision", round(tp / cast(greatest(1, tp + fn) AS DOUBLE), 9) AS recall, CASE WHEN tp > 0 THEN round(2 * tp / cast(2 * tp + fp + fn AS DOUBLE), 9) ELSE 0.0::DOUBLE END AS f1 FROM s""")
def event_evaluation_techniques(spark, d):
    """Techniques on matched events."""
    z = _aligned(spark, d).where("matched").select("ee", "ae", F.explode(F.array_union("ee", "ae")).alias("technique"))
    a, b = F.array_contains("ee", F.col("technique")), F.array_contains("ae", F.col("technique"))
    s = z.groupBy("technique").agg(F.count_if(a & b).alias("tp"), F.count_if(~a).alias("fp"), F.count_if(~b).alias("fn"), F.count_if(a).alias("support"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = F.when(tp > 0, F.round(2 * tp / (2 * tp + fp + fn), 9)).otherwise(0.0)
    return s.select("*", F.round(tp / F.greatest(F.lit(1), tp + fp), 9).alias("precision"), F.round(tp / F.greatest(F.lit(1), tp + fn), 9).alias("recall"), f1.alias("f1"))


_FILL = """o AS (SELECT l_orderkey, list(cast(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_quantity) AS qs, cast(sum(l_quantity) AS BIGINT) // 4 * 4 AS target FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, qs, target, 0 AS k, 0::BIGINT AS total, {'cost': 0.0::DOUBLE, 'picks': CAST([] AS INTEGER[])} AS best FROM o
UNION ALL SELECT l_orderkey, any_value(qs), any_value(target), k + 1, total + size AS total, min({'cost': best.cost + extra, 'picks': list_append(best.picks, pick)})
FROM (SELECT f.*, pick, CASE pick WHEN 0 THEN qs[k + 1] WHEN 1 THEN greatest(1, qs[k + 1] // 2) ELSE qs[k + 1] + 4 END AS size, CASE pick WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS extra FROM f, (VALUES (0), (1), (2)) AS t(pick) WHERE k < len(qs)) WHERE total + size <= target GROUP BY l_orderkey, k, total + size),
w AS (SELECT l_orderkey, best FROM f WHERE k = len(qs) AND total = target),
fill AS (SELECT o.l_orderkey, o.target, best.cost AS cost, array_to_string(best.picks, ',') AS picks FROM o LEFT JOIN w USING (l_orderkey))"""


@query(f"WITH RECURSIVE {_FILL} SELECT * FROM fill")
def min_cost_fill(spark, d):
    """The cheapest choice of one size for each line of an order so that the sizes fill the order's capacity."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        sizes = [r[2] for r in rows]
        target = sum(sizes) // 4 * 4
        found = folds.cheapest_fill([[(q, 0.0), (max(1, q // 2), 1.0), (q + 4, 1.5)] for q in sizes], target)
        return [(*key, target, *((None, None) if found is None else (found[0], ",".join(map(str, found[1])))))]

    return folds.fold_groups(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "q"], fold, "l_orderkey long, target long, cost double, picks string")


# A proposal changes the lines that do not keep their size. Option 2 removes a line; the others change its duration. Each
# change has a probability; an event has a match and a confidence.
_MODS = f"""{_FILL}, p AS (SELECT *, exp(-cost) AS relative FROM fill WHERE picks IS NOT NULL AND contains(replace(picks, ',', ''), '1') OR contains(picks, '2')),
li AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS pos, l_tax AS prob, l_returnflag = 'N' AS matched, l_discount * 10 AS confidence, l_partkey % 2 = 0 AS even FROM lineitem),
x AS (SELECT p.l_orderkey, p.relative, li.*, string_split(picks, ',')[pos] AS pick FROM p JOIN li ON li.l_orderkey = p.l_orderkey WHERE string_split(picks, ',')[pos] <> '0'),
m AS (SELECT l_orderkey, any_value(relative) AS relative, count(*) AS changes, count(*) FILTER (pick = '2') AS removals, coalesce(min(prob) FILTER (pick = '1'), 0) AS prob, coalesce(bool_and(NOT matched AND confidence < 0.4) FILTER (pick = '2'), false) AS spurious, bool_and(even) AS right_ FROM x GROUP BY l_orderkey)"""


def _modifications(spark, d):
    """A row for each proposal that changes something: its relative probability and what it changes."""
    p = min_cost_fill(spark, d).where(F.col("picks").rlike("[12]")).select("l_orderkey", F.exp(-F.col("cost")).alias("relative"), F.posexplode(F.split("picks", ",")).alias("pos", "pick"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    li = table(spark, d, "lineitem").select("l_orderkey", (F.row_number().over(w) - 1).alias("pos"), F.col("l_tax").alias("prob"), (F.col("l_returnflag") == "N").alias("matched"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_partkey") % 2 == 0).alias("even"))
    x = p.where("pick <> '0'").join(li, ["l_orderkey", "pos"])
    removed = F.col("pick") == "2"
    spurious = F.bool_and(F.when(removed, ~F.col("matched") & (F.col("confidence") < 0.4)))
    return x.groupBy("l_orderkey").agg(F.max("relative").alias("relative"), F.count(F.lit(1)).alias("changes"), F.count_if(removed).alias("removals"), F.coalesce(F.min(F.when(~removed, F.col("prob"))), F.lit(0)).alias("prob"), F.coalesce(spurious, F.lit(False)).alias("spurious"), F.bool_and("even").alias("right"))


@query(f"""WITH RECURSIVE {_MODS} SELECT l_orderkey, changes, removals, CASE WHEN relative >= 0.2 THEN 'plausible' WHEN l_orderkey % 2 = 0 AND changes = 2 AND removals = 1 AND spurious AND prob >= 0.05 THEN 'duplicate closure'
WHEN l_orderkey % 2 = 0 AND changes = 2 AND removals = 0 AND prob >= 0.02 AND relative >= 0.01 THEN 'two change closure' WHEN changes = 1 AND removals = 0 AND prob >= 0.005 THEN 'single closure' ELSE 'rejected' END AS decision FROM m""")
def accept_proposals(spark, d):
    """Proposals that are plausible (relative probability of .2 or more), or fall under one of three overrides, each with
    its floor: a single change (.005); in measures of vector pages, one removal of an unmatched, doubtful event with one
    change (.05), or two changes (.02 each, .01 together)."""
    m = _modifications(spark, d)
    vector, n, gone, p, r = F.col("l_orderkey") % 2 == 0, F.col("changes"), F.col("removals"), F.col("prob"), F.col("relative")
    how = F.when(r >= 0.2, "plausible").when(vector & (n == 2) & (gone == 1) & F.col("spurious") & (p >= 0.05), "duplicate closure")
    how = how.when(vector & (n == 2) & (gone == 0) & (p >= 0.02) & (r >= 0.01), "two change closure").when((n == 1) & (gone == 0) & (p >= 0.005), "single closure").otherwise("rejected")
    return m.select("l_orderkey", "changes", "removals", how.alias("decision"))


@query(f"""WITH RECURSIVE {_MODS} SELECT count(*) AS proposals, count(*) FILTER (right_) AS "right", count(*) FILTER (relative >= 0.2) AS plausible, count(*) FILTER (relative >= 0.2 AND right_) AS plausible_right FROM m""")
def proposal_precision(spark, d):
    """A proposal is right if each of its changes is: here, changes of lines with an even part."""
    ok = F.col("relative") >= 0.2
    return _modifications(spark, d).agg(F.count(F.lit(1)).alias("proposals"), F.count_if("right").alias("right"), F.count_if(ok).alias("plausible"), F.count_if(ok & F.col("right")).alias("plausible_right"))


#: Parts of a whole, 384 to it: value, dot and division of the longest first; of equal ones the plain first.
UNITS = tuple((ticks, *min((division != "1:1", dot != "none", value, dot, division) for value in (1, 2, 4, 8, 16, 32, 64) for dot, dots in (("none", 2), ("single", 3)) for division, times in (("1:1", 3), ("3:2", 2)) if 384 * dots * times == ticks * 6 * value)[2:])
              for ticks in sorted({384 * dots * times // (6 * value) for value in (1, 2, 4, 8, 16, 32, 64) for dots in (2, 3) for times in (2, 3)}, reverse=True))
#: Gaps that no units fill.
UNFILLED = tuple(r for r in range(1, 24) if not any(4 * a + 6 * b + 9 * c == r for a in range(6) for b in range(4) for c in range(3)))


def _decomposed() -> list[tuple[int, int, int]]:
    """(rest, position, unit) of every rest that is left after whole dotted wholes: the longest unit whose rest can still
    be filled, and so on."""
    out = []
    for start in range(UNITS[0][0] + max(UNFILLED) + 1):
        rest, pos = start, 0
        while rest and start not in UNFILLED:
            k = next(k for k, u in enumerate(UNITS) if u[0] <= rest and rest - u[0] not in UNFILLED)
            out.append((start, pos, k))
            rest, pos = rest - UNITS[k][0], pos + 1
    return out


_UNITS_SQL = "u AS (SELECT * FROM (VALUES " + ", ".join(f"({u[0]}, {u[1]}, '{u[2]}', '{u[3]}')" for u in UNITS) + ") AS t(ticks, value, dot, division))"
_BAD = ", ".join(map(str, UNFILLED))


@query(f"""WITH RECURSIVE {EVENTS}, g0 AS (SELECT user_id, day, event_id, x + 300 AS "from", lead(x) OVER (PARTITION BY user_id, day ORDER BY x, event_id) AS until FROM events_x),
g AS (SELECT event_id, coalesce(until, 86400) - "from" AS gap FROM g0 WHERE coalesce(until, 86400) > "from" AND coalesce(until, 86400) - "from" NOT IN ({_BAD})), {_UNITS_SQL},
f AS (SELECT event_id, gap AS rest, CAST(NULL AS INTEGER) AS ticks FROM g
UNION ALL SELECT event_id, rest - best, best FROM (SELECT event_id, rest, (SELECT max(u.ticks) FROM u WHERE u.ticks <= f.rest AND f.rest - u.ticks NOT IN ({_BAD})) AS best FROM f WHERE rest > 0))
SELECT event_id, u.value, u.dot, u.division, count(*) AS n FROM f JOIN u USING (ticks) GROUP BY ALL""")
def gap_fill(spark, d):
    """Each gap, in 384ths of a whole, as the rests that fill it exactly: always the longest one (plain, dotted, in
    triplets, from 1 to 1/64) whose rest can still be filled. Gaps that cannot be filled give none."""
    units = spark.createDataFrame([(k, *u) for k, u in enumerate(UNITS)], "unit int, ticks int, value int, dot string, division string")
    rests = spark.createDataFrame(_decomposed(), "rest long, pos int, unit int").groupBy("rest", "unit").agg(F.count(F.lit(1)).alias("n"))
    top = UNITS[0][0]
    g = gap_rows(spark, d).where(~F.col("gap").isin(*UNFILLED)).select("event_id", "gap", F.floor(F.col("gap") / top).alias("k"))
    less = ((F.col("k") > 0) & (F.col("gap") - F.col("k") * top).isin(*UNFILLED)).cast("long")
    g = g.withColumn("k", F.col("k") - less).withColumn("rest", F.col("gap") - F.col("k") * top)
    # Both tables are fixed: a row for each unit, and at most a few for each of 588 rests.
    parts = g.where("k > 0").select("event_id", F.lit(0).alias("unit"), F.col("k").alias("n")).unionByName(g.where("rest > 0").join(F.broadcast(rests), "rest").select("event_id", "unit", "n"))
    both = parts.groupBy("event_id", "unit").agg(F.sum("n").alias("n"))
    return both.join(F.broadcast(units), "unit").select("event_id", "value", "dot", "division", "n")


#: Durations (value, dot) of the capacities, in sixteenths, that one printed attack may fill.
CAPACITIES = ((16, 1, "none"), (12, 2, "single"), (8, 2, "none"), (6, 4, "single"), (4, 4, "none"), (3, 8, "single"), (2, 8, "none"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, day, count(*) AS n, min(event_id) AS event_id, min(v) AS v, min(event_type) AS kind FROM events_x GROUP BY ALL),
m AS (SELECT * FROM (VALUES {", ".join(f"({c}, {value}, '{dot}')" for c, value, dot in CAPACITIES)}) AS t(capacity, value, dot))
SELECT user_id, day, event_id, capacity, value, dot FROM g JOIN m ON v % 17 = capacity WHERE n = 1 AND kind <> 'error' AND v // 17 % 16 < capacity""")
def single_event_fill(spark, d):
    """A measure with one printed attack that is shorter than the measure: the attack gets the measure's capacity, if that
    is one of the seven that a duration has."""
    g = events(spark, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"), F.min("v").alias("v"), F.min("event_type").alias("kind"))
    one = g.where("n = 1 AND kind <> 'error'").select("user_id", "day", "event_id", (F.col("v") % 17).alias("capacity"), (F.floor(F.col("v") / 17) % 16).alias("current"))
    sizes = spark.createDataFrame(CAPACITIES, "capacity long, value int, dot string")  # fixed: seven rows
    return one.where("current < capacity").join(F.broadcast(sizes), "capacity").select("user_id", "day", "event_id", F.col("capacity").cast("int").alias("capacity"), "value", "dot")


def _two_sides(spark, d):
    """Line items as boxes: odd lines are truth, even lines are found; the flag is their class."""
    b = boxes(spark, d).withColumn("id", F.col("l_linenumber").cast("long") * 1_000_000 + (F.col("x") * 1000 + F.col("y")).cast("long"))
    return b.select("l_orderkey", F.col("l_linestatus").alias("kind"), "id", (F.col("l_linenumber") % 2 == 0).cast("int").alias("side"), F.col("l_quantity").cast("double").alias("score"), "x", "y", (F.col("w") * 2).cast("double").alias("w"), (F.col("h") * 2).alias("h"), F.col("l_returnflag").alias("label"), "row")


def _rounded(c):
    """To nine places by way of a whole number of the ninth, as DuckDB does it; round(c, 9) goes by c's decimals instead."""
    return F.round(F.col(c) * 1e9) / 1e9


_SIDES = f"""{BOXES}, b2 AS (SELECT l_orderkey, l_linestatus AS kind, cast(l_linenumber AS BIGINT) * 1000000 + cast(x * 1000 + y AS BIGINT) AS id, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS side, cast(l_quantity AS DOUBLE) AS score, x, y, cast(w * 2 AS DOUBLE) AS w, h * 2 AS h, l_returnflag AS label FROM boxes)"""
_BOX_SQL = "{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 'label': label}"


def _iou_sql(a: str, b: str) -> str:
    both = f"(greatest(0.0::DOUBLE, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0::DOUBLE, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({both} / ({a}.w * {a}.h + {b}.w * {b}.h - {both}))"


def _box_sql(rank: str, fits: str) -> str:
    return f"""WITH RECURSIVE {_SIDES}, g AS (SELECT l_orderkey, kind, list({_BOX_SQL} ORDER BY score DESC, id) FILTER (side = 1) AS ls, list({_BOX_SQL}) FILTER (side = 0) AS rs FROM b2 GROUP BY ALL),
f AS (SELECT l_orderkey, kind, ls, rs, 0 AS k, CAST(NULL AS BIGINT) AS truth_id, CAST(NULL AS DOUBLE) AS measure, false AS same FROM g WHERE len(ls) > 0 AND len(rs) > 0
UNION ALL SELECT l_orderkey, kind, ls, list_filter(rs, lambda q: best IS NULL OR q.id <> best.id), k + 1, best.id, abs(best.rank), best.label = ls[k + 1].label
FROM (SELECT *, list_sort(list_filter(list_transform(rs, lambda q: {{'rank': {rank}, 'id': q.id, 'label': q.label}}), lambda z: {fits}))[1] AS best FROM f WHERE k < len(ls)))
SELECT l_orderkey, kind, ls[k].id AS found_id, truth_id, round(measure, 9) AS measure, same FROM f WHERE truth_id IS NOT NULL"""


@query(_box_sql("-" + _iou_sql("ls[k + 1]", "q"), "-z.rank >= 0.3::DOUBLE"))
def box_match_iou(spark, d):
    """Found boxes by falling score take the truth of the same class that overlaps most, at 0.3 at least, and whether the
    strings of both agree. Of found boxes with equal score and id the one that lies first in the table comes first."""
    return folds.match_boxes(_two_sides(spark, d), ["l_orderkey", "kind"], 0.3, ties=("row",)).withColumn("measure", _rounded("measure"))


@query(_box_sql("sqrt(pow(ls[k + 1].x + ls[k + 1].w / 2 - q.x - q.w / 2, 2) + pow(ls[k + 1].y + ls[k + 1].h / 2 - q.y - q.h / 2, 2))", "z.rank <= 20"))
def box_match_center(spark, d):
    """The same by the distance of centres, 20 at most."""
    return folds.match_boxes(_two_sides(spark, d), ["l_orderkey", "kind"], None, 20.0, ties=("row",)).withColumn("measure", _rounded("measure"))


@query(f"""WITH RECURSIVE {_SIDES}, g AS (SELECT l_orderkey, kind, list({_BOX_SQL} ORDER BY score DESC, id) AS ls FROM b2 GROUP BY ALL),
f AS (SELECT l_orderkey, kind, ls, 0 AS k, list_filter(ls, lambda q: false) AS kept, false AS ok FROM g
UNION ALL SELECT l_orderkey, kind, ls, k + 1, CASE WHEN good THEN list_append(kept, ls[k + 1]) ELSE kept END, good FROM (SELECT *, len(list_filter(kept, lambda q: {_iou_sql("ls[k + 1]", "q")} >= 0.4::DOUBLE)) = 0 AS good FROM f WHERE k < len(ls)))
SELECT l_orderkey, kind, ls[k].id AS id FROM f WHERE ok""")
def nms_boxes(spark, d):
    """Boxes of an order and class that no better box overlaps by 0.4."""
    return folds.suppress_boxes(_two_sides(spark, d), ["l_orderkey", "kind"], 0.4)


_DIGITS = f"""{EVENTS}, n AS (SELECT *, v % 6 AS string, v % 10 AS digit, row_number() OVER w AS r, lead(x) OVER w AS nx, lead(v % 10) OVER w AS nd FROM events_x WINDOW w AS (PARTITION BY user_id, day, v % 6 ORDER BY x, event_id)),
c AS (SELECT *, coalesce(digit BETWEEN 1 AND 3 AND nx - x < 3000 AND 10 * digit + nd BETWEEN 10 AND 36, false) AS able FROM n)"""


@query(f"""WITH RECURSIVE {_DIGITS}, f AS (SELECT *, able AS joined, true AS head FROM c WHERE r = 1
UNION ALL SELECT c.*, c.able AND NOT f.joined, NOT f.joined FROM f JOIN c ON c.user_id = f.user_id AND c.day = f.day AND c.string = f.string AND c.r = f.r + 1)
SELECT user_id, day, string, CASE WHEN joined THEN (x + nx) / 2.0::DOUBLE ELSE cast(x AS DOUBLE) END AS x, CASE WHEN joined THEN 10 * digit + nd ELSE digit END AS fret FROM f WHERE head""")
def join_digits(spark, d):
    """Digits of a user, day and string joined to numbers."""
    g = events(spark, d).select(*ON, (F.col("v") % 6).alias("string"), F.col("x").cast("double").alias("x"), (F.col("v") % 10).alias("digit"), "event_id")
    fold = lambda key, rows: [(*key, float(x), v) for x, v in folds.join_digits([r[:2] for r in rows], 3000.0)]
    return folds.fold_groups(g, [*ON, "string"], ["x", "event_id"], fold, "user_id long, day string, string long, x double, fret long")


@query(f"""WITH RECURSIVE {EVENTS}, g AS (SELECT user_id, day, list({{'id': event_id, 'x': x}} ORDER BY x, event_id) FILTER (event_type <> 'error') AS es, list({{'id': event_id, 'x': x, 'n': 2 + v % 5, 'lo': CASE WHEN v % 3 = 0 THEN x - 1800 END, 'hi': CASE WHEN v % 3 = 0 THEN x + 3600 + v % 1800 END}} ORDER BY x, event_id) FILTER (event_type = 'error') AS ms FROM events_x GROUP BY ALL),
f AS (SELECT user_id, day, es, ms, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS got FROM g WHERE len(es) >= 2 AND len(ms) > 0
UNION ALL SELECT user_id, day, es, ms, k + 1, list_concat(used, chosen), chosen FROM (
SELECT *, CASE WHEN len(inside) >= 2 THEN inside WHEN best IS NULL THEN CAST([] AS BIGINT[]) ELSE range(best.i, best.i + best.n) END AS chosen FROM (
SELECT *, list_filter(range(1, len(es) + 1), lambda i: ms[k + 1].lo IS NOT NULL AND es[i].x >= ms[k + 1].lo - 432 AND es[i].x <= ms[k + 1].hi + 432 AND NOT list_contains(used, i)) AS inside,
list_sort(list_filter(flatten(list_transform(range(2, least(7, len(es)) + 1), lambda n: list_transform(range(1, len(es) - n + 2), lambda i: {{'cost': abs((es[i].x + es[i + n - 1].x) / 2.0::DOUBLE - ms[k + 1].x) / 3600.0::DOUBLE + 0.12::DOUBLE * abs(n - ms[k + 1].n), 'n': n, 'i': i}}))), lambda z: len(list_filter(used, lambda y: y BETWEEN z.i AND z.i + z.n - 1)) = 0))[1] AS best
FROM f WHERE k < len(ms))))
SELECT user_id, day, ms[k].id AS marker_id, cast(len(got) AS INTEGER) AS n, array_to_string(list_transform(got, lambda i: es[i].id), ',') AS event_ids FROM f WHERE k > 0 AND len(got) > 0""")
def assign_marker_window(spark, d):
    """Markers of a user and day to events: those in the marker's bracket, else the run whose middle lies nearest."""
    v, x = F.col("v"), F.col("x")
    bracket = F.when(v % 3 == 0, x - 1800)
    e = events(spark, d).select(*ON, "event_id", x.cast("double").alias("x"), (F.col("event_type") == "error").alias("marker"), (2 + v % 5).alias("n"), bracket.cast("double").alias("lo"), F.when(v % 3 == 0, x + 3600 + v % 1800).cast("double").alias("hi"))

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        es, ms = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        got = folds.windows_of_markers([r[1] for r in es], [(r[1], r[3], None if r[4] is None else (r[4], r[5])) for r in ms], 3600.0)
        return [(*key, ms[m][0], len(i), ",".join(str(es[k][0]) for k in i)) for m, i in got]

    return folds.fold_groups(e, ON, ["x", "event_id"], fold, "user_id long, day string, marker_id long, n int, event_ids string")


# A note's pitch is v // 6 % 40; an event attacks one string, two or none, may seem to miss one or two notes, has ink on
# some strings, and its ties may point at strings or at pitches.
_NOTE3 = "STRUCT(s BIGINT, e BIGINT, p BIGINT)[]"
_NOTE4 = "STRUCT(s BIGINT, e BIGINT, p BIGINT, n BIGINT)[]"
_HAS = "len(list_filter({}, lambda z: z.s = {})) > 0"


_CONTINUED = f"""WITH RECURSIVE {EVENTS}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, event_type = 'error' AS dead, CASE WHEN v % 4 = 0 THEN 1 + v // 10 % 2 ELSE 0 END AS missing,
CASE WHEN v % 3 = 0 THEN CAST([] AS STRUCT(s BIGINT, p BIGINT)[]) WHEN v % 3 = 1 THEN [{{'s': v % 6, 'p': v // 6 % 40}}] ELSE [{{'s': v % 6, 'p': v // 6 % 40}}, {{'s': (v + 2) % 6, 'p': (v // 6 + 7) % 40}}] END AS att,
CASE WHEN event_type = 'view' THEN list_filter([0, 1, 2, 3, 4, 5], lambda s: (v // 7 + s) % 4 = 0) ELSE CAST([] AS INTEGER[]) END AS ink, CASE WHEN event_type = 'purchase' THEN [v // 9 % 6, v // 11 % 6] ELSE CAST([] AS BIGINT[]) END AS strs,
CASE WHEN event_type <> 'signup' THEN CAST([] AS BIGINT[]) WHEN v // 10 % 2 = 0 THEN [v // 13 % 40] ELSE [v // 13 % 40, v // 17 % 40] END AS pits FROM events_x),
f AS (SELECT user_id, 0::BIGINT AS r, CAST([] AS {_NOTE4}) AS last, CAST([] AS {_NOTE4}) AS tied, CAST([] AS {_NOTE3}) AS before, CAST(NULL AS BIGINT) AS event_id, 'none' AS method, CAST([] AS {_NOTE3}) AS chosen, 0::BIGINT AS missing FROM (SELECT DISTINCT user_id FROM events_x)
UNION ALL SELECT user_id, r, list_concat(list_filter(last, lambda y: NOT ((NOT dead AND {_HAS.format('att', 'y.s')}) OR {_HAS.format('done', 'y.s')})), fresh, list_transform(done, lambda y: {{'s': y.s, 'e': event_id, 'p': y.p, 'n': r}})),
list_concat(list_filter(tied, lambda y: NOT ((NOT dead AND {_HAS.format('att', 'y.s')}) OR {_HAS.format('done', 'y.s')})), list_transform(done, lambda y: {{'s': y.s, 'e': event_id, 'p': y.p, 'n': r}})),
list_sort(list_concat(list_transform(att, lambda y: {{'s': y.s, 'e': event_id, 'p': y.p}}), list_transform(done, lambda y: {{'s': y.s, 'e': event_id, 'p': y.p}}))), event_id, CASE WHEN want = 0 THEN 'none' WHEN len(pick) <> want THEN 'unresolved' ELSE how END, done, want FROM (
SELECT *, CASE WHEN want > 0 AND len(pick) = want THEN pick ELSE CAST([] AS {_NOTE3}) END AS done, CASE WHEN dead THEN CAST([] AS {_NOTE4}) ELSE list_transform(att, lambda y: {{'s': y.s, 'e': event_id, 'p': y.p, 'n': r}}) END AS fresh FROM (
SELECT *, CASE WHEN len(ink2) > 0 THEN len(ink2) ELSE missing END AS want, CASE WHEN len(ink2) > 0 THEN ink2 WHEN len(part) = missing THEN part ELSE adjacent END AS pick, CASE WHEN len(ink2) > 0 THEN 'ink' WHEN len(part) = missing THEN way ELSE 'adjacent' END AS how FROM (
SELECT *, CASE WHEN len(by_s) > 0 THEN by_s WHEN len(by_p) > 0 THEN by_p WHEN len(held) = missing THEN held ELSE CAST([] AS {_NOTE3}) END AS part, CASE WHEN len(by_s) > 0 THEN 'string target' WHEN len(by_p) > 0 THEN 'pitch target' ELSE 'recent chain' END AS way FROM (
SELECT *, CASE WHEN missing > 0 AND len(att) = 0 THEN list_concat(ink1, CASE WHEN len(before) >= 2 THEN more ELSE list_slice(more, 1, greatest(0, missing - len(ink1))) END) ELSE ink1 END AS ink2,
CASE WHEN p1 IS NULL OR len(pits) <> missing OR abs(p1.p - pits[1]) > 1.5 OR (len(pits) = 2 AND (p2 IS NULL OR abs(p2.p - pits[2]) > 1.5)) THEN CAST([] AS {_NOTE3}) WHEN len(pits) = 2 THEN [{{'s': p1.s, 'e': p1.e, 'p': p1.p}}, {{'s': p2.s, 'e': p2.e, 'p': p2.p}}] ELSE [{{'s': p1.s, 'e': p1.e, 'p': p1.p}}] END AS by_p FROM (
SELECT *, list_filter(before, lambda y: list_contains(ink, y.s) AND NOT {_HAS.format('ink1', 'y.s')}) AS more, list_sort(list_transform(list_filter(free, lambda y: y.s <> p1.s), lambda y: {{'d': abs(y.p - pits[2]), 's': y.s, 'e': y.e, 'p': y.p}}))[1] AS p2 FROM (
SELECT *, list_filter(held, lambda y: list_contains(ink, y.s)) AS ink1, list_transform(list_sort(list_filter(last, lambda y: list_contains(strs, y.s) AND NOT {_HAS.format('att', 'y.s')})), lambda y: {{'s': y.s, 'e': y.e, 'p': y.p}}) AS by_s, list_sort(list_transform(free, lambda y: {{'d': abs(y.p - pits[1]), 's': y.s, 'e': y.e, 'p': y.p}}))[1] AS p1, list_filter(before, lambda y: NOT {_HAS.format('att', 'y.s')}) AS adjacent FROM (
SELECT f.last, f.tied, f.before, n.*, list_transform(list_sort(list_filter(f.tied, lambda y: n.r - y.n <= 2 AND NOT {_HAS.format('n.att', 'y.s')})), lambda y: {{'s': y.s, 'e': y.e, 'p': y.p}}) AS held, CASE WHEN len(n.pits) > 0 THEN list_filter(f.last, lambda y: n.r - y.n <= 8 AND NOT {_HAS.format('n.att', 'y.s')}) ELSE CAST([] AS {_NOTE4}) END AS free
FROM f JOIN n ON n.user_id = f.user_id AND n.r = f.r + 1))))))))
SELECT user_id, event_id, method, missing, array_to_string(list_transform(chosen, lambda y: y.s || '<' || y.e), ',') AS sources FROM f WHERE r > 0 AND missing > 0"""


@query(_CONTINUED)
def resolve_continuations(spark, d):
    """Notes of a user's events that sound on without an attack, where they come from, and by which rule."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        state, out = folds.Continuations(), []
        for event, _, dead, missing, attacks, ink, strings, pitches, _ in rows:
            method, chosen = state.step(event, [(a["s"], a["p"]) for a in attacks], dead, missing, dict.fromkeys(ink, 1.0), strings, pitches)
            if method != "none":
                out.append((*key, event, method, len(chosen) or missing, ",".join(f"{s}<{source}" for s, source, _ in chosen)))
        return out

    return folds.fold_groups(_sounding(spark, d), ["user_id"], ["ts", "event_id"], fold, "user_id long, event_id long, method string, missing long, sources string")


#: Open strings; a pitch of the events counts as a fret. Heights are in steps of half a spacing (5), from 110 above the top line.
TUNING = (64, 59, 55, 50, 45, 40)
_STEP = f"60 - ((({list(TUNING)}[{{0}}.s + 1] + {{0}}.p + 12) // 12 - 1) * 7 + {list(folds.StaffInk.DEGREES)}[({list(TUNING)}[{{0}}.s + 1] + {{0}}.p + 12) % 12 + 1])"
_INKED = f"({_STEP.format('y')} BETWEEN 0 AND 39 AND (v // 7 + {_STEP.format('y')}) % 4 = 0)"
_COVERED = f"(v // 3 % 3 <= len(att) AND v // 5 % 10 < 5 AND len(list_filter(att, lambda z: abs(({_STEP.format('y')}) - ({_STEP.format('z')})) <= 1)) > 0)"


def _with_staff() -> str:
    """The same rules with ink from the profile, hidden candidates left out, and suppressed events passed by."""
    sql = _CONTINUED.replace("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, v, v % 23 = 0 AS skip,", 1)
    sql = sql.replace("list_filter(held, lambda y: list_contains(ink, y.s)) AS ink1", f"list_filter(held, lambda y: {_INKED} AND NOT {_COVERED}) AS ink1")
    sql = sql.replace("list_filter(before, lambda y: list_contains(ink, y.s) AND NOT", f"list_filter(before, lambda y: {_INKED} AND NOT")
    # A suppressed event has nothing missing and leaves what is remembered as it is.
    sql = sql.replace("UNION ALL SELECT user_id, r, list_concat(list_filter(last,", "UNION ALL SELECT user_id, r, CASE WHEN skip THEN last ELSE list_concat(list_filter(last,", 1)
    sql = sql.replace("'n': r}})),\nlist_concat(list_filter(tied,".replace("}}", "}"), "'n': r})) END,\nCASE WHEN skip THEN tied ELSE list_concat(list_filter(tied,", 1)
    sql = sql.replace("'n': r})),\nlist_sort(list_concat(", "'n': r})) END,\nlist_sort(list_concat(", 1)
    sql = sql.replace("event_id, CASE WHEN want = 0 THEN", "event_id, CASE WHEN skip OR want = 0 THEN", 1).replace(" END, done, want FROM (", " END, done, CASE WHEN skip THEN 0 ELSE want END FROM (", 1)
    return sql.replace("CASE WHEN want > 0 AND len(pick) = want THEN pick", "CASE WHEN NOT skip AND want > 0 AND len(pick) = want THEN pick", 1)


@query(_with_staff())
def resolve_continuations_on_staff(spark, d):
    """The same with ink looked up at the height where a note would be written, without candidates that an attacked head
    covers, and past events that were suppressed."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        state, out = folds.Continuations(), []
        for event, _, dead, missing, attacks, _, strings, pitches, v in rows:
            notes = [(a["s"], a["p"]) for a in attacks]
            if v % 23 == 0:
                state.skip(event, notes)
                continue
            profile = [float((v // 7 + k) % 4 == 0) for k in range(40)]
            ink = folds.StaffInk(list(TUNING), 0.0, 10.0, profile, -110.0, 5.0, v // 3 % 3, v // 5 % 10 / 10)
            method, chosen = state.step(event, notes, dead, missing, ink, strings, pitches)
            if method != "none":
                out.append((*key, event, method, len(chosen) or missing, ",".join(f"{s}<{source}" for s, source, _ in chosen)))
        return out

    return folds.fold_groups(_sounding(spark, d), ["user_id"], ["ts", "event_id"], fold, "user_id long, event_id long, method string, missing long, sources string")


def _sounding(spark, d):
    v = F.col("v")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    note = lambda s, p: F.struct(s.alias("s"), p.alias("p"))
    one, two = note(v % 6, F.floor(v / 6) % 40), note((v + 2) % 6, (F.floor(v / 6) + 7) % 40)
    div = lambda k: F.floor(v / k)
    ink = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda s: (div(7) + s) % 4 == 0)
    kind = F.col("event_type")
    e = events(spark, d).select(
        "user_id", "event_id", "ts", (kind == "error").alias("dead"), F.when(v % 4 == 0, 1 + div(10) % 2).otherwise(0).alias("missing"),
        F.when(v % 3 == 0, none("struct<s:long,p:long>")).when(v % 3 == 1, F.array(one)).otherwise(F.array(one, two)).alias("attacks"), F.when(kind == "view", ink).otherwise(none("int")).alias("ink"),
        F.when(kind == "purchase", F.array(div(9) % 6, div(11) % 6)).otherwise(none("long")).alias("strings"), F.when(kind != "signup", none("long")).when(div(10) % 2 == 0, F.array(div(13) % 40)).otherwise(F.array(div(13) % 40, div(17) % 40)).alias("pitches"), "v",
    )
    return e


_MEASURES = """m0 AS (SELECT user_id, day, event_id, x, event_type, v, CASE WHEN event_type = 'view' THEN x // 7200 ELSE (x + 120) // 7200 END AS measure, v % 70 AS y, least(greatest((v % 70) // 10, 0), 5) AS string, CASE WHEN v // 70 % 11 = 10 THEN 'x' ELSE cast(v // 70 % 11 AS VARCHAR) END AS sign FROM events_x),
gl AS (SELECT * FROM m0 WHERE event_type <> 'view' AND abs(y - (string * 10 + 5)) <= 4.2 AND measure BETWEEN 0 AND 11 AND x <= measure * 7200 + 6720),
is0 AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id, day, measure, string ORDER BY x, sign) > 600 THEN 1 ELSE 0 END AS new FROM gl),
is1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day, measure, string ORDER BY x, sign ROWS UNBOUNDED PRECEDING) AS run FROM is0),
tk0 AS (SELECT user_id, day, measure, string, run, string_agg(sign, '' ORDER BY x, sign) AS raw, (min(x) + max(x)) / 2.0::DOUBLE AS x FROM is1 GROUP BY ALL),
tk AS (SELECT user_id, day, measure, string, x, CASE WHEN raw = 'x' THEN 'x' ELSE cast(try_cast(raw AS BIGINT) AS VARCHAR) END AS token FROM tk0 WHERE raw = 'x' OR (NOT contains(raw, 'x') AND try_cast(raw AS BIGINT) <= 36)),
tr AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, measure ORDER BY x, string, token) AS r FROM tk)"""


@query(f"""WITH RECURSIVE {EVENTS}, {_MEASURES}, f AS (SELECT tr.*, [x] AS members, 0 AS cluster FROM tr WHERE r = 1
UNION ALL SELECT user_id, day, measure, string, x, token, r, CASE WHEN near THEN list_append(members, x) ELSE [x] END, cluster + CASE WHEN near THEN 0 ELSE 1 END
FROM (SELECT tr.*, f.members, f.cluster, abs(tr.x - list_aggregate(f.members, 'median')) <= 900 AS near FROM f JOIN tr ON tr.user_id = f.user_id AND tr.day = f.day AND tr.measure = f.measure AND tr.r = f.r + 1)),
cl AS (SELECT user_id, day, measure, cluster, median(x) AS middle FROM f GROUP BY ALL), ev AS (SELECT user_id, day, measure, list({{'x': x, 'id': event_id}}) AS es FROM m0 WHERE event_type = 'view' GROUP BY ALL),
h AS (SELECT user_id, day, measure, -1 AS cluster, coalesce(any_value(es), CAST([] AS STRUCT(x BIGINT, id BIGINT)[])) AS es, CAST(NULL AS BIGINT) AS event, CAST(NULL AS DOUBLE) AS at FROM (SELECT DISTINCT user_id, day, measure FROM cl) LEFT JOIN ev USING (user_id, day, measure) GROUP BY user_id, day, measure
UNION ALL SELECT user_id, day, measure, cluster, CASE WHEN best.d <= 1200 THEN list_filter(es, lambda y: y.id <> best.id) ELSE es END, CASE WHEN best.d <= 1200 THEN best.id END, CASE WHEN best.d <= 1200 THEN cast(best.x AS DOUBLE) ELSE middle END
FROM (SELECT cl.*, h.es, list_sort(list_transform(h.es, lambda y: {{'d': abs(y.x - cl.middle), 'x': y.x, 'id': y.id}}))[1] AS best FROM h JOIN cl ON cl.user_id = h.user_id AND cl.day = h.day AND cl.measure = h.measure AND cl.cluster = h.cluster + 1))
SELECT f.user_id, f.day, f.measure, h.event, h.at AS x, cast(f.string AS INTEGER) AS string, f.token, CASE WHEN row_number() OVER (PARTITION BY f.user_id, f.day, f.measure, f.cluster, f.string ORDER BY f.x, f.token) > 1 THEN 'duplicate' WHEN h.event IS NULL THEN 'created' ELSE 'associated' END AS outcome
FROM f JOIN h ON h.user_id = f.user_id AND h.day = f.day AND h.measure = f.measure AND h.cluster = f.cluster""")
def glyph_pipeline(spark, d):
    """Glyphs to notes: the nearest string within its radius, the measure that contains them, tokens, clusters, events."""
    v, x = F.col("v"), F.col("x")
    string = F.least(F.floor((v % 70) / 10), F.lit(5)).cast("int")
    sign = F.when(F.floor(v / 70) % 11 == 10, "x").otherwise((F.floor(v / 70) % 11).cast("string"))
    e = events(spark, d).select(*ON, F.when(F.col("event_type") == "view", F.floor(x / 7200)).otherwise(F.floor((x + 120) / 7200)).alias("measure"), x.cast("double").alias("x"), "event_id", (F.col("event_type") == "view").alias("event"), string.alias("string"), sign.alias("sign"), (v % 70).alias("y"))
    placed = (F.abs(F.col("y") - (F.col("string") * 10 + 5)) <= 4.2) & F.col("measure").between(0, 11) & (x <= F.col("measure") * 7200 + 6720)
    pipeline = folds.Glyphs(600.0, 900.0, 1200.0)

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        found = pipeline.notes([(r[0], r[3], r[4]) for r in rows if not r[2]], [(r[0], r[1]) for r in rows if r[2]])
        return [(*key, *n) for n in found]

    return folds.fold_groups(e.where(F.col("event") | placed).drop("y"), [*ON, "measure"], ["x", "event_id"], fold, "user_id long, day string, measure long, event long, x double, string int, token string, outcome string")


# Meters: v % 4 is the truth; where v % 7 = 0 it is seen, where v % 11 = 0 something else is; the rest of a bar is v % 4
# or, every third time, one more.
_METERS = f"""{EVENTS}, p AS (SELECT user_id, ts, event_id, v % 4 AS truth, CASE WHEN v % 7 = 0 THEN v % 4 WHEN v % 11 = 0 THEN (v + 1) % 4 END AS seen, (v + CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END) % 4 AS total FROM events_x),
c AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried, coalesce(truth IS DISTINCT FROM lag(truth) OVER w, true) AS prints, coalesce(total = lag(total) OVER w OR total = lead(total) OVER w, false) AS near FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN total = carried THEN carried WHEN near THEN total ELSE carried END AS refined FROM c)"""


def _meters(spark, d):
    v, by, order = F.col("v"), ["user_id"], ["ts", "event_id"]
    p = events(spark, d).select("user_id", "ts", "event_id", (v % 4).alias("truth"), F.when(v % 7 == 0, v % 4).when(v % 11 == 0, (v + 1) % 4).alias("seen"), ((v + (v % 3 == 0).cast("int")) % 4).alias("total"))
    w, t = timeline.ordered(by, order), F.col("total")
    near = F.coalesce((t == F.lag("total").over(w)) | (t == F.lead("total").over(w)), F.lit(False))
    c = timeline.carry_forward(p, by, order, "seen").withColumn("prints", timeline.value_changes("truth", by, order)).withColumn("near", near)
    return c.withColumn("refined", F.when(t == F.col("carried"), F.col("carried")).when(F.col("near"), t).otherwise(F.col("carried")))


@query(f"""WITH {_METERS} SELECT count(*) AS n, count(*) FILTER (prints) AS expected, count(*) FILTER (seen IS NOT NULL AND prints) AS detected, count(*) FILTER (seen = truth AND prints) AS value_right, count(*) FILTER (seen IS NOT NULL AND NOT prints) AS extra,
count(*) FILTER (carried = truth) AS carried_right, count(*) FILTER (refined = truth) AS refined_right, round(count(*) FILTER (seen IS NOT NULL AND prints) / cast(greatest(1, count(seen)) AS DOUBLE), 9) AS "precision", round(count(*) FILTER (seen IS NOT NULL AND prints) / cast(greatest(1, count(*) FILTER (prints)) AS DOUBLE), 9) AS recall FROM r""")
def meter_scoring(spark, d):
    """Presence where a meter is printed (only where it changes), value where it is seen, and both propagated values."""
    seen, prints, right = F.col("seen").isNotNull(), F.col("prints"), lambda c: F.col(c) == F.col("truth")
    s = _meters(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(prints).alias("expected"), F.count_if(seen & prints).alias("detected"), F.count_if(right("seen") & prints).alias("value_right"), F.count_if(seen & ~prints).alias("extra"), F.count_if(right("carried")).alias("carried_right"), F.count_if(right("refined")).alias("refined_right"))
    rate = lambda n: F.round(F.col("detected") / F.greatest(F.lit(1), n), 9)
    return s.select("*", rate(F.col("detected") + F.col("extra")).alias("precision"), rate(F.col("expected")).alias("recall"))


@query(f"""WITH {_METERS} SELECT event_id, 'wrong_value' AS type, truth, seen AS prediction FROM r WHERE seen IS NOT NULL AND prints AND seen <> truth UNION ALL SELECT event_id, 'false_presence', truth, NULL FROM r WHERE seen IS NOT NULL AND NOT prints UNION ALL SELECT event_id, 'missed_print', truth, NULL FROM r WHERE seen IS NULL AND prints
UNION ALL SELECT event_id, 'propagation', truth, carried FROM r WHERE carried IS DISTINCT FROM truth UNION ALL SELECT event_id, 'rhythm_refined', truth, refined FROM r WHERE refined IS DISTINCT FROM truth""")
def meter_errors(spark, d):
    """A row for each error of meter_scoring, with its type, the truth and what was predicted."""
    seen, prints, truth = F.col("seen"), F.col("prints"), F.col("truth")
    there, none = seen.isNotNull(), F.lit(None).cast("long")
    error = lambda when, kind, value: F.when(when, F.struct(F.lit(kind).alias("type"), value.cast("long").alias("prediction")))
    every = F.array_compact(F.array(
        error(there & prints & (seen != truth), "wrong_value", seen), error(there & ~prints, "false_presence", none), error(~there & prints, "missed_print", none),
        error(~F.col("carried").eqNullSafe(truth), "propagation", F.col("carried")), error(~F.col("refined").eqNullSafe(truth), "rhythm_refined", F.col("refined")),
    ))
    return _meters(spark, d).select("event_id", "truth", F.explode(every).alias("e")).select("event_id", "e.type", "truth", "e.prediction")
