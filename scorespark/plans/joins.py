"""Joins: lookups, alignments by key and position, intervals, sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import association as A
from scorespark.operators.references import resolve_bars
from scorespark.plans.base import BOXES, EVENTS, Registry, boxes, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT o_orderkey, c_mktsegment AS segment, c_custkey IS NULL AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 10 <> 0""")
def split_lookup(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "segment", F.col("c_custkey").isNull().alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, cast(coalesce(p_size, l_quantity) AS BIGINT) AS value, CASE WHEN p_partkey IS NULL THEN 'own' ELSE 'semantic' END AS origin
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_linenumber % 2 = p_size % 2""")
def semantic_fallback(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") % 2).alias("parity"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_linenumber") % 2).alias("odd"))
    j = li.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("odd") == F.col("parity")), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.col("p_size").cast("double"), "l_quantity").cast("long").alias("value"), F.when(F.col("p_partkey").isNull(), "own").otherwise("semantic").alias("origin"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_type, day, event_id, v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id, day, event_type) AS n FROM events_x
WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id, day, event_type ORDER BY ts, event_id))
SELECT a.user_id, a.day, a.rn AS pos, a.event_id AS view_id, b.event_id AS click_id FROM r a JOIN r b ON a.user_id = b.user_id AND a.day = b.day AND a.rn = b.rn
WHERE a.event_type = 'view' AND b.event_type = 'click' AND a.n = b.n""")
def ordinal_zip(spark, d):
    e = events(spark, d).where(F.col("event_type").isin("view", "click"))
    w = W.partitionBy("user_id", "day", "event_type")
    e = e.select("user_id", "day", "event_type", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("pos"), F.count(F.lit(1)).over(w).alias("n"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", "day", "pos", "n", F.col("event_id").alias(name))
    return side("view", "view_id").join(side("click", "click_id"), ["user_id", "day", "pos", "n"]).drop("n")


@query(f"""WITH {BOXES}, i AS (SELECT a.l_orderkey AS k, a.l_linenumber AS i, b.l_linenumber AS j, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h + b.w * b.h AS area
FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT k AS l_orderkey, i, j, round(inter / (area - inter), 9) AS iou FROM i WHERE inter > 0""")
def pairwise_iou(spark, d):
    cols = ["l_orderkey", "l_linenumber", "x", "y", "w", "h"]
    a = boxes(spark, d).select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = boxes(spark, d).select(*[F.col(c).alias(f"b_{c}") for c in cols])
    j = a.join(b, (F.col("a_l_orderkey") == F.col("b_l_orderkey")) & (F.col("a_l_linenumber") < F.col("b_l_linenumber")))
    iou = S.box_iou(*[F.col(f"{s}_{c}") for s in "ab" for c in "xywh"])
    return j.select(F.col("a_l_orderkey").alias("l_orderkey"), F.col("a_l_linenumber").alias("i"), F.col("b_l_linenumber").alias("j"), F.round(iou, 9).alias("iou")).where("iou > 0")


_DAYS = "date_diff('day', DATE '1990-01-01', cast({} AS DATE))"
_SPAN = f"""o AS (SELECT o_orderkey, o_custkey, {_DAYS.format('o_orderdate')} AS d0 FROM orders), l AS (SELECT l_orderkey, l_linenumber, {_DAYS.format('l_shipdate')} AS s0 FROM lineitem)"""


def _spans(spark, d):
    days = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", days("o_orderdate").alias("d0"))
    return o, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", days("l_shipdate").alias("s0"))


@query(f"""WITH {_SPAN}, p AS (SELECT o_orderkey, l_linenumber, greatest(0, least(d0 + 90, s0 + 30) - greatest(d0, s0)) * 1.0 / (greatest(d0 + 90, s0 + 30) - least(d0, s0)) AS iou FROM o JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, l_linenumber, round(cast(iou AS DOUBLE), 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY round(cast(iou AS DOUBLE), 9) DESC, l_linenumber) AS r FROM p) WHERE r = 1 AND iou >= 0.1""")
def interval_iou_best(spark, d):
    o, li = _spans(spark, d)
    iou = F.round(S.interval_iou(F.col("d0"), F.col("d0") + 90, F.col("s0"), F.col("s0") + 30), 9)
    p = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", iou.alias("iou"))
    best = p.groupBy("o_orderkey").agg(F.max(F.struct("iou", (-F.col("l_linenumber")).alias("back"))).alias("b"))
    return best.select("o_orderkey", (-F.col("b.back")).alias("l_linenumber"), "b.iou").where("iou >= 0.1")


_SHIFTS = ((0, 30_000, 0), (25_000, 60_000, 1), (60_000, 86_400, 2))


@query(f"""WITH {EVENTS}, m AS (SELECT * FROM (VALUES {", ".join(map(str, _SHIFTS))}) AS t(lo, hi, ordinal))
SELECT event_id, cast(min(ordinal) AS INTEGER) AS span FROM events_x JOIN m ON x BETWEEN lo - 60 AND hi + 60 GROUP BY event_id""")
def point_in_interval(spark, d):
    # Three spans of a day, a constant of the query: the first that contains x is a row-local choice.
    hit = F.lit(None).cast("int")
    for lo, hi, ordinal in reversed(_SHIFTS):
        hit = F.when(F.col("x").between(lo - 60, hi + 60), F.lit(ordinal)).otherwise(hit)
    return events(spark, d).select("event_id", hit.alias("span")).where("span IS NOT NULL")


_LEVELS = (0.0, 5.0, 12.5, 25.0, 50.0, 90.0)


@query(f"""WITH {EVENTS} SELECT event_id, cast(arg_min(i, (abs(value - level), i)) AS INTEGER) AS level FROM events_x, (VALUES {", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(_LEVELS))}) AS t(i, level)
WHERE abs(value - level) <= 20 GROUP BY event_id""")
def nearest_level(spark, d):
    levels = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(i).alias("i")) for i, v in enumerate(_LEVELS)])
    near = F.array_min(F.transform(levels, lambda x: F.struct(F.abs(F.col("value") - x["v"]).alias("gap"), x["i"].alias("i"))))
    return events(spark, d).select("event_id", near.alias("n")).where("n.gap <= 20").select("event_id", F.col("n.i").alias("level"))


@query(f"""WITH {EVENTS}, m AS (SELECT * FROM events_x WHERE event_type = 'error'), a AS (SELECT * FROM events_x WHERE event_type = 'purchase'),
b AS (SELECT m.event_id AS marker_id, m.user_id, m.x, m.day, arg_max(a.event_id, (a.x, a.event_id)) FILTER (a.x <= m.x) AS before, arg_min(a.event_id, (abs(a.x - m.x), a.event_id)) AS near
FROM m LEFT JOIN a ON m.user_id = a.user_id AND m.day = a.day GROUP BY ALL)
SELECT marker_id, coalesce(before, near) AS attack_id FROM b""")
def asof_or_nearest(spark, d):
    e = events(spark, d).select("event_id", "event_type", "user_id", "day", "x")
    return A.asof_or_nearest(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id", "day"], "x", "event_id").select(F.col("event_id").alias("marker_id"), F.col("match_id").alias("attack_id"))


@query(f"""WITH {EVENTS}, s AS (SELECT event_id AS span_id, day, event_type, x AS lo, x + cast(v % 4000 AS BIGINT) AS hi FROM events_x WHERE event_type = 'purchase')
SELECT e.event_id, max(hi - lo) AS widest FROM events_x e JOIN s ON e.day = s.day AND e.x BETWEEN s.lo - 4 AND s.hi + 4 WHERE e.event_type = 'click' GROUP BY e.event_id HAVING count(*) = 2 AND max(hi - lo) >= 1200""")
def stab_exactly_two(spark, d):
    e = events(spark, d)
    spans = e.where("event_type = 'purchase'").select("day", F.col("x").alias("lo"), (F.col("x") + F.col("v") % 4000).alias("hi"))
    points = e.where("event_type = 'click'").select("event_id", "day", "x")
    hit = A.range_join(points, spans, ["day"], "x", "lo", "hi", 4)
    g = hit.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("hi") - F.col("lo")).alias("widest"))
    return g.where("n = 2 AND widest >= 1200").select("event_id", "widest")


@query(f"""WITH {_SPAN} SELECT o_orderkey, l_linenumber, least(d0 + 90, s0 + 30) - greatest(d0, s0) AS days FROM o JOIN l ON o_orderkey = l_orderkey WHERE s0 <= d0 + 90 AND s0 + 30 >= d0""")
def interval_overlap(spark, d):
    o, li = _spans(spark, d)
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).where("s0 <= d0 + 90 AND s0 + 30 >= d0")
    return j.select("o_orderkey", "l_linenumber", (F.least(F.col("d0") + 90, F.col("s0") + 30) - F.greatest("d0", "s0")).alias("days"))


@query("""WITH r AS (SELECT o_orderkey, unnest([o_orderkey, -1, o_orderkey + 1]) AS ref, unnest([0, 1, 2]) AS pos FROM orders)
SELECT r.o_orderkey, cast(pos AS INTEGER) AS pos, l_orderkey, l_linenumber FROM r JOIN lineitem ON ref = l_orderkey WHERE ref <> -1""")
def resolve_refs(spark, d):
    # References as the documents hold them: ids separated by blanks, -1 for none.
    refs = F.concat_ws(" ", "o_orderkey", F.lit(-1), F.col("o_orderkey") + 1)
    r = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.split(refs, " ")).alias("pos", "ref")).withColumn("ref", F.col("ref").cast("long")).where("ref <> -1")
    return r.join(table(spark, d, "lineitem"), F.col("ref") == F.col("l_orderkey")).select("o_orderkey", "pos", "l_orderkey", "l_linenumber")


#: Documents of bars (customers), voices (orders), beats (lines), notes (parts) and rhythms (suppliers): lists of ids with -1
#: and ids that point nowhere, and the chain followed.
_CHAIN = """WITH voice_rows AS (SELECT o_custkey AS bar, o_orderkey AS voice FROM orders), beat_rows AS (SELECT l_orderkey AS voice, l_orderkey * 10 + l_linenumber AS beat, min(l_suppkey) AS rhythm FROM lineitem GROUP BY ALL),
bar_refs AS (SELECT c_custkey AS bar, unnest(v) AS ref, generate_subscripts(v, 1) - 1 AS voice_number FROM (SELECT c_custkey, list_concat(CASE WHEN c_custkey % 11 = 0 THEN [-7] ELSE [] END, list(o_orderkey ORDER BY o_orderkey)) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)),
in_bar AS (SELECT bar, voice_number, voice FROM bar_refs JOIN voice_rows USING (bar) WHERE ref = voice),
in_voice AS (SELECT voice, beat, rhythm, row_number() OVER (PARTITION BY voice ORDER BY beat) - 1 AS position FROM beat_rows),
note_refs AS (SELECT l_orderkey * 10 + l_linenumber AS beat, CASE WHEN l_partkey % 13 = 0 THEN -9 ELSE l_partkey END AS ref, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS n FROM lineitem WHERE l_partkey % 5 <> 0),
chord AS (SELECT beat, string_agg(p_size, ',' ORDER BY n) AS notes FROM note_refs JOIN part ON ref = p_partkey GROUP BY beat),
timed AS (SELECT beat, cast(s_nationkey AS BIGINT) AS ticks FROM beat_rows JOIN supplier ON s_suppkey = rhythm WHERE rhythm % 17 <> 0)
"""


def _documents(spark, d):
    def refs(by, value, order, *first):
        return F.array_join(F.concat(*first, F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"].cast("string"))), " ")

    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("beat", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    odd = F.when(F.col("o_custkey") % 11 == 0, F.array(F.lit("-1"), F.lit("-7"))).otherwise(F.array(F.lit("-1")))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    bars = o.join(known, "o_custkey", "left_semi").groupBy("o_custkey").agg(refs("o_custkey", F.col("o_orderkey"), ["o_orderkey"], odd).alias("voice_refs")).withColumnRenamed("o_custkey", "bar")
    lists = li.select("l_orderkey", "beat").distinct().groupBy("l_orderkey").agg(refs("l_orderkey", F.col("beat"), ["beat"]).alias("beat_refs"))
    voices = o.select(F.col("o_orderkey").alias("voice")).join(lists.withColumnRenamed("l_orderkey", "voice"), "voice", "left")
    note = F.when(F.col("l_partkey") % 5 == 0, -1).when(F.col("l_partkey") % 13 == 0, -9).otherwise(F.col("l_partkey"))
    rhythm = F.when(F.min("l_suppkey") % 17 == 0, F.lit("none")).otherwise(F.min("l_suppkey").cast("string"))
    beats = li.groupBy("beat").agg(refs("beat", note, ["l_partkey"]).alias("note_refs"), rhythm.alias("rhythm_ref"))
    notes = table(spark, d, "part").select(F.col("p_partkey").alias("note"), F.col("p_size").cast("string").alias("said"))
    rhythms = table(spark, d, "supplier").select(F.col("s_suppkey").alias("rhythm"), F.col("s_nationkey").cast("long").alias("ticks"))
    return resolve_bars(bars, voices, beats, notes, rhythms)


@query(_CHAIN + """SELECT bar, cast(voice_number AS INTEGER) AS voice_number, cast(position AS INTEGER) AS position, beat, CASE WHEN notes IS NULL THEN 'rest' ELSE 'note' END AS state, coalesce(notes, '') AS notes, ticks,
cast(coalesce(sum(ticks) OVER (PARTITION BY bar, voice_number ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS onset
FROM in_bar JOIN in_voice USING (voice) LEFT JOIN chord USING (beat) LEFT JOIN timed USING (beat)""")
def resolve_chain(spark, d):
    """Events of documents that hold bars, voices, beats, notes and rhythms as tables with lists of ids."""
    return _documents(spark, d)[0]


@query(_CHAIN + """SELECT 'voice' AS hop, cast(bar AS VARCHAR) AS owner, '-7' AS ref FROM bar_refs WHERE ref = -7 UNION ALL SELECT 'note', cast(beat AS VARCHAR), '-9' FROM note_refs WHERE ref = -9
UNION ALL SELECT 'note', cast(beat AS VARCHAR), cast(ref AS VARCHAR) FROM note_refs WHERE ref > 0 AND ref NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'rhythm', cast(beat AS VARCHAR), CASE WHEN rhythm % 17 = 0 THEN 'none' ELSE cast(rhythm AS VARCHAR) END FROM beat_rows WHERE rhythm % 17 = 0 OR rhythm NOT IN (SELECT s_suppkey FROM supplier)""")
def dangling_refs(spark, d):
    """References of these documents that point nowhere."""
    return _documents(spark, d)[1]


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')""")
def exclude_heldout(spark, d):
    held = table(spark, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(held, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def only_known(spark, d):
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"""WITH {EVENTS}, v AS (SELECT day, user_id, count(*) AS views FROM events_x WHERE event_type = 'view' GROUP BY ALL), c AS (SELECT day, user_id, count(*) AS clicks FROM events_x WHERE event_type = 'click' GROUP BY ALL)
SELECT coalesce(v.day, c.day) AS day, coalesce(v.user_id, c.user_id) AS user_id, coalesce(views, 0) AS views, coalesce(clicks, 0) AS clicks FROM v FULL JOIN c ON v.day = c.day AND v.user_id = c.user_id""")
def full_outer_index(spark, d):
    e = events(spark, d)
    side = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("day", "user_id").agg(F.count(F.lit(1)).alias(name))
    return side("view", "views").join(side("click", "clicks"), ["day", "user_id"], "full_outer").na.fill(0, ["views", "clicks"])


@query("""WITH f AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id)
SELECT a.conv_id, b.conv_id AS next_id, a.roles = b.roles AS equal FROM f a JOIN f b ON b.conv_id = a.conv_id + 1""")
def fingerprint_equal(spark, d):
    f = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"]), ",").alias("roles"))
    g = f.select((F.col("conv_id") - 1).alias("conv_id"), F.col("conv_id").alias("next_id"), F.col("roles").alias("other"))
    return f.join(g, "conv_id").select("conv_id", "next_id", (F.col("roles") == F.col("other")).alias("equal"))


@query("""SELECT n_nationkey, status FROM nation, (VALUES ('F'), ('O'), ('P')) AS t(status)""")
def work_grid(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("status"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events_x),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY old) AS new FROM o WHERE event_type <> 'error')
SELECT a.user_id, a.new AS from_pos, b.new AS to_pos FROM o x JOIN k a ON a.user_id = x.user_id AND a.old = x.old JOIN k b ON b.user_id = x.user_id AND b.old = x.old + 1""")
def remap_edges(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    o = events(spark, d).select("user_id", "event_type", F.row_number().over(w).cast("long").alias("old"))
    kept = o.where("event_type <> 'error'").select("user_id", "old", F.row_number().over(W.partitionBy("user_id").orderBy("old")).cast("long").alias("new"))
    edges = o.select("user_id", "old", (F.col("old") + 1).alias("next"))
    first = kept.select("user_id", "old", F.col("new").alias("from_pos"))
    second = kept.select("user_id", F.col("old").alias("next"), F.col("new").alias("to_pos"))
    return edges.join(first, ["user_id", "old"]).join(second, ["user_id", "next"]).select("user_id", "from_pos", "to_pos")


@query("""WITH m AS (SELECT l_orderkey, l_linestatus, sum(cast(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, cast(a.q AS BIGINT) AS quantity_f, cast(b.q AS BIGINT) AS quantity_o, cast(a.q - b.q AS BIGINT) AS gap FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'""")
def paired_gap(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum(F.col("l_quantity").cast("long")))
    return p.where("F IS NOT NULL AND O IS NOT NULL").select("l_orderkey", F.col("F").alias("quantity_f"), F.col("O").alias("quantity_o"), (F.col("F") - F.col("O")).alias("gap"))


@query("""SELECT l_orderkey, list_sort(list(DISTINCT CASE WHEN p_type = 'SMALL' THEN 'X' ELSE cast(p_size AS VARCHAR) END)).array_to_string(',') AS notes FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY l_orderkey""")
def expected_notes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_type") == "SMALL", "X").otherwise(F.col("p_size").cast("string")).alias("note"))
    j = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey").join(p, "l_partkey")
    return j.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("note")), ",").alias("notes"))
