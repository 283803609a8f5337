"""Score documents as a user has them: exported plans, expected notes, chronological comparison, split proposals."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.operators import passes as P
from scorespark.operators import scores as O
from scorespark.plans.base import EVENTS, Registry, events, table
from scorespark.sources import manifests as M
from scorespark.storage import scratch_dir

query = Registry()
QUERIES, SQL = query.queries, query.sql


_PLAN = """WITH m AS (SELECT o_custkey % 12 AS document, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderkey) - 1 AS measure, 2 + o_orderkey % 3 AS num FROM orders),
e AS (SELECT document, measure, l_linenumber % 2 AS voice, row_number() OVER (PARTITION BY document, measure, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN m ON l_orderkey = o_orderkey),
f AS (SELECT *, [cast(position AS VARCHAR), '8', cast(1 << (l_partkey % 4) AS VARCHAR), cast(l_partkey % 2 AS VARCHAR), '1/1', CASE l_returnflag WHEN 'R' THEN 'rest' ELSE 'note' END, CASE l_returnflag WHEN 'R' THEN '' ELSE (l_partkey % 6 + 1) || ':' || l_suppkey % 25 END] AS fields, l_suppkey % 3 AS pick FROM e),
head AS (SELECT DISTINCT document, unnest(['META' || chr(9) || 'TITLE_B64' || chr(9) || base64(encode('document ' || document)), 'META' || chr(9) || 'TEMPO' || chr(9) || 60 + document * 5, 'META' || chr(9) || 'TUNING' || chr(9) || '64,59,55,50,45,40']) AS line, unnest([0, 1, 2]) AS pos FROM m),
bars AS (SELECT document, measure, concat_ws(chr(9), 'MEASURE', measure, measure + 1, num, '4') AS line FROM m),
"""


def _plan_tables(spark, d):
    """Documents of orders as measures and line items as events in two voices."""
    key = W.partitionBy("document").orderBy("o_orderkey")
    o = table(spark, d, "orders").select((F.col("o_custkey") % 12).alias("document"), "o_orderkey", (2 + F.col("o_orderkey") % 3).alias("numerator"))
    m = o.withColumn("measure", F.row_number().over(key) - 1)
    place = W.partitionBy("document", "measure", "voice").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, d, "lineitem").join(m, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("voice", F.col("l_linenumber") % 2)
    rest = F.col("l_returnflag") == "R"
    e = e.select(
        "document", "measure", "voice", (F.row_number().over(place) - 1).alias("position"), (F.row_number().over(place) - 1).alias("onset_n"), F.lit(8).alias("onset_d"), F.expr("shiftleft(1, cast(l_partkey % 4 AS int))").alias("value"),
        (F.col("l_partkey") % 2).alias("dot"), F.lit("1/1").alias("division"), F.when(rest, "rest").otherwise("note").alias("state"),
        F.when(rest, "").otherwise(F.concat((F.col("l_partkey") % 6 + 1).cast("string"), F.lit(":"), (F.col("l_suppkey") % 25).cast("string"))).alias("notes"), (F.col("l_suppkey") % 3).alias("pick"),
    )
    meta = o.select("document").distinct().select("document", F.concat(F.lit("document "), F.col("document").cast("string")).alias("title"), (60 + F.col("document") * 5).alias("tempo"), F.array(*map(F.lit, (64, 59, 55, 50, 45, 40))).alias("tuning"))
    return meta, m.select("document", "measure", (F.col("measure") + 1).alias("number"), "numerator", F.lit(4).alias("denominator")), e


def _written(spark, lines):
    """lines through the sink, a few hundred to a file, and back by file and place in it."""
    path = f"{scratch_dir(spark)}/plans-{uuid.uuid4().hex}"
    M.write_plans(lines, path, "document", O.LINE_ORDER, 300)
    return M.read_plans(spark, path, "document", "long")


@query(_PLAN + """lines AS (SELECT document, 0 AS s, 0 AS a, 0 AS b, 'PLAN' || chr(9) || '2' AS line FROM (SELECT DISTINCT document FROM m) UNION ALL SELECT document, 1, pos, 0, line FROM head UNION ALL SELECT document, 2, measure, -1, line FROM bars
UNION ALL SELECT document, 2, measure, position, concat_ws(chr(9), 'EVENT', measure, position, array_to_string(fields, chr(9)), pick) FROM f WHERE voice = 0)
SELECT document, row_number() OVER (PARTITION BY document ORDER BY s, a, b) - 1 AS number, line FROM lines""")
def plan_files(spark, d):
    """One voice's plan of each document as text files: each measure followed by its events."""
    meta, measures, e = _plan_tables(spark, d)
    return _written(spark, O.plan_lines(meta, measures, e.where("voice = 0")))


@query(_PLAN + """lines AS (SELECT document, 0 AS s, 0 AS a, 0 AS b, 0 AS c, 'PLAN' || chr(9) || '3' AS line FROM (SELECT DISTINCT document FROM m) UNION ALL SELECT document, 1, pos, 0, 0, line FROM head UNION ALL SELECT document, 2, measure, 0, 0, line FROM bars
UNION ALL SELECT document, 3, voice, measure, position, concat_ws(chr(9), 'EVENT', measure, position, voice, array_to_string(fields, chr(9)), CASE WHEN voice = first THEN pick ELSE 0 END) FROM (SELECT *, min(voice) OVER (PARTITION BY document) AS first FROM f))
SELECT document, row_number() OVER (PARTITION BY document ORDER BY s, a, b, c) - 1 AS number, line FROM lines""")
def plan_files_all_voices(spark, d):
    """Plans of all voices: measures first, then voice by voice; only the first voice has strokes."""
    meta, measures, e = _plan_tables(spark, d)
    return _written(spark, O.plan_lines(meta, measures, e, all_voices=True))


_NOTE = "l_orderkey AS measure, l_linenumber * 960 AS precise_start, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS voice, cast(l_partkey % 6 AS INTEGER) + 1 AS string, cast(l_suppkey % 25 AS INTEGER) AS fret"


@query(f"""WITH g AS (SELECT {_NOTE}, l_returnflag = 'R' AS tied FROM lineitem), s AS (SELECT {_NOTE}, arg_max(l_quantity > 40, (l_partkey, l_suppkey)) AS dead FROM lineitem WHERE l_partkey % 19 <> 0 AND l_orderkey % 23 <> 0 GROUP BY ALL),
j AS (SELECT g.*, s.dead FROM g LEFT JOIN s USING (measure, precise_start, voice, string, fret) WHERE NOT tied)
SELECT measure, precise_start, coalesce(array_to_string(list_sort(list(DISTINCT string || ':' || CASE WHEN dead THEN 'X' ELSE cast(fret AS VARCHAR) END) FILTER (dead IS NOT NULL)), ','), '') AS notes, count(DISTINCT (voice, string, fret)) FILTER (dead IS NULL) AS missing FROM j GROUP BY ALL""")
def expected_visible_notes(spark, d):
    """Notes that each event should show: those of the geometry that are not tied, by string and fret of the semantic beat of
    the same precise start; dead ones show an X."""
    li = table(spark, d, "lineitem")
    geometry = li.selectExpr(*(_NOTE + ", l_returnflag = 'R' AS tied").split(", "))
    semantic = li.where("l_partkey % 19 <> 0 AND l_orderkey % 23 <> 0").selectExpr(*(_NOTE + ", l_quantity > 40 AS dead").split(", "), "l_partkey", "l_suppkey")
    return O.expected_notes(geometry, semantic, ["measure", "precise_start"], ["l_partkey", "l_suppkey"])


_CLOSE = f"""{EVENTS}, c AS (SELECT *, event_type = 'purchase' AS matched, CASE WHEN event_id % 5 = 0 THEN [] ELSE list_transform(range(1 + event_id % 3), lambda i: (event_id + i * v) % 6) END AS strings,
event_id % 7 < 5 AS ties_only, (v % 100) / 100.0::DOUBLE AS tie FROM events_x), w AS (SELECT *, row_number() OVER o - 1 AS position, lead(x) OVER o - x AS gap, lead(matched) OVER o AS next_matched, lead(strings) OVER o AS next_strings FROM c WINDOW o AS (PARTITION BY user_id, day ORDER BY x, event_id)),
k AS (SELECT *, NOT matched AND (len(strings) = 0 OR ties_only) AND coalesce(next_matched AND gap > 0 AND gap <= 0.9 * 7000, false) AND (len(strings) = 0 OR list_has_any(strings, next_strings) OR tie < 0.5) AS gone FROM w)"""


@query(f"""WITH {_CLOSE} SELECT event_id, position, row_number() OVER (PARTITION BY user_id, day ORDER BY position) - 1 AS new_position FROM k WHERE NOT gone""")
def prune_split_proposals(spark, d):
    """Events less those that a matched attack right after them makes a duplicate of, with their place before and after."""
    n = F.col("event_id")
    strings = F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), n % 3), lambda i: (n + i * F.col("v")) % 6))
    e = events(spark, d).select("user_id", "day", "x", "event_id", (F.col("event_type") == "purchase").alias("matched"), strings.alias("strings"), (n % 7 < 5).alias("ties_only"), ((F.col("v") % 100) / 100).alias("tie"))
    kept, _ = O.prune_split_proposals(e, ["user_id", "day"], ["x", "event_id"], "x", F.lit(7000.0))
    return kept.select("event_id", "position", "new_position")


@query("""WITH x AS (SELECT l_orderkey AS measure, l_suppkey * 10 AS precise_start, l_partkey AS start, l_linenumber AS voice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber) - 1 AS index FROM lineitem),
a AS (SELECT measure, index, precise_start + CASE WHEN (precise_start + start) % 41 = 0 THEN 1 ELSE 0 END AS precise_start, start, CASE WHEN start % 29 = 0 THEN NULL ELSE voice END AS voice FROM x WHERE NOT (index > 0 AND measure % 31 = 0 AND index = (SELECT max(index) FROM x AS y WHERE y.measure = x.measure))),
n AS (SELECT coalesce(e.measure, b.measure) AS measure, e.n AS e, b.n AS b FROM (SELECT measure, count(*) AS n FROM x GROUP BY ALL) e FULL JOIN (SELECT measure, count(*) AS n FROM a GROUP BY ALL) b USING (measure) WHERE e.n IS DISTINCT FROM b.n)
SELECT measure, CAST(NULL AS BIGINT) AS index, 'count' AS field, cast(coalesce(e, 0) AS VARCHAR) AS expected, cast(coalesce(b, 0) AS VARCHAR) AS found FROM n UNION ALL
SELECT x.measure, x.index, 'precise_start', cast(x.precise_start AS VARCHAR), cast(a.precise_start AS VARCHAR) FROM x JOIN a USING (measure, index) WHERE x.precise_start IS DISTINCT FROM a.precise_start UNION ALL
SELECT x.measure, x.index, 'voice', cast(x.voice AS VARCHAR), cast(a.voice AS VARCHAR) FROM x JOIN a USING (measure, index) WHERE x.voice IS DISTINCT FROM a.voice""")
def dq_chronological_diff(spark, d):
    """Measures against the semantic document, whose beats are kept in the order they were made: sorted by precise start and
    start first, then compared field by field."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("measure"), (F.col("l_suppkey") * 10).alias("precise_start"), F.col("l_partkey").alias("start"), F.col("l_linenumber").alias("voice"))
    w = W.partitionBy("measure").orderBy("precise_start", "start", "voice")
    index = F.row_number().over(w) - 1
    gone = (F.col("index") > 0) & (F.col("measure") % 31 == 0) & (F.col("index") == F.max("index").over(W.partitionBy("measure")))
    a = x.withColumn("index", index.cast("long")).withColumn("_gone", gone).where("NOT _gone").drop("_gone")
    late = F.when((F.col("precise_start") + F.col("start")) % 41 == 0, 1).otherwise(0)
    a = a.withColumn("precise_start", F.col("precise_start") + late).withColumn("voice", F.when(F.col("start") % 29 != 0, F.col("voice")))
    return O.chronological_diff(x, a, ["measure"], ["precise_start", "start", "voice"], "index", ["precise_start", "start", "voice"])


SUPPORTED, FILLED = [6, 8, 9, 12, 16, 18, 24], [3, 4, 6, 8, 12, 16]
_EVENT = """l_orderkey % 40 AS doc, l_orderkey AS measure, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, CASE WHEN l_partkey % 11 <> 0 THEN 1 + l_partkey % 6 END AS ticks,
l_suppkey % 6 AS string, CASE WHEN l_returnflag <> 'R' THEN l_partkey % 40 END AS fret, l_returnflag = 'A' AS matched, cast(l_discount * 10 AS DOUBLE) AS confidence, cast(0.9 - l_tax * 5 AS DOUBLE) AS p_now, cast(0.02 + l_tax * 2 AS DOUBLE) AS p_more,
CASE WHEN l_returnflag = 'R' THEN l_linenumber % 2 ELSE 0 END AS tie_count, cast(l_discount * 10 AS DOUBLE) AS tie"""
_BAR = "o_orderkey % 40 AS doc, o_orderkey AS measure, CASE WHEN o_orderkey % 13 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 16 WHEN 2 THEN 18 ELSE 8 END END AS capacity, o_orderkey % 3 = 0 AS printed, o_orderkey % 2 = 0 AS vector, o_orderkey % 5 < 3 AS authoritative, cast(11.0 AS DOUBLE) AS spacing"


def _score_document(spark, d):
    # Numbered by document and measure, the key that all passes deal by: the SQL's l_orderkey is the measure.
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    place = (F.row_number().over(W.partitionBy(*P.MEASURE).orderBy(*order)) - 1).cast("int")
    e = table(spark, d, "lineitem").selectExpr(*(c for c in _columns(_EVENT) if not c.endswith("AS position")), *order).withColumn("position", place)
    notes = F.when(F.col("fret").isNull(), F.array().cast("array<struct<string: bigint, fret: bigint>>")).otherwise(F.array(F.struct("string", "fret")))
    more = F.when(F.col("ticks").isNotNull(), F.array(F.struct((F.col("ticks") + 1).alias("ticks"), F.col("p_more").alias("p")), F.struct((F.col("ticks") * 2).alias("ticks"), F.lit(0.3).alias("p")))).otherwise(F.array())
    e = e.select("doc", "measure", "position", "ticks", notes.alias("notes"), "matched", "confidence", "p_now", more.cast("array<struct<ticks: bigint, p: double>>").alias("alternatives"), "tie_count", "tie", (F.col("position") * 10.0).alias("x"), F.lit(False).alias("suppressed"), F.lit(False).alias("ties_only"))
    return e, table(spark, d, "orders").selectExpr(*_columns(_BAR))


def _columns(text: str) -> list[str]:
    """The columns of a select list: cut at the commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


_COST = "cast(round(-ln(greatest({0}, 1e-12::DOUBLE)) * 1000000) AS BIGINT)"


def _correct_sql(e: str, n: int) -> str:
    """Audit, proposals, acceptance, application and pruning of the events in table e, as corrected{n}."""
    return f"""w{n} AS (SELECT m1.doc, m1.measure, capacity, vector FROM m1 JOIN (SELECT measure, sum(ticks) AS total FROM {e} GROUP BY ALL) USING (measure) WHERE total > 0 AND capacity <> total),
k{n} AS (SELECT {e}.*, w{n}.capacity, w{n}.vector, row_number() OVER (PARTITION BY measure ORDER BY position) AS k FROM {e} JOIN w{n} USING (doc, measure) WHERE ticks IS NOT NULL),
q{n} AS (SELECT measure, k, ticks AS size, p_now AS p FROM k{n} UNION SELECT measure, k, size, max(p) FROM (SELECT measure, k, ticks, t0 + 1 AS size, p_more AS p FROM k{n} UNION ALL SELECT measure, k, ticks, t0 * 2, 0.3::DOUBLE FROM k{n}) WHERE size <> ticks GROUP BY measure, k, size
UNION SELECT measure, k, 0, greatest(0.01::DOUBLE, 1 - confidence) FROM k{n} WHERE NOT matched AND (confidence < 0.6::DOUBLE OR vector AND confidence < 0.75::DOUBLE)),
o{n} AS (SELECT *, {_COST.format("p")} AS cost, cast(row_number() OVER (PARTITION BY measure, k ORDER BY size) - 1 AS INTEGER) AS pick FROM q{n}),
z{n} AS (SELECT measure, any_value(capacity) AS capacity, count(*) AS n, sum({_COST.format("p_now")}) AS now FROM k{n} GROUP BY measure),
f{n} AS (SELECT measure, capacity, 0::BIGINT AS k, 0::BIGINT AS total, {{'cost': 0::BIGINT, 'picks': CAST([] AS INTEGER[])}} AS best FROM z{n}
UNION ALL SELECT measure, any_value(capacity), k + 1, total + size, min({{'cost': best.cost + cost, 'picks': list_append(best.picks, pick)}}) FROM (SELECT f.measure, f.capacity, f.k, f.total, f.best, o.size, o.cost, o.pick FROM f{n} f JOIN o{n} o ON o.measure = f.measure AND o.k = f.k + 1 WHERE f.total + o.size <= 2 * f.capacity) GROUP BY measure, k, total + size),
c{n} AS (SELECT k.measure, k.position, nullif(o.size, 0) AS new, o.p, exp(greatest(-60, least(60, (z.now - f.best.cost) / 1000000.0::DOUBLE))) AS relative, k.vector, NOT k.matched AND k.confidence < 0.4::DOUBLE AS doubtful
FROM f{n} f JOIN z{n} z ON f.measure = z.measure AND f.k = z.n AND f.total = z.capacity JOIN k{n} k ON k.measure = f.measure JOIN o{n} o ON o.measure = k.measure AND o.k = k.k AND o.pick = f.best.picks[k.k] WHERE o.size <> k.ticks),
h{n} AS (SELECT *, count(*) OVER v AS n, count(*) FILTER (new IS NULL) OVER v AS gone, min(p) FILTER (new IS NOT NULL) OVER v AS least, coalesce(bool_and(doubtful) FILTER (new IS NULL) OVER v, false) AS all_doubtful FROM c{n} WINDOW v AS (PARTITION BY measure)),
y{n} AS (SELECT *, CASE WHEN relative >= 0.2::DOUBLE THEN 'plausible' WHEN vector AND n = 2 AND gone = 1 AND all_doubtful AND least >= 0.05::DOUBLE THEN 'duplicate closure' WHEN vector AND n = 2 AND gone = 0 AND least >= 0.02::DOUBLE AND relative >= 0.01::DOUBLE THEN 'two change closure' WHEN n = 1 AND gone = 0 AND least >= 0.005::DOUBLE THEN 'single closure' END AS selection FROM h{n}),
a{n} AS (SELECT e.* REPLACE (CASE WHEN y.measure IS NOT NULL THEN y.new ELSE e.ticks END AS ticks, CASE WHEN y.measure IS NOT NULL AND y.new IS NULL THEN NULL ELSE e.fret END AS fret, CASE WHEN y.measure IS NOT NULL AND y.new IS NULL THEN 0 ELSE e.tie_count END AS tie_count)
FROM {e} e LEFT JOIN y{n} y ON e.measure = y.measure AND e.position = y.position AND y.selection IS NOT NULL),
corrected{n} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY measure ORDER BY position) - 1 AS position) FROM a{n} WHERE ticks IS NOT NULL OR fret IS NOT NULL)"""


def _fill_sql(e: str, out: str) -> str:
    return f"""{out} AS (SELECT e.* REPLACE (CASE WHEN authoritative AND capacity IN ({", ".join(map(str, FILLED))}) AND ticks < capacity AND n = 1 THEN capacity ELSE ticks END AS ticks) FROM (SELECT * FROM {e}) e LEFT JOIN (SELECT measure, count(*) AS n FROM {e} GROUP BY ALL) USING (measure) LEFT JOIN (SELECT measure, capacity, authoritative FROM m1) USING (measure))"""


_PASSES = f"""WITH RECURSIVE m0 AS (SELECT {_BAR} FROM orders), e0 AS (SELECT *, ticks AS t0, position * 10.0::DOUBLE AS x, false AS ties_only FROM (SELECT {_EVENT} FROM lineitem)),
s0 AS (SELECT m0.*, coalesce(total, 0) AS total FROM m0 LEFT JOIN (SELECT measure, sum(ticks) AS total FROM e0 GROUP BY ALL) USING (measure)),
m1 AS (SELECT doc, measure, cast(CASE WHEN total IN ({", ".join(map(str, SUPPORTED))}) AND (printed OR coalesce(lag(total) OVER w = total, false) OR coalesce(lead(total) OVER w = total, false)) THEN total ELSE capacity END AS BIGINT) AS capacity, vector, authoritative, spacing FROM s0 WINDOW w AS (PARTITION BY doc ORDER BY measure)),
e1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY measure ORDER BY position) - 1 AS position) FROM e0 WHERE ticks IS NOT NULL OR fret IS NOT NULL),
{_correct_sql("e1", 1)}, {_fill_sql("corrected1", "e2")},
d0 AS (SELECT * FROM e2 WHERE fret IS NOT NULL), d1 AS (SELECT *, list_concat(coalesce(list(fret) OVER (v ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), coalesce(list(fret) OVER (v ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), [])) AS near, count(*) OVER (PARTITION BY doc, string, fret) AS own FROM d0 WINDOW v AS (PARTITION BY doc, string ORDER BY measure, position)),
d2 AS (SELECT doc, string, fret, count(*) AS n FROM d0 GROUP BY ALL), d3 AS (SELECT d1.measure, d1.position, CASE WHEN d1.fret BETWEEN 20 AND 39 AND (coalesce(d2.n, 0) >= greatest(6, 3 * own) OR (len(list_filter(near, lambda x: x <= 19 AND abs(x - d1.fret // 10) <= 2)) >= 2 AND len(list_filter(near, lambda x: abs(x - d1.fret) <= 4)) = 0)) THEN d1.fret // 10 ELSE d1.fret END AS fixed
FROM d1 LEFT JOIN d2 ON d2.doc = d1.doc AND d2.string = d1.string AND d2.fret = d1.fret // 10), e3 AS (SELECT e2.* REPLACE (CASE WHEN e2.fret IS NULL THEN NULL ELSE fixed END AS fret) FROM e2 LEFT JOIN d3 USING (measure, position)),
e4 AS (SELECT *, lag(fret) OVER v AS before_fret, lag(string) OVER v AS before_string FROM e3 WINDOW v AS (PARTITION BY doc ORDER BY measure, position)), e5 AS (SELECT * EXCLUDE (before_fret, before_string) REPLACE (CASE WHEN takes THEN before_fret ELSE fret END AS fret, CASE WHEN takes THEN before_string ELSE string END AS string, ties_only OR takes AS ties_only) FROM (SELECT *, fret IS NULL AND tie_count = 1 AND before_fret IS NOT NULL AS takes FROM e4)),
e6 AS (SELECT e5.*, lead(matched) OVER v AS next_matched, lead(x) OVER v - x AS gap, lead(CASE WHEN fret IS NOT NULL THEN string END) OVER v AS next_string, vector AND authoritative AS active, spacing FROM e5 JOIN (SELECT measure, vector, authoritative, spacing FROM m1) USING (measure) WINDOW v AS (PARTITION BY measure ORDER BY position)),
e7 AS (SELECT * FROM e6 WHERE NOT (active AND NOT matched AND (fret IS NULL OR ties_only) AND coalesce(next_matched AND gap > 0 AND gap <= 0.9 * spacing, false) AND (fret IS NULL OR coalesce(string = next_string, false) OR tie < 0.5::DOUBLE))),
e8 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY measure ORDER BY position) - 1 AS position) FROM e7 WHERE NOT (fret IS NULL AND NOT matched AND tie_count > 0)),
{_correct_sql("e8", 2)}, {_fill_sql("corrected2", "e9")}"""


@query(_PASSES + """, t AS (SELECT measure, sum(ticks) AS total, count(*) AS events, count(fret) AS notes FROM e9 GROUP BY ALL)
SELECT m1.doc, m1.measure, capacity, cast(coalesce(total, 0) AS BIGINT) AS total, CASE WHEN capacity IS NULL THEN 'unknown' WHEN coalesce(total, 0) = 0 THEN 'inactive' WHEN total = capacity THEN 'exact' WHEN total < capacity THEN 'underfilled' ELSE 'overfilled' END AS status, coalesce(events, 0) AS events, coalesce(notes, 0) AS notes FROM m1 LEFT JOIN t USING (measure)""")
def document_passes(spark, d):
    """Measures of whole documents after meter, pruning, corrections, fill, digits, ties, pruning and corrections again."""
    e, audited = P.refine_document(*_score_document(spark, d), SUPPORTED, FILLED)
    n = e.groupBy("measure").agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("notes")).cast("long").alias("notes"))
    return audited.join(n, "measure", "left").na.fill(0, ["events", "notes"]).select("doc", "measure", "capacity", "total", "status", "events", "notes")


@query(_PASSES + """ SELECT measure, position, ticks, coalesce(string || ':' || fret, '') AS notes FROM (SELECT * REPLACE (CASE WHEN fret IS NULL THEN NULL ELSE string END AS string) FROM e9)""")
def document_passes_events(spark, d):
    """The events of these documents."""
    e, _ = P.refine_document(*_score_document(spark, d), SUPPORTED, FILLED)
    said = F.array_join(F.transform("notes", lambda n: F.concat(n["string"].cast("string"), F.lit(":"), n["fret"].cast("string"))), ",")
    return e.select("measure", "position", "ticks", said.alias("notes"))


@query(_PASSES + """ SELECT measure, position, new AS ticks, selection FROM y1 WHERE selection IS NOT NULL""")
def applied_corrections(spark, d):
    """The changes that the first corrections make, and why each was accepted."""
    e, m = _score_document(spark, d)
    m = P.refine_meter(e, m, SUPPORTED)
    e = P.prune_empty(e)
    return P.accepted(P.proposals(e, m)).select("measure", "position", "ticks", "selection")
