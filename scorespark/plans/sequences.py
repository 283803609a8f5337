"""Matching, clustering, constraint and fusion operators on ordered groups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import timeline
from scorespark.plans.base import EVENTS, Registry, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

ON = ["user_id", "day"]


_AUDIT = f"""{EVENTS}, t AS (SELECT user_id, day, cast(sum(v) AS BIGINT) AS total, count(*) AS n FROM events_x WHERE event_type <> 'error' GROUP BY ALL),
a AS (SELECT user_id, day, total, total - 4000 AS delta, CASE WHEN total = 0 THEN 'inactive' WHEN user_id % 10 = 0 THEN 'unknown' WHEN total = 4000 THEN 'exact' WHEN total < 4000 THEN 'underfilled' ELSE 'overfilled' END AS status FROM t)"""


def _audit(spark, d):
    t = events(spark, d).where("event_type <> 'error'").groupBy("user_id", "day").agg(F.sum("v").alias("total"))
    s = F.when(F.col("total") == 0, "inactive").when(F.col("user_id") % 10 == 0, "unknown").when(F.col("total") == 4000, "exact").when(F.col("total") < 4000, "underfilled").otherwise("overfilled")
    return t.select("user_id", "day", "total", (F.col("total") - 4000).alias("delta"), s.alias("status"))


@query(f"WITH {_AUDIT} SELECT * FROM a")
def capacity_audit(spark, d):
    return _audit(spark, d)


@query(f"WITH {_AUDIT} SELECT status, count(*) AS n, cast(sum(delta) AS BIGINT) AS delta FROM a GROUP BY status")
def capacity_summary(spark, d):
    return _audit(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"))


@query("""SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_returnflag = 'R')""")
def prune_empty(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("empty")).where("NOT empty").select("l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS new_pos FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_discount = 0)""")
def prune_unpitched(spark, d):
    keep = ~((F.col("l_linestatus") == "O") & (F.col("l_discount") == 0))
    return timeline.renumber(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], keep).select("l_orderkey", "l_linenumber", "l_partkey", "new_pos")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, day, min(event_id) AS event_id, count(*) AS n FROM events_x WHERE event_type = 'click' GROUP BY ALL)
SELECT user_id, day, event_id FROM s WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM events_x e WHERE e.user_id = s.user_id AND e.day = s.day AND e.event_type = 'view')""")
def isolated_recovery(spark, d):
    e = events(spark, d)
    s = e.where("event_type = 'click'").groupBy("user_id", "day").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return s.join(e.where("event_type = 'view'").select("user_id", "day"), ["user_id", "day"], "left_anti").select("user_id", "day", "event_id")


@query("""SELECT c_custkey AS slot, CASE WHEN s_acctbal > 5000 THEN 'vector' WHEN c_acctbal / 10000 >= 0.45 THEN 'classifier' WHEN coalesce(s_acctbal, 0) / 10000 < 0.8 AND n_nationkey IS NOT NULL THEN 'detector' ELSE 'blank' END AS source
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey LEFT JOIN nation ON c_custkey % 50 = n_nationkey""")
def source_fusion(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("slot"), "c_acctbal", (F.col("c_custkey") % 50).alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), "s_acctbal")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit(True).alias("seen"))
    j = c.join(s, "slot", "left").join(n, "k", "left")
    kind = F.when(F.col("s_acctbal") > 5000, "vector").when(F.col("c_acctbal") / 10000 >= 0.45, "classifier").when((F.coalesce("s_acctbal", F.lit(0.0)) / 10000 < 0.8) & F.col("seen").isNotNull(), "detector").otherwise("blank")
    return j.select("slot", kind.alias("source"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS visual, count(*) - count(*) FILTER (l_linestatus = 'F') AS missing, count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) - count(*) FILTER (l_linestatus = 'F') > 0 AS candidate FROM lineitem GROUP BY l_orderkey""")
def tie_candidate(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("visual"), F.count_if(F.col("l_linestatus") != "F").alias("missing"))
    return g.withColumn("candidate", (F.col("visual") > 0) & (F.col("missing") > 0))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, day, event_id, x + 300 AS "from", lead(x) OVER (PARTITION BY user_id, day ORDER BY x, event_id) AS until FROM events_x)
SELECT user_id, day, event_id, "from", coalesce(until, 86400) - "from" AS gap FROM g WHERE coalesce(until, 86400) > "from" """)
def gap_rows(spark, d):
    until = F.coalesce(F.lead("x").over(W.partitionBy(*ON).orderBy("x", "event_id")), F.lit(86_400))
    g = events(spark, d).select("user_id", "day", "event_id", (F.col("x") + 300).alias("from"), until.alias("until"))
    return g.where("until > from").select("user_id", "day", "event_id", "from", (F.col("until") - F.col("from")).alias("gap"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, x // 60 ORDER BY x, event_id) AS r FROM events_x)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing timing' WHEN x >= 80000 THEN 'outside capacity' WHEN r > 1 THEN 'duplicate onset' ELSE 'ok' END AS issue FROM r""")
def admission_issues(spark, d):
    minute = F.floor(F.col("x") / 60)
    r = F.row_number().over(W.partitionBy(*ON, minute).orderBy("x", "event_id"))
    e = events(spark, d).withColumn("r", r)
    return e.select("event_id", F.when(F.col("event_type") == "error", "missing timing").when(F.col("x") >= 80_000, "outside capacity").when(F.col("r") > 1, "duplicate onset").otherwise("ok").alias("issue"))


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber % 3)) AS a, list(DISTINCT l_linenumber % 3) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY l_orderkey), b AS (SELECT *, list_filter(a, lambda x: NOT list_contains(coalesce(e, []), x)) AS m FROM g)
SELECT l_orderkey, cast(CASE WHEN len(m) = 1 THEN m[1] WHEN len(a) = 1 THEN a[1] ELSE list_min(a) END AS INTEGER) AS voice FROM b""")
def disambiguate_voice(spark, d):
    k = F.col("l_linenumber") % 3
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(k).alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", k)).alias("e"))
    m = F.array_except("a", "e")
    return g.select("l_orderkey", F.when(F.size(m) == 1, F.element_at(m, 1)).otherwise(F.array_min("a")).alias("voice"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 AND doc_id % 2 = 0 THEN 'quality' WHEN quality = 1 AND toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS flag, quality = 1 AND toxic = 1 AS downgraded FROM labels""")
def flag_conflict(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    flag = F.when(q & t, F.when(F.col("doc_id") % 2 == 0, "quality").otherwise("toxic")).when(q, "quality").when(t, "toxic").otherwise("none")
    return table(spark, d, "labels").select("doc_id", flag.alias("flag"), (q & t).alias("downgraded"))


@query(f"""WITH {EVENTS} SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM events_x t WHERE t.event_type = 'purchase' AND t.user_id = e.user_id AND t.day = e.day AND abs(t.x - e.x) <= 1800) THEN 'note' ELSE e.event_type END AS state FROM events_x e WHERE e.event_type <> 'purchase'""")
def override_state(spark, d):
    e = events(spark, d).select("event_id", "user_id", "day", "event_type", "x")
    trusted = F.when(F.col("event_type") == "purchase", F.col("x"))
    w = W.partitionBy(*ON).orderBy("x")
    # The nearest trusted place on either side, by one window; no pairs.
    gap = F.least(F.coalesce(F.col("x") - F.last(trusted, ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)), F.lit(1 << 40)), F.coalesce(F.first(trusted, ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing)) - F.col("x"), F.lit(1 << 40)))
    return e.withColumn("gap", gap).where("event_type <> 'purchase'").select("event_id", F.when(F.col("gap") <= 1800, "note").otherwise(F.col("event_type")).alias("state"))


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT count(*) AS expected, count(b.o_orderkey) AS structural, count(*) FILTER (b.p IS NOT DISTINCT FROM a.o_orderpriority AND b.o_orderkey IS NOT NULL) AS full_match, count(b.o_orderkey) - count(*) FILTER (b.p IS NOT DISTINCT FROM a.o_orderpriority AND b.o_orderkey IS NOT NULL) AS lossy
FROM orders a LEFT JOIN b ON a.o_orderkey = b.o_orderkey AND a.o_orderstatus = b.o_orderstatus""")
def readback_layers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderpriority")).alias("p"), F.lit(True).alias("there"))
    j = o.join(b, ["o_orderkey", "o_orderstatus"], "left")
    full = F.col("there").isNotNull() & F.col("p").eqNullSafe(F.col("o_orderpriority"))
    s = j.agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("structural"), F.count_if(full).alias("full_match"))
    return s.withColumn("lossy", F.col("structural") - F.col("full_match"))


@query(f"""WITH {EVENTS} SELECT event_id, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, day) >= 3 AS authoritative FROM events_x""")
def authority_flag(spark, d):
    n = F.sum((F.col("event_type") == "click").cast("int")).over(W.partitionBy(*ON))
    return events(spark, d).select("event_id", (n >= 3).alias("authoritative"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS harmonic, doc_id % 5 = 0 AND quality = 1 AS muted, CASE WHEN doc_id % 3 = 0 OR (doc_id % 5 = 0 AND quality = 1) THEN 1 ELSE 0 END AS attached FROM labels""")
def override_flags(spark, d):
    names = F.array(F.lit("harmonic"), F.lit("muted"))
    asserted = F.array_compact(F.array(F.when(F.col("doc_id") % 3 == 0, "harmonic"), F.when((F.col("doc_id") % 5 == 0) & (F.col("quality") == 1), "muted")))
    flags = F.map_from_arrays(names, F.transform(names, lambda n: F.array_contains(F.col("on"), n)))
    lb = table(spark, d, "labels").withColumn("on", asserted).withColumn("f", flags)
    return lb.select("doc_id", F.col("f")["harmonic"].alias("harmonic"), F.col("f")["muted"].alias("muted"), F.when(F.size("on") > 0, 1).otherwise(0).alias("attached"))


@query(f"""WITH {EVENTS}, p AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) AS t(w)) SELECT event_id, w, round({S.WHOLE} * w, 0)::BIGINT AS ticks FROM events_x, p WHERE event_type = 'purchase'""")
def scaled_ticks(spark, d):
    e = events(spark, d).where("event_type = 'purchase'").select("event_id", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("w"))
    return e.withColumn("ticks", F.round(F.lit(S.WHOLE) * F.col("w")).cast("long"))
