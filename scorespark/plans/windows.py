"""Window functions over timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import timeline as T
from scorespark.operators.association import islands
from scorespark.plans.base import EVENTS, Registry, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

USER, ORDER = ["user_id"], ["ts", "event_id"]
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN v END AS printed FROM events_x), c AS (
SELECT event_id, user_id, printed, last_value(printed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM p)
SELECT *, CASE WHEN printed IS NOT NULL THEN 'printed' WHEN carried IS NOT NULL THEN 'carried' ELSE 'unknown' END AS origin FROM c""")
def carry_forward(spark, d):
    p = events(spark, d).select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("v")).alias("printed"))
    return T.carry_forward(p, USER, ORDER, "printed").drop("ts")


@query(f"""WITH {EVENTS}, t AS (SELECT event_id, user_id, day, ts, CASE WHEN event_type <> 'error' THEN v END AS ticks FROM events_x), o AS (
SELECT event_id, user_id, day, ticks, CASE WHEN ticks IS NOT NULL THEN cast(coalesce(sum(ticks) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS onset FROM t)
SELECT *, onset + ticks AS "end" FROM o""")
def running_onset(spark, d):
    t = events(spark, d).select("event_id", "user_id", "day", "ts", F.when(F.col("event_type") != "error", F.col("v")).alias("ticks"))
    return T.running_onset(t, ["user_id", "day"], ORDER, "ticks").drop("ts")


_DAILY = "d AS (SELECT event_type, day, count(*) AS n FROM events_x GROUP BY ALL)"


@query(f"""WITH {EVENTS}, {_DAILY} SELECT event_type, day, n, coalesce(n = lag(n) OVER w, false) OR coalesce(n = lead(n) OVER w, false) AS supported FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def neighbour_support(spark, d):
    g = events(spark, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    w = T.ordered(["event_type"], ["day"])
    same = lambda c: F.coalesce(F.col("n") == c, F.lit(False))
    return g.withColumn("supported", same(F.lag("n").over(w)) | same(F.lead("n").over(w)))


@query(f"""WITH {EVENTS}, {_DAILY}, s AS (SELECT *, n % 8 AS total, lag(n % 8) OVER w AS p, lead(n % 8) OVER w AS q, last_value(CASE WHEN n % 5 = 0 THEN n % 8 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS current FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, total, current, CASE WHEN total = current THEN current WHEN n % 5 = 0 THEN total WHEN total = p OR total = q THEN total ELSE current END AS refined FROM s""")
def refine_meter(spark, d):
    g = events(spark, d).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.col("n") % 8)
    g = T.carry_forward(g.withColumn("seen", F.when(F.col("n") % 5 == 0, F.col("total"))), ["event_type"], ["day"], "seen", "current")
    w, t, c = T.ordered(["event_type"], ["day"]), F.col("total"), F.col("current")
    near = (t == F.lag("total").over(w)) | (t == F.lead("total").over(w))
    return g.select("event_type", "day", "total", "current", F.when(t == c, c).when(F.col("n") % 5 == 0, t).when(F.coalesce(near, F.lit(False)), t).otherwise(c).alias("refined"))


@query(f"""WITH {EVENTS} SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER {_W} AS r, lag(event_type) OVER {_W} AS p FROM events_x) WHERE r = 1 OR event_type IS DISTINCT FROM p""")
def value_changes(spark, d):
    return events(spark, d).withColumn("_c", T.value_changes("event_type", USER, ORDER)).where("_c").select("event_id", "user_id", "event_type")


@query("""WITH o AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, cast(l_quantity AS BIGINT) AS v FROM lineitem),
w AS (SELECT *, list(v) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, v ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, list(v) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, v ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b,
count(*) OVER (PARTITION BY l_suppkey, v) AS own FROM o), n AS (SELECT *, list_concat(coalesce(a, []), coalesce(b, [])) AS near, (SELECT count(*) FROM o AS q WHERE q.l_suppkey = w.l_suppkey AND q.v = w.v // 10) AS digit FROM w)
SELECT l_suppkey, l_orderkey, l_linenumber, v, cast(CASE WHEN v BETWEEN 20 AND 39 AND (digit >= greatest(6, 3 * own) OR (len(list_filter(near, lambda x: x <= 19 AND abs(x - v // 10) <= 2)) >= 2 AND len(list_filter(near, lambda x: abs(x - v) <= 4)) = 0)) THEN v // 10 ELSE v END AS BIGINT) AS fixed FROM n""")
def outlier_digit_fix(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("v"))
    return T.outlier_digits(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "v"], "v").drop("l_partkey")


@query(f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN x - lag(x) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM events_x WINDOW w AS (PARTITION BY user_id, day ORDER BY x, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, day, cast(island AS BIGINT) AS island, count(*) AS n, min(x) AS x0, max(x) AS x1 FROM i GROUP BY ALL""")
def gap_islands(spark, d):
    i = islands(events(spark, d), ["user_id", "day"], "x", 3600, ["event_id"])
    return i.groupBy("user_id", "day", "island").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256(c_name)) - 1 AS rank, count(*) OVER () AS n FROM customer), k AS (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS part FROM r)
SELECT c_custkey, CASE WHEN rank < part THEN 'test' WHEN rank < 2 * part THEN 'validation' ELSE 'train' END AS split FROM k""")
def rank_split(spark, d):
    c = table(spark, d, "customer").select("c_custkey", S.digest(F.col("c_name")).alias("h"))
    part = F.greatest(F.lit(1), F.bround(F.col("n") * 0.1, 0))
    total = c.agg(F.count(F.lit(1)).alias("n"))
    r = T.global_rank(c, "h").crossJoin(F.broadcast(total))  # one row
    return r.select("c_custkey", F.when(F.col("rank") < part, "test").when(F.col("rank") < 2 * part, "validation").otherwise("train").alias("split"))


@query("""SELECT c_custkey, b AS bucket, CASE b WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT c_custkey, cast(('0x' || substr(sha256(c_name), 1, 8)) AS BIGINT) % 10 AS b FROM customer)""")
def hash_split(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", S.hash_bucket(c).alias("bucket"), S.hash_split(c).alias("split"))


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(cast(o_orderkey AS VARCHAR))) AS r FROM orders) WHERE r <= 20""")
def quota_per_group(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", S.digest(F.col("o_orderkey").cast("string")).alias("h"))
    return o.withColumn("r", F.row_number().over(T.ordered(["o_orderpriority"], ["h"]))).where("r <= 20").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, o_orderpriority, r AS round FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) ORDER BY r, o_orderpriority LIMIT 23""")
def round_robin_pick(spark, d):
    w = T.ordered(["o_orderpriority"], [F.desc("o_totalprice"), F.desc("o_orderdate"), F.desc("o_orderkey")])
    o = table(spark, d, "orders").withColumn("round", F.row_number().over(w).cast("long")).where("round <= 23")
    return o.orderBy("round", "o_orderpriority").limit(23).select("o_orderkey", "o_orderpriority", "round")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS new_pos FROM lineitem WHERE l_returnflag <> 'R'""")
def renumber_after_prune(spark, d):
    li = table(spark, d, "lineitem")
    return T.renumber(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber", "l_partkey", "new_pos")


@query(f"""WITH {EVENTS}, n AS (SELECT *, lead(x) OVER w - x AS gap, lead(event_type) OVER w AS next_type FROM events_x WINDOW w AS (PARTITION BY user_id, day ORDER BY x, event_id))
SELECT event_id FROM n WHERE NOT coalesce(gap > 0 AND gap <= 0.9 * 600 AND event_type = 'view' AND next_type <> 'error', false)""")
def prune_near_duplicate(spark, d):
    w = T.ordered(["user_id", "day"], ["x", "event_id"])
    gap, after = F.lead("x").over(w) - F.col("x"), F.lead("event_type").over(w)
    gone = (gap > 0) & (gap <= 0.9 * 600) & (F.col("event_type") == "view") & (after != "error")
    return events(spark, d).withColumn("_gone", F.coalesce(gone, F.lit(False))).where("NOT _gone").select("event_id")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS local FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n)
SELECT c.conv_id, c.turn, cast(base + local + 1 AS BIGINT) AS number FROM c JOIN o ON c.conv_id = o.conv_id""")
def document_numbering(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    local = c.select("conv_id", "turn", (F.row_number().over(T.ordered(["conv_id"], ["turn", "role", "text"])) - 1).alias("local"))
    # Offsets of pages: sums over ranges of conv_id, so that no task sees all pages.
    base = T.running_total(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), ["conv_id"], F.col("n"), "base").select("conv_id", "base")
    return local.join(base, "conv_id").select("conv_id", "turn", (F.col("base") + F.col("local") + 1).alias("number"))


@query(f"""WITH {EVENTS}, g AS (SELECT *, min(x) OVER p AS lo, max(x) OVER p AS hi, count(*) OVER p AS n, row_number() OVER (PARTITION BY user_id, day ORDER BY x, event_id) - 1 AS pos FROM events_x WINDOW p AS (PARTITION BY user_id, day))
SELECT event_id, round(CASE WHEN n = 1 THEN 0.5 WHEN hi = lo THEN pos / (n - 1) ELSE (x - lo) / (hi - lo) END, 9) AS scaled FROM g""")
def minmax_normalise(spark, d):
    s = T.minmax(events(spark, d), ["user_id", "day"], ["x", "event_id"], "x")
    return s.select("event_id", F.round("scaled", 9).alias("scaled"))


@query(f"""WITH {EVENTS} SELECT event_id, x - first_value(x) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS shifted FROM events_x""")
def origin_shift(spark, d):
    return events(spark, d).select("event_id", (F.col("x") - F.first("x").over(T.ordered(["user_id", "day"], ORDER))).alias("shifted"))


@query("""WITH p AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT *, max(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS r FROM m WHERE v = top AND v >= 0.1) SELECT vec_id, cast(pos AS INTEGER) AS pos, cast(r AS INTEGER) AS "rank" FROM k WHERE r <= 5""")
def peaks_1d(spark, d):
    """The five highest peaks of each vector; of equal ones the first."""
    # In the row: nothing is exploded before the choice.
    v, n = F.col("embedding"), F.size("embedding")
    at = lambda i: F.get(v, i)
    peak = lambda x, i: (x >= 0.1) & (x >= F.coalesce(at(i - 1), x)) & (x >= F.coalesce(at(i + 1), x))
    found = F.filter(F.sequence(F.lit(0), n - 1), lambda i: peak(at(i), i))
    best = F.slice(F.array_sort(F.transform(found, lambda i: F.struct((-at(i)).alias("v"), i.alias("i")))), 1, 5)
    return table(spark, d, "embeddings").where(n > 0).select("vec_id", F.posexplode(best).alias("r", "b")).select("vec_id", F.col("b.i").alias("pos"), (F.col("r") + 1).alias("rank"))


@query(f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER {_W} AS n FROM events_x), k AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS ln, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY n) AS lv FROM n)
SELECT event_id, CASE WHEN n - ln <= 8 THEN lv END AS recent FROM k""")
def last_by_key_recent(spark, d):
    return T.latest_by_key(events(spark, d), USER, "event_type", ORDER, "v", 8).select("event_id", "recent")


@query("""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL WHEN role = 'user' THEN 'up' ELSE 'down' END AS s FROM conversations),
f AS (SELECT conv_id, n, s AS out, CAST(NULL AS VARCHAR) AS before FROM c WHERE n = 1 UNION ALL
SELECT c.conv_id, c.n, coalesce(c.s, CASE WHEN f.out = 'up' AND f.before = 'down' THEN 'down' WHEN f.out = 'down' AND f.before = 'up' THEN 'up' END), f.out FROM f JOIN c ON c.conv_id = f.conv_id AND c.n = f.n + 1)
SELECT conv_id, n, out AS stroke FROM f""")
def alternate_fill(spark, d):
    s = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.lit(None)).when(F.col("role") == "user", "up").otherwise("down")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", s.alias("s"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "s"))).alias("l"))

    def step(acc, x):
        a, b = acc["b"], acc["c"]
        fill = F.when((b == "up") & (a == "down"), "down").when((b == "down") & (a == "up"), "up")
        out = F.coalesce(x["s"], fill)
        return F.struct(b.alias("b"), out.alias("c"), F.concat(acc["o"], F.array(out)).alias("o"))

    none = F.lit(None).cast("string")
    o = g.select("conv_id", F.aggregate("l", F.struct(none.alias("b"), none.alias("c"), F.array().cast("array<string>").alias("o")), step)["o"].alias("o"))
    return o.select("conv_id", F.posexplode("o").alias("n", "stroke")).select("conv_id", (F.col("n") + 1).cast("long").alias("n"), "stroke")
