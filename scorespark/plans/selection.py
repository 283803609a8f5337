"""Top-k, sets, splits and sampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators.sampling import weighted_draws as draw_by_weight
from scorespark.operators.scoring import first_by
from scorespark.plans.base import BOXES, EVENTS, Registry, boxes, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x, l_linenumber, w, h) AS BIGINT) AS number FROM boxes WHERE l_returnflag <> 'R'""")
def reading_order(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("y", "x", "l_linenumber", "w", "h")
    return boxes(spark, d).where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("number"))


@query("""WITH s AS (SELECT vec_id, list_sort(list_transform(embedding, lambda v, i: {'n': -v, 'i': cast(i AS BIGINT)})) AS o FROM embeddings), k AS (SELECT vec_id, o, list_filter(o[1:5], lambda x: -x.n >= 0.25) AS f FROM s)
SELECT vec_id, array_to_string(list_transform(CASE WHEN len(f) > 0 THEN f ELSE o[1:1] END, lambda x: x.i), ',') AS top FROM k""")
def topk_floor(spark, d):
    ranked = F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("n"), (i + 1).cast("long").alias("i"))))
    v = table(spark, d, "embeddings").select("vec_id", ranked.alias("o"))
    strong = F.filter(F.slice("o", 1, 5), lambda x: -x["n"] >= F.lit(0.25).cast("float"))
    best = F.when(F.size(strong) > 0, strong).otherwise(F.slice("o", 1, 1))
    return v.select("vec_id", F.array_join(F.transform(best, lambda x: x["i"].cast("string")), ",").alias("top"))


@query("""WITH j AS (SELECT source, count(*) FILTER (quality = 0) AS fn, count(*) FILTER (toxic = 1) AS fp, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, n, fn, fp FROM j ORDER BY round(1 - (fn + fp) / n, 9), fn DESC, fp DESC, source LIMIT 10""")
def worst_k(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    g = j.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("fn"), F.count_if(F.col("toxic") == 1).alias("fp"), F.count(F.lit(1)).alias("n"))
    f = F.round(1 - (F.col("fn") + F.col("fp")) / F.col("n"), 9)
    return g.orderBy(f, F.desc("fn"), F.desc("fp"), "source").limit(10).select("source", "n", "fn", "fp")


@query("""WITH RECURSIVE v AS (SELECT vec_id, list_transform(list_zip(embedding, range(0, len(embedding))), lambda z: {'n': -z[1], 'i': z[2]}) AS c FROM embeddings),
f AS (SELECT vec_id, list_sort(c) AS c, CAST([] AS BIGINT[]) AS picked, 0 AS k FROM v
UNION ALL SELECT vec_id, list_filter(c, lambda z: abs(z.i - c[1].i) > 1), list_append(picked, c[1].i), k + 1 FROM f WHERE k < 3 AND len(c) > 0)
SELECT vec_id, list_transform(list_sort(picked), lambda i: cast(i AS INTEGER)) AS picked FROM f WHERE k = 3 OR len(c) = 0""")
def topk_nonadjacent(spark, d):
    """The three largest components no two of which are neighbours."""
    ranked = F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))

    def step(acc, x):
        near = F.exists(acc, lambda i: F.abs(i - x["i"]) <= 1)
        return F.when((F.size(acc) < 3) & ~near, F.concat(acc, F.array(x["i"]))).otherwise(acc)

    picked = F.aggregate(ranked, F.array().cast("array<int>"), step)
    return table(spark, d, "embeddings").select("vec_id", F.array_sort(picked).alias("picked"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def best_by_tuple(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey ORDER BY first LIMIT 50) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f)""")
def limit_sources(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")).orderBy("first").limit(50).select("o_custkey")
    return o.join(F.broadcast(first), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT 'customer' AS domain, c_custkey AS id, c_name AS name, c_mktsegment AS segment, true AS supervised FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, false FROM supplier""")
def tagged_union(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("domain"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(True).alias("supervised"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("domain"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True).withColumn("supervised", F.coalesce("supervised", F.lit(False)))


@query("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def coverage_missing(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").subtract(seen)


@query("""SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10""")
def coverage_extra(spark, d):
    return table(spark, d, "lineitem").select("l_partkey").subtract(table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey")))


@query("""SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'""")
def multiset_diff(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda s: li.where(F.col("l_linestatus") == s).select("l_suppkey", "l_linenumber")
    return side("F").exceptAll(side("O"))


@query("""SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997""")
def split_overlap(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return o.where("y = 1996").select("o_custkey").intersect(o.where("y = 1997").select("o_custkey"))


@query("""SELECT doc_id, h AS sha256 FROM (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", S.digest(F.col("text")).alias("sha256"))
    return docs.groupBy("sha256").agg(F.min(F.struct("source", "doc_id")).alias("b")).select("b.doc_id", "sha256")


_GROUPS = "g AS (SELECT c_mktsegment AS family, c_nationkey AS grp, count(*) AS n FROM customer GROUP BY ALL)"


@query(f"""WITH {_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('7:' || grp)) AS r, count(*) OVER (PARTITION BY family) AS k FROM g)
SELECT family, grp, n, CASE WHEN k > 1 AND r <= least(k - 1, greatest(1, round_even(k * 0.1, 0))) THEN 'validation' ELSE 'train' END AS split FROM r""")
def stratified_group_split(spark, d):
    return _stratified(spark, d)


def _stratified(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("family")
    r = F.row_number().over(w.orderBy(S.digest(F.concat(F.lit("7:"), F.col("grp").cast("string")))))
    k = F.count(F.lit(1)).over(w)
    g = g.withColumn("r", r).withColumn("k", k)
    picked = (F.col("k") > 1) & (F.col("r") <= F.least(F.col("k") - 1, F.greatest(F.lit(1), F.bround(F.col("k") * 0.1, 0))))
    return g.select("family", "grp", "n", F.when(picked, "validation").otherwise("train").alias("split"))


@query(f"""WITH {_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY sha256('7:' || grp)) AS r, count(*) OVER (PARTITION BY family) AS k FROM g),
s AS (SELECT family, grp, CASE WHEN k > 1 AND r <= least(k - 1, greatest(1, round_even(k * 0.1, 0))) THEN 'validation' ELSE 'train' END AS split FROM r)
SELECT c_custkey, split, cast(row_number() OVER (PARTITION BY split, c_nationkey ORDER BY c_custkey) AS BIGINT) AS new_id, c_nationkey FROM customer JOIN s ON c_mktsegment = family AND c_nationkey = grp""")
def resplit_rows(spark, d):
    s = _stratified(spark, d).select(F.col("family").alias("c_mktsegment"), F.col("grp").alias("c_nationkey"), "split")
    j = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").join(s, ["c_mktsegment", "c_nationkey"])
    return j.select("c_custkey", "split", F.row_number().over(W.partitionBy("split", "c_nationkey").orderBy("c_custkey")).cast("long").alias("new_id"), "c_nationkey")


_BASE_SPLIT = "CASE WHEN c_custkey % 10 = 0 THEN 'test' WHEN c_custkey % 10 = 1 THEN 'validation' ELSE 'train' END"


def _base_split():
    k = F.col("c_custkey") % 10
    return F.when(k == 0, "test").when(k == 1, "validation").otherwise("train")


@query(f"""SELECT c_custkey, coalesce(o.split, {_BASE_SPLIT}) AS split FROM customer LEFT JOIN (SELECT s_suppkey, 'holdout' AS split FROM supplier WHERE s_acctbal < 0) o ON c_custkey = s_suppkey""")
def split_override(spark, d):
    o = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("c_custkey"), F.lit("holdout").alias("o"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("o", _base_split()).alias("split"))


@query(f"""SELECT c_custkey, CASE WHEN s = 'test' THEN 'test' WHEN s = 'validation' OR c_mktsegment = 'MACHINERY' THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, {_BASE_SPLIT} AS s FROM customer)""")
def split_precedence(spark, d):
    s = _base_split()
    return table(spark, d, "customer").select("c_custkey", F.when(s == "test", "test").when((s == "validation") | (F.col("c_mktsegment") == "MACHINERY"), "validation").otherwise("train").alias("split"))


@query(f"""SELECT coalesce(s, 'unknown') AS split, CASE WHEN s IS NULL THEN 'excluded unknown' WHEN s = 'test' THEN 'excluded test' WHEN s = 'validation' THEN 'validation' ELSE 'train' END AS task, count(*) AS n
FROM orders LEFT JOIN (SELECT c_custkey, {_BASE_SPLIT} AS s FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY ALL""")
def domain_remap(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), _base_split().alias("s"))
    j = table(spark, d, "orders").select("o_custkey").join(c, "o_custkey", "left")
    s = F.col("s")
    task = F.when(s.isNull(), "excluded unknown").when(s == "test", "excluded test").when(s == "validation", "validation").otherwise("train")
    return j.groupBy(F.coalesce(s, F.lit("unknown")).alias("split"), task.alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS used FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey, list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(used, x)) AS blank FROM g)
SELECT l_orderkey, CASE WHEN len(blank) > 0 THEN blank[l_orderkey % len(blank) + 1] END AS slot FROM b""")
def rotating_negative(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("used"))
    g = g.withColumn("blank", F.array_except(F.sequence(F.lit(1), F.lit(7)), "used"))
    k = F.size("blank")
    return g.select("l_orderkey", F.when(k > 0, F.element_at("blank", (F.col("l_orderkey") % F.greatest(k, F.lit(1)) + 1).cast("int"))).alias("slot"))


_WEIGHT = "1 + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_linenumber = 7 THEN 3 ELSE 0 END + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, cast({_WEIGHT} AS INTEGER) AS weight FROM lineitem")
def sample_weights(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_WEIGHT).alias("weight"))


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, {_WEIGHT} AS w FROM lineitem), t AS (SELECT sum(w) AS s, count(*) AS n FROM w),
e AS (SELECT w.*, cast(w * n AS DOUBLE) / s AS x, cast(('0x' || substr(sha256(l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM w, t)
SELECT l_orderkey, l_linenumber, l_partkey, cast(floor(x) + CASE WHEN u < x - floor(x) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM e""")
def weighted_resample(spark, d):
    """Copies of each row, as many in all as there are rows but for rounding: their expected counts follow the weights."""
    w = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_WEIGHT).alias("w"))
    total = w.agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))
    x = (F.col("w") * F.col("n")).cast("double") / F.col("s")
    u = F.conv(F.substring(S.digest(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    e = w.crossJoin(F.broadcast(total)).select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"), u.alias("u"))  # one row
    return e.select("l_orderkey", "l_linenumber", "l_partkey", (F.floor("x") + F.when(F.col("u") < F.col("x") - F.floor("x"), 1).otherwise(0)).alias("copies"))


@query("""WITH w AS (SELECT l_orderkey, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
c AS (SELECT *, cast(sum(w) OVER (ORDER BY l_orderkey) - w AS DOUBLE) AS at FROM w), t AS (SELECT cast(sum(w) AS DOUBLE) AS total FROM w),
d AS (SELECT i AS draw, least(cast(('0x' || substr(sha256('17:' || i), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE * total, total) AS at FROM t, (SELECT unnest(range(count(*))) AS i FROM lineitem))
SELECT d.draw, c.l_orderkey FROM d ASOF JOIN c ON d.at >= c.at""")
def weighted_draws(spark, d):
    """As many draws of orders with replacement as there are line items, by the quantity that was not returned."""
    li = table(spark, d, "lineitem")
    w = li.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("w"))
    return draw_by_weight(w, ["l_orderkey"], "w", li.count(), 17)


@query(f"""WITH {EVENTS} SELECT event_type, count(*) FILTER (v >= 1800) AS kept, count(*) FILTER (v < 1800) AS dropped FROM events_x GROUP BY event_type""")
def confidence_gate(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count_if(F.col("v") >= 1800).alias("kept"), F.count_if(F.col("v") < 1800).alias("dropped"))


@query(f"""WITH {EVENTS}, t AS (SELECT DISTINCT least(i * 25000, 86400 - 30000) AS start FROM generate_series(0, 3) AS g(i))
SELECT event_id, cast(start AS BIGINT) AS start, x - start AS tile_x FROM events_x JOIN t ON x >= start AND x < start + 30000""")
def overlap_tiles(spark, d):
    starts = F.array(*[F.lit(s).cast("long") for s in sorted({min(i * 25_000, 86_400 - 30_000) for i in range(4)})])
    hit = F.filter(starts, lambda s: (F.col("x") >= s) & (F.col("x") < s + 30_000))
    return events(spark, d).select("event_id", "x", F.explode(hit).alias("start")).select("event_id", "start", (F.col("x") - F.col("start")).alias("tile_x"))


@query("""SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders""")
def first_in_group(spark, d):
    return first_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
