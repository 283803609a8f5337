"""Data-quality rules: each gives the rows that violate it."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.plans.base import BOXES, EVENTS, Registry, boxes, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT 'duplicate' AS rule, o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 UNION ALL
SELECT 'two splits', o_custkey, count(DISTINCT o_orderstatus) FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 2 UNION ALL
SELECT 'unknown', o_custkey, 1 FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -900)""")
def dq_unique_and_split(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    g = o.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderstatus").alias("k"))
    rules = F.array_compact(F.array(F.when(F.col("n") > 12, F.struct(F.lit("duplicate").alias("rule"), F.col("n").alias("n"))), F.when(F.col("k") > 2, F.struct(F.lit("two splits").alias("rule"), F.col("k").alias("n")))))
    found = g.select("id", F.explode(rules).alias("r")).select("r.rule", "id", "r.n")
    known = table(spark, d, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("id"))
    return found.unionByName(g.select("id").join(known, "id", "left_anti").select(F.lit("unknown").alias("rule"), "id", F.lit(1).cast("long").alias("n")))


@query("""SELECT l_orderkey, count(*) AS found, cast(max(l_linenumber) AS BIGINT) AS stated FROM lineitem GROUP BY l_orderkey HAVING count(*) <> max(l_linenumber)""")
def dq_count_match(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("found"), F.max("l_linenumber").cast("long").alias("stated"))
    return g.where("found <> stated")


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS found FROM documents WHERE substr(sha256(text), 1, 16) <> substr(sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END), 1, 16)""")
def dq_hash_match(spark, d):
    docs = table(spark, d, "documents")
    stored = F.substring(S.digest(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), 1, 16)
    found = F.substring(S.digest(F.col("text")), 1, 16)
    return docs.where(found != stored).select("doc_id", found.alias("found"))


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""")
def dq_leakage(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("splits")).where("splits > 1")


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)
SELECT a.o_orderkey, 'o_orderstatus' AS field, a.o_orderstatus AS expected, b.o_orderstatus AS found FROM orders a JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus UNION ALL
SELECT a.o_orderkey, 'o_orderpriority', a.o_orderpriority, b.o_orderpriority FROM orders a JOIN b USING (o_orderkey) WHERE a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def dq_field_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "P").otherwise(F.col("o_orderstatus")).alias("b_o_orderstatus"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("b_o_orderpriority"))
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("expected"), F.col(f"b_{c}").alias("found")) for c in ("o_orderstatus", "o_orderpriority")])
    wrong = F.filter(pairs, lambda p: ~p["expected"].eqNullSafe(p["found"]))
    return o.join(b, "o_orderkey").select("o_orderkey", F.explode(wrong).alias("w")).select("o_orderkey", "w.*")


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, x, y FROM boxes WHERE NOT (w > 0 AND h > 0 AND x + w / 2 BETWEEN 0 AND 110 AND abs(y + h / 2 - round(y + h / 2)) <= 0.01)""")
def dq_geometry(spark, d):
    ok = "w > 0 AND h > 0 AND x + w / 2 BETWEEN 0 AND 110 AND abs(y + h / 2 - round(y + h / 2)) <= 0.01"
    return boxes(spark, d).where(f"NOT ({ok})").select("l_orderkey", "l_linenumber", "x", "y")


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(s, ',') AS found FROM g WHERE s[len(s)] <> len(s)""")
def dq_index_complete(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("s"))
    return g.where(F.col("s") != F.sequence(F.lit(1), F.size("s"))).select("l_orderkey", F.array_join("s", ",").alias("found"))


@query("""SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1] - z[2]))) > 0.5""")
def dq_array_tolerance(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gap = F.array_max(F.zip_with("embedding", "other", lambda p, q: F.abs(p - q)))
    return a.join(b, "vec_id").where(gap > 0.5).select("vec_id")


@query("""SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) FILTER (toxic = 1) = 0""")
def dq_positive_support(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("n")).where("n = 0").select("source")


@query("""(SELECT 'left' AS side, p_type AS category FROM part WHERE p_size > 25 EXCEPT SELECT 'left', p_type FROM part WHERE p_size <= 3) UNION ALL (SELECT 'right', p_type FROM part WHERE p_size <= 3 EXCEPT SELECT 'right', p_type FROM part WHERE p_size > 25)""")
def dq_category_match(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("category"), "p_size")
    a, b = p.where("p_size > 25").select("category"), p.where("p_size <= 3").select("category")
    return a.subtract(b).select(F.lit("left").alias("side"), "category").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "category"))


@query(f"""WITH {EVENTS} SELECT user_id, day, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events_x GROUP BY ALL HAVING count(*) FILTER (event_type = 'view') <> count(*) FILTER (event_type = 'click')""")
def dq_group_count_match(spark, d):
    g = events(spark, d).groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return g.where("a <> b")
