"""Aggregations and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import scoring
from scorespark.operators.scoring import THRESHOLDS, sweep
from scorespark.plans.base import EVENTS, Registry, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql



@query("""SELECT key, count(*) AS n FROM (SELECT unnest(['flag:' || l_returnflag, 'status:' || l_linestatus, 'line:' || l_linenumber]) AS key FROM lineitem) GROUP BY key""")
def keyed_counts(spark, d):
    keys = F.array(*[F.concat(F.lit(p), c) for p, c in (("flag:", "l_returnflag"), ("status:", "l_linestatus"), ("line:", "l_linenumber"))])
    return table(spark, d, "lineitem").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, o_custkey % 2 AS parity, count(*) AS n FROM orders GROUP BY ALL""")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 2).alias("parity")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def status_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# Truth: quality; prediction: an even number of characters, or none of these documents.
_PRED = """p AS (SELECT lb.doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, quality = 1 AS truth, toxic = 1 AS toxic, coalesce(n_chars % 2 = 0, false) AS pred,
coalesce(n_chars % 101, 0) AS score FROM labels lb LEFT JOIN documents d ON lb.doc_id = d.doc_id)"""


def _pred(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = table(spark, d, "labels").join(docs, "doc_id", "left")
    return j.select(
        "doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("toxic"), F.coalesce(F.col("n_chars") % 2 == 0, F.lit(False)).alias("pred"), F.coalesce(F.col("n_chars") % 101, F.lit(0)).alias("score")
    )


def _counts():
    t, p = F.col("truth"), F.col("pred")
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


_COUNTS = "count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn"
_PRF = "round(tp / greatest(1, tp + fp), 9) AS precision, round(tp / greatest(1, tp + fn), 9) AS recall, round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-12, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 9) AS f1"
_PRF0 = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"


def _prf(df, f=S.precision_recall):
    return [F.round(c, 9).alias(n) for n, c in f(F.col("tp"), F.col("fp"), F.col("fn")).items()]


@query(f"WITH {_PRED} SELECT {_COUNTS} FROM p")
def binary_counts(spark, d):
    return _pred(spark, d).agg(*_counts())


@query(f"WITH {_PRED}, c AS (SELECT {_COUNTS} FROM p) SELECT {_PRF} FROM c")
def prf1(spark, d):
    return _pred(spark, d).agg(*_counts()).select(*_prf(None))


@query(f"WITH {_PRED}, c AS (SELECT lang, {_COUNTS} FROM p GROUP BY lang) SELECT lang, {_PRF0} FROM c")
def prf1_zero(spark, d):
    return _pred(spark, d).groupBy("lang").agg(*_counts()).select("lang", *_prf(None, S.precision_recall_zero))


@query(f"WITH {_PRED}, c AS (SELECT lang, source, {_COUNTS} FROM p GROUP BY GROUPING SETS ((), (lang), (source))) SELECT lang, source, tp, fp, fn, tn, {_PRF0} FROM c")
def metrics_grouping_sets(spark, d):
    g = _pred(spark, d).groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(*_counts())
    return g.select("lang", "source", "tp", "fp", "fn", "tn", *_prf(None, S.precision_recall_zero))


@query(f"""WITH {_PRED}, c AS (SELECT lang, count(*) FILTER (truth) AS support, {_COUNTS} FROM p GROUP BY lang)
SELECT count(*) FILTER (support > 0) AS classes, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FILTER (support > 0), 9) AS macro_f1 FROM c""")
def macro_f1_supported(spark, d):
    c = _pred(spark, d).groupBy("lang").agg(*_counts()).withColumn("support", F.col("tp") + F.col("fn"))
    f1 = S.precision_recall_zero(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    return c.agg(F.count_if(F.col("support") > 0).alias("classes"), F.round(F.avg(F.when(F.col("support") > 0, f1)), 9).alias("macro_f1"))


_GUESS = "g AS (SELECT lang AS truth, CASE WHEN n_chars % 10 = 0 THEN 'other' WHEN n_chars % 10 < 3 THEN 'en' ELSE lang END AS guess FROM documents WHERE lang IS NOT NULL)"
_LANGS = ("de", "en", "es", "fr", "other")


def _guess(spark, d):
    k = F.col("n_chars") % 10
    return table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("truth"), F.when(k == 0, "other").when(k < 3, "en").otherwise(F.col("lang")).alias("guess"))


CONFUSION = f"WITH {_GUESS} SELECT truth, {', '.join(f'''count(*) FILTER (guess = '{x}') AS {x}''' for x in _LANGS)} FROM g GROUP BY truth"


@query(CONFUSION)
def confusion_matrix(spark, d):
    return _guess(spark, d).groupBy("truth").pivot("guess", list(_LANGS)).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""WITH {_GUESS}, c AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = guess) AS hit, count(*) FILTER (guess = 'other') AS blank FROM g GROUP BY truth)
SELECT cast(sum(n) AS BIGINT) AS n, cast(sum(hit) AS BIGINT) AS hit, round(sum(hit) / sum(n), 9) AS accuracy, round(avg(hit / n), 9) AS macro_recall, round(sum(blank) / sum(n), 9) AS blank_rate FROM c""")
def confusion_summary(spark, d):
    c = _guess(spark, d).groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("guess")).alias("hit"), F.count_if(F.col("guess") == "other").alias("blank"))
    s = c.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.sum("blank").alias("blank"), F.round(F.avg(F.col("hit") / F.col("n")), 9).alias("macro_recall"))
    return s.select("n", "hit", F.round(F.col("hit") / F.col("n"), 9).alias("accuracy"), "macro_recall", F.round(F.col("blank") / F.col("n"), 9).alias("blank_rate"))


_SWEEP = f"""t AS (SELECT cast(i AS BIGINT) AS threshold FROM generate_series({THRESHOLDS[0]}, {THRESHOLDS[-1]}, 5) AS g(i)),
s AS (SELECT {{key}} threshold, count(*) FILTER (truth AND score >= threshold) AS tp, count(*) FILTER (NOT truth AND score >= threshold) AS fp, count(*) FILTER (truth AND score < threshold) AS fn, count(*) FILTER (truth) AS support FROM p, t GROUP BY {{key}} threshold),
m AS (SELECT *, {_PRF} FROM s)"""


@query(f"WITH {_PRED}, {_SWEEP.format(key='')} SELECT threshold, tp, fp, fn, f1 FROM m ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1")
def threshold_sweep_best(spark, d):
    m = sweep(_pred(spark, d), [], "score", "truth")
    best = m.agg(F.max(F.struct("f1", "precision", "recall", "threshold", "tp", "fp", "fn")).alias("b"))
    return best.select("b.threshold", "b.tp", "b.fp", "b.fn", "b.f1")


@query(f"""WITH {_PRED}, {_SWEEP.format(key='lang,')}, ok AS (SELECT * FROM m WHERE support >= 5 AND precision >= 0.5),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold) AS r FROM ok)
SELECT l.lang, coalesce(b.threshold / 100, 1.1) AS threshold FROM (SELECT DISTINCT lang FROM p) l LEFT JOIN b ON l.lang = b.lang AND r = 1""")
def threshold_gated(spark, d):
    m = sweep(_pred(spark, d), ["lang"], "score", "truth")
    ok = (F.col("support") >= 5) & (F.col("precision") >= 0.5)
    best = m.groupBy("lang").agg(F.max(F.when(ok, F.struct("f1", (-F.col("threshold")).alias("back")))).alias("b"))
    return best.select("lang", F.coalesce(-F.col("b.back") / 100, F.lit(1.1)).alias("threshold"))


@query(f"""WITH {EVENTS} SELECT event_type, round(avg(abs(v - 2500)), 6) AS mean, round(quantile_cont(abs(v - 2500), 0.5), 6) AS median, round(quantile_cont(abs(v - 2500), 0.95), 6) AS p95 FROM events_x GROUP BY event_type""")
def error_percentiles(spark, d):
    e = F.abs(F.col("v") - 2500)
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg(e), 6).alias("mean"), F.round(F.percentile(e, 0.5), 6).alias("median"), F.round(F.percentile(e, 0.95), 6).alias("p95"))


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey % 20 AS note, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT k - 1 AS k, note, n FROM a),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.k = b.k AND a.note = b.note)
SELECT k AS l_orderkey, cast(sum(least(x, y)) AS BIGINT) AS common, cast(sum(greatest(x, y)) AS BIGINT) AS combined FROM j GROUP BY k""")
def multiset_overlap(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 20).alias("note"))
    return scoring.multiset_overlap(a, a.withColumn("l_orderkey", F.col("l_orderkey") - 1), ["l_orderkey"], ["note"])


@query("""WITH a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 10)) AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_partkey % 10)) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT a.k AS l_orderkey, a.s = b.s AS exact, len(list_intersect(a.s, b.s)) AS tp, len(b.s) - len(list_intersect(a.s, b.s)) AS fp, len(a.s) - len(list_intersect(a.s, b.s)) AS fn FROM a JOIN b ON a.k = b.k""")
def set_exact(spark, d):
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_partkey") % 10)))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(side("F").alias("a"), side("O").alias("b")).where("size(a) > 0 AND size(b) > 0")
    both = F.size(F.array_intersect("a", "b")).cast("long")
    return g.select("l_orderkey", (F.col("a") == F.col("b")).alias("exact"), both.alias("tp"), (F.size("b") - both).alias("fp"), (F.size("a") - both).alias("fn"))


@query("""WITH c AS (SELECT l_suppkey, cast(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, q AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, (q = 6) DESC, q DESC) AS r FROM c) WHERE r = 1""")
def modal_with_ties(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("q", F.struct("n", F.col("q") == 6, "q")).alias("mode"))


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AS muted, bool_or(l_discount > 0.09) AS bend, bool_or(l_returnflag = 'R' OR l_tax = 0 OR l_linenumber = 7) AS dead FROM lineitem GROUP BY l_orderkey""")
def flag_or(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("muted"), F.bool_or(F.col("l_discount") > 0.09).alias("bend"), F.bool_or((F.col("l_returnflag") == "R") | (F.col("l_tax") == 0) | (F.col("l_linenumber") == 7)).alias("dead"))


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS before_f, count(*) FILTER (CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END = 'F') AS after_f,
count(*) FILTER (o_orderstatus IS DISTINCT FROM CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END) AS changed FROM orders""")
def before_after_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return o.agg(F.count_if(F.col("a") == "F").alias("before_f"), F.count_if(F.col("b") == "F").alias("after_f"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


@query("""SELECT l_orderkey, count(*) AS notes, count(*) FILTER (l_quantity >= 10) AS two_digit, count(*) FILTER (l_returnflag = 'A') AS effects, cast(max(l_quantity) AS BIGINT) AS max_fret FROM lineitem GROUP BY l_orderkey""")
def corpus_stats(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("l_quantity") >= 10).alias("two_digit"), F.count_if(F.col("l_returnflag") == "A").alias("effects"), F.max("l_quantity").cast("long").alias("max_fret"))


@query("""SELECT l_linestatus, count(DISTINCT l_suppkey) AS sources, count(*) AS n, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_linestatus""")
def distinct_per_split(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.countDistinct("l_suppkey").alias("sources"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS q, round(sum(cast(l_quantity AS BIGINT)) / count(*), 9) AS ratio FROM lineitem GROUP BY ALL""")
def micro_rollup(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return g.withColumn("ratio", F.round(F.col("q") / F.col("n"), 9))


@query("""SELECT l_orderkey, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS total, cast(min(l_linenumber) AS INTEGER) AS exact_measures,
array_to_string(list_slice(list_distinct_ordered, 1, 3), ',') AS issues FROM (SELECT l_orderkey, l_quantity, l_linenumber, NULL AS x FROM lineitem) JOIN (
SELECT l_orderkey AS k, list(f ORDER BY first_line, f) AS list_distinct_ordered FROM (SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL) GROUP BY l_orderkey) ON k = l_orderkey GROUP BY l_orderkey, list_distinct_ordered""")
def merged_report(spark, d):
    pairs = F.array_sort(F.collect_set(F.struct("l_linenumber", "l_returnflag")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.min("l_linenumber").alias("exact_measures"), pairs.alias("p"))
    issues = F.slice(F.array_distinct(F.transform("p", lambda x: x["l_returnflag"])), 1, 3)
    return g.select("l_orderkey", "total", "exact_measures", F.array_join(issues, ",").alias("issues"))


@query("""WITH k AS (SELECT * FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) AS t(lang)), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), j AS (SELECT k.lang, coalesce(n, 0) AS n FROM k LEFT JOIN c ON k.lang = c.lang)
SELECT lang, n, round(CASE WHEN n = 0 THEN 0 ELSE least(10.0::DOUBLE, sqrt(max(n) OVER () / n)) END, 9) AS weight FROM j""")
def class_weights(spark, d):
    c = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # Five rows: the list of classes is a constant of the query.
    k = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    j = k.join(c, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max("n").over(W.partitionBy(F.lit(1)))
    return j.select("lang", "n", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(10.0), F.sqrt(top / F.col("n")))), 9).alias("weight"))


@query(f"""WITH {EVENTS} SELECT user_id, day, cast(sum(v * 1024) AS BIGINT) AS total, count(*) AS n FROM events_x WHERE event_type IN ('view', 'click') GROUP BY ALL""")
def measure_total(spark, d):
    return events(spark, d).where(F.col("event_type").isin("view", "click")).groupBy("user_id", "day").agg(F.sum(F.col("v") * 1024).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, c AS (SELECT day, count(*) FILTER (event_type = 'view') AS truth, count(*) FILTER (event_type = 'click') AS pred FROM events_x GROUP BY day)
SELECT count(*) AS pages, count(*) FILTER (truth = pred) AS exact_pages, cast(sum(abs(truth - pred)) AS BIGINT) AS abs_error, round(avg(CASE WHEN truth = pred THEN 1 ELSE 0 END), 9) AS exact_rate FROM c""")
def count_error(spark, d):
    c = events(spark, d).groupBy("day").agg(F.count_if(F.col("event_type") == "view").alias("t"), F.count_if(F.col("event_type") == "click").alias("p"))
    same = F.col("t") == F.col("p")
    return c.agg(F.count(F.lit(1)).alias("pages"), F.count_if(same).alias("exact_pages"), F.sum(F.abs(F.col("t") - F.col("p"))).alias("abs_error"), F.round(F.avg(same.cast("int")), 9).alias("exact_rate"))


_MASKED = """m AS (SELECT l_orderkey, l_returnflag <> 'R' AS visible, (l_partkey % 5 > 0) AS a, (l_suppkey % 4 > 0) AS b FROM lineitem)"""


@query(f"""WITH {_MASKED}, t AS (SELECT 'part' AS task, visible, a AS hit FROM m UNION ALL SELECT 'supplier', true, b FROM m), e AS (SELECT l_orderkey, bool_and(CASE WHEN visible THEN a ELSE true END AND b) AS exact FROM m GROUP BY l_orderkey)
SELECT task, count(*) FILTER (visible) AS support, round(avg(CASE WHEN hit THEN 1 ELSE 0 END) FILTER (visible), 9) AS accuracy FROM t GROUP BY task UNION ALL SELECT 'event', count(*), round(avg(CASE WHEN exact THEN 1 ELSE 0 END), 9) FROM e""")
def masked_accuracy(spark, d):
    m = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("visible"), (F.col("l_partkey") % 5 > 0).alias("a"), (F.col("l_suppkey") % 4 > 0).alias("b"))
    tasks = F.explode(F.array(F.struct(F.lit("part").alias("task"), "visible", F.col("a").alias("hit")), F.struct(F.lit("supplier").alias("task"), F.lit(True).alias("visible"), F.col("b").alias("hit"))))
    t = m.select(tasks.alias("t")).select("t.*").where("visible")
    one = lambda df, *k: df.agg(*k)
    part = one(t.groupBy("task"), F.count(F.lit(1)).alias("support"), F.round(F.avg(F.col("hit").cast("int")), 9).alias("accuracy"))
    e = m.groupBy("l_orderkey").agg(F.bool_and(F.when(F.col("visible"), F.col("a")).otherwise(F.lit(True)) & F.col("b")).alias("exact"))
    whole = e.agg(F.lit("event").alias("task"), F.count(F.lit(1)).alias("support"), F.round(F.avg(F.col("exact").cast("int")), 9).alias("accuracy"))
    return part.unionByName(whole)


@query(f"""WITH {_PRED} SELECT lang, count(*) FILTER (truth) AS positives, round(coalesce(avg(CASE WHEN score % 3 = doc_id % 3 THEN 1 ELSE 0 END) FILTER (truth), 0), 9) AS count_accuracy, round(avg(CASE WHEN score % 3 = doc_id % 3 THEN 1 ELSE 0 END), 9) AS all_accuracy,
count(*) FILTER (truth = pred AND score % 3 = doc_id % 3) AS joint_exact FROM p GROUP BY lang""")
def positive_count_accuracy(spark, d):
    same = F.col("score") % 3 == F.col("doc_id") % 3
    return _pred(spark, d).groupBy("lang").agg(
        F.count_if(F.col("truth")).alias("positives"), F.round(F.coalesce(F.avg(F.when(F.col("truth"), same.cast("int"))), F.lit(0.0)), 9).alias("count_accuracy"), F.round(F.avg(same.cast("int")), 9).alias("all_accuracy"), F.count_if((F.col("truth") == F.col("pred")) & same).alias("joint_exact")
    )


@query(f"WITH {_PRED} SELECT doc_id, lang, truth, pred FROM p WHERE truth IS DISTINCT FROM pred")
def error_rows(spark, d):
    return _pred(spark, d).where(~F.col("truth").eqNullSafe(F.col("pred"))).select("doc_id", "lang", "truth", "pred")


@query("""WITH s AS (SELECT l_orderkey AS beat, l_linenumber % 2 AS voice, l_suppkey % 6 AS string, bool_or(l_returnflag = 'R') AS dead, cast(avg(l_partkey) AS DOUBLE) AS x, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT beat, cast(count(*) AS BIGINT) AS notes, round(avg(x), 6) AS x, string_agg(string || CASE WHEN dead THEN 'X' ELSE '' END, ',' ORDER BY string, voice) AS strings FROM s GROUP BY beat""")
def symbols_to_events(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("beat"), (F.col("l_linenumber") % 2).alias("voice"), (F.col("l_suppkey") % 6).alias("string")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("dead"), F.avg("l_partkey").alias("x"))
    name = F.concat(F.col("string").cast("string"), F.when(F.col("dead"), "X").otherwise(""))
    g = s.groupBy("beat").agg(F.count(F.lit(1)).alias("notes"), F.round(F.avg("x"), 6).alias("x"), F.array_sort(F.collect_list(F.struct("string", "voice", name.alias("name")))).alias("l"))
    return g.select("beat", "notes", "x", F.array_join(F.transform("l", lambda v: v["name"]), ",").alias("strings"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber % 2) FILTER (l_returnflag <> 'R')), ',') AS voices FROM lineitem GROUP BY l_orderkey""")
def active_voices(spark, d):
    v = F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber") % 2)))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(v.alias("v"))
    return g.select("l_orderkey", F.when(F.size("v") > 0, F.array_join("v", ",")).alias("voices"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey % 10 AS r FROM lineitem WHERE l_linenumber <= 4), q AS (SELECT DISTINCT l_orderkey, l_partkey % 10 AS r FROM lineitem WHERE l_linenumber >= 3),
j AS (SELECT coalesce(t.l_orderkey, q.l_orderkey) AS k, t.r IS NOT NULL AS in_t, q.r IS NOT NULL AS in_q FROM t FULL JOIN q ON t.l_orderkey = q.l_orderkey AND t.r = q.r)
SELECT count(*) FILTER (in_t) AS truth, count(*) FILTER (in_q) AS predicted, count(*) FILTER (in_t AND in_q) AS correct, round(count(*) FILTER (in_t AND in_q) / greatest(1, count(*) FILTER (in_t)), 9) AS coverage FROM j""")
def relation_coverage(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 10).alias("r"), "l_linenumber")
    g = li.groupBy("l_orderkey", "r").agg(F.bool_or(F.col("l_linenumber") <= 4).alias("t"), F.bool_or(F.col("l_linenumber") >= 3).alias("q"))
    t, q = F.col("t"), F.col("q")
    s = g.agg(F.count_if(t).alias("truth"), F.count_if(q).alias("predicted"), F.count_if(t & q).alias("correct"))
    return s.withColumn("coverage", F.round(F.col("correct") / F.greatest(F.lit(1), F.col("truth")), 9))
