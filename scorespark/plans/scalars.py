"""Projections, filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.plans.base import BOXES, EVENTS, Registry, boxes, events, table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = 'Brand#1' AND p_type IN ('ECONOMY', 'SMALL') AND p_size BETWEEN 4 AND 40""")
def eligible_sources(spark, d):
    p = table(spark, d, "part")
    return p.where((F.col("p_brand") == "Brand#1") & F.col("p_type").isin("ECONOMY", "SMALL") & F.col("p_size").between(4, 40)).select("p_partkey", "p_name", "p_size")


@query("""SELECT l_orderkey, count(*) AS n_lines, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
GROUP BY l_orderkey HAVING count(*) BETWEEN 3 AND 6 AND sum(l_quantity) BETWEEN 60 AND 200""")
def gated_orders(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return g.where(F.col("n_lines").between(3, 6) & F.col("quantity").between(60, 200))


@query("""SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS content_id FROM documents""")
def content_id(spark, d):
    h = S.digest(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("sha256"), F.substring(h, 1, 16).alias("content_id"))


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, x * 2.0 AS px, y * 4.0 AS py, w * 2.0 AS pw, h * 4.0 AS ph, x * 2.0 + w * 2.0 AS px1, y * 4.0 + h * 4.0 AS py1 FROM boxes""")
def scaled_boxes(spark, d):
    b = boxes(spark, d).select("l_orderkey", "l_linenumber", (F.col("x") * 2.0).alias("px"), (F.col("y") * 4.0).alias("py"), (F.col("w") * 2.0).alias("pw"), (F.col("h") * 4.0).alias("ph"))
    return b.withColumns({"px1": F.col("px") + F.col("pw"), "py1": F.col("py") + F.col("ph")})


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, x, y, w, h FROM boxes WHERE w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > 120 OR y + h > 60""")
def invalid_boxes(spark, d):
    return boxes(spark, d).where("w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > 120 OR y + h > 60").select("l_orderkey", "l_linenumber", "x", "y", "w", "h")


@query(f"""WITH {EVENTS}, f AS (SELECT event_id, x, cast((x - 100.0) * 0.5 + 8.0 - (event_id % 4) * 16.0 AS DOUBLE) AS tile_x FROM events_x)
SELECT event_id, tile_x, abs((tile_x - 8.0 + (event_id % 4) * 16.0) / 0.5 + 100.0 - x) < 1e-5 AS ok FROM f""")
def tile_roundtrip(spark, d):
    e = events(spark, d).select("event_id", "x", ((F.col("x") - 100.0) * 0.5 + 8.0 - (F.col("event_id") % 4) * 16.0).alias("tile_x"))
    back = (F.col("tile_x") - 8.0 + (F.col("event_id") % 4) * 16.0) / 0.5 + 100.0
    return e.select("event_id", "tile_x", (F.abs(back - F.col("x")) < 1e-5).alias("ok"))


_RATIO_SQL = r"""SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 THEN n END AS num, CASE WHEN d > 0 THEN d END AS den FROM (
SELECT l_orderkey, l_linenumber, try_cast(regexp_extract(t, '^\s*(-?\d{1,9})\s*/\s*(\d{1,9})\s*$', 1) AS BIGINT) AS n,
try_cast(regexp_extract(t, '^\s*(-?\d{1,9})\s*/\s*(\d{1,9})\s*$', 2) AS BIGINT) AS d FROM (
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'x/4' WHEN 2 THEN concat(cast(l_quantity AS BIGINT), '/0') ELSE concat(cast(l_quantity AS BIGINT), '/', l_linenumber) END AS t FROM lineitem))"""


@query(_RATIO_SQL)
def parse_ratio(spark, d):
    q = F.col("l_quantity").cast("long").cast("string")
    t = F.when(F.col("l_linenumber") == 1, F.lit("x/4")).when(F.col("l_linenumber") == 2, F.concat(q, F.lit("/0"))).otherwise(F.concat(q, F.lit("/"), F.col("l_linenumber")))
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.ratio(t).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "r.num", "r.den")


_CODE = "event_id, cast(1 << (v % 8) AS BIGINT) AS note, cast(v % 3 AS BIGINT) AS dots, cast(1 + v % 7 AS BIGINT) AS enters, CASE WHEN v % 11 = 0 THEN 1000 END AS explicit"


@query(f"""WITH {EVENTS}, c AS (SELECT {_CODE} FROM events_x), n AS (SELECT *, CASE WHEN enters <= 1 THEN 1 WHEN enters = 3 THEN 2 WHEN enters <= 7 THEN 4 ELSE 8 END AS times FROM c),
r AS (SELECT *, 46126080 * CASE dots WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END * times AS top, note * CASE dots WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END * enters AS bottom FROM n)
SELECT event_id, note, dots, enters, cast(times AS BIGINT) AS times, cast(coalesce(explicit, CASE WHEN top % bottom = 0 THEN top // bottom END) AS BIGINT) AS ticks FROM r""")
def duration_ticks(spark, d):
    c = events(spark, d).selectExpr("event_id", "cast(shiftleft(1L, cast(v % 8 AS int)) AS long) AS note", "v % 3 AS dots", "1 + v % 7 AS enters", "CASE WHEN v % 11 = 0 THEN 1000L END AS explicit")
    c = c.withColumn("times", S.tuplet_normal(F.col("enters")).cast("long"))
    ticks = S.duration_ticks(F.col("note"), F.col("dots"), F.col("enters"), F.col("times"))
    return c.select("event_id", "note", "dots", "enters", "times", F.coalesce("explicit", ticks).alias("ticks"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 8 ELSE -1 END AS code FROM orders""")
def coded_priority(spark, d):
    codes = F.create_map(*[F.lit(x) for pair in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 4), ("4-NOT SPECIFIED", 8)) for x in pair])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(codes, F.col("o_orderpriority")), F.lit(-1)).alias("code"))


_VOICE = """SELECT l_orderkey, l_linenumber, state, CASE WHEN state = 'empty' THEN 0 ELSE note END AS note, CASE WHEN state = 'empty' THEN 'none' ELSE dot END AS dot FROM (
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'empty' WHEN l_linestatus = 'F' THEN 'rest' ELSE 'note' END AS state, cast(l_quantity AS BIGINT) AS note,
CASE WHEN l_discount >= 0.07 THEN 'double' WHEN l_discount >= 0.03 THEN 'single' ELSE 'none' END AS dot FROM lineitem)"""


def _voice(spark, d):
    state = F.when(F.col("l_returnflag") == "R", "empty").when(F.col("l_linestatus") == "F", "rest").otherwise("note")
    dot = F.when(F.col("l_discount") >= 0.07, "double").when(F.col("l_discount") >= 0.03, "single").otherwise("none")
    empty = F.col("state") == "empty"
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"), F.col("l_quantity").cast("long").alias("note"), dot.alias("dot"))
    return v.select("l_orderkey", "l_linenumber", "state", F.when(empty, F.lit(0)).otherwise(F.col("note")).alias("note"), F.when(empty, "none").otherwise(F.col("dot")).alias("dot"))


@query(_VOICE)
def normalised_voice(spark, d):
    return _voice(spark, d)


@query(f"""SELECT l_orderkey, l_linenumber, CASE state WHEN 'empty' THEN '-' WHEN 'rest' THEN concat('R', note, repeat('.', dots)) ELSE concat('N', note, repeat('.', dots)) END AS code
FROM (SELECT *, CASE dot WHEN 'double' THEN 2 WHEN 'single' THEN 1 ELSE 0 END AS dots FROM ({_VOICE}))""")
def short_code(spark, d):
    dots = F.when(F.col("dot") == "double", "..").when(F.col("dot") == "single", ".").otherwise("")
    code = F.when(F.col("state") == "empty", "-").when(F.col("state") == "rest", F.concat(F.lit("R"), "note", dots)).otherwise(F.concat(F.lit("N"), "note", dots))
    return _voice(spark, d).select("l_orderkey", "l_linenumber", code.alias("code"))


@query("""SELECT l_orderkey, l_linenumber, printf('o%d_p%03d_m%02d', l_orderkey, l_partkey % 1000, l_linenumber) AS sample_key FROM lineitem""")
def sample_key(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("o%d_p%03d_m%02d", "l_orderkey", F.col("l_partkey") % 1000, "l_linenumber").alias("sample_key"))


_URL = r"^https?://([^/.]+)\.([^/]+)/([a-z]+)/(\d+)"


@query(rf"""SELECT page_id, regexp_extract(url, '{_URL}', 1) AS host, lower(split_part(regexp_extract(url, '{_URL}', 2), '.', 1)) AS family, regexp_extract(url, '{_URL}', 3) AS section,
CASE WHEN regexp_matches(url, '{_URL}') THEN 'ok' ELSE 'no match' END AS status FROM pages""")
def url_group(spark, d):
    part = lambda i: F.regexp_extract("url", _URL, i)
    return table(spark, d, "pages").select("page_id", part(1).alias("host"), F.lower(F.split_part(part(2), F.lit("."), F.lit(1))).alias("family"), part(3).alias("section"), F.when(F.col("url").rlike(_URL), "ok").otherwise("no match").alias("status"))


@query("""SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS pos, l_linenumber, cast(l_quantity AS BIGINT) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def flatten_nested(spark, d):
    nested = _nested(spark, d)
    return nested.select("o_orderkey", F.posexplode("lines").alias("pos", "line")).select("o_orderkey", F.col("pos").cast("long").alias("pos"), "line.l_linenumber", F.col("line.l_quantity").cast("long").alias("quantity"))


def _nested(spark, d):
    """Orders with their lines nested, as song documents hold their events."""
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("lines"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")


@query("""SELECT l_orderkey AS o_orderkey, CASE WHEN bool_or(l_returnflag <> 'R' AND l_linestatus = 'O') THEN 'note' ELSE 'rest' END AS kind FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def event_kind(spark, d):
    sounding = F.exists("lines", lambda x: (x["l_returnflag"] != "R") & (x["l_linestatus"] == "O"))
    return _nested(spark, d).select("o_orderkey", F.when(sounding, "note").otherwise("rest").alias("kind"))


@query(f"""WITH {EVENTS} SELECT event_id, greatest(0, least(47, cast(trunc(value / 100.0 * 48) AS INTEGER))) AS bin, (greatest(0, least(47, cast(trunc(value / 100.0 * 48) AS INTEGER))) + 0.5) * 100.0 / 48 AS centre FROM events_x""")
def clamped_bin(spark, d):
    b = S.clamp_bin(F.col("value"), 100.0, 48)
    return events(spark, d).select("event_id", b.alias("bin"), ((b + F.lit(0.5)) * 100.0 / 48).alias("centre"))


@query("""SELECT l_orderkey, l_linenumber, midi, midi // 12 * 7 + [0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6][cast(midi % 12 AS INTEGER) + 1] AS step FROM (
SELECT l_orderkey, l_linenumber, cast([64, 59, 55, 50, 45, 40, 35][l_linenumber] + l_partkey % 25 + 12 AS BIGINT) AS midi FROM lineitem)""")
def pitch_position(spark, d):
    tuning, degree = F.array(*map(F.lit, (64, 59, 55, 50, 45, 40, 35))), F.array(*map(F.lit, (0, 0, 1, 1, 2, 3, 3, 4, 4, 5, 5, 6)))
    midi = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.element_at(tuning, F.col("l_linenumber")) + F.col("l_partkey") % 25 + 12).cast("long").alias("midi"))
    return midi.select("*", (F.expr("midi div 12") * 7 + F.element_at(degree, (F.col("midi") % 12).cast("int") + 1)).alias("step"))


@query("""SELECT p_partkey, cast(i - 1 AS INTEGER) AS pos, substr(cast(p_size AS VARCHAR), cast(i AS INTEGER), 1) AS digit FROM part, generate_series(1, 2) AS g(i) WHERE i <= length(cast(p_size AS VARCHAR)) AND p_size <> 13
UNION ALL SELECT p_partkey, 0, 'X' FROM part WHERE p_size = 13""")
def digit_symbols(spark, d):
    digits = F.when(F.col("p_size") == 13, F.array(F.lit("X"))).otherwise(F.filter(F.split(F.col("p_size").cast("string"), ""), lambda c: c != ""))
    return table(spark, d, "part").select("p_partkey", F.posexplode(digits).alias("pos", "digit"))


@query("""SELECT p_partkey, greatest(0, CASE WHEN p_size >= 32 THEN 3 WHEN p_size >= 16 THEN 2 WHEN p_size >= 8 THEN 1 ELSE 0 END) AS beams FROM part""")
def beam_count(spark, d):
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0), F.floor(F.log2("p_size")).cast("int") - 2).alias("beams"))


@query(r"""SELECT page_id, list_extract(list_filter(list_transform(regexp_extract_all(html, '=\s*"?(\d{2,3})\b', 1), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 20 AND 400), 1) AS first_number FROM pages""")
def first_number_in_text(spark, d):
    found = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r'=\s*"?(\d{2,3})\b'), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.between(20, 400))
    return table(spark, d, "pages").select("page_id", F.try_element_at(found, F.lit(1)).alias("first_number"))


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), t AS (SELECT doc_id, token, regexp_replace(token, '[()]', '', 'g') AS bare FROM w)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (token LIKE '(%)') AS tied, count(*) FILTER (lower(bare) = 'x') AS dead, count(*) FILTER (regexp_full_match(bare, '\d+') AND try_cast(bare AS INTEGER) <= 36) AS frets FROM t GROUP BY doc_id""")
def token_normalise(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")).withColumn("bare", F.regexp_replace("token", "[()]", ""))
    fret = F.col("bare").rlike(r"^\d+$") & (F.col("bare").try_cast("int") <= 36)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("token").like("(%)")).alias("tied"), F.count_if(F.lower("bare") == "x").alias("dead"), F.count_if(fret).alias("frets"))


@query("""SELECT doc_id, base64(encode(coalesce(nullif(split_part(text, chr(10), 1), ''), source, 'untitled'))) AS title FROM documents""")
def encoded_title(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    title = F.coalesce(F.when(first != "", first), "source", F.lit("untitled"))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode(title, "UTF-8")), "[\r\n]", "").alias("title"))


@query("""SELECT vec_id, list_extract(list_transform(o, lambda x: x.i), 1) AS top1, list_extract(list_transform(o, lambda x: x.i), 2) AS top2, list_extract(list_transform(o, lambda x: x.i), 3) AS top3 FROM (
SELECT vec_id, list_sort(list_transform(embedding, lambda v, i: {'n': -v, 'i': cast(i AS BIGINT)})) AS o FROM embeddings)""")
def vector_top3(spark, d):
    ranked = F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("n"), (i + 1).cast("long").alias("i"))))
    v = table(spark, d, "embeddings").select("vec_id", ranked.alias("o"))
    return v.select("vec_id", *[F.col("o")[k]["i"].alias(f"top{k + 1}") for k in range(3)])


_GRAMMAR = [(n, m) for m in (2, 4, 8) for n in range(2, 8)]


@query(f"""WITH g AS (SELECT * FROM (VALUES {", ".join(map(str, _GRAMMAR))}) AS t(num, den)), s AS (
SELECT vec_id, num, den, (abs(cast(embedding[num] AS DOUBLE)) + 0.01::DOUBLE) * (abs(cast(embedding[den] AS DOUBLE)) + 0.01::DOUBLE) AS p FROM embeddings, g)
SELECT vec_id, cast(num AS INTEGER) AS num, cast(den AS INTEGER) AS den FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, num, den) AS r FROM s) WHERE r = 1""")
def grammar_best_match(spark, d):
    # The grammar is a literal of 18 rows: scored inside each row, so nothing is joined or shuffled.
    grammar = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(m).alias("den")) for n, m in _GRAMMAR])
    p = lambda k: F.abs(F.element_at("embedding", k)).cast("double") + 0.01
    best = F.array_min(F.transform(grammar, lambda g: F.struct((-(p(g["num"]) * p(g["den"]))).alias("cost"), g["num"].alias("num"), g["den"].alias("den"))))
    return table(spark, d, "embeddings").select("vec_id", best.alias("b")).select("vec_id", "b.num", "b.den")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN cast(l_quantity AS BIGINT) END AS value, round(l_discount * 10, 6) AS confidence,
CASE WHEN l_returnflag <> 'N' AND l_tax > 0.04 THEN 'tax' END AS override FROM lineitem""")
def compact_prediction(spark, d):
    head = F.struct(F.when(F.col("l_returnflag") == "N", "empty").otherwise("note").alias("state"), F.col("l_quantity").cast("long").alias("value"), F.round(F.col("l_discount") * 10, 6).alias("confidence"), (F.col("l_tax") > 0.04).alias("over"))
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", head.alias("h"))
    sounding = F.col("h.state") != "empty"
    return v.select("l_orderkey", "l_linenumber", F.when(sounding, F.col("h.value")).alias("value"), "h.confidence", F.when(sounding & F.col("h.over"), "tax").alias("override"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 3 = 1 THEN 99 END, 0) AS value,
concat_ws(';', CASE WHEN c_custkey % 3 <> 0 THEN 'not supplied' END, CASE WHEN c_custkey % 3 = 2 THEN 'standard assumed' END) AS log FROM customer""")
def default_with_log(spark, d):
    k = F.col("c_custkey") % 3
    supplied, stored = F.when(k == 0, F.col("c_nationkey")), F.when(k == 1, F.lit(99))
    log = F.array_compact(F.array(F.when(supplied.isNull(), "not supplied"), F.when(F.coalesce(supplied, stored).isNull(), "standard assumed")))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(supplied, stored, F.lit(0)).alias("value"), F.array_join(log, ";").alias("log"))
