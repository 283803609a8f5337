"""License scan by ordered signature rules, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorespark.llm.license_rules import GENERIC, GRANT, NAMED, TAG, VERSIONED, rules

#: Phrases that are always reported, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WEIGHT = {TAG: 1.0, GRANT: 0.95, VERSIONED: 0.85, NAMED: 0.6, GENERIC: 0.2}

_LONGEST_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


#: A place where a rule matches: its words are start .. end - 1.
_PLACE = "struct<start:int,end:int,rule:int,tier:int,label:string,version:string>"
#: Stands before the first word of a match; texts are free of it by then.
_MARK = "\x01"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(text: Column, rule: Column) -> Column:
    """All places of a rule, in order. The words of the text are numbered once, whatever the number of matches."""
    none = F.array().cast(f"array<{_PLACE}>")

    def of(found: Column) -> Column:
        words = F.split(F.regexp_replace(text, rule["pattern"], F.lit(_MARK + "$0")), F.lit(" "))
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)), lambda i: i.isNotNull())
        version = lambda m: F.when(rule["tier"].isin(TAG, VERSIONED), F.nullif(F.replace(F.regexp_extract(m, r"(\d+(?: \d+)*)", 1), F.lit(" "), F.lit(".")), F.lit("")))
        one = lambda s, m: F.struct(s.alias("start"), (s + _spaces(m) + 1).alias("end"), rule["rule"].alias("rule"), rule["tier"].alias("tier"), rule["label"].alias("label"), version(m).alias("version"))
        return F.zip_with(starts, found, one).cast(f"array<{_PLACE}>")

    return _let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, of(found)).otherwise(none))


def _uncontained(found: Column) -> Column:
    """The places that no other contains which is of the same or a stronger tier; of equal places in a tier, the rule that
    comes first stays.

    One pass in order of start, with the farthest end of each tier so far. What is kept is gathered in blocks of about
    the root of their number, so that no long array is copied for each place.
    """
    reach, kept = F.array(*[F.lit(-1)] * len(WEIGHT)), F.array().cast(f"array<{_PLACE}>")

    def step(acc: Column, x: Column) -> Column:
        inside = F.exists(F.slice(acc["reach"], 1, x["tier"] + 1), lambda r: r >= x["end"])
        far = F.transform(acc["reach"], lambda r, i: F.when((i == x["tier"]) & (x["end"] > r), x["end"]).otherwise(r))
        return F.struct(far.alias("reach"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(x["place"]))).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["reach"].alias("reach"), kept.alias("out")), step)
        return _let(inner, lambda got: F.struct(got["reach"].alias("reach"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    def in_order(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / size).cast("int")), lambda k: F.slice(xs, k * size + 1, size))
        zero = F.struct(reach.alias("reach"), F.array().cast(f"array<array<{_PLACE}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, zero, block)["out"])

    order = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["rule"].alias("rule"), x["tier"].alias("tier"), x["end"].alias("end"), x.alias("place")))
    return F.when(F.size(found) > 0, _let(F.array_sort(order), in_order)).otherwise(kept)


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences named or quoted in each whole text.

    Input: doc_id, text; other columns are ignored. Output for each row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections (array of start, end, rule, tier, label, version: those that are not suppressed).

    Null text counts as empty: no words, null positions, empty labels, score 0. Repeated rows give repeated results.

    Words are joined by single blanks and patterns run over that. A rule runs only where the text has its gate, a word
    that each of its matches contains. All its places become intervals of words, and what a place of the same or a stronger
    tier contains is suppressed. score is the largest weight of what is left. Nothing is shuffled, and the work for a text
    grows about with its words, whatever it matches.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), upper, lower), _LONGEST_RUN, " "))
    d = docs.select("doc_id", words.alias("w"))
    d = d.select("doc_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("t"), F.when(F.col("w") == "", F.lit(0)).otherwise(_spaces(F.col("w")) + 1).cast("long").alias("n_words"))

    every = [(n, *r) for n, r in enumerate(rules())]
    gates = F.array(*[F.lit(g) for g in sorted({r[3] for r in every})])
    row = lambda n, tier, label, gate, p: F.struct(F.lit(n).alias("rule"), F.lit(tier).alias("tier"), F.lit(label).alias("label"), F.lit(gate).alias("gate"), F.lit(_bounded(p)).alias("pattern"))
    table, base = F.array(*[row(*r) for r in every]), F.array(*[row(-1, -1, label, phrase, phrase) for phrase, label in BASE])
    found = lambda rs: F.flatten(F.transform(rs, lambda r: _places(F.col("t"), r)))
    none = F.array().cast(f"array<{_PLACE}>")
    d = d.withColumn("k", F.array_intersect(F.split("t", " "), gates))
    d = d.withColumn("b", F.when(F.contains("t", F.lit(" license ")), found(F.filter(base, lambda r: F.contains(F.col("t"), r["gate"])))).otherwise(none))
    d = d.withColumn("f", F.when(F.size("k") > 0, found(F.filter(table, lambda r: F.array_contains(F.col("k"), r["gate"])))).otherwise(none))
    d = d.withColumn("s", _uncontained(F.col("f")))
    weight = F.array(*[F.lit(WEIGHT[i]) for i in range(len(WEIGHT))])
    labels_of = lambda c: F.transform(c, lambda x: x["label"])
    starts = F.transform("b", lambda x: x["start"])
    return d.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels_of("b"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels_of("b"), labels_of("s"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("s", lambda x: F.element_at(weight, x["tier"] + 1))), F.lit(0.0)).alias("score"),
        F.col("s").alias("detections"),
    )


def _plain(pattern: str) -> str:
    """pattern for words that have two blanks between them, of which a match takes one on either side: for an engine that
    cannot look around."""
    return " (" + pattern.replace(" ?", "(?:@)?").replace(" ", "  ").replace("@", "  ") + ") "


def sql() -> str:
    """The scan in DuckDB: all places of all rules, less those that another contains."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ",\n".join(f"({n}, {tier}, {quoted(label)}, {quoted(gate)}, {quoted(_plain(p))})" for n, (tier, label, gate, p) in enumerate(rules()))
    base = ", ".join(f"({-1 - n}, -1, {quoted(label)}, {quoted(phrase.split()[0])}, {quoted(_plain(phrase))})" for n, (phrase, label) in enumerate(BASE))
    weights = " ".join(f"WHEN {t} THEN {w}::DOUBLE" for t, w in WEIGHT.items())
    return f"""
WITH rules(n, tier, label, gate, pattern) AS (VALUES {base},
{table}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), t AS (
  SELECT r, ' ' || array_to_string(ws, '  ') || ' ' AS t, list_distinct(ws) AS own FROM d
), m AS (
  SELECT r, n, tier, label, regexp_extract_all(t, pattern) AS found, string_split(regexp_replace(t, pattern, ' ' || chr(1) || '\\1 ', 'g'), '  ') AS words FROM t JOIN rules ON list_contains(own, gate) WHERE regexp_matches(t, pattern)
), z AS (
  SELECT r, n, tier, label, found, list_filter(range(1, len(words) + 1), lambda i: contains(words[i], chr(1))) AS starts FROM m
), f AS (
  SELECT r, n, tier, label, unnest(starts) - 1 AS s, unnest(list_transform(found, lambda x: len(string_split(trim(x), '  ')))) AS size FROM z
), b AS (
  SELECT r, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS ls FROM f WHERE tier < 0 GROUP BY r
), kept AS (
  SELECT * FROM f a WHERE tier >= 0 AND NOT EXISTS (SELECT 1 FROM f e WHERE e.r = a.r AND e.tier BETWEEN 0 AND a.tier AND e.s <= a.s AND e.s + e.size >= a.s + a.size AND (e.s < a.s OR e.s + e.size > a.s + a.size OR e.n < a.n))
), k AS (
  SELECT r, list(DISTINCT label) AS ls, max(CASE tier {weights} END) AS score FROM kept GROUP BY r
)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(k.ls, [])))), ',') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""
