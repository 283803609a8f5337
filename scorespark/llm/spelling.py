"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie kept as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import saved

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the longest words that go into the trie: one bit of a long for each length that may be left.
DEPTH = 64
#: Rows of a step from which hot nodes are told apart.
HOT_FROM = 100_000


def spelled(docs: DataFrame, one_in: int = 199) -> DataFrame:
    """(word, n): the runs of letters of all whole texts in lower case, a code point deleted where the crc32 of
    `doc_id:run` is divisible by one_in, and how often each result occurs."""
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    ascii = F.octet_length("run") == F.char_length("run")
    runs = runs.withColumn("run", F.when(ascii, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    word = F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def trie(words: DataFrame) -> DataFrame:
    """Edges of the trie of words: node (the string that leads to it), depth, sign, and of the words below: how many, which
    numbers of code points are left after the sign (bits), and which signs come next (bits of their code modulo 64).

    Each word ends with an edge of the empty sign.
    """
    places = words.select("word", F.explode(F.expr("sequence(0, char_length(word))")).alias("depth"))
    edges = places.selectExpr(
        "depth",
        "left(word, depth) AS node",
        "substring(word, depth + 1, 1) AS sign",
        "if(depth = char_length(word), 0L, shiftleft(1L, char_length(word) - depth - 1)) AS lengths",
        "shiftleft(1L, ascii(substring(word, depth + 2, 1)) % 64) AS nexts",
    )
    edges = edges.groupBy("depth", "node", "sign").agg(F.bit_or("lengths").alias("lengths"), F.bit_or("nexts").alias("nexts"), F.count(F.lit(1)).alias("words"))
    return edges.sortWithinPartitions("depth", "node")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all words, of DEPTH (64, the bits of a long) code points at most, that are one replaced or deleted code point apart; each pair once,
    the longer or smaller word first.

    A state is (word, place in it, node, edits). Level by level states take the edges of their nodes: the edge of the
    word's own sign; without an edit so far also every edge of a greater sign (replaced; the smaller sign is found from the
    other word), or the edge of the sign after the next (deleted; of a run of equal signs the last). Insertions are the
    deletions of the other word. A state that takes the edge of the empty sign with one edit is a pair. States stop where
    no word below has the length that is left or the sign that comes next, and without an edit where a word is alone.

    States without edits are joined by node, those with one by node and sign. Nodes with more than a thousandth of the
    states are fewer than a thousand, each with fewer edges than the alphabet has signs: they are broadcast.
    """
    edges = saved(trie(words), "trie")
    own = words.select("word", F.lit(0).alias("at"), F.lit("").alias("node"))
    moved, pairs, depth = None, [], 0
    while own is not None or moved is not None:
        level = edges.where(F.col("depth") == depth).drop("depth")
        steps = []
        if own is not None:
            steps += [_first_edits(own, level)]
        if moved is not None:
            steps += [_same_signs(moved, level)]
        taken = saved(reduce(DataFrame.unionByName, steps), "frontier")
        pairs.append(taken.where("edits = 1 AND sign = ''").selectExpr("word AS a", "node AS b"))
        own, moved = taken.where("edits = 0"), taken.where("edits = 1 AND sign <> ''")
        left = {r[0] for r in taken.where("sign <> ''").groupBy("edits").count().collect()}
        own, moved, depth = own if 0 in left else None, moved if 1 in left else None, depth + 1
    return reduce(DataFrame.unionByName, pairs)


#: A word below the edge has as many code points left as the state, and its next sign. The state is at place `{at}` after it.
FITS = "(sign = '' OR (shiftright(lengths, char_length(word) - ({at})) & 1) = 1 AND (shiftright(nexts, ascii(substring(word, ({at}) + 1, 1)) % 64) & 1) = 1)"


def _first_edits(own: DataFrame, level: DataFrame) -> DataFrame:
    """Steps of states without an edit, which are at their own prefix; so the words below a node are its states."""
    total = own.count()
    here, after = "substring(word, at + 1, 1)", "substring(word, at + 2, 1)"
    below = level.groupBy("node").agg(F.sum("words").alias("_n")) if total > HOT_FROM else None
    met = _meet(own.select("word", "at", "node"), level, ["node"], below, total)
    moves = f"""filter(array(
        if(sign = {here} AND sign <> '' AND words > 1, struct(at + 1 AS at, 0 AS edits), null),
        if(sign > {here} AND {here} <> '' AND {FITS.format(at="at + 1")}, struct(at + 1 AS at, 1 AS edits), null),
        if(sign = {after} AND {here} <> '' AND {here} <> {after} AND {FITS.format(at="at + 2")}, struct(at + 2 AS at, 1 AS edits), null)
    ), m -> m IS NOT NULL)"""
    met = met.where(f"sign >= {here} OR sign = {after}")
    return met.select("word", "node", "sign", "words", F.explode(F.expr(moves)).alias("m")).selectExpr("word", "m.at AS at", "concat(node, sign) AS node", "m.edits AS edits", "sign", "words")


def _same_signs(moved: DataFrame, level: DataFrame) -> DataFrame:
    """Steps of states with an edit: only along the word's own signs."""
    states = moved.select("word", "at", "node", F.expr("substring(word, at + 1, 1)").alias("sign"))
    total = states.count()
    counts = states.groupBy("node", "sign").agg(F.count(F.lit(1)).alias("_n")) if total > HOT_FROM else None
    met = _meet(states, level, ["node", "sign"], counts, total)
    return met.where(FITS.format(at="at + 1")).selectExpr("word", "at + 1 AS at", "concat(node, sign) AS node", "1 AS edits", "sign", "words")


def _meet(states: DataFrame, level: DataFrame, on: list[str], counts: DataFrame | None, total: int) -> DataFrame:
    if counts is None:
        return states.join(level, on)
    hot = saved(counts.where(F.col("_n") * 1000 > total).select(*on), "hot")
    stay = states.join(F.broadcast(level.join(F.broadcast(hot), on)), on)
    return stay.unionByName(states.join(F.broadcast(hot), on, "left_anti").join(level.join(F.broadcast(hot), on, "left_anti"), on))


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _hashes(word: str) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Hash of a word, a polynomial modulo 2^64, and of the word without each of its code points; and whether each is the
    last of a run of equal ones, so that the word without it is another than without the next."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(codes) - 1, BASE))))
        upto = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * powers, dtype=np.uint64)))
        return upto[-1], upto[:-1] + (upto[-1] - upto[1:]) * INVERSE, np.append(codes[1:] != codes[:-1], True)


def _without_one(depth: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, word in zip(batch["row"].to_pylist(), batch["word"].to_pylist(), strict=True):
                whole, parts, ends = _hashes(word)
                yield pa.RecordBatch.from_pydict({"row": [row], "at": pa.array([-1], pa.int32()), "h": pa.array([int(whole.astype(np.int64))], pa.int64()), "ends": [True]})
                for k in range(0, len(parts) if len(word) > depth else 0, 50_000):
                    h = parts[k : k + 50_000].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(h), row)), "at": pa.array(np.arange(k, k + len(h), dtype=np.int32)), "h": pa.array(h), "ends": pa.array(ends[k : k + 50_000])})

    return each


def long_pairs(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """near_pairs() of words where one has more than depth code points, for which a trie is too deep: words that are equal
    without the code point at one place, or that another is without one of its. Each word gives a row of 20 bytes for each
    code point; hashes only propose, the words themselves decide."""
    rows = saved(words.where(F.char_length("word") >= depth).select(F.monotonically_increasing_id().alias("row"), "word"), "long")
    parts = saved(rows.mapInArrow(_without_one(depth), "row long, at int, h long, ends boolean"), "parts")
    shorter, whole = parts.where("at >= 0"), parts.where("at < 0").selectExpr("row AS b", "h")
    one, other = (shorter.select(F.col("row").alias(side), "at", "h") for side in "ab")
    found = one.join(other, ["at", "h"]).where("a <> b").selectExpr("a", "b", "at", "true AS replaced")
    found = found.unionByName(shorter.where("ends").select(F.col("row").alias("a"), "at", "h").join(whole, "h").selectExpr("a", "b", "at", "false AS replaced"))
    for side in "ab":
        found = found.join(rows.select(F.col("row").alias(side), F.col("word").alias(f"word_{side}")), side)
    cut = "left({0}, at) = left({1}, at) AND substring({0}, at + 2) = substring({1}, at + {2})"
    same = f"if(replaced, word_a < word_b AND char_length(word_a) = char_length(word_b) AND {cut.format('word_a', 'word_b', 2)}, char_length(word_a) = char_length(word_b) + 1 AND {cut.format('word_a', 'word_b', 1)})"
    return found.where(same).selectExpr("word_a AS a", "word_b AS b").distinct()


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, depth: int = DEPTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least least_length code points and least_count occurrences.

    Two words are near that differ by one inserted, deleted or replaced code point. form is a word's near word with the
    largest n, of equal ones the smallest, if its n is at least `times` the word's; root is where following forms ends.

    Null text has no words; a null doc_id counts as an empty string in the deletions; repeated rows count each; other
    columns are ignored; an empty table gives an empty result. Words of any length are compared: those beyond depth
    (DEPTH at most) by `long_pairs`. A word's near words are fewer than 182 for each of its code points, however common they are.
    """
    words = saved(spelled(docs).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "words")
    pairs = near_pairs(words.where(F.char_length("word") <= depth))
    if not words.where(F.char_length("word") > depth).isEmpty():
        pairs = pairs.unionByName(long_pairs(words, depth))
    both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    told = both.join(words.selectExpr("word AS b", "n AS m"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    told = words.join(told.withColumnRenamed("a", "word"), "word", "left")
    follows = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best"))
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), follows["b"].alias("form"), (-follows["m"]).alias("form_n")), "near")

    # n grows by the factor `times` from form to form, so there are few levels.
    level, roots = told.where("form IS NULL").selectExpr("word", "word AS root"), []
    while not level.isEmpty():
        roots.append(level)
        level = saved(told.where("form IS NOT NULL").select("word", "form").join(level.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
    root = reduce(DataFrame.unionByName, roots) if roots else level
    return told.join(root, "word").select("word", "form", "root", "n", "n_near", "form_n")
