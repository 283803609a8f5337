"""The training-data operators against brute force, on the smallest tables and on a table of odd cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorespark.llm import automaton, bpe, counts, embeddings, exact, langid, license, packing, queries, simhash, substring, suffix, tokens

LONG = "".join(f"palabra{i} " for i in range(3000))
PASSAGE = "the same passage of rather many words stands in more than one document and goes on for quite a while " * 3
ODD = [
    (1, "Hello  World", "en", "a"),
    (2, "hello world", "en", "a"),
    (3, "Hello\tWor ld", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", None, None),
    (7, LONG, "es", "b"),
    (8, LONG, "es", "b"),
    (9, "start " + PASSAGE + " end of nine", "en", "a"),
    (10, "other words before " + PASSAGE, "en", "a"),
    (11, "ends <|endoftext|> here\x1cand it's 12 o'clock 　  x", "en", "c"),
    (11, "ends <|endoftext|> here\x1cand it's 12 o'clock 　  x", "en", "c"),
    (None, "no id, same text", "de", "c"),
    (None, "no id, same text", "de", "c"),
    (12, "a" * 5000, None, "c"),
    (13, "éèà ñ 日本語 \U0001f600 mixed", "fr", "d"),
    (14, "Licensed under the Apache License, Version 2.0. MIT license! MIT licenses, MIT License", "en", "d"),
    (15, "GNU General Public License v3; SPDX-License-Identifier: GPL-3.0-only", "en", "d"),
    (16, "1234 5678 !!!", None, "d"),
]
COLUMNS = "doc_id long, text string, lang string, source string, digest int, row int, fp string, _rid int, label string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Read from files, as the operators ask for; with further columns whose names they might use themselves."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(*r, k, k, "x", k, "y") for k, r in enumerate(ODD)], COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet'").fetchall())


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


ON_DOCS = {
    "simhash": simhash.simhash_dedup,
    "substring": substring.substring_dedup,
    "packing": packing.pack,
    "exact": exact.exact_dedup,
    "suffix": suffix.suffix_dedup,
    "license": license.license_scan,
    "language": lambda d: langid.identify_language(d, sample_rows=100),
    "bpe": bpe.bpe_digests,
    "counts": counts.token_counts,
    "automaton": automaton.automaton_digests,
    "no exact copies": exact.drop_exact_copies,
    "no near copies": simhash.drop_near_copies,
    "identified": langid.keep_identified,
    "cut": substring.cut_repeats,
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_table(none, name):
    assert ON_DOCS[name](none).count() == 0


@pytest.mark.parametrize("name", [n for n in ON_DOCS if n not in {"packing", "no exact copies", "no near copies", "identified", "cut"}])
def test_odd_rows_all_come_back(odd, name):
    got = sorted(str(r[0]) for r in ON_DOCS[name](odd).select("doc_id").collect())
    assert got == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", ["no exact copies", "no near copies", "identified", "cut"])
def test_filters_keep_all_columns(odd, name):
    got = ON_DOCS[name](odd)
    assert got.columns == odd.columns
    kept = {r["digest"]: r for r in got.collect()}
    for r in odd.collect():
        if r["digest"] in kept and name != "cut":
            assert kept[r["digest"]] == r


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=str)


@pytest.mark.parametrize("chars", [64, 1])
def test_exact_odd_rows(odd, chars):
    """With one digit of the digest most rows are hits whose bytes differ: verification has to tell them apart."""
    got = exact.exact_dedup(odd, digest_chars=chars).collect()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in ODD:
        groups[hashlib.sha256(strip(t).encode()).hexdigest()].append((-len(t or ""), i is None, i))
    assert len(got) == len(ODD)
    assert sum(r["kept"] for r in got) == len(groups)
    for r in got:
        g = groups[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]


@pytest.mark.parametrize("chars, fanout", [(64, 2), (1, 3), (64, 9)])
def test_exact_batches_equal_one(odd, spark, tmp_path, chars, fanout):
    """Five batches, merged through several levels, give what one gives; doc_id and text decide, not the batch."""
    for k in range(5):
        odd.where(F.pmod(F.xxhash64("row"), F.lit(5)) == k).write.parquet(str(tmp_path / str(k)))
    batches = [spark.read.parquet(str(tmp_path / str(k))) for k in range(5)]
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    key = lambda rows: sorted(map(str, rows))
    one = exact.exact_dedup(odd, digest_chars=chars).collect()
    got = exact.exact_dedup(*batches, digest_chars=chars, fanout=fanout).collect()
    assert key([r[c] for c in columns] for r in got) == key([r[c] for c in columns] for r in one)
    kept = lambda rows: key((r["doc_id"], r["text_sha256"]) for r in rows if r["kept"])
    assert kept(got) == kept(one)


def test_exact_index_has_runs_levels_and_filters(spark, tmp_path):
    """Runs and levels are counted, and what the filters let through as hits."""
    entries = lambda lo, hi, runs: spark.range(lo, hi).selectExpr("id AS doc_id", "0 AS batch", "id AS _rid", "1L AS n_cp", f"cast(id % {runs} AS int) AS run", "sha2(cast(id AS string), 256) AS digest")
    index = exact.DigestIndex(fanout=3)
    index.count = True
    index.add(entries(0, 2000, 10))  # ten memtables: three merges, then one of those
    assert [level.runs for level in index.levels] == [1, 0, 1] and index.merges == 4
    assert index.hits < 100 < 3000 < index.misses  # no digest is in two runs: a hit is a filter's error
    index.hits = index.misses = 0
    index.add(entries(1990, 4000, 2))  # ten digests again: the left-over run and the two new ones are merged
    assert [level.runs for level in index.levels] == [0, 1, 1] and index.merges == 5
    got = index.rows()
    assert got.count() == 4000 and got.where("group_size = 2").count() == 10 and index.hits < 200
    assert got.where("group_size = 2").selectExpr("min(best.doc_id)", "max(best.doc_id)").first() == (1990, 1999)
    index.add(spark.range(0).selectExpr("id AS doc_id", "0 AS batch", "id AS _rid", "1L AS n_cp", "0 AS run", "'' AS digest"))
    assert index.rows().count() == 4000


def test_exact_query_goes_through_the_index(spark, sf_dir, tmp_path, monkeypatch):
    """A table of many parts is many runs on more than one level, and gives what SQL gives."""
    path, seen, add = str(tmp_path / "documents"), [], exact.DigestIndex.add
    spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.01/documents.parquet").repartition(20).write.parquet(path)
    monkeypatch.setattr(exact.DigestIndex, "add", lambda self, e: (seen.append(self), add(self, e)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a task for each file
    try:
        got = [tuple(r) for r in exact.exact_dedup(spark.read.parquet(path), fanout=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert [level.runs for level in seen[0].levels] == [2, 0, 2] and seen[0].merges >= 8
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(got) == sorted(con.execute(exact.SQL).fetchall())


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, sf_dir, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids, group = sorted(prints), {}
    for i in ids:
        if i not in group:
            todo, group[i] = [i], i
            while todo:
                p = prints[todo.pop()]
                for j in ids:
                    if j not in group and (prints[j] ^ p).bit_count() <= 3:
                        group[j] = i
                        todo.append(j)
    got = {r[0]: (r[1], r[2]) for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in ids}


def test_simhash_tiles_lose_nothing(spark):
    """A hot bucket, in tiles of a few rows, gives the same components as all pairs."""
    rng = np.random.default_rng(5)
    prints = sorted({int(0xABCDEF0123456789 ^ sum(1 << int(b) for b in rng.choice(24, 4, replace=False))) for _ in range(150)})
    links = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    whole = simhash.BitSlices(prints, list(range(64)))
    for i, p in enumerate(prints):
        near = whole.near(p)
        assert {j for j in range(len(prints)) if near >> j & 1} == {j for j in range(len(prints)) if (prints[j] ^ p).bit_count() <= 3}
    wide = simhash.BitSlices(prints, list(range(64)), 5)
    assert all((wide.near(prints[0]) >> j & 1) == ((prints[j] ^ prints[0]).bit_count() <= 5) for j in range(len(prints)))
    assert links


def test_near_texts(spark, tmp_path):
    """Similarity of five-word shingles of 0.8 or more links; less does not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[1:]])), (3, " ".join(words[:200] + [f"v{i}" for i in range(200)])), (4, " ".join([*words[:100], "new", *words[101:]])), (5, "alone")]
    spark.createDataFrame(rows, "row long, text string").write.parquet(str(tmp_path / "near"))
    docs = spark.read.parquet(str(tmp_path / "near"))
    got = {r["row"]: r["label"] for r in simhash.near_texts(docs, slot=2).collect()}
    assert got == {1: 1, 2: 1, 4: 1}


def test_near_texts_with_repeats(spark, tmp_path):
    """Sets decide: a line repeated many more times moves fingerprints far apart and yet links."""
    rows, apart = [], []
    for k in range(60):
        words, line = [f"u{k}x{i}" for i in range(400)], " ".join(f"l{k}x{i}" for i in range(12))
        pair = [" ".join([*words, *[line] * n]) for n in (1, 60)]
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        apart.append((simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count())
    assert sum(x > 22 for x in apart) > 10
    spark.createDataFrame(rows, "row long, text string").write.parquet(str(tmp_path / "near"))
    got = {r["row"]: r["label"] for r in simhash.near_texts(spark.read.parquet(str(tmp_path / "near"))).collect()}
    assert got == {r: r // 2 * 2 for r, _ in rows}


def test_near_texts_blocks_and_tiles_lose_nothing():
    """Pairs just over 0.8, short and long, share a block; a tile links what all pairs of sets link."""
    rng = np.random.default_rng(5)
    for n in (9, 90, 900):
        for _ in range(700):
            h = rng.integers(0, 1 << 63, n, np.uint64)
            a, b = simhash._least(h[: n * 17 // 18]), simhash._least(h[-(n * 17 // 18) :])
            assert any(a[2 * k : 2 * k + 2] == b[2 * k : 2 * k + 2] for k in range(simhash.BANDS))
    base = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64).astype("<u8"))
    sets = [np.sort(rng.choice(base[: 40 * (1 + k % 4)], 30 * (1 + k % 4) + k % 7, replace=False)) for k in range(120)]
    run = pd.DataFrame({"row": range(120), "shingles": [x.tobytes() for x in sets]})
    want, got = list(range(120)), list(range(120))

    def link(label, a, b):
        low, high = sorted((label[a], label[b]))
        label[:] = [low if x == high else x for x in label]

    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                link(want, i, j)
    for a, b in simhash._similar_in_tile(0.8)(run).itertuples(index=False):
        link(got, a, b)
    assert got == want and 1 < len(set(want)) < 120


def brute_suffix(texts, length):
    count = collections.Counter(r[i : i + length] for r in texts for i in range(len(r) - length + 1))
    out = []
    for r in texts:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                cover[i : i + length] = True
        left = bytes(x for x, c in zip(r, cover, strict=False) if not c)
        runs = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(cover.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_matches_brute_force(spark, sf_dir, texts):
    want = dict(zip(texts, brute_suffix([t.encode() for t in texts.values()], 200), strict=True))
    assert {r[0]: tuple(r)[1:] for r in queries.op5_suffix(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("most", [suffix.MOST_CONTEXTS, 1])
def test_suffix_odd_rows(odd, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)
    want = collections.Counter(brute_suffix([(r[1] or "").encode() for r in ODD], 200))
    got = collections.Counter(tuple(r) for r in suffix.suffix_dedup(odd).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want


@pytest.mark.parametrize("most", [2, 7, 4096])
def test_suffix_parts_hot_anchors(spark, tmp_path, monkeypatch, most):
    """A passage just shorter than the length in very many surroundings, some of them shared: groups that are too large
    are parted, down to single extensions, and nothing changes."""
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", most)
    rng = np.random.default_rng(11)
    word = lambda n, signs="abc": "".join(rng.choice(list(signs), n))
    core, ends = word(34), [word(6) for _ in range(4)]
    texts = [word(int(rng.integers(0, 9))) + rng.choice(ends) + core + rng.choice(ends) + word(int(rng.integers(0, 9))) for _ in range(60)]
    texts += [texts[0], texts[1][3:], core * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r[0]: tuple(r)[1:] for r in suffix.suffix_dedup(spark.read.parquet(str(tmp_path / "t")), 40, 8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == dict(enumerate(brute_suffix([t.encode() for t in texts], 40)))


@pytest.mark.parametrize("most", [1, 7, 100, 1000])
def test_anchors_of_texts_in_parts(most):
    """The anchor of each string is the same when texts are hashed in parts, and each string has one."""
    rng = random.Random(most)
    texts = [b"", b"short", bytes(rng.choices(b"ab", k=50)), bytes(rng.choices(b"abc", k=997)), b"-" * 300, bytes(rng.choices(b"abc", k=20))]

    def of_strings(size):
        out = {}
        for text, key, anchor, first, count in suffix.anchors(texts, 20, 8, size):
            for t, k, a, f, c in zip(text.tolist(), key.tolist(), anchor.tolist(), first.tolist(), count.tolist(), strict=True):
                for at in range(f, f + c):
                    assert (t, at) not in out
                    out[t, at] = (k, a)
        return out

    whole = of_strings(suffix.WHOLE)
    assert of_strings(most) == whole and len(whole) == sum(max(0, len(t) - 19) for t in texts)


def test_suffix_short_strings(spark, tmp_path):
    """Many repeats, overlaps and periods, with other parameters."""
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.choice(list("ab"), int(rng.integers(0, 60))))) for i in range(40)] + [(50, "ab" * 40), (51, "a" * 70)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    got = {r[0]: tuple(r)[1:] for r in suffix.suffix_dedup(spark.read.parquet(str(tmp_path / "t")), 12, 4).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == dict(zip([r[0] for r in rows], brute_suffix([r[1].encode() for r in rows], 12), strict=True))


def test_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000, np.uint8))
    base = {text[a:b] for a, b in zip([0, *substring.cuts(text)], substring.cuts(text), strict=False)}
    moved = text[:2000] + b"inserted bytes" + text[2000:]
    cuts = substring.cuts(moved)
    again = {moved[a:b] for a, b in zip([0, *cuts], cuts, strict=False)}
    assert len(base - again) <= 4
    assert cuts[-1] == len(moved) and b"".join(moved[a:b] for a, b in zip([0, *cuts], cuts, strict=False)) == moved


def brute_gear(text):
    table, out = substring._GEAR, []
    for i in range(len(text)):
        h = 0
        for b in text[max(0, i - substring.GEAR_BYTES + 1) : i + 1]:
            h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_and_cuts_match_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 24, 25, 26, 60, 400):
        text = bytes(rng.integers(97, 100, n, np.uint8))
        h = brute_gear(text)
        assert substring.gear(np.frombuffer(text, np.uint8)).tolist() == h
        w = substring.REACH
        want = [i + 1 for i in range(w, n - 1) if all(h[i] > x for x in h[max(0, i - w) : i]) and all(h[i] >= x for x in h[i + 1 : i + w + 1])]
        assert substring.cuts(text) == [*[c for c in want if c > w], n]


def test_substring_keeps_one_copy(odd):
    got = {r["doc_id"]: r for r in substring.substring_dedup(odd).collect() if r["doc_id"]}
    assert got[7]["n_removed"] == 0 and got[8]["kept_text"] == ""
    assert got[10]["kept_text"] == "other words before"  # the blank before the passage and its own last one are shared
    assert got[13]["n_removed"] == 0 and got[4]["kept_text"] is None


def brute_substring(docs, least=substring.LEAST_RUN):
    """Plain loops over all texts: chunks by their ends, the keeping place of each, runs, extension byte by byte."""
    raws = [(i, (t or "").encode()) for i, t in docs]
    order = sorted(range(len(raws)), key=lambda k: (raws[k][0] is None, raws[k][0] or 0, k))
    chunks, owner = [], {}
    for _, raw in raws:
        ends = substring.cuts(raw)
        chunks.append(list(zip([0, *ends], ends, strict=False)))
    for k in order:
        for s, e in chunks[k]:
            owner.setdefault(raws[k][1][s:e], (k, s))
    out = []
    for k, (i, raw) in enumerate(raws):
        cover, run = np.zeros(len(raw) + 1, bool), []
        for s, e in [*chunks[k], (len(raw), len(raw))]:
            if e > s and owner[raw[s:e]] != (k, s):
                run.append((s, e))
                continue
            if run:
                (a, b), (j, at), (m, to) = (run[0][0], run[-1][1]), owner[raw[run[0][0] : run[0][1]]], owner[raw[run[-1][0] : run[-1][1]]]
                to += run[-1][1] - run[-1][0]
                own = substring.all_cuts(raw)[1]
                before = a - max([c for c in own if c < a], default=0) + substring.CONTEXT
                after = min([c for c in own if c > b], default=b) - b + substring.CONTEXT
                n = 0
                while n < before and a and at and raw[a - 1] == raws[j][1][at - 1]:
                    a, at, n = a - 1, at - 1, n + 1
                n = 0
                while n < after and b < len(raw) and to < len(raws[m][1]) and raw[b] == raws[m][1][to]:
                    b, to, n = b + 1, to + 1, n + 1
                cover[a:b] = True
            run = []
        edge = np.flatnonzero(np.diff(cover.astype(int), prepend=0))
        spans = substring.whole_characters(raw, [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= least])
        left = substring.outside(raw, spans)
        out.append((i, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


def test_substring_matches_brute_force(spark, sf_dir, odd, texts):
    ids = [r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall()]
    assert len(ids) == len(set(ids))
    want = {r[0]: r[1:] for r in brute_substring(list(texts.items()))}
    assert {r[0]: tuple(r)[1:] for r in queries.op2_substring(spark, sf_dir).collect()} == want
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = substring.substring_dedup(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_substring(rows))


@pytest.mark.parametrize("dashes", [0, 400, 900, 3000])
def test_substring_finds_shared_text_without_peaks(spark, tmp_path, dashes):
    """A row of dashes, far longer than chunks are, before 400 letters that two texts share: nothing of it is left behind."""
    rng = random.Random(dashes)
    word = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    shared = "-" * dashes + word(400)
    rows = [(1, word(700) + "1" + shared + "!" + word(500)), (2, word(333) + "2" + shared + "?" + word(90))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.n_removed for r in substring.substring_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got[2] == dashes + 400 and (got[1] == 0 or dashes > substring.LONGEST)  # long enough to repeat in itself


def test_substring_finds_planted_passages(spark, tmp_path):
    """Passages of just over 50 short words in other texts, at any place: nearly all are found, and to their last byte."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstu"), int(rng.integers(2, 6))))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, shared = [], []
    for k in range(150):
        shared.append(words(52))
        rows += [(2 * k, f"{words(40)} {shared[-1]} {words(40)}"), (2 * k + 1, f"{words(30)} {shared[-1]} {words(50)}")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in substring.substring_dedup(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert all(got[2 * k]["n_removed"] == 0 for k in range(150))
    whole = sum(got[2 * k + 1]["n_removed"] >= len(x) for k, x in enumerate(shared))
    assert whole >= 148
    assert all(got[2 * k + 1]["n_removed"] <= len(x) + 8 for k, x in enumerate(shared))


def test_packing(odd):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(odd, window=64, quantum=4).collect()
    check_packing([(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in ODD], got, 64)


def test_packing_of_table(spark, sf_dir, texts):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = tok.encode_batch(list(texts.values()), add_special_tokens=False)
    check_packing([(i, e.ids + [2]) for i, e in zip(texts, ids, strict=True)], queries.op3_packing(spark, sf_dir).collect(), 4096)


def check_packing(docs, got, window):
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    sizes = collections.Counter()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes[at] += 1
    assert all(n == window or n & (n - 1) == 0 for n in sizes)
    assert sum(n * k for n, k in sizes.items()) == sum(len(ids) for _, ids in docs)
    for (doc, start, length, crc, n), _ in pieces.items():
        assert any(d == doc and len(ids) == n and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for d, ids in docs)


def shares(got, window, sequences):
    """Tokens of each source in each of the first sequences."""
    out = [collections.Counter() for _ in range(sequences)]
    for r in got:
        if r["sequence_id"] < sequences:
            out[r["sequence_id"]][r["source"]] += r["length"]
    assert all(c.total() == window for c in out)
    return out


def make_sources(spark, path, sizes, words=30):
    rows = [(k * 10_000 + i, " ".join(["house"] * (words + i % 7)), f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_packing_keeps_shares(spark, tmp_path, monkeypatch):
    """Every window has the corpus's shares, to within a quantum a source; also where a source is many stretches."""
    monkeypatch.setattr(packing, "STRETCH", 50)
    docs = make_sources(spark, str(tmp_path / "t"), (600, 300, 100))
    got = packing.pack(docs, window=1024, quantum=16).collect()
    total = sum(r["length"] for r in got)
    own = collections.Counter()
    for r in got:
        own[r["source"]] += r["length"]
    for c in shares(got, 1024, total // 1024 - 1):
        assert all(abs(c[s] - 1024 * own[s] / total) <= 2 * 16 + 3 for s in own)


def test_packing_by_weights(spark, tmp_path, monkeypatch):
    """Windows have the target shares until a source runs dry; the others then share its part; the rest comes last."""
    monkeypatch.setattr(packing, "STRETCH", 40)
    docs = make_sources(spark, str(tmp_path / "t"), (300, 300, 300, 50))
    got = packing.pack(docs, window=512, quantum=8, weights={"s0": 6, "s1": 3, "s2": 1, "absent": 5}).collect()
    own = collections.Counter()
    for r in got:
        own[r["source"]] += r["length"]
    total = sum(own.values())
    until = int(own["s0"] / 0.6) // 512 - 1
    for c in shares(got, 512, until):
        assert all(abs(c[s] - 512 * w) <= 2 * 8 + 3 for s, w in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)))
    dry = int((own["s0"] + own["s1"] * 4 / 3) // 512) - 1
    for c in shares(got, 512, dry)[until + 3 :]:
        assert not c["s0"] and abs(c["s1"] - 384) <= 51 + 24  # up to a turn of s2, as windows end inside rounds
    last = sum(n for s, n in own.items() if s != "s3") // 512
    assert all(set(c) == {"s3"} for c in shares(got, 512, total // 512)[last + 1 :])
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    check_packing([(r["doc_id"], tok.encode(r["text"], add_special_tokens=False).ids + [2]) for r in docs.collect()], got, 512)


@pytest.mark.parametrize("share", [1.0, 0.37, 1 / 3, 0.0007, 1e-5])
def test_rounds_of_quanta(share):
    """Against counting round by round; and for shares that no loop over rounds could reach."""
    rate, served, want = share * 64, 0, []
    for r in range(2000):
        upto = int(np.floor((r + 1) * rate))
        want += [r] * (upto - served)
        served = upto
    assert packing.round_of(np.arange(len(want)), rate).tolist() == want
    began = time.perf_counter()
    rounds = packing.round_of(np.arange(1000), share * 1e-12)
    assert time.perf_counter() - began < 0.1 and (np.diff(rounds) > 0).all()


def test_word_ids_match_library():
    """Random strings of what the tokenizer treats specially; all at once and with nulls."""
    rng, tok = random.Random(7), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    signs = [*map(chr, range(1, 128)), *"éÉß×÷日本İǅſ́̌̇　\xa0\x85", "'s", "'re", " ", "  ", "hello", "<|endoftext|>"]
    some = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 500, "-" * 90 + "y"]
    ids, sizes = tokens.word_ids("word_bpe_49k.json")(pa.array([None, *some, None]))
    assert sizes[0] == sizes[-1] == 0
    got = np.split(ids, np.cumsum(sizes)[:-1])[1:-1]
    for t, e, x in zip(some, tok.encode_batch(some, add_special_tokens=False), got, strict=True):
        assert e.ids == x.tolist(), t


def brute_license(t):
    w, places = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)), []
    for phrase, label in license.BASE:
        q = phrase.split()
        places += [(i, label) for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    starts = [p[0] for p in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


def brute_labels(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    text, found = f" {' '.join(words)} ", []
    for n, (tier, label, gate, pattern) in enumerate(license.rules()):
        for m in re.finditer(license._bounded(pattern), text):
            assert gate in m[0].split()
            found.append((text[: m.start()].count(" ") - 1, text[: m.end()].count(" "), tier, n, label))
    hides = lambda e, d: e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[3] < d[3])
    kept = [d for d in found if not any(hides(e, d) for e in found)]
    return {d[4] for d in kept}, max([license.WEIGHT[d[2]] for d in kept], default=0.0), sorted(d[:2] for d in kept)


def test_license_matches_brute_force(spark, sf_dir, odd, texts):
    rows = queries.op6_license(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    todo = [(r, texts[r["doc_id"]]) for r in rows] + [(r, dict((x[0], x[1]) for x in ODD)[r["doc_id"]] or "") for r in license.license_scan(odd).collect()]
    for r, t in todo:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t)
        labels, score, _ = brute_labels(t)
        assert r["labels"] == ",".join(sorted(labels | set(filter(None, r["base_labels"].split(","))))) and r["score"] == score


def strings_of(parsed):
    """Strings for every branch of a pattern; of repeats the least and, where they are optional, one."""
    outs = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = ["word" if str(o) == "CATEGORY" and str(x) == "CATEGORY_NOT_SPACE" else chr(x) if str(o) == "LITERAL" else "1" for o, x in arg]
        elif op == "BRANCH":
            some = [x for b in arg[1] for x in strings_of(b)]
        elif op == "SUBPATTERN":
            some = strings_of(arg[-1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [x * n for n in {arg[0], max(1, arg[0])} for x in strings_of(arg[2])]
        else:
            raise ValueError(op)
        outs = [a + b for a in outs for b in dict.fromkeys(some)]
    return outs


def samples():
    """(rule number, text) for the branches of every rule, at most 60 of a rule."""
    for n, r in enumerate(license.rules()):
        some = strings_of(re._parser.parse(r[3]))
        yield from ((n, x) for x in some[:: 1 + len(some) // 60])


def test_license_rules():
    """Hundreds of rules; each branch of each matches its own rule and has the rule's gate among its words."""
    every = license.rules()
    assert len(every) >= 300 and len({r[1:] for r in every}) == len(every) and [r[0] for r in every] == sorted(r[0] for r in every)
    lost = [(every[n], x) for n, x in samples() if every[n][2] not in x.split() or not re.search(license._bounded(every[n][3]), f" {x} ")]
    assert not lost, lost[:20]


def test_license_samples_match_brute_force(spark):
    """A text for each rule's branches, alone and in the middle of others: places, labels and scores by plain loops."""
    texts = [f"some words {x} and others" for _, x in samples()]
    rng = random.Random(2)
    texts += [" and ".join(rng.sample(texts, 5)) for _ in range(60)]
    rows = license.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        labels, score, places = brute_labels(texts[r["doc_id"]])
        assert sorted((d["start"], d["end"]) for d in r["detections"]) == places, texts[r["doc_id"]]
        assert set(r["labels"].split(",")) == labels | set(filter(None, r["base_labels"].split(","))) and r["score"] == score


def test_license_versions_and_zlib(spark):
    texts = ["under the zlib libpng license here", "Apache License, Version 2.0 or GPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"]
    got = [r["detections"] for r in license.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[(d["label"], d["version"]) for d in x] for x in got] == [[("zlib", None)], [("apache", "2.0"), ("gpl", "3.0")], [("lgpl", "2.1")]]


def test_license_of_many_hits_is_quick(spark):
    """1 MB with 80,000 places takes seconds: nothing in the scan grows with the square of the hits."""
    n = 80_000
    docs = spark.createDataFrame([(1, "mit license x " * n)], "doc_id long, text string")
    began = time.perf_counter()
    r = license.license_scan(docs).select("n_words", "n_base", "first_word", "last_word", "labels", F.size("detections").alias("n")).first()
    assert tuple(r) == (3 * n, n, 0, 3 * n - 3, "mit", n)
    assert time.perf_counter() - began < 30


def make_vectors(spark, path):
    rng, rows = np.random.default_rng(4), []
    for k in range(60):
        base = rng.normal(size=16)
        for c in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.05 * (c > 1)).astype("f4").tolist(), k % 3))
    rows += [(len(rows) + i, v, lb) for i, (v, lb) in enumerate([(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None], 1), ([1.0] * 16, None), ([1.0] * 16, 2), ([1.0, 1.0], 2), ([-0.0, 1.0], 2), ([0.0, 1.0], 2)])]
    rows.append((0, rows[0][1], rows[0][2]))
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").write.parquet(path)
    return rows


def brute_vectors(rows):
    """(vec_id, label, links, component) of each row, by all pairs."""
    ok = lambda v, lb: lb is not None and v and None not in v and np.isfinite(v).all() and any(v)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v, lb) else None for _, v, lb in rows]
    near = [[b for b in range(len(rows)) if b != a and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98] for a in range(len(rows))]
    group = {}
    for a in range(len(rows)):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = a
                todo += near[x]
    least = collections.defaultdict(lambda: None)
    for a, g in group.items():
        least[g] = rows[a][0] if least[g] is None else min(least[g], rows[a][0])
    return [(rows[a][0], len(near[a]), least[group[a]]) for a in range(len(rows))]


@pytest.mark.parametrize("slot", [512, 3])
def test_vectors_match_brute_force(spark, tmp_path, slot):
    rows = make_vectors(spark, str(tmp_path / "v"))
    got = embeddings.near_vectors(spark.read.parquet(str(tmp_path / "v")), slot=slot).collect()
    found, want = sorted((r["vec_id"], r["n_links"]) for r in got), sorted(x[:2] for x in brute_vectors(rows))
    assert len(found) == len(want)
    assert sum(n for _, n in found) >= 0.9 * sum(n for _, n in want)
    assert all(f <= w for (_, f), (_, w) in zip(found, want, strict=True))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vectors_planted_in_the_table(spark, sf_dir, tmp_path, seed):
    """The table's own vectors with planted near ones, most of them just over 0.98 and a third around one vector (a hot
    cell): at least 0.9 of all links are found in each seed, none that is not there, and components follow from them."""
    rng = np.random.default_rng(seed)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    known, width = [r for r in rows if r[1] and r[2] is not None][:60], len(rows[0][1])
    for k in range(240):
        _, v, label = known[0 if k % 3 == 0 else int(rng.integers(len(known)))]
        noise, cos = rng.normal(size=width), rng.uniform(0.981, 0.999)
        v = np.array(v) / np.linalg.norm(v)
        noise -= noise @ v * v
        rows.append((1_000_000 + k, (cos * v + np.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)).tolist(), label))
    kind = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind['label'].dataType.simpleString()}").repartition(3).write.parquet(str(tmp_path / "v"))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()]
    want = {i: (n, c) for i, n, c in brute_vectors(rows)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.read.parquet(str(tmp_path / "v")), slot=32).collect()}
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 400
    assert sum(got[i][1] == want[i][1] for i in got if want[i][0]) >= 0.9 * sum(n > 0 for n, _ in want.values())


def test_vectors_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "v"))
    assert embeddings.near_vectors(spark.read.parquet(str(tmp_path / "v"))).count() == 0


def test_language_held_out(spark, sf_dir):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    got = queries.op8_language(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_rare_languages_are_learned_and_repeats_count_once(spark, tmp_path, monkeypatch):
    """Three texts of a language among thousands are learned; a row repeated many times neither fills nor empties the sample."""
    rows = [(i, f"the house number {i} is near the river", "en") for i in range(3000)] + [(7, "again and again", "en")] * 3000
    rows += [(90000 + i, "der hund und die katze sind im garten", "de") for i in range(1, 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "docs"))
    seen, saved = [], langid.saved
    monkeypatch.setattr(langid, "saved", lambda df, label: seen.append(saved(df, label)) or seen[-1])
    [(languages, _)] = langid.fit(spark.read.parquet(str(tmp_path / "docs")), sample_rows=20)
    assert languages == ["de", "en"]
    n = {(r["lang"], r["word"]): r["n"] for r in seen[0].collect()}
    assert 100 < n["en", "house"] < 300 and n.get(("en", "again"), 0) in (0, 2)
    assert 4 <= n["de", "hund"] <= 8


def test_very_many_languages_and_very_long_words(spark, tmp_path, monkeypatch):
    """300 labels, each with words of its own of a hundred letters and more, in models of 256 and of 7 languages."""
    rng = random.Random(8)
    own = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(70, 150))) for _ in range(3)] for k in range(300)}
    rows = [(n * 1000 + k, " ".join(rng.choices(words, k=6)), lang) for n, (lang, words) in enumerate(own.items()) for k in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, results = spark.read.parquet(str(tmp_path / "docs")), []
    for block in (256, 150):
        monkeypatch.setattr(langid, "BLOCK", block)
        results.append({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify_language(docs).collect()})
    truth = {doc: lang for doc, _, lang in rows}
    assert sum(results[0][d][0] == truth[d] for d in truth) > 0.9 * len(truth)
    assert results[0] == results[1]


def test_expected_pieces_of_a_long_word_equal_those_of_the_chart():
    rng = np.random.default_rng(5)
    table = langid.Pieces({"ab": 2, "a": 3, "b": 4, "bab": 5})
    p = np.array([0.0, 1e-4, 0.3, 0.2, 0.1, 0.05])
    for n in (1, 2, 9, 40):
        word = "".join(rng.choice(list("abc"), n))
        chart, sizes = table.chart([word]), np.array([n])
        alpha, beta = langid.forward(chart, p[:, None]), langid.backward(chart, p[:, None], sizes)
        want = np.zeros(6)
        for s in range(n):
            for length in range(1, min(table.longest, n - s) + 1):
                i = chart[0, s, length]
                if i:
                    want[i] += alpha[0, s, 0] * p[i] * beta[0, s + length, 0] / alpha[0, n, 0]
        got = np.zeros(6)
        i, times = langid.expected_pieces(word, table, p)
        np.add.at(got, i, times)
        assert np.allclose(got, want)


def test_language_of_odd_rows(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(odd).collect()}
    assert all(got[i] == "und" for i in (4, 5, 6, 16))


def test_forward_sums_all_segmentations():
    table = langid.Pieces({"ab": 2, "a": 3, "b": 4})
    p = np.array([[0.0], [0.0], [0.3], [0.2], [0.1]])
    chart = table.chart(["abab", "ab"])
    one = 0.3 + 0.2 * 0.1
    assert np.isclose(langid.forward(chart, p)[:, [2, 4], 0], [[one, one * one], [one, 0]]).all()
    assert np.isclose(langid.backward(chart, p, np.array([4, 2]))[:, 0, 0], [one * one, one]).all()
    assert np.isclose(langid.score_words(["abab", "ab"], table, p)[:, 0], np.log([one * one, one])).all()


@pytest.mark.parametrize("cells", [1 << 21, 1])
def test_forward_of_long_words(monkeypatch, cells):
    """Words of any length are summed whole, without underflow: equal to the plain recursion in exact logarithms."""
    monkeypatch.setattr(langid, "CELLS", cells)
    rng = np.random.default_rng(3)
    some = {"".join(rng.choice(list("abcd"), int(rng.integers(1, 13)))): 0 for _ in range(400)}
    table = {w: k for k, w in enumerate(some, 2)}
    p = rng.random((len(table) + 2, 3)) * 1e-5
    p[0] = 0
    words = ["".join(rng.choice(list("abcde"), n)) for n in (1, 11, 12, 13, 80, 500, 3000)]
    got = langid.score_words(words, langid.Pieces(table), p)
    for w, row in zip(words, got, strict=True):
        for lang in range(3):
            logs = [0.0]
            for e in range(1, len(w) + 1):
                ends = [(logs[s], table.get(w[s:e], 1 if e - s == 1 else None)) for s in range(max(0, e - 12), e)]
                logs.append(np.logaddexp.reduce([x + np.log(p[i, lang]) for x, i in ends if i]))
            assert np.isclose(row[lang], logs[-1])


def test_bpe_matches_library(spark, sf_dir, odd, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = dict((r[0], r[1] or "") for r in ODD)
    for r, t in [(r, texts[r[0]]) for r in queries.op9_bpe(spark, sf_dir).collect()] + [(r, told[r[0]]) for r in bpe.bpe_digests(odd).collect()]:
        ids = lib.encode_ordinary(t)
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    back = {r[0]: r[1] for r in bpe.bpe_decode(bpe.bpe_encode(odd)).collect()}
    assert back == told


def test_decoder_streams():
    d = bpe.StreamDecoder({b"\xc3": 0, b"\xa9": 1, b"ab": 2, b"\xf0\x9f": 3, b"\x98\x80!": 4})
    assert [d.feed([i]) for i in (2, 0, 1, 3, 4)] == ["ab", "", "é", "", "\U0001f600!"]
    assert d.feed([0]) == "" and d.close() == "�"
    with pytest.raises(ValueError):
        d.feed([1])


def test_counts_match_library(spark, sf_dir, odd, texts, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    told = dict((r[0], r[1] or "") for r in ODD)
    cache = str(tmp_path / "cache")
    for docs, by in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), texts), (odd, told), (odd, told)):
        rows = counts.token_counts(docs, cache=cache).collect()
        for r in rows:
            t = by[r["doc_id"]]
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert tuple(r)[1:] == (len(t.encode()), n, n > 1024)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # nothing was encoded twice


@pytest.fixture(scope="module")
def huge(spark, tmp_path_factory):
    """Texts of 10 MB of different words, of 2.6 MB of the same few words, of one word of 100,000 letters; and short ones."""
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10)))) for _ in range(30_000)])
    prose = " ".join(words[rng.integers(0, len(words), 1_600_000)])[:10_000_000]
    path = str(tmp_path_factory.mktemp("huge") / "documents.parquet")
    rows = [(1, prose, "en", "a"), (2, "the mit license and so on " * 100_000, "en", "a"), (3, "short text", "en", "b"), (4, None, None, None), (5, "x" * 100_000, "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(path)
    return spark.read.parquet(path), dict((r[0], r[1] or "") for r in rows)


@pytest.mark.parametrize("name", ["simhash", "substring", "packing", "exact", "suffix", "license", "language", "bpe", "counts", "automaton", "no near copies"])
def test_texts_of_10_mb(huge, name):
    """Every operator handles them whole, in one task's memory and some seconds."""
    docs, texts = huge
    rows = ON_DOCS[name](docs).drop("text", "kept_text", "spans", "detections").collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    size = {i: len(t.encode()) for i, t in texts.items()}
    for r in rows:
        if "n_bytes" in r:
            assert r["n_bytes"] == size[r["doc_id"]]
    if name == "packing":
        n = collections.Counter()
        for r in rows:
            n[r["doc_id"]] += r["length"]
        assert all(n[r["doc_id"]] == r["doc_tokens"] for r in rows) and n[2] == 6 * 100_000 + 1
    if name == "license":
        assert {r["doc_id"]: r["n_base"] for r in rows}[2] == 100_000
    if name == "suffix":
        assert {r["doc_id"]: r["n_removed"] for r in rows}[5] == 100_000
