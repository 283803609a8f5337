"""Spelling variants against plain counting and comparing."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from scorespark.llm import queries, spelling


def counted(rows, one_in=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def brute(n, least_length=6, least_count=5):
    """All columns by word; near words by taking out one code point, or marking it, of every word."""
    words = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    keys = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            keys[w[:i] + "*" + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= keys[w[:i] + "*" + w[i + 1 :]] - {w}
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * k else None
    out = {}
    for w, k in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, k, len(near[w]), words.get(form[w]))
    return out


def told(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(rows))
    assert told(queries.op11_spelling(spark, sf_dir)) == want and any(v[0] for v in want.values())


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, node string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("hot, depth", [(100_000, 64), (0, 12)])
def test_spelling_of_odd_rows(spark, tmp_path, monkeypatch, hot, depth):
    """Runs of one letter, words that begin others, letters beyond ASCII, words of about DEPTH letters and far beyond."""
    monkeypatch.setattr(spelling, "HOT_FROM", hot)
    rng = random.Random(4)
    some = ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaa", "planet", "planets", "plante", "plan", "garden", "gardén", "GARDEN", "ÉTÉÉTÉ", "étéété", "xplanet", "planetx"]
    some += ["".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(150)]
    base = "".join(rng.choices("abc", k=depth))
    some += [base, base + "a", "b" + base, base[:7] + "z" + base[8:], base[:-1] + "zz", base + "ab", base + "ac", base * 40, base * 40 + "q", base * 20 + "d" + base * 20, base * 20 + base[1:] + base * 19]
    rows = [(None, None), (None, ""), (1, "1 2 3 ÷×"), (2, "short word")]
    rows += [(k, f"{w} {w.capitalize()}, " * rng.choice([2, 12, 70, 400])) for k, w in enumerate(some)] * 2
    want = brute(counted(rows))
    assert sum(len(w) > depth for w in want) > 5 and any(v[1] != v[0] and v[0] for v in want.values())
    assert told(spelling.spelling_variants(table(spark, str(tmp_path / "d"), rows), depth=depth)) == want


def test_spelling_of_nothing(spark, tmp_path):
    assert told(spelling.spelling_variants(table(spark, str(tmp_path / "d"), []))) == {}
    assert told(spelling.spelling_variants(table(spark, str(tmp_path / "e"), [(1, None), (2, "a few words")]))) == {}


def test_words_of_fifty_thousand_letters(spark, tmp_path):
    """One letter over and over: every deletion gives the same word."""
    long, longer = "y" * 50_000, "y" * 50_001
    rows = [(k, f"{long}. planet") for k in range(5)] + [(k, longer) for k in range(30)]
    n = counted(rows)
    assert n[long] == 5 and n[longer] == 30 and n["planet"] == 5
    got = told(spelling.spelling_variants(table(spark, str(tmp_path / "d"), rows)))
    assert got == {long: (longer, longer, 5, 1, 30), longer: (None, longer, 30, 1, None), "planet": (None, "planet", 5, 0, None)}
