"""Hand-computed cases of the operators."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scorespark.functions import scalar as S
from scorespark.operators import association, folds, scoring, timeline
from scorespark.plans import ordered
from scorespark.sources import files, manifests


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "dots", "enters", "times", "whole"), [(4, 1, 1, 1, (3, 8)), (8, 0, 3, 2, (1, 12)), (4, 2, 1, 1, (7, 16)), (1, 0, 1, 1, (1, 1)), (128, 0, 13, 8, (8, 13 * 128))])
def test_durations(spark, value, dots, enters, times, whole):
    assert one(spark, S.duration_ticks(*map(F.lit, (value, dots, enters, times)))) == S.WHOLE * whole[0] // whole[1]


def test_durations_that_are_not_whole(spark):
    assert one(spark, S.duration_ticks(*map(F.lit, (4, 0, 17, 16)))) is None


@pytest.mark.parametrize(("n", "times"), [(1, 1), (3, 2), (5, 4), (7, 4), (9, 8), (13, 8)])
def test_tuplets(spark, n, times):
    assert one(spark, S.tuplet_normal(F.lit(n))) == times


@pytest.mark.parametrize(("text", "want"), [("3/4", (3, 4)), (" 12 / 8 ", (12, 8)), ("3/0", None), ("x/4", None), ("", None), (None, None)])
def test_ratio(spark, text, want):
    got = one(spark, S.ratio(F.lit(text).cast("string")))
    assert (None if got is None else tuple(got)) == want


def test_precision_conventions(spark):
    zero = one(spark, S.precision_recall_zero(F.lit(0), F.lit(0), F.lit(0))["f1"])
    assert zero == 0.0
    assert one(spark, S.precision_recall(F.lit(3), F.lit(1), F.lit(2))["recall"]) == 0.6


def test_carry_forward(spark):
    rows = [("d", 0, None), ("d", 1, "4/4"), ("d", 2, None), ("d", 3, "3/4"), ("d", 4, None)]
    got = timeline.carry_forward(spark.createDataFrame(rows, "doc string, n int, sig string"), ["doc"], ["n"], "sig").orderBy("n").collect()
    assert [(r["carried"], r["origin"]) for r in got] == [(None, "unknown"), ("4/4", "printed"), ("4/4", "carried"), ("3/4", "printed"), ("3/4", "carried")]


def test_outlier_digits(spark):
    rows = [("d", i, v) for i, v in enumerate([2, 2, 23, 3, 2])]
    got = timeline.outlier_digits(spark.createDataFrame(rows, "doc string, n int, v long"), ["doc"], ["n"], "v").orderBy("n").collect()
    assert [r["fixed"] for r in got] == [2, 2, 2, 3, 2]


def test_global_rank(spark):
    values = random.Random(3).sample(range(10_000), 500)
    got = timeline.global_rank(spark.createDataFrame([(v,) for v in values], "k long").repartition(7), "k").collect()
    assert {r["k"]: r["rank"] for r in got} == {v: i for i, v in enumerate(sorted(values))}


def sides(spark, left, right):
    make = lambda rows: spark.createDataFrame(rows, "g string, x double, id long, c double")
    return make(left), make(right)


def test_greedy_by_confidence(spark):
    truth, pred = sides(spark, [("a", 10.0, 1, 0.0), ("a", 12.0, 2, 0.0)], [("a", 11.0, 7, 0.9), ("a", 11.4, 8, 0.8)])
    got = folds.greedy_match(pred.withColumn("worse", -F.col("c")), truth, ["g"], "x", 2, "worse").collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == {(7, 1), (8, 2)}


def test_greedy_matches_a_plain_loop(spark):
    rng = random.Random(8)
    left = [("ab"[i % 2], float(rng.randrange(400)), i, 0.0) for i in range(80)]
    right = [("ab"[i % 2], float(rng.randrange(400)), 100 + i, 0.0) for i in range(80)]
    want, used = set(), set()
    for g, x, i, _ in sorted(left, key=lambda r: (r[1], r[2])):
        near = sorted((abs(x - y), y, j) for h, y, j, _ in right if h == g and abs(x - y) <= 3 and j not in used)
        if near:
            used.add(near[0][2])
            want.add((i, near[0][2]))
    l, r = sides(spark, left, right)
    assert {(x["left_id"], x["right_id"]) for x in folds.greedy_match(l, r, ["g"], "x", 3).collect()} == want


def test_suppress_matches_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [("g", float(rng.randrange(300)), i, float(rng.randrange(20))) for i in range(90)]
    kept = []
    for _, x, i, c in sorted(rows, key=lambda r: (-r[3], r[2])):
        if all(abs(x - k) > 5 for k, _ in kept):
            kept.append((x, i))
    df = spark.createDataFrame(rows, "g string, x double, id long, c double")
    assert {r["id"] for r in folds.suppress(df, ["g"], "x", "c", 5).collect()} == {i for _, i in kept}


def test_range_join_matches_a_plain_loop(spark):
    rng = random.Random(6)
    points = [("a", rng.randrange(1000), i) for i in range(100)]
    spans = [("a", s := rng.randrange(1000), s + rng.randrange(90), i) for i in range(100)]
    p = spark.createDataFrame(points, "g string, x long, p long")
    s = spark.createDataFrame(spans, "g string, lo long, hi long, s long")
    got = {(r["p"], r["s"]) for r in association.range_join(p, s, ["g"], "x", "lo", "hi", 4).collect()}
    assert got == {(i, j) for _, x, i in points for _, lo, hi, j in spans if lo - 4 <= x <= hi + 4}


def test_islands(spark):
    rows = [("g", x) for x in (0, 1, 5, 6, 20)]
    got = association.islands(spark.createDataFrame(rows, "g string, x int"), ["g"], "x", 4).orderBy("x").collect()
    assert [r["island"] for r in got] == [0, 0, 0, 0, 1]


def test_monotone_alignment():
    assert folds.monotone_pairs([0.0, 0.5, 1.0], [0.01, 0.98]) == [(0, 0), (2, 1)]
    assert folds.monotone_pairs([0.0, 1.0], [0.4, 0.6]) == [(0, 0), (1, 1)]


def test_edit_alignment():
    """Unlike notes cost .65, another state .2, another rhythm .075; gaps cost 1; of equal costs a match comes first."""
    note = lambda rhythm, *notes: ("note", rhythm, list(notes))
    rest = ("rest", "4", [])
    assert folds.event_cost(note("4", "1:3"), note("4", "1:3")) == 0
    assert folds.event_cost(note("4", "1:3"), note("8", "1:3")) == pytest.approx(0.075)
    assert folds.event_cost(note("4", "1:3", "2:0"), note("4", "1:3")) == pytest.approx(0.325)
    assert folds.event_cost(note("4", "1:3"), rest) == pytest.approx(0.65 + 0.2 + 0.075)
    assert folds.event_cost(rest, rest) == 0
    a = [note("4", "1:3"), rest, note("8", "2:0"), note("8", "1:5")]
    assert folds.edit_pairs(a, [a[0], a[2], a[3]]) == [(0, 0), (1, None), (2, 1), (3, 2)]
    assert folds.edit_pairs([], a[:1]) == [(None, 0)]


def test_event_cost_paths_match_all_paths():
    rng = random.Random(4)
    for _ in range(40):
        a, b = ([(rng.choice(("note", "rest")), rng.choice("48"), rng.sample(["1:0", "2:3", "3:X"], rng.randrange(3))) for _ in range(rng.randrange(5))] for _ in range(2))

        def least(i, j):
            if i == len(a) or j == len(b):
                return len(a) - i + len(b) - j
            return min(folds.event_cost(a[i], b[j]) + least(i + 1, j + 1), 1 + least(i + 1, j), 1 + least(i, j + 1))

        path = folds.edit_pairs(a, b)
        assert sum(1 if i is None or j is None else folds.event_cost(a[i], b[j]) for i, j in path) == pytest.approx(least(0, 0))


def test_cheapest_fill_matches_all_choices():
    rng = random.Random(2)
    for _ in range(60):
        options = [[(rng.randrange(1, 6), float(rng.randrange(5))) for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        target = rng.randrange(2, 16)
        fits = [sum(o[k][1] for o, k in zip(options, picks, strict=True)) for picks in itertools.product(range(3), repeat=len(options)) if sum(o[k][0] for o, k in zip(options, picks, strict=True)) == target]
        found = folds.cheapest_fill(options, target)
        assert (found is None) == (not fits) and (found is None or found[0] == min(fits))


def test_small_folds():
    assert folds.join_digits([(0, 1), (1, 2), (9, 3), (10, 9), (20, 4)], 2) == [(0.5, 12), (9, 3), (10, 9), (20, 4)]
    assert folds.mean_groups([0, 1, 2, 10, 11], 2) == [0, 0, 0, 1, 1]
    assert folds.anchored_pairs([("a", 0.0), ("b", 0.5), ("c", 1.0)], [("a", 0.0), ("c", 1.0)]) == ([(0, 0), (2, 1)], "anchors")
    assert folds.anchored_pairs([("a", 0.0), ("b", 0.5)], [("c", 0.1), ("b", 0.5), ("a", 1.0)]) == ([(0, 2)], "anchors")
    assert folds.median_groups([0, 1, 2, 10, 11], 2) == [0, 0, 0, 1, 1]
    assert folds.iou((0, 0, 2, 2), (1, 1, 2, 2)) == pytest.approx(1 / 7)


def test_marker_windows():
    """A bracket comes first; else the nearest run, with a penalty for each event more or less; no event twice."""
    events = [0.0, 10.0, 20.0, 30.0, 40.0]
    assert folds.windows_of_markers(events, [(15.0, 2, None), (35.0, 2, None)], 10.0) == [(0, [1, 2]), (1, [3, 4])]
    assert folds.windows_of_markers(events, [(15.0, 3, (18.0, 41.0))], 10.0) == [(0, [2, 3, 4])]
    assert folds.windows_of_markers(events, [(20.0, 5, None)], 10.0) == [(0, [0, 1, 2, 3, 4])]
    assert folds.windows_of_markers(events, [(20.0, 2, (0.0, 40.0)), (20.0, 2, None)], 10.0) == [(0, [0, 1, 2, 3, 4])]
    assert folds.windows_of_markers([5.0], [(5.0, 2, None)], 10.0) == []


def test_continuations():
    """Each rule of the order in which sources are asked."""
    new = lambda: folds.Continuations()
    attack = lambda c, event, *notes: c.step(event, list(notes), False, 0, {}, [], [])
    c = new()
    attack(c, 1, (1, 40), (2, 45))
    assert c.step(2, [(2, 47)], False, 1, {}, [], []) == ("adjacent", [(1, 1, 40)])
    assert c.step(3, [], False, 1, {}, [], []) == ("recent chain", [(1, 2, 40)])
    assert c.step(4, [(1, 41)], False, 1, {}, [], []) == ("unresolved", [])  # a fresh attack ends the chain
    c = new()
    attack(c, 1, (1, 40), (2, 45))
    attack(c, 2, (3, 50))
    assert c.step(3, [], False, 1, {}, [2], []) == ("string target", [(2, 1, 45)])
    c = new()
    attack(c, 1, (1, 40), (2, 45))
    attack(c, 2, (3, 50))
    assert c.step(3, [(3, 52)], False, 1, {}, [], [44]) == ("pitch target", [(2, 1, 45)])
    assert c.step(4, [], False, 1, {}, [], [60])[0] == "recent chain"  # too far for the pitch
    c = new()
    attack(c, 1, (1, 40), (2, 45))
    assert c.step(2, [], False, 1, {1: 0.3, 2: 0.3, 4: 0.9}, [], []) == ("ink", [(1, 1, 40), (2, 1, 45)])  # ink says how many
    assert c.step(3, [(5, 60)], False, 0, {1: 0.5}, [], []) == ("ink", [(1, 2, 40)])
    c = new()
    c.step(1, [(1, 40)], True, 0, {}, [], [])  # dead notes do not sound on, but are what came before
    assert c.step(2, [], False, 1, {}, [1], [])[0] == "adjacent"


def test_glyphs():
    g = folds.Glyphs(1.0, 3.0, 4.0)
    digits = [(10.0, 1, "1"), (10.8, 1, "2"), (20.0, 1, "9"), (20.5, 1, "9"), (11.0, 2, "x"), (30.0, 3, "0"), (30.9, 3, "7")]
    assert g.tokens(digits) == [(10.4, 1, "12"), (11.0, 2, "x"), (30.45, 3, "7")]  # 99 is more than 36
    assert g.notes(digits, [(12.0, 7), (90.0, 8)]) == [(7, 12.0, 1, "12", "associated"), (7, 12.0, 2, "x", "associated"), (None, 30.45, 3, "7", "created")]
    assert [n[4] for n in g.notes([(10.0, 1, "1"), (12.0, 1, "3")], [])] == ["created", "duplicate"]


def test_gap_units():
    """Sizes, and that the greedy choice fills each rest exactly."""
    assert len(ordered.UNITS) == 21 and ordered.UNITS[0] == (576, 1, "single", "1:1") and ordered.UNITS[-1] == (4, 64, "none", "3:2")
    assert ordered.UNFILLED == (1, 2, 3, 5, 7, 11)
    filled = {}
    for rest, pos, unit in ordered._decomposed():
        filled.setdefault(rest, []).append((pos, ordered.UNITS[unit][0]))
    for rest in range(1, 588):
        parts = [t for _, t in sorted(filled.get(rest, []))]
        assert sum(parts) == (0 if rest in ordered.UNFILLED else rest) and parts == sorted(parts, reverse=True)


def test_outlier_digits_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [("ab"[k % 2], k, rng.choice([2, 2, 3, 1, 4, 12, 15, 20, 21, 23, 25, 30, 37, 39, 40])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    want = {}
    for g in "ab":
        own = [(k, v) for h, k, v in rows if h == g]
        values = [v for _, v in own]
        for i, (k, v) in enumerate(own):
            near, digit = values[max(0, i - 3) : i] + values[i + 1 : i + 4], v // 10
            common = values.count(digit) >= max(6, 3 * values.count(v))
            local = sum(0 <= x <= 19 and abs(x - digit) <= 2 for x in near) >= 2 and not any(abs(x - v) <= 4 for x in near)
            want[k] = digit if 20 <= v <= 39 and (common or local) else v
    got = {r["k"]: r["fixed"] for r in timeline.outlier_digits(df, ["g"], ["k"], "v").collect()}
    assert got == want and any(want[k] != v for _, k, v in rows)


def test_rewrite_is_whole_or_not_at_all(spark, tmp_path):
    path, one = str(tmp_path / "set"), spark.range(10)
    manifests.rewrite(spark, path, one.write.parquet)

    def broken(folder):
        spark.range(5).write.parquet(folder)
        raise OSError("lost")

    for write, check, error in ((broken, None, OSError), (spark.range(3).write.parquet, lambda p: spark.read.parquet(p).count() == 10, ValueError)):
        with pytest.raises(error):
            manifests.rewrite(spark, path, write, check)
        assert spark.read.parquet(path).count() == 10
    manifests.rewrite(spark, path, spark.range(20).write.parquet)
    assert spark.read.parquet(path).count() == 20 and [f.name for f in tmp_path.iterdir()] == ["set"]


def test_page_files(spark, tmp_path):
    size = lambda w, h: files.PNG + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    for name, head, n in (("a", size(1200, 1600), 12_000), ("b", size(1200, 1600), 100), ("c", size(999, 1600), 12_000), ("d", size(1200, 10), 12_000), ("e", b"GIF89a", 12_000)):
        (tmp_path / f"{name}.png").write_bytes(head + bytes(n))
    got = {r["path"][-5:]: r["rule"] for r in files.file_heads(spark, str(tmp_path), "*.png").select("path", files.png_rule(F.col("head"), F.col("length")).alias("rule")).collect()}
    assert got == {"a.png": None, "b.png": "too small", "c.png": "too narrow", "d.png": "too low", "e.png": "wrong signature"}


def test_sweep_counts(spark):
    rows = [(s, s >= 40) for s in range(0, 100, 10)]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.sweep(spark.createDataFrame(rows, "score int, truth boolean"), [], "score", "truth").collect()}
    assert got[40] == (6, 0, 0) and got[35] == (6, 0, 0) and got[30] == (6, 1, 0) and got[95] == (0, 0, 6)


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": 2, "v": null}\n')
    schema = spark.createDataFrame([], "id int, v string").schema
    assert manifests.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).count() == 2
    assert manifests.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema, missing_ok=True).count() == 0
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.json").write_text('{"id": 5,\n "v": "y"}')
    assert manifests.read_json_documents(spark, str(tmp_path), schema).first()["id"] == 5
    files = manifests.discover(spark, str(tmp_path), "*.json*", 1, 1000).collect()
    assert [f["path"].rsplit("/", 1)[-1] for f in files] == ["a.jsonl", "b.json"]
    assert len(manifests.discover(spark, str(tmp_path), "*.json*", 1, 1000, depth=1).collect()) == 1


def test_coco(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a", "source_group": "s"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 2, "name": "x"}]}')
    images, annotations, categories = manifests.read_coco(spark, str(tmp_path / "c.json"))
    assert manifests.annotated_images(images, annotations).first()["annotations"][0]["id"] == 7 and categories.count() == 1
    with pytest.raises(Exception, match="no image"):
        manifests.annotated_images(images, annotations.withColumn("image_id", F.lit(9).cast("long"))).collect()


def test_incremental(spark):
    todo = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    assert [r["id"] for r in manifests.incremental(todo, todo.where("id < 3"), ["id", "v"]).collect()] == [3]


def test_write_table(spark, tmp_path):
    manifests.write_table(spark.createDataFrame([(1, "a")], "id int, v string"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first()["v"] == "a"


def test_file_headers_of_all_tables(spark, tmp_path):
    """Every file of every table is looked at, at both ends; empty and cut files are not in order."""
    from scorespark import plans

    spark.range(5).repartition(2).write.parquet(str(tmp_path / "nation.parquet"))
    whole = next((tmp_path / "nation.parquet").glob("*.parquet")).read_bytes()
    for name, data in {"orders": whole, "cut": whole[:-1], "headless": b"XXXX" + whole[4:], "empty": b"", "short": b"PAR1"}.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: r["ok"] for r in plans.queries()["dq_file_header"](spark, str(tmp_path)).collect()}
    assert {k: got.pop(f"{k}.parquet") for k in ("orders", "cut", "headless", "empty", "short")} == {"orders": True, "cut": False, "headless": False, "empty": False, "short": False}
    assert list(got.values()) == [True, True]


def test_scans_keep_no_rows_of_a_hot_group(spark, monkeypatch):
    """One group over many batches: the state goes on from batch to batch, and no rows are gathered."""
    from scorespark.operators import folds

    def gathered(*_):
        raise AssertionError("a group is gathered")

    monkeypatch.setattr(folds, "fold_groups", gathered)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).selectExpr("if(id < 900, 0, 1) AS g", "id", "cast(id * 3 AS double) AS x")
        kept, groups = folds.keep_first(df, ["g"], "x", 10).collect(), folds.anchored_groups(df, ["g"], "x", 10).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(r["id"] for r in kept) == [*range(0, 900, 4), *range(900, 1000, 4)]
    assert {r["id"]: r["grp"] for r in groups} == {i: (i if i < 900 else i - 900) // 4 for i in range(1000)}
