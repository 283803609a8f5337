"""Real files: heads read by tasks, rules of pages, results kept by file."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from scorespark.sources import files as L


def png(size=20_000, width=1200, height=1500, signature=L.PNG):
    head = signature + b"\0\0\0\rIHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big")
    return head[:size] + b"\7" * max(0, size - len(head))


def put(root, name, content):
    path = Path(root) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_one_broken_file_for_each_rule(spark, tmp_path):
    root = str(tmp_path)
    for name, content in {
        "a/1.png": png(), "a/2.png": png(10_000), "a/3.png": png(9_999), "b/1.png": png(signature=b"GIF89a.."), "b/2.png": png(width=999),
        "c/1.png": png(height=999), "c/2.png": b"", "d/1.png": png(), "e/1.png": png(), "e/other.txt": b"x", ".hidden/1.png": b"x", "a/_4.png": b"x",
    }.items():
        put(root, name, content)
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 2), ("f", 1)], "document string, pages int")
    heads = L.file_heads(spark, root, "*.png", files=2)
    got = L.checked_pages(heads, expected, F.regexp_extract("path", r"/(\w+)/\d+\.png$", 1)).collect()
    told = {(r.document, r.path and r.path.rsplit("/", 1)[1]): r.rule for r in got}
    assert len(got) == len(told) and told == {
        ("a", "3.png"): "too small", ("b", "1.png"): "wrong signature", ("b", "2.png"): "too narrow", ("c", "1.png"): "too low", ("c", "2.png"): "too small",
        ("d", None): "wrong page count", ("f", None): "wrong page count", ("e", None): "unknown document",
    }
    assert heads.rdd.getNumPartitions() == 5


def test_heads_and_tails(spark, tmp_path):
    put(tmp_path, "x/long", b"abcd" + b"." * 1000 + b"wxyz")
    put(tmp_path, "short", b"ab")
    put(tmp_path, "none", b"")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.head), bytes(r.tail)) for r in L.file_heads(spark, root, head=4, tail=3).collect()}
        assert got == {"long": (1008, b"abcd", b"xyz"), "short": (2, b"ab", b"ab"), "none": (0, b"", b"")}
    os.makedirs(tmp_path / "empty")
    assert L.file_heads(spark, str(tmp_path / "empty")).collect() == []


def test_results_are_kept_by_file(spark, tmp_path):
    root, table = str(tmp_path / "in"), str(tmp_path / "kept")
    asked = []

    def listed():
        return L.file_heads(spark, root, "*.txt", head=100).drop("tail")

    def work(files):
        asked.append(sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()))
        return files.select("path", F.length("head").alias("n"))

    def run(**more):
        return {r.path.rsplit("/", 1)[1]: r.n for r in L.with_results(listed(), work, table, "n int", **more).collect()}

    put(root, "a.txt", b"one")
    put(root, "b.txt", b"four")
    assert run(dpi=300) == {"a.txt": 3, "b.txt": 4} and asked.pop() == ["a.txt", "b.txt"]
    assert run(dpi=300) == {"a.txt": 3, "b.txt": 4} and asked.pop() == []
    put(root, "c.txt", b"12345")
    os.utime(Path(root) / "a.txt", (1_000_000_000, 1_000_000_000))
    assert run(dpi=300) == {"a.txt": 3, "b.txt": 4, "c.txt": 5} and asked.pop() == ["a.txt", "c.txt"]
    assert run(dpi=150) == {"a.txt": 3, "b.txt": 4, "c.txt": 5} and asked.pop() == ["a.txt", "b.txt", "c.txt"]
    assert run(dpi=300) == {"a.txt": 3, "b.txt": 4, "c.txt": 5} and asked.pop() == []
    assert run(dpi=300, force=True) == {"a.txt": 3, "b.txt": 4, "c.txt": 5} and asked.pop() == ["a.txt", "b.txt", "c.txt"]
    os.remove(Path(root) / "b.txt")
    assert run(dpi=300) == {"a.txt": 3, "c.txt": 5} and asked.pop() == []

    # A run that fails keeps nothing, and its files are asked for again.
    put(root, "d.txt", b"x")
    try:
        L.with_results(listed(), lambda f: f.select("path", F.raise_error(F.lit("no")).cast("int").alias("n")), table, "n int", dpi=300).collect()
    except Exception as e:
        assert "no" in str(e)
    assert run(dpi=300) == {"a.txt": 3, "c.txt": 5, "d.txt": 1} and asked.pop() == ["d.txt"]
