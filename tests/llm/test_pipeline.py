"""The pipeline's stages on a planted corpus."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from scorespark.llm import simhash

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("bel", "dor", "fan", "gil", "hum", "jex", "kov", "lat")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    passage = prose(99, 60)
    near = prose(1, 300).split()
    near[150] = "changed"
    rows = [
        (1, prose(1, 300), "en"),
        (2, prose(1, 300).replace(" ", "\n"), "en"),
        (3, " ".join(near), "en"),
        (4, prose(4, 80) + " " + passage + " " + prose(5, 80), "en"),
        (5, prose(6, 80) + " " + passage + " " + prose(7, 80), "en"),
        (6, prose(8, 200), "en"),
        (7, None, "en"),
        (8, "123 456", None),
        (9, prose(9, 20), None),
    ]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, f"s{r[0] % 2}", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{root}/documents.parquet")
    return str(root), dict((r[0], r[1]) for r in rows), passage


def test_stages(spark, corpus, tmp_path):
    root, texts, passage = corpus
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, root)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == {1, 2, 3, 4, 5, 6, 9}
    assert set(seen[1]) == {1, 3, 4, 5, 6, 9}
    assert set(seen[2]) == {1, 4, 5, 6, 9}
    assert set(seen[3]) == {1, 4, 5, 6, 9}
    assert all(seen[3][i] == texts[i] for i in (1, 4, 6, 9))
    assert passage[100:300] not in seen[3][5] and len(seen[3][5]) < len(texts[5]) - 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, root)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {1, 4, 5, 6, 9}


def test_run(spark, corpus):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, corpus[0]).select("doc_id").collect()} == {1, 4, 5, 6, 9}


@pytest.mark.parametrize("ids, lang", [(range(1, 5), None), ([None] * 4, "en"), ([i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0][:4], "en")], ids=["no labels", "no ids", "all held out"])
def test_language_keeps_letters_where_nothing_is_learned(spark, ids, lang):
    texts = ["an ordinary text", None, "12 34 !", "日本語"]
    docs = spark.createDataFrame(list(zip(ids, texts, [lang] * 4, strict=True)), "doc_id long, text string, lang string")
    assert {r["text"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {texts[0], texts[3]}


def test_language_rejects_by_the_model(spark):
    """Scripts that were not learned and noise go; with labels of that script they stay."""
    odd = ["日本語のテキストです", "xqzkw vvbn qqrt zzxp bvxq"]
    known = [(i, f"this is the text number {'x' * (i % 3)} of many and it is about the house", "en") for i in range(40)]
    kept = lambda rows: {r["text"] for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    rows = [*known, *((100 + i, t, None) for i, t in enumerate(odd)), (200, "it is a house", None)]
    assert kept(rows) == {t for _, t, _ in known} | {"it is a house"}
    rows += [(300 + i, odd[0], "ja") for i in range(10)]
    assert kept(rows) == {t for _, t, _ in known} | {"it is a house", odd[0]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted_near_copies_are_caught(spark, tmp_path):
    """Of texts with changed, missing and added words, all pairs of similarity 0.8 or more are caught, and none below."""
    rng, rows, sets = random.Random(5), [], {}
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} or {tuple(t)}
    for k in range(120):
        base = prose(1000 + k, rng.choice((12, 40, 150, 400))).split()
        for c in range(3):
            words = list(base)
            for _ in range(c * rng.randrange(1, 1 + max(1, len(base) // 25))):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice(([], ["new"], ["quite", "new"]))
            rows.append((len(rows), " ".join(words), k))
            sets[len(rows) - 1] = shingles(words)
    spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "t"))
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.read.parquet(str(tmp_path / "t")), "").collect()}
    want = set()
    for k in range(120):
        own = [i for i, _, g in rows if g == k]
        label = {i: i for i in own}
        for a in own:
            for b in own:
                if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = {i: low if x == high else x for i, x in label.items()}
        want |= set(label.values())
    assert kept == want and 130 < len(want) < 300


def repeats(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def same_share(a, b):
    a, b = repeats(a), repeats(b)
    return (a & b).total() / (a | b).total()


def test_near_copies_by_fingerprints(spark, tmp_path):
    """Operator 1's links count: texts within three bits go where their shingles, repeats included, agree to 0.8; one
    fingerprint of otherwise different texts is not enough. Sets of shingles tell neither case."""
    line, rows = prose(70, 12), []
    for k in range(4):
        rows += [(10 * k + i, " ".join([prose(200 + 10 * k + i, 100), *[f"{line} {k}"] * 200])) for i in range(2)]  # mostly one line
        rows += [(10 * k + i, " ".join([prose(200 + 10 * k + i, 100), *[f"n{k}"] * 150])) for i in (5, 6)]  # over half one shingle
    texts = dict(rows)
    bits = lambda a, b: (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count()
    near = [10 * k for k in range(4) if bits(10 * k, 10 * k + 1) <= 3]
    assert near and all(same_share(texts[i], texts[i + 1]) >= 0.8 for i in near)
    assert all(bits(10 * k + 5, 10 * k + 6) == 0 and same_share(texts[10 * k + 5], texts[10 * k + 6]) < 0.8 for k in range(4))
    rows += [(100, None), (101, " \t"), (102, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert simhash.near_texts(docs.withColumnRenamed("doc_id", "row")).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - {i + 1 for i in near}


def test_fingerprint_links_match_brute_force(spark, tmp_path):
    """All pairs within a component of fingerprints are compared, also where tiles hold a few rows."""
    rng, texts = random.Random(8), []
    for k in range(25):
        base = prose(3000 + k, 150).split() + ["again"] * rng.choice((0, 0, 400))
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "new"
            texts.append(" ".join(words[rng.choice((0, 0, 100)) :]))
    prints = [simhash.fingerprint(t) for t in texts]

    def grouped(label, links):
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    pairs = [(j, i) for i in range(len(texts)) for j in range(i)]
    reach = grouped(list(range(len(texts))), [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = grouped(list(range(len(texts))), [(a, b) for a, b in pairs if reach[a] == reach[b] and same_share(texts[a], texts[b]) >= 0.8])
    spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    found = simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "t")), slot=2).collect()
    assert grouped(list(range(len(texts))), [(r["a"], r["b"]) for r in found]) == want
    assert len(set(reach)) < len(set(want)) < len(texts)
