"""The tokenization automaton against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from scorespark.llm import automaton, queries

NAME = "byte_bpe_50k.json"
PARTS = ["a", "e", "th", "The", "ing", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", "-", "--------", "é", "ü", "日本", "🙂", " ", "\x1c", "\x85", "͸", "౜", "<|endoftext|>", "<|endof", "http://", "́", "　", "\x00"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(P.path(NAME))


def test_automaton_matches_library_on_tables(spark, sf_dir, tok):
    want = {}
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_automaton(spark, sf_dir).collect()}
    assert got == want


def test_automaton_matches_library_on_random_strings(tok):
    rng, codec = random.Random(5), automaton.automaton_codec(NAME)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices("-=*_ .ab", k=300)) for _ in range(300)] + ["".join(map(chr, rng.choices(range(0xD7FF), k=30))) for _ in range(300)]
    for text in texts:
        ids, said = codec.encode(text)
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.uint32).tolist() == want and said == ",".join(map(str, want)), text
        assert codec.decode(np.array(want, np.int64)).decode(errors="replace") == tok.decode(want, skip_special_tokens=False)


def test_decoding_of_any_ids(tok):
    rng, codec = random.Random(6), automaton.automaton_codec(NAME)
    for _ in range(500):
        ids = rng.choices(range(50_257), k=20)
        assert codec.decode(np.array(ids)).decode(errors="replace") == tok.decode(ids, skip_special_tokens=False)
    assert codec.decode(np.array([-1, 50_257, 64])) == b"a"


def merged(word, merges):
    """Ids of a word by making all merges, the first in the list first, each from the left."""
    parts = [bytes([b]) for b in word]
    for u, v in merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == u and parts[k + 1] == v:
                parts[k : k + 2] = [u + v]
            k += 1
    return parts


@pytest.mark.parametrize("seed", range(40))
def test_gadgets_accept_what_merging_gives(seed):
    """Random merges over two letters: each word has one accepted sequence, that of merging; merges that never happen too."""
    rng = random.Random(seed)
    tokens, merges = [b"a", b"b"], []
    for _ in range(rng.randint(1, 12)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    ids = {t: i for i, t in enumerate(tokens)}
    machine = automaton.Automaton(ids, merges)
    for n in range(1, 9):
        for bits in range(1 << n):
            word = bytes(b"ab"[bits >> k & 1] for k in range(n))
            want = [ids[t] for t in merged(word, merges)]
            assert list(machine.encode(word)) == want
            assert all(machine.arc(x, y) for x, y in zip(want, want[1:], strict=False))


def test_encode_and_decode_of_odd_rows(spark, tmp_path):
    rows = [(1, None, 1), (1, None, 1), (None, "", 2), (3, "x <|endoftext|> é" * 9, 3), (4, "a" * 100_000, 4)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    encoded = automaton.automaton_encode(docs)
    back = sorted((r.doc_id or 0, r.text) for r in automaton.automaton_decode(encoded).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    assert automaton.automaton_digests(docs.limit(0)).collect() == []
    strange = spark.createDataFrame([(1, [64, None, 99_999, 64]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in automaton.automaton_decode(strange).orderBy("doc_id").collect()] == ["aa", ""]
