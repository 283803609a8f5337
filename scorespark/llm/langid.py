"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorespark.llm.common import map_batches, saved
from scorespark.llm.tokens import HARD, KIND, LETTER, SPACE, Numbers, Units, file_of

#: Runs of letters; case does not count.
WORDS = re.compile(r"[^\W\d_]+")
#: For Units: runs of plain letters, and of anything that holds other characters than ASCII and Latin-1 letters.
KINDS = np.where((KIND == HARD) & (np.arange(256) >= 0x80), HARD, np.where(KIND == LETTER, LETTER, SPACE)).astype(np.uint8)
#: Characters, with the mark, of words that are learned from many at once; longer ones one by one.
TOGETHER = 64
MARK = "▁"
#: Texts to a model: the expected size of the sample that it is fitted on, in equal parts for each language, and the
#: least part of a language that has as many.
SAMPLE_ROWS, LEAST_ROWS = 4000, 200
ROUNDS = 2
FLOOR = 1e-7
#: Languages that a model has; texts pass through as many models as that takes, and each goes to every worker.
BLOCK = 256
#: Cells (word, place, length) of a chart that are made at once, about, and steps after which probabilities are rescaled.
CELLS, RESCALE = 1 << 20, 24
PRED, SCORE, RATE = "_scorespark_lang", "_scorespark_score", "_scorespark_rate"
#: Least log probability a character (letters and one mark a word) under the best language for keep_identified(): one in
#: about 1100. Over sf0.01 all texts have -2.4 and more, -6.3 and more with a model of a single labelled text; noise such
#: as "xqzkw vvbn" has -7.4, scripts that were not learned have -11 and less.
LEAST_RATE = -7.0


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> dict[str, int]:
    """Lower-case pieces of a public vocabulary that consist of letters, numbered from 2. 0: no piece, 1: any character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file_of(vocabulary))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    good = sorted(p for p in found if p.removeprefix(MARK).isalpha())
    return {p: i for i, p in enumerate(good, 2)}


class Pieces:
    """Numbers of the pieces that lie in words, found by polynomial hashes of all substrings at once."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, table: dict[str, int]):
        self.size = max(table.values(), default=1) + 1
        self.longest = max(map(len, table), default=1)
        keys = np.array([self.key(p) for p in table], np.uint64).astype(np.int64)
        self.numbers = Numbers(keys)
        self.ids = np.array([*table.values(), 0], np.int32)

    def key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + (ord(c) + 1) * 0xBF58476D1CE4E5B9) % (1 << 64)
        return h

    def ending(self, signs: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """[word, end - lo, length] -> piece (0: none, 1: any one character) that ends with characters lo .. hi - 1."""
        n = len(signs)
        value = (signs.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        most = self.longest
        first = max(0, lo - most + 1)
        part = value[:, first:hi]
        chart = np.zeros((n, hi - lo, most + 1), np.int32)
        h = np.zeros_like(part)
        for length in range(1, min(most, hi) + 1):
            # h[:, k]: hash of the `length` characters that begin with first + k
            h = h[:, : part.shape[1] - length + 1] * self.FACTOR + part[:, length - 1 :]
            begin = max(lo - length + 1 - first, 0)
            if begin >= h.shape[1]:
                continue
            at = begin + first + length - 1 - lo
            chart[:, at : at + h.shape[1] - begin, length] = self.ids[self.numbers(h[:, begin:].astype(np.int64))]
        chart[:, :, 1] = np.maximum(chart[:, :, 1], 1)
        return chart

    def chart(self, words: list[str]) -> np.ndarray:
        """[word, start, length] -> piece, of whole words."""
        signs, sizes = signs_of(words)
        ends = self.ending(signs, 0, signs.shape[1])
        out = np.zeros_like(ends)
        for length in range(1, min(self.longest, signs.shape[1]) + 1):
            out[:, : signs.shape[1] - length + 1, length] = ends[:, length - 1 :, length]
        out[np.arange(signs.shape[1])[None, :, None] + np.arange(self.longest + 1) > sizes[:, None, None]] = 0
        return out


def signs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words as numbers, [word, place], and their sizes."""
    sizes = np.array([len(w) for w in words])
    return np.array(words, f"U{sizes.max()}").view(np.uint32).reshape(len(words), -1), sizes


def score_words(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """[word, language]: log probability, summed over all segmentations. Words have about the same length, which may be
    any: the forward sum needs the last places only, as many as a piece can have, and is rescaled as it goes."""
    signs, sizes = signs_of(words)
    n, longest = signs.shape
    out, scale = np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    window = [np.ones((n, p.shape[1]))]  # the last one is that of the place before
    step = max(RESCALE, CELLS // (n * (pieces.longest + 1)))
    for lo in range(0, longest, step):
        chart = pieces.ending(signs, lo, min(longest, lo + step))
        for k in range(chart.shape[1]):
            now = window[-1] * p[chart[:, k, 1]]
            for length in range(2, len(window) + 1):
                i = chart[:, k, length]
                if i.any():
                    now += window[-length] * p[i]
            window = [*window[-pieces.longest + 1 :], now]
            if len(done := np.flatnonzero(sizes == lo + k + 1)):
                out[done] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
            if (lo + k + 1) % RESCALE == 0:
                by = np.maximum(now, 1e-300)
                window = [x / by for x in window]
                scale += np.log(by)
    return out


def forward(chart: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: probability of the first characters, summed over their segmentations."""
    n, longest, _ = chart.shape
    alpha = np.zeros((n, longest + 1, p.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, longest + 1):
        for s in range(max(0, e - chart.shape[2] + 1), e):
            alpha[:, e] += alpha[:, s] * p[chart[:, s, e - s]]
    return alpha


def backward(chart: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, longest, _ = chart.shape
    beta = np.zeros((n, longest + 1, p.shape[1]))
    beta[np.arange(n), sizes] = 1
    for s in range(longest - 1, -1, -1):
        for e in range(s + 1, min(longest, s + chart.shape[2] - 1) + 1):
            beta[:, s] += beta[:, e] * p[chart[:, s, e - s]]
    return beta


def expected_pieces(word: str, pieces: Pieces, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected number of each) over all segmentations of one word of any length, by logarithms. p: of one language."""
    signs, _ = signs_of([word])
    n, most, step = signs.shape[1], pieces.longest, max(1, CELLS // (pieces.longest + 1))
    ends = np.concatenate([pieces.ending(signs, lo, min(n, lo + step))[0] for lo in range(0, n, step)])  # [end - 1, length]
    with np.errstate(divide="ignore"):
        logs = np.log(p)[ends]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for e in range(1, n + 1):
        k = min(most, e)
        alpha[e] = np.logaddexp.reduce(alpha[e - k : e][::-1] + logs[e - 1, 1 : k + 1])
    for s in range(n - 1, -1, -1):
        k = min(most, n - s)
        beta[s] = np.logaddexp.reduce(beta[s + 1 : s + k + 1] + logs[np.arange(s, s + k), np.arange(1, k + 1)])
    e, length = np.nonzero(ends)
    fits = length <= e + 1
    e, length = e[fits], length[fits]
    return ends[e, length], np.exp(alpha[e + 1 - length] + logs[e, length] + beta[e + 1] - alpha[n])


def by_length(words: list[str], wide: int, cells: int = CELLS):
    """Numbers of words in groups of like length, so that charts, with `wide` cells a character, hold few empty cells and are
    no larger than cells, but for single words."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        to = at + 1
        # Lengths rise, so the last word says how large the chart is.
        while to < len(order) and (to - at + 1) * len(words[order[to]]) * wide <= cells:
            to += 1
        yield order[at:to]
        at = to


class Model:
    """p[piece, language]; row 0 is no piece. Scores the distinct words of a batch by the forward sum."""

    def __init__(self, vocabulary: str, languages: list[str], p: np.ndarray):
        self.languages, self.p, self.pieces = languages, p, Pieces(pieces(vocabulary))

    def _of_units(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, characters with a mark for each word) of each distinct unit."""
        units = u.distinct.cast(pa.string()).to_pylist()
        words, owner = [], []
        for k in np.flatnonzero(~u.hard).tolist():
            words.append(MARK + units[k])
            owner.append(k)
        for k in np.flatnonzero(u.hard).tolist():
            for w in WORDS.findall(units[k].lower()):
                words.append(MARK + w)
                owner.append(k)
        score, size = np.zeros((len(units), len(self.languages))), np.zeros(len(units), np.int64)
        np.add.at(size, owner, [len(w) for w in words])
        for group in by_length(words, self.pieces.longest + 1) if self.languages else ():
            np.add.at(score, [owner[k] for k in group], score_words([words[k] for k in group], self.pieces, self.p))
        return score, size

    def characters(self, texts: pa.Array) -> np.ndarray:
        """Characters of words with a mark for each."""
        u = Units(pc.fill_null(texts, ""), KINDS)
        _, size = self._of_units(u)
        upto, chars = np.append(u.first, len(u.codes)), np.zeros(len(texts), np.int64)
        if len(full := np.flatnonzero(np.diff(upto))):
            chars[full] = np.add.reduceat(size[u.codes], upto[full])
        return chars

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language (its number), its log probability, the sum of all languages' probabilities over its own, and
        the number of characters with a mark for each word, of each text."""
        u = Units(pc.fill_null(texts, ""), KINDS)
        score, size = self._of_units(u)
        upto = np.append(u.first, len(u.codes))
        n, full = len(texts), np.flatnonzero(np.diff(upto))
        total, chars = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        if len(full):
            total[full] = np.add.reduceat(score[u.codes], upto[full], axis=0)
            chars[full] = np.add.reduceat(size[u.codes], upto[full])
        best = total.argmax(axis=1)
        top = total[np.arange(n), best]
        return best, top, np.exp(total - top[:, None]).sum(axis=1), chars


def held_out() -> Column:
    """True for documents that are never learned from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> list[tuple[list[str], np.ndarray]]:
    """Piece probabilities of each language by expectation-maximisation over word counts, BLOCK languages at a time.

    Learns from text and lang of documents that are not held out and have both, and a letter. All their languages are
    learned, each on a sample of about sample_rows / languages of its texts, or LEAST_ROWS if that is more (all, if there
    are fewer), chosen by a hash of doc_id and text; rows that repeat both count as one. Word counts and expected piece
    counts are summed by Spark; the counts of pieces, as many as the vocabulary has times BLOCK, and one row for each
    language come to the driver.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    labels = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    rows = {r["lang"]: r["n"] for r in labels.collect()}
    if not rows:
        return []
    most = max(sample_rows // len(rows), LEAST_ROWS)
    share = F.least(F.lit(1 << 30), F.floor(F.lit((1 << 30) * most) / F.greatest(F.lit(1), F.col("n"))))
    sample = usable.join(F.broadcast(labels.select("lang", share.alias("_share"))), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("_share"))  # a row for each language
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count_words(batch: pa.RecordBatch) -> dict:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for w in WORDS.findall(text.lower()):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        keys = list(counts)
        return {"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(counts.values(), pa.int64())}

    words = map_batches(sample.select("lang", "text"), lambda: count_words, "lang string, word string, n long")
    words = saved(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    names = sorted(rows)
    blocks = [names[k : k + BLOCK] for k in range(0, len(names), BLOCK)]
    return [(block, _fit_block(words.where(F.col("lang").between(block[0], block[-1])), block, vocabulary, rounds)) for block in blocks]


def _fit_block(words: DataFrame, languages: list[str], vocabulary: str, rounds: int) -> np.ndarray:
    table = pieces(vocabulary)
    size, at = len(table) + 2, {x: i for i, x in enumerate(languages)}
    p = np.full((size, len(languages)), 1 / size)
    p[0] = 0
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(p)

        def make(shared=shared):
            known = Pieces(table)

            def expect(batch: pa.RecordBatch) -> dict:
                p, total = shared.value, np.zeros((size, len(languages)))
                langs, texts, ns = batch["lang"].to_pylist(), [MARK + w for w in batch["word"].to_pylist()], batch["n"].to_pylist()
                short = [k for k, w in enumerate(texts) if len(w) <= TOGETHER]
                for part in by_length([texts[k] for k in short], known.longest + 1):
                    group = [short[k] for k in part]
                    chart, sizes = known.chart([texts[k] for k in group]), np.array([len(texts[k]) for k in group])
                    own, n = np.array([at[langs[k]] for k in group]), np.array([ns[k] for k in group], float)
                    alpha, beta = forward(chart, p), backward(chart, p, sizes)
                    rows = np.arange(len(group))
                    weight = n / np.maximum(alpha[rows, sizes, own], 1e-300)
                    a, b = alpha[rows, :, own], beta[rows, :, own]
                    for s in range(chart.shape[1]):
                        for length in range(1, min(known.longest, chart.shape[1] - s) + 1):
                            i = chart[:, s, length]
                            use = np.flatnonzero(i)
                            if len(use):
                                np.add.at(total, (i[use], own[use]), weight[use] * a[use, s] * p[i[use], own[use]] * b[use, s + length])
                for k in set(range(len(texts))) - set(short):
                    i, times = expected_pieces(texts[k], known, p[:, at[langs[k]]])
                    np.add.at(total, (i, at[langs[k]]), ns[k] * times)
                i, lang = np.nonzero(total)
                return {"piece": pa.array(i, pa.int64()), "lang": pa.array(lang, pa.int64()), "c": pa.array(total[i, lang], pa.float64())}

            return expect

        got = map_batches(words, make, "piece long, lang long, c double").groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas()
        counts = np.zeros_like(p)
        counts[got["piece"], got["lang"]] = got["c"]
        p = np.maximum(counts / np.maximum(counts.sum(axis=0), 1e-300), FLOOR)
        p[0] = 0
        shared.unpersist()
    # What is summed in another order must not change a prediction.
    return np.round(p, 12)


def identify_language(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score (probability among the learned languages).

    Input: doc_id, text, lang; lang is only learned from. Texts that are null or have no letter get 'und' and score 0,
    as all do where there is nothing to learn from. doc_id may be null or repeated; other columns are ignored.
    """
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs, vocabulary, sample_rows), vocabulary)
    return out.select("doc_id", "held_out", F.col(PRED).alias("lang_pred"), F.col(SCORE).alias("score"))


_BEST, _TOP, _SUM, _CHARS = "_scorespark_best", "_scorespark_top", "_scorespark_sum", "_scorespark_chars"


def predict(docs: DataFrame, models: list[tuple[list[str], np.ndarray]], vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """docs, all columns (text among them), with PRED, SCORE and RATE added: the best of all models' languages, its probability
    among them, and the text's log probability a character under it (null where there is no letter, 0 where there is no
    language). Each model passes over the texts and keeps what is best so far."""
    names = docs.columns
    for languages, p in models or [([], np.zeros((len(pieces(vocabulary)) + 2, 0)))]:
        docs = _one_model(docs, languages, p, vocabulary)
    told = (F.col(_CHARS) > 0) & F.col(_BEST).isNotNull()
    rate = F.when(F.col(_CHARS) > 0, F.coalesce(F.col(_TOP) / F.col(_CHARS), F.lit(0.0)))
    return docs.select(*names, F.when(told, F.col(_BEST)).otherwise("und").alias(PRED), F.when(told, 1 / F.col(_SUM)).otherwise(0.0).alias(SCORE), rate.alias(RATE))


def _one_model(docs: DataFrame, languages: list[str], p: np.ndarray, vocabulary: str) -> DataFrame:
    """docs with the best language so far, its log probability, the sum of probabilities over its own, and the characters."""
    shared, first = docs.sparkSession.sparkContext.broadcast(p), _BEST not in docs.columns

    def make():
        model = _model(vocabulary, tuple(languages), shared)

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: batch[c] for c in batch.schema.names}
            if not languages:
                n = len(batch)
                chars = model.characters(batch["text"])
                return out | {_BEST: pa.nulls(n, pa.string()), _TOP: pa.nulls(n, pa.float64()), _SUM: pa.nulls(n, pa.float64()), _CHARS: pa.array(chars, pa.int64())}
            best, top, total, chars = model.predict(batch["text"])
            name = pa.array(languages).take(pa.array(best))
            if not first:
                old, old_sum = batch[_TOP].to_numpy(zero_copy_only=False), batch[_SUM].to_numpy(zero_copy_only=False)
                stays = old >= top
                high = np.maximum(old, top)
                total = old_sum * np.exp(old - high) + total * np.exp(top - high)
                name, top = pc.if_else(pa.array(stays), batch[_BEST], name), high
            return out | {_BEST: name, _TOP: pa.array(top, pa.float64()), _SUM: pa.array(total, pa.float64()), _CHARS: pa.array(chars, pa.int64())}

        return work

    added = [(_BEST, T.StringType()), (_TOP, T.DoubleType()), (_SUM, T.DoubleType()), (_CHARS, T.LongType())]
    schema = T.StructType([*docs.schema.fields, *([T.StructField(n, k) for n, k in added] if first else [])])
    return map_batches(docs, make, schema)


_models: dict[tuple, Model] = {}


def _model(vocabulary: str, languages: tuple[str, ...], shared) -> Model:
    """One model for each broadcast and worker, so that what it remembers serves all its tasks."""
    key = (vocabulary, languages, shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else hash(shared.value.tobytes()))
    if key not in _models:
        _models.clear()
        _models[key] = Model(vocabulary, list(languages), shared.value)
    return _models[key]


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose language can't be told: null texts, texts without letters, and texts
    that the best of the learned languages gives less than LEAST_RATE a character.

    Where there is nothing to learn from, all texts with letters stay.
    """
    return predict(docs, fit(docs)).where(F.col(RATE) >= LEAST_RATE).select(*docs.columns)
