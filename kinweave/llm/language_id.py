"""Language identification by mixtures: every text is explained by shares of languages.

A language's model are smoothed frequencies of hashed byte trigrams within words, counted over all training rows. A
word's likelihood under each language is the product over its trigrams; expectation-maximisation finds each text's
language shares. Its language set is chosen by penalised likelihood: the best single language, then one language more as
long as the fit gains more than the penalty for a further share (BIC). The prediction is the largest share.

The model is languages x 2**15 numbers; above ``MOST_LANGS`` distinct values of lang training is refused with an error.

Contract: held out are rows with crc32(doc_id as text) mod 5 = 0; models come from text and non-null lang of the other
rows only. Null texts and texts without a letter are ``und`` with score 0. Without any model every text is ``und``.
Ties go to the first language in code-point order. Texts of any length are read whole, in slices. Extra columns are
carried along, rows are never dropped; repeated rows and ids get each their own text's answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, map_arrow, materialize
from kinweave.llm._text import Words, slices
from kinweave.llm.toxicity import held_out

BITS = 15
#: Distinct languages that a model may have: 64 MB on the executors.
MOST_LANGS = 512
#: Bytes of words: letters, A-Z folded, and every byte of a multi-byte character.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B]


def _trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first code of each word, and the end): trigrams of each word with one blank before and after it."""
    length = words.end - words.start
    if not len(length):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    first = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(words.start - first[:-1], length) + np.arange(first[-1])
    middle = _FOLD[words.data[at]]
    before, after = np.roll(middle, 1), np.roll(middle, -1)
    before[first[:-1]] = 32
    after[first[1:] - 1] = 32
    code = (before << 16 | middle << 8 | after) * np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BITS)).astype(np.int64), first


def _words(texts: pa.Array) -> Iterator[Words]:
    for _, data, offsets in slices(texts):
        yield Words(data, offsets, LETTERS)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all training rows; a task sends one row for each language and code that it met."""
    known = columns(docs, "doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(~F.coalesce(held_out(), F.lit(False)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                codes = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(n[codes])], ["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            at = 0
            for words in _words(batch.column(0)):
                codes, first = _trigrams(words)
                edges = first[words.first]
                for i in range(len(words.count)):
                    own = codes[edges[i] : edges[i + 1]]
                    if langs[at + i] not in sums:
                        sums[langs[at + i]] = np.zeros(1 << BITS, np.int64)
                    np.add.at(sums[langs[at + i]], own, 1)
                at += len(words.count)
            if len(sums) > 64:
                yield from told()
        yield from told()

    return known.select("text", "lang").mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log-likelihoods of each code; bounded by languages x 2**BITS numbers."""
    counted = materialize(trigram_counts(docs))
    found = counted.select("lang").distinct().limit(MOST_LANGS + 1).count()
    if found > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} distinct values")
    rows = counted.toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), 1 << BITS))
    counts[np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy()) if langs else [], rows["code"]] = rows["n"]
    shared = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * (1 << BITS))
    smooth = 200.0  # a language's counts are held against the shared ones, so that rare codes say little
    return langs, np.log((counts + smooth * shared) / (counts.sum(1, keepdims=True) + smooth)).astype(np.float32)


def _shares(own: np.ndarray, edges: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) of each text by expectation-maximisation over its words; allowed: languages of each text."""
    n = np.diff(edges)
    text = np.repeat(np.arange(len(n)), n)
    top = own.max(1, keepdims=True)
    like = np.exp(own - top)
    shares = allowed / allowed.sum(1, keepdims=True)
    total = np.zeros(len(like))
    for _ in range(rounds):
        part = like * shares[text]
        total = part.sum(1)
        part /= total[:, None].clip(1e-300)
        sums = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(part, 0)])
        shares = np.where(n[:, None] > 0, (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)[:, None], shares)
    total = (like * shares[text]).sum(1)
    sums = np.concatenate([[0.0], np.cumsum(np.log(total.clip(1e-300)) + top[:, 0])])
    return shares, sums[edges[1:]] - sums[edges[:-1]]


def mixtures(words: Words, likelihood: np.ndarray) -> np.ndarray:
    """The language shares of each text of a slice, over the set that the penalised likelihood selects."""
    codes, first = _trigrams(words)
    langs = len(likelihood)
    own = np.zeros((len(words.start), langs))
    for k in range(langs):
        sums = np.concatenate([[0.0], np.cumsum(likelihood[k][codes], dtype=np.float64)])
        own[:, k] = sums[first[1:]] - sums[first[:-1]]
    edges = words.first
    sums = np.concatenate([np.zeros((1, langs)), np.cumsum(own, 0)])
    single = sums[edges[1:]] - sums[edges[:-1]]
    best = single.argmax(1)
    shares = np.zeros((len(best), langs))
    shares[np.arange(len(best)), best] = 1.0
    if langs == 1:
        return shares
    score = single.max(1)
    full, _ = _shares(own, edges, np.ones((len(best), langs)))
    # Texts of one language: their share is how surely the text as a whole is of it.
    shares *= np.exp(score - np.logaddexp.reduce(single, 1))[:, None]
    order = np.argsort(-full, 1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(words.count, 2))
    mixed = np.flatnonzero(np.sort(full, 1)[:, -2] > 0.02)
    for size in range(2, langs + 1):
        if not len(mixed):
            break
        n = words.count[mixed]
        rows = np.repeat(edges[mixed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        allowed = np.zeros((len(mixed), langs))
        np.put_along_axis(allowed, order[mixed, :size], 1.0, 1)
        own_shares, fit = _shares(own[rows], np.concatenate([[0], np.cumsum(n)]), allowed)
        fit -= 2 * (size - 1) * penalty[mixed]  # for each further language its share and its choice
        better = fit > score[mixed]
        score[mixed[better]] = fit[better]
        shares[mixed[better]] = own_shares[better]
        mixed = mixed[better]
    return shares


def _lettered(batch: pa.Array) -> list[bool]:
    """Whether each text has a letter."""
    return [t is not None and any(map(str.isalpha, t)) for t in batch.to_pylist()]


def predict(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with held_out, lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    other = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "held_out")]
    schema = columns(docs, *other, "text").schema.add("lang_pred", "string").add("score", "double")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, likelihood = model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            named, score = [], []
            for words in _words(texts) if langs else ():
                shares = mixtures(words, likelihood)
                best = shares.argmax(1)
                named += [langs[k] for k in best]
                score += shares[np.arange(len(best)), best].tolist()
            if not langs:
                named, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, lettered in enumerate(_lettered(texts)):
                if not lettered:
                    named[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(np.clip(score, 0.0, 1.0), pa.float64())], names=schema.names)

    rated = map_arrow(columns(docs, *other, "text"), rate, schema)
    return rated.withColumn("held_out", F.coalesce(held_out(), F.lit(False))) if "doc_id" in other else rated
