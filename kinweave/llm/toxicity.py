"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over hashed words and proper word beginnings (they catch compounds and inflections) learns from confirmed toxic texts (P) and from texts taken as unlabelled (U). Its
risk is prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)): where the corrected part turns negative the step goes back up,
so the model cannot fit U below what the prior allows. The prior is the toxic share of the training labels.

P and U are bounded samples (``most_positive``, ``most_unlabelled`` rows with the smallest hash of their id), drawn from
training rows only; every document is scored on its whole text. Features of the sampled texts stay on the executors:
the driver gets the ``most_words`` codes that an aggregation selects, and of each sampled row only those codes' counts.

Contract: held out are rows with crc32(doc_id as text) mod 5 = 0; rows without an id are not held out and not learned
from. Labels, lang, source and doc_id are no inputs of a score. Null and empty texts get the score of the intercept; a
very long text is counted whole, in training and in scoring. Without a positive label every score is 0. Labels of
unknown documents and null labels are ignored, repeated equal labels count once; an id with both labels is positive.
Equal hashes of ids and equal gains of words are settled by the id and the word's code. Repeated rows get equal scores.
Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, map_arrow, materialize
from kinweave.llm._text import ALNUM, U64, Words, byte_sums, mix, slices

BITS = 20
#: Words added to a text's length, so that a few words decide little.
SMOOTH = 50


def held_out(column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


#: Lengths in bytes of the word beginnings; only longer words have them.
BEGINNINGS = (4, 5, 6, 7, 8, 9)


def _codes(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes of words, hashed features): the words themselves, then their beginnings of each length."""
    sums = byte_sums(words.data, words.start, fold=True)
    base = sums[words.start]
    yield np.arange(len(words.start)), (mix(sums[words.end] - base) >> U64(64 - BITS)).astype(np.int32)
    length = words.end - words.start
    for size in BEGINNINGS:
        own = np.flatnonzero(length > size)
        yield own, (mix(sums[words.start[own] + size] - base[own] + U64(size)) >> U64(64 - BITS)).astype(np.int32)


def _counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashed features, their counts, words) of each text."""
    for _, data, offsets in slices(texts):
        words = Words(data, offsets, ALNUM, fold=True)
        parts = [(own, codes, np.searchsorted(own, words.first)) for own, codes in _codes(words)]
        for i, n in enumerate(words.count.tolist()):
            found, counts = np.unique(np.concatenate([codes[cut[i] : cut[i + 1]] for _, codes, cut in parts]), return_counts=True)
            yield found, counts.astype(np.int32), n


def _sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int) -> DataFrame:
    """(doc_id, positive, codes, counts, n) of the sampled training texts, written to the checkpoint folder."""
    near = F.xxhash64(F.col("doc_id"), F.lit(17))
    toxic = labels.filter(F.col("toxic") == 1).filter(~held_out()).select("doc_id").distinct()
    known = columns(docs, "doc_id").filter(~held_out())
    sides = [(True, known.join(toxic, "doc_id", "left_semi"), most_positive), (False, known, most_unlabelled)]
    chosen = [own.orderBy(near, "doc_id").limit(most).distinct().withColumn("positive", F.lit(side)) for side, own, most in sides]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c.tobytes(), k.tobytes(), n) for c, k, n in _counts(batch.column(1))]
            own = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], ["doc_id", "positive", "codes", "counts", "n"])

    texts = columns(docs, "doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "positive")
    found = materialize(texts.mapInArrow(count, "doc_id long, positive boolean, codes binary, counts binary, n long"))
    # An id with several rows brings them all; the bounds hold for rows too.
    kept = [found.filter(F.col("positive") == side).orderBy(near, "doc_id", "codes", "counts").limit(most) for side, _, most in sides]
    return materialize(kept[0].union(kept[1]))


def _select(rows: DataFrame, most: int) -> list[int]:
    """The codes that set P apart from U best, by the likelihood ratio of the shares of texts that hold them."""
    texts = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    p, u = float(texts[True]), float(texts[False])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bool, list[np.ndarray]] = {True: [], False: []}
            for side, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[side].append(np.frombuffer(codes, np.int32))  # a text's codes are distinct
            for side, own in seen.items():
                if own:
                    codes, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([side] * len(codes)), pa.array(codes), pa.array(n.astype(np.int64))], ["positive", "code", "n"])

    held = rows.select("positive", "codes").mapInArrow(spread, "positive boolean, code int, n long").groupBy("code").agg(*[F.coalesce(F.sum(F.when(F.col("positive") == side, F.col("n"))), F.lit(0)).alias(c) for side, c in ((True, "p"), (False, "u"))])
    a, b = (F.col("p") + 0.5) / (p + 1), (F.col("u") + 0.5) / (u + 1)
    gain = p * (a * F.log(a / b) + (1 - a) * F.log(F.greatest(1 - a, F.lit(1e-9)) / F.greatest(1 - b, F.lit(1e-9))))
    best = held.filter("p >= 3").withColumn("gain", gain).filter("gain > 6")  # about the 0.05 % level of a single word
    return sorted(r["code"] for r in best.orderBy(F.desc("gain"), "code").limit(most).collect())


def _matrix(rows: DataFrame, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the sampled rows, whether each is positive), positive rows first, in an order of content."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, counts, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                _, at, to = np.intersect1d(np.frombuffer(own, np.int32), codes, assume_unique=True, return_indices=True)
                out.append((to.astype(np.int16).tobytes(), (100 * np.frombuffer(counts, np.int32)[at] / (n + SMOOTH)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in out], pa.binary()) for k in range(2)]], ["doc_id", "positive", "at", "share"])

    got = rows.mapInArrow(reduce, "doc_id long, positive boolean, at binary, share binary").toArrow()
    got = got.sort_by([("positive", "descending"), ("doc_id", "ascending"), ("at", "ascending"), ("share", "ascending")])
    x = np.zeros((got.num_rows, len(codes)), np.float32)
    for i, (at, share) in enumerate(zip(got["at"], got["share"], strict=True)):
        x[i, np.frombuffer(at.as_buffer(), np.int16)] = np.frombuffer(share.as_buffer(), np.float32)
    return x, np.array(got["positive"].to_pylist(), dtype=bool)


def non_negative_pu(x: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 600, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear model under the non-negative risk with logistic loss, by Adam over all rows."""
    p, u = x[: int(positive.sum())], x[int(positive.sum()) :]  # positive rows come first, so these are views
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        zp, zu = (p @ w).astype(float) + b, (u @ w).astype(float) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up_p = -prior * (1 - sp) / len(p)
        down_u, down_p = su / len(u), -prior * sp / len(p)
        if negative >= 0:
            gp, gu = up_p + down_p, down_u
        else:  # step back: undo what overfits the unlabelled texts
            gp, gu = -down_p, -down_u
        slope = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, most_words: int = 512) -> tuple[np.ndarray, float] | None:
    """Weights of the hashed words and the intercept; None without positive labels."""
    labels = columns(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    ids = labels.filter(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    split = ids.agg(F.sum("toxic"), F.count("*")).first()
    if not split[0]:
        return None
    rows = _sample(docs, labels, most_positive, most_unlabelled)
    if rows.select("positive").distinct().count() < 2:
        return None
    prior = min(max(split[0] / split[1], 1e-4), 0.5)
    codes = np.array(_select(rows, most_words), np.int32)
    x, positive = _matrix(rows, codes)
    w, b = non_negative_pu(x, positive, prior)
    out = np.zeros(1 << BITS, np.float32)
    out[codes] = w
    return out, float(b)


def scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The columns of ``docs`` with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))
    other = [c for c in docs.columns if c not in ("text", "score", "predicted", "held_out")]
    schema = columns(docs, *other, "text").schema.add("score", "double").add("predicted", "integer")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                if model.value is None:
                    out.append(np.zeros(len(offsets) - 1))
                    continue
                weights, b = model.value
                words = Words(data, offsets, ALNUM, fold=True)
                z = np.zeros(len(words.count))
                for own, codes in _codes(words):
                    sums = np.concatenate([[0.0], np.cumsum(weights[codes], dtype=np.float64)])
                    z += np.diff(sums[np.searchsorted(own, words.first)])
                z = b + 100 * z / (words.count + SMOOTH)
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            score = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    rated = map_arrow(columns(docs, *other, "text"), rate, schema)
    return rated.withColumn("held_out", F.coalesce(held_out(), F.lit(False))) if "doc_id" in other else rated
