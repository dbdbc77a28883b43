"""Benchmark decontamination by winnowing.

Of each sliding window of hashes of k consecutive words the smallest is kept as a fingerprint, with k and the window
so chosen that every shared span of ``span`` words (13) holds a common fingerprint.

1. Test items give their fingerprints and the 128-bit hashes of their spans, on the executors. Two bit filters of them,
   sized by their counted number up to a fixed most, are all that is broadcast. An item of fewer words than ``span`` is
   one span of its own length, and its own fingerprint.
2. Documents keep the fingerprints that may be an item's, extend each to the spans around it, and of these keep what may
   be a span of an item. Spans that follow each other are one run; a run is named by the hash of its spans, so that a
   passage that many documents share is looked up once.
3. The spans of the distinct runs are joined to the items' spans, the runs to their answers, and a row's hits are put
   together by a key made of its id and text.

There is one path for every size; only joins of counted small tables are broadcast.

Contract: words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A word
inside any occurrence of an item's span is hit; a document is contaminated from 5 % of hit words on. Null or wordless
texts have no hits; null items are no items. Repeated items all count; equal ids of items count once; words of items
without an id are hit, but such items are neither counted nor named. Every row is judged by its own text, with a
repeated id, without one, and however long it is; equal rows get equal answers. Extra columns are carried along; those
named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, map_arrow, materialize, quoted, row_key, small_side, unused
from kinweave.llm._text import ALNUM, U64, Words, mix, ranges, slices, sliding_min, window_starts, windows

#: A filter has 16 bits for each counted entry, and 2**MOST_BITS at most (8 MB); beyond, more suspects are joined.
MOST_BITS = 26
_SECOND = U64(0x7A3D9E1C5B86F24D)
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _spans(hashes: np.ndarray, length: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the spans of ``length`` words, of all or of those at the starts."""
    every = slice(None) if starts is None else starts
    return windows(hashes, length)[every], windows(hashes ^ _SECOND, length)[every]


def item_spans(benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """(length, print, h1, h2, item): the distinct spans of every item, with the fingerprint of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for at, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, ALNUM, fold=True)
                hashes = words.hashes()
                for i, count in enumerate(words.count.tolist()):
                    length = min(count, span)
                    if not length:
                        continue
                    own = hashes[words.first[i] : words.first[i + 1]]
                    h1, h2 = _spans(own, length)
                    prints = sliding_min(windows(own, k), span - k + 1) if length == span else h1
                    item = pa.array([names[at + i].as_py()] * len(h1), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), length, np.int32)), *[pa.array(x.view(np.int64)) for x in (prints, h1, h2)], item], ["length", "print", "h1", "h2", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text IS NOT NULL")
    return items.mapInArrow(read, "length int, print long, h1 long, h2 long, item string").distinct()


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """64-bit words in which a bit is set for the top bits of each value; made by the executors."""
    entries = values.select(column).distinct().count()
    bits = min(MOST_BITS, max(16, (16 * entries).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = values.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("word"))
    rows = words.toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(U64)
    return out


def _maybe(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set."""
    place = values >> U64(64 - 6 - (len(filter_).bit_length() - 1))
    return (filter_[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1


def _suspects(words: Words, hashes: np.ndarray, lengths: list[int], prints: np.ndarray, spans: np.ndarray, span: int, k: int) -> Iterator[tuple[np.ndarray, int]]:
    """(word indexes at which spans of items may begin, their length) in a slice."""
    for length in lengths:
        starts = window_starts(words.first, words.count, length)
        if len(starts) and length == span:
            # The smallest k-gram of every span; consecutive spans mostly share it, so it is looked up once a run.
            least = sliding_min(windows(hashes, k), span - k + 1)[starts]
            run = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            found = np.flatnonzero(_maybe(prints, least[run]))
            until = np.append(run, len(least))
            starts = starts[ranges(run[found], until[found + 1] - run[found])]
        if len(starts):
            starts = starts[_maybe(spans, windows(hashes, length)[starts])]
            if len(starts):
                yield starts, length


_RUNS = "_k1 long, _k2 long, start long, length int, r1 long, r2 long, spans binary"


def runs(docs: DataFrame, lengths: list[int], prints: np.ndarray, spans: np.ndarray, span: int, k: int) -> DataFrame:
    """(_k1, _k2, start, length, r1, r2, spans): runs of spans that may be items', the hashes of their spans packed."""
    sent = docs.sparkSession.sparkContext.broadcast((prints, spans))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, spans = sent.value
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for at, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, ALNUM, fold=True)
                hashes = words.hashes()
                for starts, length in _suspects(words, hashes, lengths, prints, spans, span, k):
                    h1, h2 = _spans(hashes, length, starts)
                    text = np.searchsorted(words.first, starts, "right") - 1
                    first = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])]))
                    n = np.diff(np.append(first, len(starts)))
                    place = (np.arange(len(starts)) - np.repeat(first, n)).astype(U64)
                    names = [mix(np.add.reduceat(mix(h + place * U64(0x9E3779B97F4A7C15)), first) + n.astype(U64) + U64(length << 32)).view(np.int64) for h in (h1, h2)]
                    both = np.stack([h1, h2], 1)
                    packed = [both[a : a + m].tobytes() for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                    own = text[first]
                    yield pa.RecordBatch.from_arrays([pa.array(k1[at + own]), pa.array(k2[at + own]), pa.array(starts[first] - words.first[own]), pa.array(np.full(len(first), length, np.int32)), *map(pa.array, names), pa.array(packed, pa.binary())], [x.split()[0] for x in _RUNS.split(", ")])

    return docs.select(*row_key(docs), "text").mapInArrow(read, _RUNS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r1, r2, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        packed = batch.column(3).to_pylist()
        n = np.array([len(x) // 16 for x in packed], np.int64)
        h = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
        rows = [*(np.repeat(x, n) for x in (r1, r2, length)), ranges(np.zeros(len(n), np.int64), n), h[:, 0].copy(), h[:, 1].copy()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["r1", "r2", "length", "at", "h1", "h2"])


def _covered(intervals: Column) -> Column:
    """The number of words that intervals (a, b) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(F.array_sort(intervals), start, step)["n"]


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 8) -> DataFrame:
    """(_k1, _k2, n_hit, n_items, items_sha256) of the rows that hold a span of an item."""
    docs = columns(docs, "doc_id", "text")
    spans = materialize(item_spans(benchmark, span, k))
    lengths = sorted(r["length"] for r in spans.select("length").distinct().collect())  # 1 to span
    found = materialize(runs(docs, lengths, bit_filter(spans, "print"), bit_filter(spans, "h1"), span, k))
    distinct = found.groupBy("r1", "r2").agg(F.first("length").alias("length"), F.first("spans").alias("spans"))
    asked = distinct.select("r1", "r2", "length", "spans").mapInArrow(_unpacked, "r1 long, r2 long, length int, at long, h1 long, h2 long")
    named = spans.groupBy("length", "h1", "h2").agg(F.collect_set("item").alias("items"))
    told = asked.join(named, ["length", "h1", "h2"]).groupBy("r1", "r2").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("b"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    met = found.drop("spans", "length").join(materialize(told), ["r1", "r2"])
    # A span's place in its run, then in its text.
    placed = met.withColumn("spans", F.transform("spans", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b"))))
    judged = placed.groupBy("_k1", "_k2").agg(_covered(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return judged.select("_k1", "_k2", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 8, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked for) with n_words, n_hit, n_items, items_sha256 and contaminated."""
    other = [c for c in docs.columns if c not in ("text", *RESULTS)]
    carried = [*other, "text"] if with_text else other
    docs = columns(docs, *other, "text")
    names = [unused(docs, n) for n in ("_k1", "_k2")]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(row_key(docs), names, strict=True)])
    kept = [*carried, *names]
    schema = columns(keyed, *kept).schema.add("n_words", "long")
    places = [keyed.columns.index(c) for c in kept]
    text = keyed.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [Words(data, offsets, ALNUM).count for _, data, offsets in slices(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*[batch.column(p) for p in places], pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))], names=schema.names)

    found = materialize(hits(docs, benchmark, span, k).toDF(*names, "n_hit", "n_items", "items_sha256"))
    joined = map_arrow(keyed, count, schema).join(small_side(found, row_bytes=128), names, "left")
    none = F.sha2(F.lit(""), 256)
    n_hit, n_words = F.coalesce(F.col("n_hit"), F.lit(0)), F.col("n_words")
    return joined.select(*[F.col(quoted(c)) for c in carried], n_words, n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"))
