"""Line dedup: a repeated line stays only in the first document that holds it.

Two Bloom filters find suspects. Every batch of texts sends the 64-bit hashes of its distinct lines (and which of
them it met in two of its own texts) to hash ranges; each range keeps a once-seen and a twice-seen filter, and a
hash whose bits are all in the first filter when it comes again goes into the second. Only lines whose bits are in
the twice-seen filter are shuffled, as 128-bit digests, to confirm the repeat and choose the smallest id.

The filters have a fixed size (``filter_bits``), so what is broadcast never grows with the data. On more lines than
they are made for the share of false suspects rises, which costs shuffle but changes no result.

Contract: lines are split at ``\\n``; a line's key has ASCII white space stripped and A-Z lower-cased; keys of fewer
than ``min_chars`` code points always stay. Null or empty text is one empty line. Repeated lines within one document
are not repeats. A repeated id counts as one document and each of its rows is treated alike; the smallest id keeps a line,
so there is no tie to settle. Rows without an id neither make repeats nor lose lines. Every text is worked on whole,
one at a time, however long. Extra columns are left alone; those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, deal, map_arrow, materialize, part_bits, unused
from kinweave.llm._text import U64, by_part, mix

_WHITE = b" \t\n\r\x0b\x0c"
_SENT = "part int, once binary, twice binary"


def _keys(text: bytes, min_chars: int) -> list[bytes]:
    """The digest of each line that can be a repeat, b'' for other lines."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_WHITE).lower()
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else b"")
    return out


def _digests(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, set[bytes]]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
        yield doc_id, set(_keys(text or b"", min_chars)) - {b""}


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), U64)[::2] if digests else np.zeros(0, U64)


def _bits(hashes: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash; both lie in the same hash range of the filter."""
    segment = U64(filter_bits - min(filter_bits, 16))
    high = (hashes >> U64(64 - filter_bits)) >> segment << segment
    low = U64((1 << int(segment)) - 1)
    other = mix(hashes)
    return high | (other & low), high | (other >> U64(32) & low)


def _test(filter_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_[bits >> U64(3)] >> (bits & U64(7)).astype(np.uint8)) & 1 == 1


def _set(filter_: np.ndarray, bits: np.ndarray) -> None:
    np.bitwise_or.at(filter_, bits >> U64(3), np.left_shift(1, (bits & U64(7)).astype(np.uint8)).astype(np.uint8))


def twice_seen_filter(docs: DataFrame, filter_bits: int, min_chars: int) -> bytes:
    """The bits of lines that may be in two documents; at most 2**filter_bits bits come to the driver."""
    bits = min(part_bits(docs.sparkSession), 16, filter_bits - 3)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d for _, own in _digests(batch, min_chars) for d in own]
            hashes, counts = np.unique(_hashes(found), return_counts=True)
            edges = by_part(hashes, bits)
            rows = [(p, hashes[a:b].tobytes(), np.packbits(counts[a:b] > 1).tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "once", "twice"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (filter_bits - bits)
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, sent, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = filters.setdefault(part, (np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)))
                hashes = np.frombuffer(sent, U64)
                again = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(hashes)).astype(bool)
                first, second = (b - U64(part * size) for b in _bits(hashes, filter_bits))
                again |= _test(once, first) & _test(once, second)
                for b in (first, second):
                    _set(twice, b[again])
                    _set(once, b)
        if filters:
            yield pa.RecordBatch.from_arrays([pa.array(list(filters), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for _, t in filters.values()], pa.binary())], ["part", "bits"])

    sent = docs.mapInArrow(send, _SENT)
    out, size = bytearray(1 << (filter_bits - 3)), 1 << (filter_bits - bits - 3)
    for part, packed in deal(sent, "part", 1 << bits).mapInArrow(gather, "part int, bits binary").collect():
        out[part * size : (part + 1) * size] = zlib.decompress(packed)
    return bytes(out)


def repeated_lines(docs: DataFrame, filter_bits: int = 28, min_chars: int = 10) -> DataFrame:
    """(doc_id, key): the digests of lines to drop from each document."""
    docs = columns(docs, "doc_id", "text")
    suspect_bits = docs.sparkSession.sparkContext.broadcast(twice_seen_filter(docs, filter_bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(suspect_bits.value, np.uint8)
        for batch in batches:
            ids, found = [], []
            for doc_id, own in _digests(batch, min_chars):
                if doc_id is not None:
                    ids += [doc_id] * len(own)
                    found += own
            first, second = _bits(_hashes(found), filter_bits)
            keep = np.flatnonzero(_test(filter_, first) & _test(filter_, second))
            words = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)[keep] if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[keep]), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["doc_id", "k1", "k2"])

    seen = materialize(docs.mapInArrow(suspects, "doc_id long, k1 long, k2 long"))
    # Partial aggregation folds a line that is everywhere to one row a task before it is shuffled.
    first = seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    first = materialize(first)  # the join then shuffles both of its sides, and a key that is everywhere can be split
    return seen.join(first, ["k1", "k2"]).filter("doc_id > first").select("doc_id", "k1", "k2")


def dedup_lines(docs: DataFrame, filter_bits: int = 28, min_chars: int = 10, with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) with ``text`` rewritten, and n_lines, n_dropped, kept_sha256 beside it.

    ``with_text=False`` returns the digest columns without the texts.
    """
    drops = repeated_lines(docs, filter_bits, min_chars).groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("_drop"))
    other = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "kept_sha256")]
    docs = columns(docs, *other, "text")
    name = unused(docs, "_drop")
    joined = columns(docs.join(drops.toDF("doc_id", name), "doc_id", "left"), *other, "text", name)
    schema = columns(docs, *other).schema
    schema = (schema.add("text", "string") if with_text else schema).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 2).cast(pa.large_binary()).to_pylist()
            drop = batch.column(batch.num_columns - 1)
            gone = [None if x is None else {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in x} for x in drop.to_pylist()]
            kept, n_lines, n_dropped, sha = [], [], [], []
            for text, out in zip(texts, gone, strict=True):
                text = text or b""
                total = text.count(b"\n") + 1
                lines = total
                if out:
                    stay = [x for x, key in zip(text.split(b"\n"), _keys(text, min_chars), strict=True) if key not in out]
                    text, lines = b"\n".join(stay), len(stay)
                if with_text:
                    kept.append(text)
                n_lines.append(total)
                n_dropped.append(total - lines)
                sha.append(hashlib.sha256(text).hexdigest())
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            new = [pa.array(kept, pa.binary()).cast(pa.string()), *new] if with_text else new
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], names=schema.names)

    return map_arrow(joined, rewrite, schema)
