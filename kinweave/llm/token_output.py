"""Token-ID output: documents packed best-fit-decreasing into rows of ids, with segment lengths and position resets.

Each task tokenizes its documents, cuts longer ones into pieces without losing an id, and packs a buffer of pieces at
a time: pieces by falling length, each into the fullest row that still has room, found by a segment tree over the
possible free capacities. Nothing is shuffled, and memory follows the buffer. Packing the whole table at once would
gain less than one part-filled row a buffer.

Contract: a document is its ids and then ``end_id``; null text is empty, so the end alone. A document longer than
``length`` gives pieces of ``length`` ids of which the first may be shorter. Every row of the table is packed, equal
and repeated ones too; rows without an id are packed with a null one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinweave.llm._spark import columns
from kinweave.llm.bpe import encoder

#: Ids that a task holds before it packs them (8 MB as 16-bit ids).
BUFFER_IDS = 4_000_000
PACKED = "sequence_id long, n_ids int, ids binary, cu_lengths array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


class Capacities:
    """How many open rows have each free capacity; finds the least capacity that a piece fits into."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, rows: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += rows
            node >>= 1

    def least(self, length: int) -> int:
        """The least free capacity of at least ``length``, or -1."""
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int, begun: dict[tuple[int, ...], int] | None = None) -> dict[tuple[int, ...], int]:
    """Patterns of piece lengths and how many rows have each, for so many pieces of each length.

    Equal pieces and equal rows are moved together, so the work follows the distinct lengths, not the pieces. Rows that
    are already ``begun`` are filled like those that it opens, and are part of the answer.
    """
    tree = Capacities(capacity)
    rows: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(pattern: tuple[int, ...], free: int, many: int) -> None:
        if many:
            rows[free][pattern] = rows[free].get(pattern, 0) + many
            tree.add(free, many)

    for pattern, many in (begun or {}).items():
        put(pattern, capacity - sum(pattern), many)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = tree.least(length)
            if free < 0:
                pattern, have, free = (), left, capacity
            else:
                pattern, have = next(iter(rows[free].items()))
            fit = free // length
            full = min(have, left // fit)
            part = left - full * fit if full < have and left - full * fit < fit else 0
            if pattern:
                used = full + bool(part)
                tree.add(free, -used)
                rows[free][pattern] -= used
                if not rows[free][pattern]:
                    del rows[free][pattern]
            put(pattern + (length,) * fit, free - fit * length, full)
            if part:
                put(pattern + (length,) * part, free - part * length, 1)
            left -= full * fit + part
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for own in rows.values():
        for pattern, many in own.items():
            out[pattern] += many
    return dict(out)


def piece_lengths(n: int, length: int) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter than ``length``."""
    pieces = max(1, -(-n // length))
    return [n - length * (pieces - 1), *[length] * (pieces - 1)]


def _pack(pieces: list[tuple], length: int, base: int) -> Iterator[tuple]:
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for piece in pieces:
        by_length[len(piece[3])].append(piece)
    number = base
    for pattern, many in best_fit_decreasing({n: len(p) for n, p in by_length.items()}, length).items():
        for _ in range(many):
            own = [by_length[n].pop() for n in pattern]
            ids = np.concatenate([p[3] for p in own])
            ends = np.cumsum(pattern)
            yield number, int(ends[-1]), np.pad(ids, (0, length - len(ids))).tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [p[0] for p in own], [p[1] for p in own], [p[2] for p in own]
            number += 1


def packed_rows(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0, buffer: int = BUFFER_IDS) -> DataFrame:
    """One row of ids for each packed sequence: the padded id matrix row (little-endian, 16 bits where the vocabulary
    allows), cumulative segment lengths, the places at which positions start again, and the pieces in it."""
    docs = columns(docs, "doc_id", "text")

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, base = 0, TaskContext.get().partitionId() << 36
        own = encoder(vocabulary)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.array([end_id], ids.dtype))
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), length)):
                    held.append((doc_id, k, start, ids[start : start + n]))
                    start += n
                size += len(ids)
                if size >= buffer:
                    yield from drain(held, base)
                    base += len(held)
                    held, size = [], 0
        yield from drain(held, base)

    def drain(held: list[tuple], base: int) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for row in _pack(held, length, base):
            found.append(row)
            if len(found) == 256:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    return docs.mapInArrow(pack, PACKED)


def write_packed(docs: DataFrame, path: str, vocabulary: str, length: int = 2048, end_id: int = 0) -> None:
    """Write the packed rows as Parquet; ``read_ids`` gives back a part's id matrix."""
    packed_rows(docs, vocabulary, length, end_id).write.mode("overwrite").parquet(path)


def read_ids(rows: pa.Table, length: int = 2048) -> np.ndarray:
    """The (rows, length) id matrix of a table of packed rows."""
    raw = b"".join(rows["ids"].to_pylist())
    wide = len(raw) == 4 * length * rows.num_rows
    return np.frombuffer(raw, np.uint32 if wide else np.uint16).reshape(rows.num_rows, length)


def unpacked(row: dict, length: int = 2048) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(doc_id, piece, start, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["ids"], np.uint32 if len(row["ids"]) == 4 * length else np.uint16)
    for doc_id, piece, start, a, b in zip(row["doc_ids"], row["pieces"], row["starts"], row["cu_lengths"], row["cu_lengths"][1:], strict=False):
        yield doc_id, piece, start, ids[a:b]
