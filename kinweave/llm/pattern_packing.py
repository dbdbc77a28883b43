"""Best-fit packing of documents by patterns of few lengths, fitted with non-negative least squares.

1. The histogram of piece lengths (at most ``length`` counts, whatever the table's size) is put into groups of
   neighbouring lengths. Patterns of up to four groups, and of one group filled up with another, that nearly fill a
   sequence are enumerated.
2. Their repeats are fitted to the groups' counts by non-negative least squares with an active set (Lawson and Hanson),
   so that no more patterns than groups get repeats, and rounded by largest remainder.
3. Each repeat becomes a sequence of real lengths of its groups, chosen to leave room for those to come, the last two
   so that they fill it best; a repeat that would leave too much room is given up.
   Equal sequences are made together, so the work follows the distinct lengths and not the pieces.
4. The fit is repeated on what is left, a few times. The pieces left over, among them the shortest, which were kept out
   of the fit, are packed best-fit-decreasing into the room that the patterns left and into further sequences. Where
   that takes more sequences than the pieces' sum needs, some patterns with short pieces are given back and packed so too.

Pieces then get their places in parallel: a piece's rank among those of its length, counted in buckets so that a common
length is dealt out, selects its pattern slot.

Contract: as in ``token_output``: a document is its ids and ``end_id``, null text is empty, and only the first piece of
a longer document may be shorter than ``length``. Each row of the table is placed exactly once; repeated and equal rows
are packed like any others, and which of equal lengths goes where is settled by id, piece and checksum. An empty table
gives no sequence. Texts of any length are cut whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, materialize
from kinweave.llm.bpe import encoder
from kinweave.llm.token_output import best_fit_decreasing, piece_lengths

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.array([end_id], ids.dtype)).astype("<u4")
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), length)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n])))
                    start += n
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return columns(docs, "doc_id", "text").mapInArrow(cut, PIECES)


#: Groups of lengths that are fitted, and the share of a sequence below which pieces only fill what is left.
GROUPS, FILLER = 64, 1 / 32
#: Room that a sequence made by a pattern may leave, as a share; pieces that would leave more are packed with the rest.
SLACK = 1 / 1024
#: Shares of the patterns' pieces that are tried to be given back.
GIVEN_BACK = (0, 0.05, 0.1, 0.2, 0.4)


def patterns(lengths: np.ndarray, capacity: int, fanout: int = 16) -> np.ndarray:
    """(patterns, lengths) counts: up to four lengths of which the last is the longest that still fits, and one length
    filled up with repeats of another."""
    lengths = np.sort(lengths)

    def grown(heads: np.ndarray) -> np.ndarray:
        """Each head with lengths no longer than its last, spread over the free room."""
        room = np.minimum(capacity - lengths[heads].sum(1), lengths[heads[:, -1]])
        top = np.searchsorted(lengths, room, "right")
        picks = (top[:, None] * (np.arange(fanout) + 1) // fanout - 1).clip(0)
        out = np.concatenate([np.repeat(heads, fanout, 0), picks.reshape(-1, 1)], 1)
        return np.unique(out[lengths[out].sum(1) <= capacity], axis=0)

    def counted(heads: np.ndarray) -> np.ndarray:
        """The heads with the longest length that fits, as counts."""
        last = np.searchsorted(lengths, capacity - lengths[heads].sum(1), "right") - 1
        out = np.zeros((len(heads), len(lengths)), np.int16)
        for column in (*heads.T, last):
            np.add.at(out, (np.flatnonzero(column >= 0), column[column >= 0]), 1)
        return out

    singles = np.arange(len(lengths))[:, None]
    pairs = grown(singles)
    thin = pairs[::2]
    triples = grown(thin[lengths[thin].sum(1) < capacity * 3 // 4])[::2]
    room = capacity - lengths[:, None]
    filled = np.eye(len(lengths), dtype=np.int16)[:, None] + np.eye(len(lengths), dtype=np.int16) * (room // lengths)[..., None].astype(np.int16)
    return np.unique(np.concatenate([*map(counted, (singles, pairs, triples)), filled.reshape(-1, len(lengths))]), axis=0)


def non_negative_fit(rows: np.ndarray, counts: np.ndarray, price: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise |weight * (rows' x - counts)|^2 / 2 + price x; at most as many of
    them are positive as there are counts. Lawson and Hanson's active set, on the normal equations."""
    a = rows * weight
    goal = counts * weight
    norm = np.sqrt((a**2).sum(1)).clip(1e-9)
    x, active = np.zeros(len(a)), []
    for _ in range(4 * len(counts)):
        slope = (a @ (goal - a[active].T @ x[active]) - price) / norm
        slope[active] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= 1e-6 * max(1.0, goal.max()) or len(active) >= len(counts):
            break
        active.append(new)
        while active:
            own = a[active]
            best = np.linalg.solve(own @ own.T + 1e-9 * np.eye(len(active)), own @ goal - price[active])
            if (best > 0).all():
                x[active] = best
                break
            have = x[active]
            down = best <= 0
            step = (have[down] / (have[down] - best[down]).clip(1e-300)).min()
            x[active] = have + step * (best - have)
            gone = [p for p, v in zip(active, x[active], strict=True) if v <= 1e-12]
            x[gone] = 0
            active = [p for p in active if p not in gone]
    return x


def rounded(rows: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeats with about the sum of x, by largest remainder, that never ask for more than the counts."""
    left, out = counts.copy(), np.zeros(len(x), np.int64)

    def take(p: int, many: int) -> int:
        many = min(many, int((left[rows[p] > 0] // rows[p][rows[p] > 0]).min()))
        left[:] -= many * rows[p]
        out[p] += many
        return many

    used = np.flatnonzero(x > 0)
    for p in used[np.argsort(-x[used], kind="stable")].tolist():
        take(p, int(x[p]))
    missing = round(float(x.sum())) - int(out.sum())
    for p in used[np.argsort(-(x[used] % 1), kind="stable")].tolist():
        missing -= take(p, 1) if missing > 0 else 0
    return out


def _realised(pattern: list[int], many: int, members: list[np.ndarray], left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Up to ``many`` sequences with a piece of each group of the pattern, taken from what is left.

    A piece is chosen so that the groups still to come fit by their mean, and the last two together so that they fill
    the room best. It ends where a group has none that fits or too much room would stay.
    """
    out: dict[tuple[int, ...], int] = {}
    while many:
        means = [float(left[members[g]] @ members[g]) / max(1, int(left[members[g]].sum())) for g in pattern]
        room, own = capacity, []
        have = left.copy()
        for i, g in enumerate(pattern):
            fits = members[g][(have[members[g]] > 0) & (members[g] <= room)]
            if not len(fits):
                return out
            if i == len(pattern) - 2:
                last = members[pattern[-1]][have[members[pattern[-1]]] > 0]
                both = fits[:, None] + last
                both[(both > room) | (fits[:, None] == last) & (have[last] < 2)] = 0
                if not both.size or not both.max():
                    return out
                x, y = np.unravel_index(int(both.argmax()), both.shape)
                own += [int(fits[x]), int(last[y])]
                break
            below = fits[fits <= room - sum(means[i + 1 :])]
            own.append(int(below[-1] if len(below) else fits[0]))
            have[own[-1]] -= 1
            room -= own[-1]
        if capacity - sum(own) > capacity * SLACK:
            break
        times = min(many, *(int(left[n]) // own.count(n) for n in set(own)))
        for n in own:
            left[n] -= times
        key = tuple(sorted(own, reverse=True))
        out[key] = out.get(key, 0) + times
        many -= times
    return out


def _fit(left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Sequences that one fit of patterns to the counts of each length places; they are taken from ``left``."""
    out: dict[tuple[int, ...], int] = {}
    present = np.flatnonzero(left)
    present = present[present > capacity * FILLER]
    if not len(present):
        return out
    names, group = np.unique(present * GROUPS // (capacity + 1), return_inverse=True)
    held = np.bincount(group, left[present]).astype(np.int64)
    length = np.bincount(group, left[present] * present) / held
    members = [present[group == g] for g in range(len(names))]
    rows = patterns(length, capacity)
    rows = rows[(rows <= held).all(1)].astype(np.int64)
    if not len(rows):
        return out
    price = (capacity - rows @ length) / capacity * held.max() * 1e-2
    x = non_negative_fit(rows, held.astype(float), price, np.sqrt(length / capacity))
    repeats = rounded(rows, x, held)
    order = np.argsort(rows @ length)[::-1]
    for p in order[repeats[order] > 0].tolist():
        pattern = np.repeat(np.arange(len(names)), rows[p])[::-1].tolist()
        for own, many in _realised(pattern, int(repeats[p]), members, left, capacity).items():
            out[own] = out.get(own, 0) + many
    return out


def fitted(counts: dict[int, int], capacity: int, rounds: int = 4) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Sequences that the fitted patterns place, and the counts of each length that they leave."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: dict[tuple[int, ...], int] = {}
    if left[capacity]:
        out[(capacity,)] = int(left[capacity])  # they fill a sequence each
        left[capacity] = 0
    for _ in range(rounds):
        new = _fit(left, capacity)
        if not new:
            break
        for own, many in new.items():
            out[own] = out.get(own, 0) + many
    return out, left


def plan(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Patterns and their repeats, holding every piece of the histogram exactly once, in as few sequences as it finds."""
    placed, left = fitted(counts, capacity)
    several = sorted((p for p in placed if len(p) > 1), key=lambda p: (p[-1], p))
    held = sum(len(p) * placed[p] for p in several)
    best: dict[tuple[int, ...], int] | None = None
    for share in GIVEN_BACK:
        kept, rest, back = dict(placed), left.copy(), share * held
        for p in several:
            if back <= 0:
                break
            many = min(kept[p], -(-int(back) // len(p)) or 1)
            kept[p] -= many
            back -= many * len(p)
            for n in p:
                rest[n] += many
        found = best_fit_decreasing({int(n): int(rest[n]) for n in np.flatnonzero(rest)}, capacity, {p: n for p, n in kept.items() if n})
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
        if sum(best.values()) * capacity < sum(n * c for n, c in counts.items()) + capacity:
            break  # no packing takes fewer
    return best or {}


def _slots(planned: dict[tuple[int, ...], int]) -> dict[int, np.ndarray]:
    """For each length the rows (ranks before, first sequence, offset) of its slots, in order of rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, many in planned.items():
        offset = 0
        for n in pattern:
            found.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + many
            offset += n
        sequence += many
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, length, end_id))
    counts = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    slots = spark.sparkContext.broadcast(_slots(plan(counts, length)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("within", within).join(bases, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("base") + F.col("within") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                rows = slots.value[n]
                at = np.searchsorted(rows[:, 0], ranks[own], "right") - 1
                sequence[own] = rows[at, 1] + ranks[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
