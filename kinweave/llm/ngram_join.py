"""N-gram Jaccard join: components of documents whose word-shingle sets are similar enough.

A document's set holds the hashes of its distinct k-word shingles. Sets meet in three steps.

1. Routing, exact by the pigeonhole rule. Sizes fall into groups so that similar sets lie in the same or the next
   group. Two similar sets in a group differ in at most D elements; the hash space is cut into K = D + 1 + E parts,
   so that at least E + 1 parts hold the same elements in both. A set sends one signature for each part with two
   elements or more (for its own and the next group); one with more than E other parts sends those with one element
   too, and one with more than E empty parts also the shingles of its prefix.
   A batch of texts sends a signature once, whoever has it: its own sets that share one are linked on the spot. So a
   signature that is everywhere is one entry a batch. Signatures that meet give candidate groups, not pairs.
2. T-occurrence search (DivideSkip) inside each candidate group: an inverted index over its sets, the shorter lists of
   a query merged by a heap, the L longest only probed by binary search for the candidates that are left. Sets already in
   one component are skipped, so a group of near copies costs about a star and not all pairs. Groups above their fair
   share of the work are cut into blocks by size group and salt, and every two blocks that can hold links meet.
3. Components of the links found.

Equal sets are one node, named by their hash; texts meet their ids only at the end.

Contract: words are runs of non-space bytes with A-Z lower-cased; fewer words than k form one shingle; texts without
words (null too) have an empty set and link with nothing; a text of any length gives its whole set. Equal texts and sets
are one class. A similarity of exactly ``percent`` links. Every row is returned, whatever other columns the table has.
Rows of one id are judged each by its own text. A row without an id gets the class of the rows with an equal set, if one
of these has an id, and null otherwise: it makes no links of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import columns, deal, materialize, part_bits, row_key, small_side
from kinweave.llm._text import NON_SPACE, U64, Words, by_part, mix, slices, window_starts, windows
from kinweave.llm.components import components, forest

#: A candidate group is cut into blocks above this many shingles, or above twice its fair share of all.
BLOCK_SHINGLES = 30_000
#: One part in so many is spare: parts that may be left out of a set's signatures.
SPARE = 12
#: Sets of large candidate groups are first compared on this share of the hash space (a power of two).
SLICE = 4


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in slices(texts):
        words = Words(data, offsets, NON_SPACE, fold=True)
        hashes = words.hashes()
        grams, starts = windows(hashes, k), window_starts(words.first, words.count, k)
        grams = grams[starts] if len(starts) else grams[:0]
        edges = np.concatenate([[0], np.cumsum(np.maximum(words.count - k + 1, 0))])
        for i, count in enumerate(words.count):
            if count >= k:
                own = np.sort(grams[edges[i] : edges[i + 1]])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif count:
                yield windows(hashes[words.first[i] : words.first[i + 1]], int(count))
            else:
                yield grams[:0]


@lru_cache(maxsize=64)
def size_groups(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower and upper size of each group; sets of similar size are in the same or in neighbouring groups."""
    low, high = [1], []
    while low[-1] <= most:
        high.append(low[-1] * 100 // percent)
        low.append(high[-1] + 1)
    high.append(low[-1] * 100 // percent)
    return np.array(low), np.array(high)


def _signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """What a set sends: signatures of its parts in its own and in the next size group."""
    low, high = size_groups(percent, max(1024, 1 << (2 * len(own)).bit_length()))
    group = int(np.searchsorted(low, len(own), "right")) - 1
    sums = np.concatenate([[U64(0)], np.cumsum(mix(own ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    out = []
    for g in (group, group + 1):
        differ = 2 * int(high[g]) * (100 - percent) // (100 + percent)
        spare = 1 + differ // SPARE
        parts = differ + 1 + spare
        cut = np.searchsorted(((own >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))
        held = np.diff(cut)
        full = np.flatnonzero(held > 1)
        if parts - len(full) > spare:  # the rule needs single elements too
            full = np.flatnonzero(held)
            if parts - len(full) > spare:
                prefix = len(own) - -(-percent * len(own) // 100) + 1
                out.append(mix(own[:prefix] + U64(g)))
        out.append(mix(sums[cut[full + 1]] - sums[cut[full]] + mix(full.astype(U64) + U64(g << 32))))
    return np.concatenate(out)


def set_names(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set, as signed integers."""
    return tuple(int(mix(own ^ U64(salt)).sum(dtype=U64).astype(np.int64)) for salt in (0, 0xA0761D6478BD642F))


_SENT = "part int, ids binary, missing binary, k1 binary, k2 binary, n binary, s1 binary, s2 binary, nodes binary, high binary, low binary, at binary"
_MET = "doc_id long, _k1 long, _k2 long, n int, s1 long, s2 long, a long, b long"


def _route(batches: Iterator[pa.RecordBatch], k: int, percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One row of ids, sizes and set hashes for each batch, and one row for each hash range of what its sets send."""
    names = [x.split()[0] for x in _SENT.split(", ")]
    turn = TaskContext.get().partitionId()  # the rows of a few batches a task are dealt out too
    for batch in batches:
        missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        n, s1, s2 = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        sets: dict[int, np.ndarray] = {}
        for i, own in enumerate(shingle_sets(batch.column(1), k)):
            n[i] = len(own)
            if len(own):
                s1[i], s2[i] = set_names(own)
                if not missing[i] and int(s1[i]) not in sets:
                    sets[int(s1[i])] = _signatures(own, percent)
        nodes = np.array(sorted(sets), np.int64)
        rows = [(turn % (1 << bits), ids.tobytes(), np.packbits(missing).tobytes(), *[batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in (2, 3)], n.tobytes(), s1.tobytes(), s2.tobytes())]
        turn += 1
        near = (None, None)
        if len(nodes):
            sent = [sets.pop(x) for x in nodes.tolist()]
            at = np.repeat(np.arange(len(nodes)), [len(x) for x in sent])
            every, least, near = _fold(np.concatenate(sent), at)
            table = nodes.tobytes()
            edges = by_part(every, bits)
            kept = (every << U64(bits)) >> U64(24)
            kind = np.uint16 if len(nodes) < 65536 else np.uint32
            for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    rows.append((p, *[None] * 7, table, (kept[a:b] >> U64(8)).astype(np.uint32).tobytes(), kept[a:b].astype(np.uint8).tobytes(), least[a:b].astype(kind).tobytes()))
            near = (nodes[near[0]].tobytes(), nodes[near[1]].tobytes())
        rows[0] = (*rows[0], None, *near, None)
        kinds = [pa.int32(), *[pa.binary()] * 11]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _fold(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, the least owner of each, links (root, owner) that span the owners of equal keys)."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    least = np.minimum.reduceat(owner, begins)
    leaders = np.repeat(least, np.diff(np.append(begins, len(keys))))
    apart = leaders != owner
    pairs = np.unique(np.stack([leaders[apart], owner[apart]], 1), axis=0)
    return keys[begins], least, forest(pairs[:, 0], pairs[:, 1])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, _k1, _k2, n, s1, s2) as they are, and edges (a, b) between sets that sent the same signature."""
    names = [x.split()[0] for x in _MET.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(a), t) for t in kinds[:6]], pa.array(a), pa.array(b)], names)

    keys: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for batch in batches:
        for _, ids, missing, k1, k2, n, s1, s2, nodes, high, low, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if nodes is None:
                ids = np.frombuffer(ids, np.int64)
                gone = np.unpackbits(np.frombuffer(missing, np.uint8), count=len(ids)).astype(bool)
                rows = [pa.array(ids, mask=gone), *[pa.array(np.frombuffer(x, np.int64)) for x in (k1, k2)], pa.array(np.frombuffer(n, np.int32)), *[pa.array(np.frombuffer(x, np.int64)) for x in (s1, s2)]]
                yield pa.RecordBatch.from_arrays([*rows, *[pa.nulls(len(ids), pa.int64())] * 2], names)
                if high:
                    yield linked(np.frombuffer(high, np.int64), np.frombuffer(low, np.int64))
                continue
            table, top = np.frombuffer(nodes, np.int64), np.frombuffer(high, np.uint32)
            keys.append((top.astype(U64) << U64(8)) | np.frombuffer(low, np.uint8))
            owners.append(table[np.frombuffer(at, np.uint16 if len(at) == 2 * len(top) else np.uint32)])
    if keys:
        found = _fold(np.concatenate(keys), np.concatenate(owners))[2]
        if len(found[0]):
            yield linked(*found)


#: So many long lists are probed at once; then candidates that cannot reach their overlap any more are dropped.
PROBES = 16


def divide_skip(sets: list[np.ndarray], percent: int, mu: float = 0.001, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of all similar pairs among the sets, by T-occurrence search.

    A query's T is the least overlap with any set of a similar size here. Its L longest lists are set aside; a candidate
    must be met T - L times in the merged shorter ones, and only then is looked up in the long lists, the shortest of
    them first and only until too many have missed it. Candidates are looked up some at a time, so that those of a
    component that one of them links are not looked up at all.

    With ``whole``, the sizes of the whole sets, ``sets`` are their parts in one slice of the hash space: a pair is then
    linked unless the slice proves that it is not similar. At most a set's size less the least overlap can be missing.
    """
    held = np.array([len(s) for s in sets])
    sizes = held if whole is None else whole
    total = len(sets)
    tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(total), held)
    order = np.argsort(inverse, kind="stable")
    postings, start = owner[order], np.concatenate([[0], np.cumsum(df)])
    probe = inverse[order] * total + postings  # sorted: a list's documents in order, list by list
    edges = np.concatenate([[0], np.cumsum(held)])
    entire, by_size = bool((held == sizes).all()), np.sort(sizes)
    root = np.arange(total)
    inside = [[i] for i in range(total)]
    links: list[tuple[int, int]] = []

    def least(q: int, other: np.ndarray | int) -> np.ndarray | int:
        """The shared elements that a similar pair must show here."""
        overlap = -(-percent * (sizes[q] + sizes[other]) // (100 + percent))
        return overlap - np.minimum(sizes[q] - held[q], sizes[other] - held[other])

    def join(q: int, other: int) -> None:
        links.append((other, q))
        small, large = sorted((int(root[other]), int(root[q])), key=lambda r: len(inside[r]))
        root[inside[small]] = large  # the smaller side gets the larger one's name, so each set changes it seldom
        inside[large] += inside[small]
        inside[small] = []

    def shared(lists: np.ndarray, doc: int) -> int:
        """How many of the lists hold a document, by binary search."""
        key = lists * total + doc
        return int((probe[np.minimum(np.searchsorted(probe, key), len(probe) - 1)] == key).sum())

    def confirmed(q: int, long: np.ndarray, docs: np.ndarray, met: np.ndarray) -> np.ndarray:
        """The documents, met so often in the short lists, that the long ones bring to the least overlap."""
        want = least(q, docs)
        for at in range(0, len(long), PROBES):
            able = met + (len(long) - at) >= want
            docs, met, want = docs[able], met[able], want[able]
            if not len(docs):
                break
            key = long[at : at + PROBES, None] * total + docs
            met = met + (probe[np.minimum(np.searchsorted(probe, key), len(probe) - 1)] == key).sum(axis=0)
        return docs[met >= want]

    def apart(q: int, docs: np.ndarray) -> np.ndarray:
        return docs[(root[docs] != root[q]) & (sizes[docs] * 100 >= percent * sizes[q]) & (sizes[docs] * percent <= 100 * sizes[q])]

    for q in range(1, total):
        if entire:
            smallest = by_size[np.searchsorted(by_size, -(-percent * sizes[q] // 100))]  # at most its own size
            need = int(-(-percent * (sizes[q] + smallest) // (100 + percent)))
        else:
            need = int(held[q] - sizes[q] + -(-percent * sizes[q] // 100))
        if need <= 0:  # the slice cannot rule all out
            near = np.flatnonzero((sizes[:q] * 100 >= percent * sizes[q]) & (sizes[:q] * percent <= 100 * sizes[q]))
            for other in near[np.asarray(least(q, near)) <= 0].tolist():
                if root[other] != root[q]:
                    join(q, other)
            need = 1
        lists = inverse[edges[q] : edges[q + 1]]
        lists = lists[df[lists] > 1]
        if len(lists) < need:
            continue
        lists = lists[np.argsort(df[lists], kind="stable")]
        aside = min(need - 1, int(need / (mu * np.log2(df[lists[-1]]) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        runs, tries = [], 4
        for t in short.tolist():
            docs = postings[start[t] : start[t + 1]]
            docs = apart(q, docs[: np.searchsorted(docs, q)])
            while tries and len(docs):  # the first of a list is looked up at once: with near copies it mostly links
                tries -= 1
                doc = int(docs[0])
                if shared(lists, doc) < least(q, doc):
                    break
                join(q, doc)
                docs = apart(q, docs)
                runs = [r for r in (apart(q, r) for r in runs) if len(r)]
            if len(docs):
                runs.append(docs)
        if len(runs) < need - aside:
            continue
        last, met, often = -1, 0, []
        for doc in heapq.merge(*[r.tolist() for r in runs], [total]):
            if doc == last:
                met += 1
                continue
            if met and met >= need - aside:
                often.append((last, met))
            last, met = doc, 1
        waiting, some = np.array(often, np.int64).reshape(-1, 2), PROBES
        while len(waiting):
            for doc in confirmed(q, long, *waiting[:some].T).tolist():
                if root[doc] != root[q]:
                    join(q, doc)
            waiting = waiting[some:]
            waiting = waiting[root[waiting[:, 0]] != root[q]]
            some *= 2
    return links


def _fair(members: DataFrame, block_shingles: int) -> int:
    """Shingles of a candidate group that one task may get."""
    every = members.agg(F.sum("n")).first()[0] or 0
    return max(block_shingles, 2 * every // max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))


def _blocks(members: DataFrame, percent: int, fair: int) -> DataFrame:
    """(rep, s1, s2, task): the tasks that each set goes to. One task for a group, or those of all blocks it must meet."""
    # Similar sizes lie within one band's width, so a set meets the blocks of its band and of the one on either side.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent * (1 + 1e-9)))).cast("int")
    banded = members.withColumn("band", band)
    weight = banded.groupBy("comp", "band").agg(F.sum("n").alias("w"))
    whole = weight.groupBy("comp").agg(F.sum("w").alias("all"))
    large = weight.join(whole, "comp").filter(F.col("all") > fair)
    blocks = large.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("band", F.ceil(2 * F.col("w") / fair).cast("int").alias("blocks")))).alias("of"))
    placed = banded.join(small_side(materialize(blocks), row_bytes=256), "comp", "left")  # a row for each large group
    place = lambda band, block: F.struct(band.cast("int").alias("band"), block.cast("int").alias("block"))
    nowhere = place(F.lit(0), F.lit(0))
    alone = placed.filter("of IS NULL").select("rep", "s1", "s2", "comp", nowhere.alias("p"), nowhere.alias("q"))
    split = placed.filter("of IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("of")[F.col("band")].cast("long")))
    near = split.select("*", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias("step")).withColumn("there", F.col("of")[F.col("band") + F.col("step")])
    met = near.filter("there > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias("block"))
    mine, theirs = place(F.col("band"), F.col("own")), place(F.col("band") + F.col("step"), F.col("block"))
    cut = met.select("rep", "s1", "s2", "comp", F.least(mine, theirs).alias("p"), F.greatest(mine, theirs).alias("q"))
    return alone.union(cut).select("rep", "s1", "s2", F.struct("comp", F.col("p.band").alias("band_a"), F.col("p.block").alias("block_a"), F.col("q.band").alias("band_b"), F.col("q.block").alias("block_b")).alias("task"))


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int, fair: int, sliced: bool = False) -> DataFrame:
    """(a, b): links between sets that DivideSkip confirms, or on a slice does not rule out."""
    tasks = materialize(_blocks(members, percent, fair))
    kind = tasks.schema["task"].dataType.simpleString()
    spread = tasks.groupBy("rep").agg(F.collect_list(F.struct("s1", "s2", "task")).alias("wanted"))
    texts = docs.select("doc_id", "text").join(small_side(materialize(spread), row_bytes=64), docs["doc_id"] == F.col("rep"))
    top = U64((1 << 64) // SLICE)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for wanted, own in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), k), strict=True):
                name = set_names(own) if len(own) else None
                tasks = [w["task"] for w in wanted if (w["s1"], w["s2"]) == name]  # another row of this id may have another set
                if tasks:
                    rows.append((name[0], tasks, len(own), (own[: np.searchsorted(own, top)] if sliced else own).tobytes()))
            if rows:
                node, tasks, n, own = zip(*rows, strict=True)
                kinds = batch.column(1).type.value_type.field("task").type
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tasks, pa.list_(kinds)), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["node", "tasks", "n", "own"])

    loaded = texts.select("text", "wanted").mapInArrow(load, f"node long, tasks array<{kind}>, n long, own binary")
    loaded = loaded.select("node", F.explode("tasks").alias("task"), "n", "own")

    def search(group: pa.Table) -> pa.Table:
        found = sorted(zip(group["node"].to_pylist(), group["n"].to_pylist(), group["own"].to_pylist(), strict=True))
        found = [x for i, x in enumerate(found) if not i or x[0] != found[i - 1][0]]
        whole = np.array([n for _, n, _ in found])
        links = divide_skip([np.frombuffer(o, U64) for *_, o in found], percent, whole=whole) if len(found) > 1 else []
        return pa.table({"a": pa.array([found[i][0] for i, _ in links], pa.int64()), "b": pa.array([found[j][0] for _, j in links], pa.int64())})

    return loaded.groupBy("task").applyInArrow(search, "a long, b long")


def _narrowed(docs: DataFrame, members: DataFrame, k: int, percent: int, fair: int) -> DataFrame:
    """Members with their large groups cut down to what a slice of the hash space cannot rule out."""
    large = members.groupBy("comp").agg(F.sum("n").alias("w")).filter(F.col("w") > fair).select("comp")
    large = small_side(materialize(large))
    wide = materialize(members.join(large, "comp", "left_semi"))
    if wide.isEmpty():
        return members
    passed = components(_links(docs, wide, k, percent, SLICE * fair, sliced=True))
    kept = wide.drop("comp").join(passed, wide["s1"] == passed["node"]).select("rep", "s1", "s2", "n", F.col("component").alias("comp"))
    return materialize(members.join(large, "comp", "left_anti").select(*kept.columns).union(kept))


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85, block_shingles: int = BLOCK_SHINGLES, narrow: bool = False, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: links are Jaccard similarities of percent or more.

    ``narrow`` adds the search on a slice for large candidate groups. It never changes the result; it pays where the
    threshold is low, since signatures then cover few elements and candidate groups grow large. ``keyed`` adds the
    row's key (``row_key``), by which it can be found again.
    """
    docs = columns(docs, "doc_id", "text")
    bits = part_bits(docs.sparkSession)
    sent = docs.select("doc_id", "text", *row_key(docs)).mapInArrow(lambda b: _route(b, k, percent, bits), _SENT)
    met = materialize(deal(sent, "part", 1 << bits).mapInArrow(_meet, _MET))
    rows = met.filter("b IS NULL").drop("a", "b")
    classes = materialize(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    candidates = components(met.filter("b IS NOT NULL").select("a", "b"))
    members = materialize(classes.join(candidates, classes["s1"] == candidates["node"]).select("rep", "s1", "s2", "n", F.col("component").alias("comp")))
    fair = _fair(members, block_shingles)
    if narrow:
        members = _narrowed(docs, members, k, percent, fair)
    found = components(_links(docs, members, k, percent, fair))
    linked = materialize(classes.join(found, classes["s1"] == found["node"]).select("s1", "s2", "n", "rep", "component"))
    least = materialize(linked.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = classes.join(linked.join(small_side(least), "component").select("s1", "s2", "n", "component_id"), ["s1", "s2", "n"], "left")
    named = materialize(named.select("s1", "s2", "n", F.coalesce("component_id", "rep").alias("component_id")))
    key = ["_k1", "_k2"] if keyed else []
    return rows.join(named, ["s1", "s2", "n"], "left").select("doc_id", *key, F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
