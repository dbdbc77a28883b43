"""Connected components: alternating large-star and small-star rounds (Kiveris et al., 2014) on DataFrames, and
union-find in one task once few enough edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm._spark import materialize

#: So many counted edges at most (16 bytes each) are joined by one task; more go through another round.
ONE_TASK_EDGES = 400_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(roots, nodes) of the edges' components: every node but a root with the least node that it is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both, "a", "b"), "a").filter("b > a").select(F.least("a", "m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges, "b", "a")
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(node, m): its least neighbour. Dealt out anew, so that the join on it shuffles both sides and a hub can be split."""
    least = edges.groupBy(node).agg(F.min(other).alias("m"))
    return least.repartition(F.col("m"), F.col(node))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        roots, nodes = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array(nodes)], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 100, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    Every round is written to the checkpoint folder, so plans stay short and survive lost executors. Rounds grow with
    the logarithm of the longest path; if ``most_rounds`` are not enough, that is an error and no partial answer.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = _state(edges)
        if now[0] <= one_task:
            edges = materialize(edges.repartition(1).mapInArrow(_at_once, "a long, b long"))
            break
        if now == before:
            break
        before = now
        edges = materialize(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
