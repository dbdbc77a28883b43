"""Account groups: plain components, and components under a size cap with an audit of every edge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.storage import materialize

ASSIGNED = "account_id string, predicted_group_id string"
AUDIT = "account_a string, account_b string, relation_score double, component_a_size_before long, component_b_size_before long, proposed_component_size long, guardrail_decision string"


class GraphError(ValueError):
    """Accounts or edges that no grouping can be made of."""


def check_edges(accounts: DataFrame, pairs: DataFrame, prediction: str, score: str | None = None, all_endpoints: bool = True) -> None:
    """Preconditions of both groupings in two passes: one over the pairs, one anti-join of the endpoints."""
    missing = sorted({"account_a", "account_b", prediction, *([score] if score else [])} - set(pairs.columns))
    if missing:
        raise GraphError(f"Pairs are missing required columns: {missing}")
    some = lambda condition: F.coalesce(F.max(condition.cast("int")), F.lit(0))
    value = F.col(score).cast("double") if score else F.lit(0.0)
    scored = value.isNull() | F.isnan(value) | ~value.between(0, 1)
    facts = pairs.agg(some(~F.coalesce(F.col(prediction).isin(0, 1), F.lit(False))).alias("label"), some(scored).alias("score"), some(F.col("account_a") == F.col("account_b")).alias("self")).first()
    if facts["label"]:
        raise GraphError("Prediction column must contain only zero or one")
    if facts["score"]:
        raise GraphError("Relation scores must be finite values in [0, 1]")
    if facts["self"]:
        raise GraphError("Self-pairs are not allowed")
    if not accounts.groupBy("account_id").count().filter("count > 1").isEmpty():
        raise GraphError("Account list must not contain duplicates")
    used = pairs if all_endpoints else pairs.filter(F.col(prediction) == 1)
    ends = used.select(F.explode(F.array("account_a", "account_b")).alias("account_id"))
    if not ends.join(accounts, "account_id", "left_anti").isEmpty():
        raise GraphError("Predicted pairs contain accounts outside the supplied account list")


#: So many counted edges at most are joined by one task; more go through rounds.
ONE_TASK_EDGES = 200_000
#: Edges of one unrestricted component that a task may hold (about 200 bytes each).
COMPONENT_EDGES = 5_000_000


def _at_once(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over all edges (a, b) of a task: every account with the least one that it is linked to."""
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for part in parts:
        for a, b in zip(part["a"], part["b"], strict=True):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    if root:
        yield pd.DataFrame({"account_id": list(root), "root": [top(x) for x in list(root)]})


def connected(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(account_id, root): the least account of each account's component, for all endpoints of the edges (a, b).

    Every round each node takes the least label around it and then its label's own label, so that rounds grow with the
    logarithm of a path. A round's labels go to the checkpoint folder. Few counted edges are joined at once.
    """
    edges = materialize(edges.select("a", "b"))
    if edges.count() <= one_task:
        return materialize(edges.repartition(1).mapInPandas(_at_once, "account_id string, root string"))
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(told, labels["node"] == told["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        # What a node learns goes to its old root too, and everyone then follows its root.
        news = lower.select("node", "mid").union(lower.select(F.col("old").alias("node"), "mid")).groupBy("node").agg(F.min("mid").alias("root"))
        jump = news.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialize(lower.select("node", "old").join(news, "node").join(jump, "root", "left").select("node", "old", F.coalesce("next", "root").alias("root")))
        done = moved.filter("root <> old").isEmpty()
        labels = moved.select("node", "root")
        if done:
            return labels.select(F.col("node").alias("account_id"), "root")


def _numbered(rooted: DataFrame) -> DataFrame:
    """Groups numbered by their least account. Only the roots are ranked: in range partitions, then shifted by their sizes."""
    roots = rooted.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root")
    placed = materialize(roots.select("root", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("p", "first", before.alias("before"))  # a row for each partition
    number = placed.join(F.broadcast(shifts), "p").select("root", (F.col("before") + F.col("i") - F.col("first") + 1).alias("number"))
    return rooted.join(number, "root").select("account_id", F.format_string("PRED-%05d", "number").alias("predicted_group_id"))


def component_assignments(accounts: DataFrame, pairs: DataFrame, prediction: str, check: bool = True) -> DataFrame:
    """A group for every account, single ones too."""
    if check:
        check_edges(accounts, pairs, prediction)
    roots = connected(pairs.filter(F.col(prediction) == 1).select(F.col("account_a").alias("a"), F.col("account_b").alias("b")))
    return _numbered(accounts.join(roots, "account_id", "left").select("account_id", F.coalesce("root", "account_id").alias("root")))


def merge_under_cap(edges: list[tuple[str, str, float]], cap: int) -> tuple[dict[str, str], list[tuple]]:
    """Strongest edge first, a merge only if its result keeps within the cap: roots, and a row for each edge."""
    root: dict[str, str] = {}
    size: dict[str, int] = {}

    def top(x: str) -> str:
        path = []
        while root.setdefault(x, x) != x:
            path.append(x)
            x = root[x]
        for y in path:
            root[y] = x
        return x

    told = []
    for a, b, score in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        x, y = top(a), top(b)
        na, nb = size.get(x, 1), size.get(y, 1)
        if x == y:
            told.append((a, b, score, na, nb, na, "accepted_redundant"))
        elif na + nb > cap:
            told.append((a, b, score, na, nb, na + nb, "deferred_component_cap"))
        else:
            low, high = min(x, y), max(x, y)
            root[high], size[low] = low, na + nb
            told.append((a, b, score, na, nb, na + nb, "accepted_merge"))
    return {x: top(x) for x in list(root)}, told


def rooted_edges(pairs: DataFrame, prediction: str, score: str, *more: str) -> DataFrame:
    """The active edges (a, b, score, ...) with the root of their unrestricted component."""
    active = materialize(pairs.filter(F.col(prediction) == 1).select(F.col("account_a").alias("a"), F.col("account_b").alias("b"), F.col(score).cast("double").alias("score"), *more))
    return active.join(connected(active).withColumnRenamed("account_id", "a"), "a")


def guarded_assignments(accounts: DataFrame, pairs: DataFrame, prediction: str, score: str, cap: int, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(assignments, audit) under a size cap; the audit carries ``split`` if the pairs have it.

    Whether an edge is accepted depends only on stronger edges of its own unrestricted component, so these are worked
    on apart, each in one task: its memory bound is the largest unrestricted component, and one of more than
    ``COMPONENT_EDGES`` edges is refused with an error.
    """
    if cap < 2:
        raise GraphError("max_component_size must be at least two")
    if check:
        check_edges(accounts, pairs, prediction, score, all_endpoints=False)
    more = ["split"] if "split" in pairs.columns else []
    edges = rooted_edges(pairs, prediction, score, *more)
    names = [c.split()[0] for c in AUDIT.split(", ")] + more
    largest_root = edges.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    if largest_root > COMPONENT_EDGES:
        raise GraphError(f"One unrestricted component has {largest_root} edges; at most {COMPONENT_EDGES} can be capped at once. Raise the threshold or lower the block cap")

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        roots, told = merge_under_cap(list(zip(group["a"], group["b"], group["score"], strict=True)), cap)
        split = dict(zip(zip(group["a"], group["b"], strict=True), group["split"], strict=True)) if more else {}
        rows = [(None, None, *t, *([split[t[0], t[1]]] if more else [])) for t in told] + [(x, r, *[None] * len(names)) for x, r in roots.items()]
        return pd.DataFrame(rows, columns=["account_id", "root", *names])

    done = materialize(edges.groupBy("root").applyInPandas(cut, "account_id string, root string, " + AUDIT + ", split string" * len(more)))
    roots = done.filter("account_id IS NOT NULL").select("account_id", "root")
    assigned = _numbered(accounts.join(roots, "account_id", "left").select("account_id", F.coalesce("root", "account_id").alias("root")))
    audit = done.filter("account_id IS NULL").select(*names)
    return assigned, audit


def mark_guarded(pairs: DataFrame, audit: DataFrame) -> DataFrame:
    """Pairs with guardrail_match: 1 for accepted edges."""
    accepted = audit.filter(F.col("guardrail_decision").startswith("accepted")).select("account_a", "account_b", F.lit(1).alias("guardrail_match"))
    return pairs.join(accepted, ["account_a", "account_b"], "left").withColumn("guardrail_match", F.coalesce("guardrail_match", F.lit(0)))


def group_profiles(assigned: DataFrame, signed: DataFrame, pairs: DataFrame, prediction: str = "enhanced_match") -> DataFrame:
    """What is known of each group; a signal for review and no more."""
    members = assigned.join(signed.select("account_id", "family_token_norm"), "account_id", "left")
    counted = members.groupBy("predicted_group_id", "family_token_norm").agg(F.count("*").alias("n"))
    named = F.when(F.coalesce(F.col("family_token_norm"), F.lit("")) != "", F.col("n"))
    groups = counted.groupBy("predicted_group_id").agg(F.sum("n").alias("members"), F.coalesce(F.try_divide(F.max(named).cast("double"), F.sum(named).cast("double")), F.lit(0.0)).alias("dominant_family_token_share"))
    of = lambda s: assigned.select(F.col("account_id").alias(f"account_{s}"), F.col("predicted_group_id").alias(f"g{s}"))
    links = pairs.filter(F.col(prediction) == 1).join(of("a"), "account_a").join(of("b"), "account_b").filter("ga = gb")
    scores = links.groupBy(F.col("ga").alias("predicted_group_id")).agg(F.min("relation_score").alias("low"), F.avg("relation_score").alias("mean"))
    small = F.col("members") <= 5
    signal = F.when(F.col("members") == 1, "singleton").when(small & (F.col("dominant_family_token_share") >= 0.60), "shared_household_signal").when(small, "shared_residence_signal").otherwise("shared_location_review")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return groups.join(scores, "predicted_group_id", "left").select("predicted_group_id", "members", signal.alias("signal_type"), "dominant_family_token_share", zero("low").alias("minimum_link_score"), zero("mean").alias("mean_link_score"), F.lit(True).alias("review_required"))


def review_building(pairs: DataFrame, prediction: str = "guardrail_match") -> DataFrame:
    """The building with most distinct linked accounts, the least id of equals, and its accepted links."""
    linked = pairs.filter(F.col(prediction) == 1)
    ends = linked.select("building_id", F.explode(F.array("account_a", "account_b")).alias("account_id"))
    best = ends.groupBy("building_id").agg(F.count_distinct("account_id").alias("accounts")).orderBy(F.desc("accounts"), "building_id").limit(1)
    return linked.join(F.broadcast(best), "building_id").select("building_id", "accounts", "account_a", "account_b", "relation_score")


def largest(assigned: DataFrame) -> int:
    found = assigned.groupBy("predicted_group_id").count().agg(F.max("count")).first()[0]
    return int(found or 0)
