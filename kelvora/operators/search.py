"""Least-cost fields from many seeds.

Three strategies give the same numbers: weights are not negative and float addition is monotone, so either returns the
least left-to-right sum over all paths.

* ``frontier``: all seeds relax in one DataFrame. What is settled stays where it lies, by (seed, node); a round moves only
  the nodes that have changed and their edges. Needs no edge list in one place; its rounds are the longest chain of hops.
* ``kernel``: seeds are dealt to tasks that each hold the edges as arrays, and relax them a front at a time. Taken only
  when counting shows at most ``KERNEL_EDGES`` edges, which bounds what is broadcast.
* ``tiles.field``: beyond that, and where a tiling of the nodes is named; its rounds are the longest chain of tiles.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNEL_EDGES = 4_000_000
FIELD = "k bigint, i bigint, e double"
TREE = "k bigint, i bigint, e double, parent bigint, depth int, passes double"


def written(df: DataFrame, label: str) -> DataFrame:
    """Lineage cut by a table in the folder that the cluster shares."""
    path = f"{_shared(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{_session_dir(spark.sparkContext.applicationId)}"
    return folder.rstrip("/")


@cache
def _session_dir(application: str) -> str:
    """A fresh folder of this process for a local session without a shared one; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix=f"kelvora-{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _settled(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Lineage cut by a table in buckets of keys: a join on them leaves it where it lies."""
    spark, name = df.sparkSession, f"kelvora_{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{_shared(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name; the files stay
    return out


def frontier(edge: DataFrame, seeds: DataFrame, e_max: float = 0.0) -> DataFrame:
    """(k, i, e) from seeds (k, i). A budget of 0 is none; a path may cost exactly the budget. Every round makes each node
    that it reaches cheaper, so it ends."""
    step = _settled(edge.select(F.col("u").alias("i"), "v", "w"), "edges", "i")
    field = _settled(seeds.select("k", "i").distinct().select("k", "i", F.lit(0.0).alias("e"), F.lit(True).alias("changed")), "field", "k", "i")
    while True:
        reach = field.where("changed").join(step, "i").select("k", F.col("v").alias("i"), (F.col("e") + F.col("w")).alias("e"))
        if e_max > 0:
            reach = reach.where(F.col("e") <= e_max)
        # Only the best offer for a node is moved, to the bucket where the node is settled.
        best = reach.groupBy("k", "i").agg(F.min("e").alias("offer"))
        both = field.select("k", "i", "e").join(best, ["k", "i"], "full")
        better = F.col("e").isNull() | (F.col("offer") < F.col("e"))
        after = both.select("k", "i", F.least("e", "offer").alias("e"), F.coalesce(better & F.col("offer").isNotNull(), F.lit(False)).alias("changed"))
        field = _settled(after, "field", "k", "i")
        if field.where("changed").limit(1).count() == 0:
            return field.select("k", "i", "e")


class Arrays:
    """Edges by source node, as arrays; nodes are numbered in ascending order of their ids."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.ids = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        order = np.lexsort((w, b, a))
        self.source, self.target, self.weight = a[order], b[order], w[order]
        self.head = np.searchsorted(self.source, np.arange(len(self.ids) + 1))

    @classmethod
    def of(cls, ids: np.ndarray, head: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Arrays:
        """As they were kept."""
        out = cls.__new__(cls)
        out.ids, out.head, out.target, out.weight = ids, head, target, weight
        out.source = np.repeat(np.arange(len(ids)), np.diff(head))
        return out

    def number(self, node: int) -> int | None:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else None

    def edges_of(self, nodes: np.ndarray) -> np.ndarray:
        """Places of all edges that leave nodes."""
        n = self.head[nodes + 1] - self.head[nodes]
        return np.repeat(self.head[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def distances(self, at: int, e_max: float = 0.0, lower: np.ndarray | None = None, goal: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, costs) from node number ``at``. Fronts are relaxed whole, the cheaper part of a front first. With a goal
        and a lower bound of what is left to it from each node, only nodes that can lie on a cheapest way are gone on with."""
        best = np.full(len(self.ids), np.inf)
        best[at] = 0.0
        self.spread(best, np.array([at]), e_max, lower, goal)
        nodes = np.flatnonzero(best < np.inf)
        return nodes, best[nodes]

    def spread(self, best: np.ndarray, front: np.ndarray, e_max: float = 0.0, lower: np.ndarray | None = None, goal: int | None = None) -> None:
        """Costs (best, by number) made least by way of a front, in place."""
        width = float(np.mean(self.weight)) * 4 if len(self.weight) else 0.0
        while len(front):
            e = best[front]
            if lower is not None:
                fine = e + lower[front] <= best[goal] * (1 + 1e-12)
                front, e = front[fine], e[fine]
                if not len(front):
                    break
            near = e <= e.min() + width
            now, later = front[near], front[~near]
            own = self.edges_of(now)
            offer = np.repeat(best[now], self.head[now + 1] - self.head[now]) + self.weight[own]
            target = self.target[own]
            fine = offer < best[target]
            if e_max > 0:
                fine &= offer <= e_max
            target = target[fine]
            np.minimum.at(best, target, offer[fine])
            front = np.unique(np.concatenate([target, later]))

    def ways(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, id of the node before it) of the best last step to each node, ties to the smaller id; infinite without one."""
        own = np.flatnonzero(best[self.source] < np.inf)
        source, target = self.source[own], self.target[own]
        offer, cost = best[source] + self.weight[own], np.full(len(self.ids), np.inf)
        np.minimum.at(cost, target, offer)
        fine, before = offer == cost[target], np.full(len(self.ids), len(self.ids))
        np.minimum.at(before, target[fine], source[fine])
        return cost, self.ids[np.minimum(before, len(self.ids) - 1)]

    def settled(self, at: int, most: int, beyond: np.ndarray | None = None) -> tuple[int, float, int] | None:
        """(nodes settled, the last one's cost, edges looked at) of a search that stops at ``most`` nodes: nodes are settled
        in order of cost, so no edge is looked at but those of settled nodes. None if one that is flagged as beyond is."""
        best, heap, done, last, looked = {at: 0.0}, [(0.0, at)], set(), 0.0, 0
        while heap and len(done) < most:
            e, n = heappop(heap)
            if n in done:
                continue
            if beyond is not None and beyond[n]:
                return None
            done.add(n)
            last, own = e, slice(self.head[n], self.head[n + 1])
            looked += own.stop - own.start
            for t, w in zip(self.target[own].tolist(), self.weight[own].tolist(), strict=True):
                if e + w < best.get(t, np.inf):
                    best[t] = e + w
                    heappush(heap, (e + w, t))
        return len(done), last, int(looked)

    def parents(self, nodes: np.ndarray, e: np.ndarray, at: int) -> np.ndarray:
        """The node through which each is cheapest, by number, ties to the smaller id; -1 for the seed."""
        best = np.full(len(self.ids), np.inf)
        best[nodes] = e
        own = self.edges_of(nodes)
        own = own[best[self.target[own]] < np.inf]
        source, target = self.source[own], self.target[own]
        order = np.lexsort((source, best[source] + self.weight[own], target))
        first = np.ones(len(order), bool)
        first[1:] = target[order][1:] != target[order][:-1]
        up = np.full(len(self.ids), -1)
        up[target[order[first]]] = source[order[first]]
        up[at] = -1
        return up[nodes]

    def tree(self, nodes: np.ndarray, e: np.ndarray, at: int, include: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parents, depths, passes) of nodes; passes are the included nodes (all, or those flagged) of a subtree."""
        up = self.parents(nodes, e, at)
        place = np.full(len(self.ids), -1)
        place[nodes] = np.arange(len(nodes))
        jump = np.where(up < 0, np.arange(len(nodes)), place[up])
        depth, far = (up >= 0).astype(np.int64), jump.copy()
        while True:  # depths by doubling
            more = depth[far]
            if not more.any():
                break
            depth, far = depth + more, far[far]
        passes = np.ones(len(nodes)) if include is None else include.astype(float)
        for d in range(int(depth.max(initial=0)), 0, -1):
            own = np.flatnonzero(depth == d) if len(nodes) < 4096 else None
            own = self._level(depth, d) if own is None else own
            np.add.at(passes, jump[own], passes[own])
        return up, depth, passes

    def _level(self, depth: np.ndarray, d: int) -> np.ndarray:
        if getattr(self, "_of", None) is not depth:
            self._order = np.argsort(depth, kind="stable")
            self._heads, self._of = np.searchsorted(depth[self._order], np.arange(int(depth.max()) + 2)), depth
        return self._order[self._heads[d] : self._heads[d + 1]]


def arrays(edge: DataFrame) -> Arrays:
    """The edges on the driver: only after their count was checked."""
    held = edge.select("u", "v", "w").toArrow()
    return Arrays(*(held.column(c).to_numpy() for c in ("u", "v", "w")))


def fits_kernel(edge: DataFrame) -> bool:
    return edge.select("u").limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES


def kernel(edge: DataFrame, seeds: DataFrame, e_max: float = 0.0, with_tree: bool = False) -> DataFrame:
    """FIELD, or TREE with parents and passes; seeds (k, i), one search each. What joins it is merged, as the planner takes it
    to be as small as the seeds."""
    held = edge.sparkSession.sparkContext.broadcast(arrays(edge))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = held.value
        for batch in batches:
            for k, seed in zip(batch["k"], batch["i"], strict=True):
                at = net.number(int(seed))
                if at is None:  # a seed without edges reaches itself
                    row = {"k": [k], "i": [seed], "e": [0.0]}
                    yield pd.DataFrame(row | ({"parent": [None], "depth": [0], "passes": [1.0]} if with_tree else {})).astype({"parent": "Int64"} if with_tree else {})
                    continue
                nodes, e = net.distances(at, e_max)
                out = {"k": k, "i": net.ids[nodes], "e": e}
                if with_tree:
                    up, depth, passes = net.tree(nodes, e, at)
                    out |= {"parent": pd.array(np.where(up < 0, 0, net.ids[up]), "Int64"), "depth": depth.astype(np.int32), "passes": passes}
                    out["parent"][up < 0] = pd.NA
                yield pd.DataFrame(out)

    some = max(1, min(seeds.sparkSession.sparkContext.defaultParallelism, 256))
    return seeds.select("k", "i").distinct().repartition(some, "k").mapInPandas(run, TREE if with_tree else FIELD).hint("merge")


def _large(held: DataFrame, seeds: DataFrame, e_max: float, tiling) -> DataFrame:
    if tiling is None:
        return frontier(held, seeds, e_max)
    from kelvora.operators import tiles

    return tiles.field(held, seeds, tiling, e_max, ready=True)


def field(edge: DataFrame, seeds: DataFrame, e_max: float = 0.0, tiling=None) -> DataFrame:
    """(k, i, e); absent rows are out of reach. Edges are made once, and counted in the table they are written to. A tiling
    (``tiles.Tiling``) tells which nodes lie together."""
    held = written(edge.select("u", "v", "w"), "edges")
    return kernel(held, seeds, e_max) if fits_kernel(held) else _large(held, seeds, e_max, tiling)


def tree(edge: DataFrame, seeds: DataFrame, e_max: float = 0.0, tiling=None) -> DataFrame:
    """TREE of each seed, by arrays or by joins."""
    held = written(edge.select("u", "v", "w"), "edges")
    if fits_kernel(held):
        return kernel(held, seeds, e_max, with_tree=True)
    from kelvora.operators import tiles
    from kelvora.operators.tree import tree_of

    if tiling is not None:
        return tiles.passes(written(tiles.parents(held, seeds, tiling, e_max, ready=True), "parents"), tiling)
    return tree_of(held, written(_large(held, seeds, e_max, tiling), "field"), seeds)


def parents(edge: DataFrame, seeds: DataFrame, e_max: float = 0.0, tiling=None) -> DataFrame:
    """(k, i, e, parent) of each seed, without what is summed over a tree."""
    held = written(edge.select("u", "v", "w"), "edges")
    if fits_kernel(held):
        return kernel(held, seeds, e_max, with_tree=True).select("k", "i", "e", "parent")
    from kelvora.operators import tiles, tree

    if tiling is not None:
        return tiles.parents(held, seeds, tiling, e_max, ready=True)
    return tree.parents(held, written(_large(held, seeds, e_max, tiling), "field"), seeds)


def best_route(edge: DataFrame, bound: DataFrame, seed: int, goal: int) -> DataFrame:
    """(seq, i, e) of one cheapest route. bound (i, left) never overstates what is left from a node to the goal, and only nodes
    that can lie on a cheapest route by it are gone on with. Many edges are searched without it, for the same route."""
    from kelvora.operators import tree as trees

    spark, held = edge.sparkSession, written(edge.select("u", "v", "w"), "edges")
    goals = spark.createDataFrame([(0, goal)], "k bigint, goal bigint")
    if not fits_kernel(held):
        seeds = spark.createDataFrame([(0, seed)], "k bigint, i bigint")
        return trees.path(written(tree(held, seeds), "tree"), goals).select("seq", "i", "e")
    net = spark.sparkContext.broadcast((arrays(held), bound.select("i", "left").toArrow()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays_, left = net.value
        at, end = arrays_.number(seed), arrays_.number(goal)
        lower = np.zeros(len(arrays_.ids))
        place = np.searchsorted(arrays_.ids, left.column("i").to_numpy())
        fine = (place < len(arrays_.ids)) & (arrays_.ids[np.minimum(place, len(arrays_.ids) - 1)] == left.column("i").to_numpy())
        lower[place[fine]] = left.column("left").to_numpy()[fine]
        for _ in batches:
            if at is None or end is None:
                continue
            nodes, e = arrays_.distances(at, 0.0, lower, end)
            up, way, cost = dict(zip(nodes.tolist(), arrays_.parents(nodes, e, at).tolist(), strict=True)), [end], dict(zip(nodes.tolist(), e.tolist(), strict=True))
            while way[-1] in up and up[way[-1]] >= 0:
                way.append(up[way[-1]])
            if way[-1] == at and end in up:
                way = way[::-1]
                yield pd.DataFrame({"seq": np.arange(len(way), dtype=np.int32), "i": arrays_.ids[way], "e": [cost[x] for x in way]})

    return spark.range(1).repartition(1).mapInPandas(run, "seq int, i bigint, e double")


def explored(edge: DataFrame, seeds: DataFrame, most: int, tiling=None) -> DataFrame:
    """(k, explored, reached): how many nodes a search from each seed settles before it is stopped at ``most``, and the cost of
    the last; what a pre-flight estimate is scaled by. Searches stop there: over arrays node by node, else by budgets that
    grow until they reach so many nodes."""
    held = written(edge.select("u", "v", "w"), "edges")
    return _explored_kernel(held, seeds, most) if fits_kernel(held) else _explored_by_budget(held, seeds, most, tiling)


def _explored_kernel(held: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    net = held.sparkSession.sparkContext.broadcast(arrays(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, seed in zip(batch["k"], batch["i"], strict=True):
                at = net.value.number(int(seed))
                rows.append((k, *((1, 0.0) if at is None else net.value.settled(at, most)[:2])))
            yield pd.DataFrame(rows, columns=["k", "explored", "reached"])

    return seeds.select("k", "i").distinct().repartition("k").mapInPandas(run, "k bigint, explored bigint, reached double")


def _explored_by_budget(held: DataFrame, seeds: DataFrame, most: int, tiling) -> DataFrame:
    from pyspark.sql import Window

    budget, left, out = (held.agg(F.avg("w")).first()[0] or 1.0) * max(1.0, most**0.5) / 2 or 1.0, seeds.select("k", "i").distinct(), None
    while True:
        got = written(_large(held, left, budget, tiling), "explored")
        n = got.groupBy("k").agg(F.count("*").alias("n"))
        # A seed is done with at so many nodes, or where no edge leads beyond what it reaches.
        few = got.join(n.where(F.col("n") < most).select("k"), "k", "left_semi")
        ways = few.select(F.col("k").alias("way_k"), F.col("i").alias("u")).join(held, "u").select("way_k", F.col("v").alias("way_i"))
        open_ = ways.join(few, (F.col("way_k") == F.col("k")) & (F.col("way_i") == F.col("i")), "left_anti").select("way_k").distinct()
        more = written(left.join(open_, F.col("k") == F.col("way_k"), "left_semi"), "unexplored")
        full = got.join(more.select("k"), "k", "left_anti")
        ranked = full.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("e", "i"))).where(F.col("n") <= most)
        told = ranked.groupBy("k").agg(F.count("*").alias("explored"), F.max("e").alias("reached"))
        out = told if out is None else out.union(told)
        if more.limit(1).count() == 0:
            return out
        left, budget = more, 2 * budget


def round_trip(there: DataFrame, back: DataFrame, cap: float = 0.0) -> DataFrame:
    out = there.select("k", "i", F.col("e").alias("f")).join(back.select("k", "i", F.col("e").alias("b")), ["k", "i"]).select("k", "i", (F.col("f") + F.col("b")).alias("e"))
    return out.where(F.col("e") <= cap) if cap > 0 else out
