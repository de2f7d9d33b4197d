"""Weighted cell graphs as relations, and least-cost paths.

Edges and weights are joins. A search is a grouped function: one task per graph and start gives the distances to all
destinations, so dates, presets and starts spread over the cluster; a single graph (10^5 edges) is far below a task's memory.
``relax`` is the relational form for graphs of any size, a join and an aggregate per hop, with its lineage cut in the shared
checkpoint folder.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.names import free
from airgrid.sources import constants as K

TERMS = ("distance", "population", "airspace", "traffic")


def edge_terms(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """edges with the four terms: length over the longest, and the mean of both ends' normalised costs. nodes: cell_id,
    population, airspace, traffic (in [0, 1]), perhaps per group of by."""
    by = by or []
    longest = edges.agg(F.max("distance_m").alias("_far"))
    side = lambda end: nodes.select(*by, F.col("cell_id").alias(end), *[F.col(t).alias(f"{end}_{t}") for t in TERMS[1:]])
    joined = edges.join(F.broadcast(longest)).join(side("src"), "src").join(side("dst"), [*by, "dst"])
    terms = {"distance": F.when(F.col("_far") > 0, F.col("distance_m") / F.col("_far")).otherwise(0.0)} | {t: (F.col(f"src_{t}") + F.col(f"dst_{t}")) / 2 for t in TERMS[1:]}
    return joined.select(*by, "src", "dst", "distance_m", *[v.alias(t) for t, v in terms.items()])


def presets(spark) -> DataFrame:
    return spark.createDataFrame(K.PRESETS, "route_name string, route_label string, " + ", ".join(f"{t}_weight double" for t in TERMS))


def weigh(terms: DataFrame, routes: DataFrame) -> DataFrame:
    """A row per edge and preset (a few rows, broadcast) with its weight."""
    weight = sum((F.col(f"{t}_weight") * F.col(t) for t in TERMS[1:]), F.col("distance_weight") * F.col("distance"))
    return terms.join(F.broadcast(routes)).withColumn("weight", weight)


def lightest(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst"), weight: str = "weight") -> DataFrame:
    """Parallel edges as one of least weight; a missing weight is 1."""
    return edges.groupBy(*keys).agg(F.min(F.coalesce(F.col(weight), F.lit(1))).alias(weight))


def both_ways(edges: DataFrame) -> DataFrame:
    flip = {"src": F.col("dst"), "dst": F.col("src")}
    return edges.unionByName(edges.select(*[flip.get(c, F.col(c)).alias(c) for c in edges.columns]))


# ---- grouped searches ------------------------------------------------------------------------------------------------


def _adjacency(src, dst, w) -> dict:
    out: dict = {}
    for a, b, x in zip(src, dst, w, strict=True):
        out.setdefault(a, []).append((b, x))
        out.setdefault(b, []).append((a, x))
    return out


def dijkstra(near: dict, start, goals: set) -> dict:
    """goal -> (cost, path). Equal costs prefer the smaller predecessor, so paths do not depend on order."""
    cost, back, done, heap = {start: 0.0}, {start: None}, set(), [(0.0, start)]
    todo = set(goals)
    while heap and todo:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        todo.discard(u)
        for v, w in near.get(u, ()):
            if w is None or math.isnan(w) or v in done:
                continue
            n = d + w
            if v not in cost or n < cost[v] or (n == cost[v] and u < back[v]):
                if v not in cost or n < cost[v]:
                    heapq.heappush(heap, (n, v))
                cost[v], back[v] = n, u
    out = {}
    for g in goals:
        if g in cost:
            path, x = [], g
            while x is not None:
                path.append(x)
                x = back[x]
            out[g] = (cost[g], path[::-1])
    return out


def shortest_paths(edges: DataFrame, ends: DataFrame, by: list[str], node: str = "long") -> DataFrame:
    """by, destination, total_cost, path for every group of undirected edges (src, dst, weight) and ends (start, goal,
    destination), a few rows that every group searches from one pass over its graph."""
    goals = [(r["start"], r["goal"], r["destination"]) for r in ends.select("start", "goal", "destination").collect()]  # configuration
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near = _adjacency(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist())
        rows = []
        for start in sorted({g[0] for g in goals}):
            found = dijkstra(near, start, {g for s, g, _ in goals if s == start})
            rows += [(*key, name, found[g][0], found[g][1]) for s, g, name in goals if s == start and g in found]
        return pd.DataFrame(rows, columns=[*by, "destination", "total_cost", "path"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "destination string", "total_cost double", f"path array<{node}>"])
    return edges.select(*by, "src", "dst", "weight").groupBy(*by).applyInPandas(search, schema)


class Network:
    """Undirected edges in rows by node: the neighbours of node i (a place in nodes, which are in order) are near[i]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = at[: len(src)], at[len(src) :]
        begin = np.concatenate([a, b])
        self._order = np.argsort(begin, kind="stable")
        self._ends = np.cumsum(np.bincount(begin, minlength=len(self.nodes)))[:-1]
        self.near = [x.tolist() for x in np.split(np.concatenate([b, a])[self._order], self._ends)]

    def weighted(self, weight: np.ndarray) -> list[list[float]]:
        """The weights of the edges in near; a missing one is never passed."""
        w = np.concatenate([weight, weight])[self._order]
        return [x.tolist() for x in np.split(np.where(np.isnan(w), np.inf, w), self._ends)]

    def place(self, node) -> int | None:
        k = int(np.searchsorted(self.nodes, node))
        return k if k < len(self.nodes) and self.nodes[k] == node else None


def heuristic(x: np.ndarray, y: np.ndarray, goals: list[int], distance_weight: float, longest: float) -> np.ndarray | None:
    """For each node the least that the way to the nearest goal can cost: the straight distance as the distance term counts it, the
    other terms being no less than 0. Being a least distance it is consistent, so a node is settled once. None if it would be 0."""
    if distance_weight <= 0 or longest <= 0 or not goals:
        return None
    least = np.min([np.hypot(x - x[g], y - y[g]) for g in goals], axis=0)
    return distance_weight * (least / longest) * (1 - 1e-12)


def astar(near: list[list[int]], weight: list[list[float]], start: int, goals: set[int], bound: np.ndarray | None = None) -> dict[int, tuple[float, list[int]]]:
    """goal -> (cost, path) of every goal that can be reached, the nodes most promising by cost so far and bound first (by cost alone
    without one). Equal costs prefer the smaller predecessor."""
    rest = [0.0] * len(near) if bound is None else bound.tolist()
    cost, back, done = [math.inf] * len(near), [-1] * len(near), bytearray(len(near))
    cost[start], todo, heap = 0.0, set(goals), [(rest[start], start)]
    while heap and todo:
        u = heapq.heappop(heap)[1]
        if done[u]:
            continue
        done[u] = 1
        todo.discard(u)
        d = cost[u]
        for v, w in zip(near[u], weight[u], strict=True):
            n = d + w
            if n < cost[v]:
                if not done[v]:
                    cost[v], back[v] = n, u
                    heapq.heappush(heap, (n + rest[v], v))
            elif n == cost[v] and u < back[v] and not done[v]:
                back[v] = u
    out = {}
    for g in goals:
        if done[g]:
            path = [g]
            while path[-1] != start:
                path.append(back[path[-1]])
            out[g] = (cost[g], path[::-1])
    return out


def preset_paths(terms: DataFrame, routes: DataFrame, ends: DataFrame, by: list[str], centres=None) -> DataFrame:
    """by, route_name, destination, total_cost, path: for every group of edges with terms, all presets (routes) and ends, both a few
    rows of configuration. The terms travel once per group and are weighed in its task, for every preset in turn. centres (node
    ids to x, y) lets searches with a distance weight go by the straight distance."""
    goals = [(r["start"], r["goal"], r["destination"]) for r in ends.select("start", "goal", "destination").collect()]  # configuration
    specs = [(r["route_name"], [r[f"{t}_weight"] for t in TERMS]) for r in routes.collect()]  # configuration
    kinds = {f.name: f.dataType.simpleString() for f in terms.schema.fields}

    def search(key, table):
        column = {c: table[c].to_numpy() for c in ("src", "dst", "distance_m", *TERMS)}
        net, out = Network(column["src"], column["dst"]), []
        x, y = centres(net.nodes) if centres else (None, None)
        for name, weights in specs:
            weight = net.weighted(sum((w * column[t] for w, t in zip(weights[1:], TERMS[1:], strict=True)), weights[0] * column["distance"]))
            for start in sorted({g[0] for g in goals}):
                mine = {net.place(g): (g, d) for s, g, d in goals if s == start}
                mine.pop(None, None)
                at = net.place(start)
                if at is None or not mine:
                    continue
                bound = heuristic(x, y, sorted(mine), weights[0], float(column["distance_m"].max())) if centres else None
                for g, (cost, path) in astar(net.near, weight, at, set(mine), bound).items():
                    out += [(name, d, cost, net.nodes[path].tolist()) for s, goal, d in goals if s == start and goal == mine[g][0]]
        data = [pa.array([k.as_py()] * len(out), k.type) for k in key] + [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())))]
        return pa.table(data, names=[*by, "route_name", "destination", "total_cost", "path"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "route_name string, destination string", "total_cost double", "path array<long>"])
    return terms.select(*by, "src", "dst", "distance_m", *TERMS).groupBy(*by).applyInArrow(search, schema)


def turn_cost(ax: float, ay: float, bx: float, by: float, cx: float, cy: float, weight: float) -> float:
    """weight * (heading change / 180°)²; none where a step has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    size = math.hypot(ux, uy) * math.hypot(vx, vy)
    if not size:
        return 0.0
    return weight * (math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / size)))) / 180.0) ** 2


def turn_penalty(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, weight: float = 1.5) -> Column:
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    size = F.hypot(ux, uy) * F.hypot(vx, vy)
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / size))))
    return F.when(size > 0, F.pow(turn / 180.0, F.lit(2.0)) * weight).otherwise(0.0)


def turn_paths(edges: DataFrame, ends: DataFrame, by: list[str], weight: float = 1.5) -> DataFrame:
    """Least cost with turn penalties: a search over directed edges, whose state is (node, the node before). edges carry
    both ends' centres (x1, y1, x2, y2)."""
    goals = [(r["start"], r["goal"], r["destination"]) for r in ends.select("start", "goal", "destination").collect()]  # configuration
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def search(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near = _adjacency(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist())
        at = dict(zip(pdf["src"], zip(pdf["x1"], pdf["y1"], strict=True), strict=True)) | dict(zip(pdf["dst"], zip(pdf["x2"], pdf["y2"], strict=True), strict=True))
        turns: dict = {}
        rows = []
        for start in sorted({g[0] for g in goals}):
            todo = {g for s, g, _ in goals if s == start}
            first = (start, -1)
            cost, back, done, heap, last = {first: 0.0}, {first: None}, set(), [(0.0, first)], {}
            while heap and todo:
                d, state = heapq.heappop(heap)
                if state in done:
                    continue
                done.add(state)
                u, before = state
                if u in todo:
                    todo.discard(u)
                    last[u] = state
                for v, w in near.get(u, ()):
                    n = d + w
                    if before != -1:
                        step = (*(round(c, 3) for c in (at[u][0] - at[before][0], at[u][1] - at[before][1], at[v][0] - at[u][0], at[v][1] - at[u][1])),)
                        if step not in turns:
                            turns[step] = turn_cost(*at[before], *at[u], *at[v], weight)
                        n += turns[step]
                    to = (v, u)
                    if to not in cost or n < cost[to]:
                        cost[to], back[to] = n, state
                        heapq.heappush(heap, (n, to))
            for s, g, name in goals:
                if s == start and g in last:
                    path, x = [], last[g]
                    while x is not None:
                        path.append(x[0])
                        x = back[x]
                    rows.append((*key, name, cost[last[g]], path[::-1]))
        return pd.DataFrame(rows, columns=[*by, "destination", "total_cost", "path"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "destination string", "total_cost double", "path array<long>"])
    return edges.select(*by, "src", "dst", "weight", "x1", "y1", "x2", "y2").groupBy(*by).applyInPandas(search, schema)


# ---- the relational search -------------------------------------------------------------------------------------------


def checkpoints(spark) -> None:
    """Sees to it that checkpoint() has the cluster's shared folder; one of our own only in local mode, where nothing is shared."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(base or "/tmp/checkpoints/airgrid")


def relax(edges: DataFrame, start, rounds: int = 10_000, every: int = 4) -> DataFrame:
    """node, cost from one start over undirected edges (src, dst, weight): each round takes the nodes that got cheaper one hop
    further. Every few rounds the state is checkpointed; it ends when no node gets cheaper."""
    spark = edges.sparkSession
    checkpoints(spark)
    hops = both_ways(edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))).persist()
    state = spark.createDataFrame([(start, 0.0, True)], f"node {edges.schema['src'].dataType.simpleString()}, cost double, fresh boolean")
    for k in range(rounds):
        step = state.where("fresh").join(hops, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        old = state.select("node", F.col("cost").alias("old"))
        state = old.join(step, "node", "full").select("node", F.least("old", "new").alias("cost"), (F.col("old").isNull() | (F.col("new") < F.col("old"))).alias("fresh"))
        state = state.withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        if k % every == every - 1:
            state = state.checkpoint()
            if not state.where("fresh").limit(1).count():
                break
    hops.unpersist()
    return state.select("node", "cost")


def path_edges(paths: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """keys, pos, a, b: consecutive nodes of each path."""
    pairs = F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))
    usable = paths.where(F.size(path) >= 2).select(*keys, F.posexplode(pairs).alias("pos", "e"))
    return usable.select(*keys, "pos", F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def path_costs(paths: DataFrame, edges: DataFrame, keys: list[str], by: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys with the summed weights (or other columns) of each path's edges; paths of one node cost 0."""
    by = by or []
    sums = sums or {"total_cost": F.col("weight")}
    hops = path_edges(paths, keys).withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    known = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    costs = hops.join(known, [*by, "src", "dst"]).groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    return paths.select(*keys).join(costs, keys, "left").na.fill(0.0, list(sums))


def breakdown(paths: DataFrame, weighted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The four weighted parts of each path's cost and their total."""
    parts = {f"{t}_cost": F.col(f"{t}_weight") * F.col(t) for t in TERMS}
    return path_costs(paths, weighted, keys, by, {**parts, "total_cost": F.col("weight")})


def polylines(paths: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, geometry: the ordered centres of a path's nodes (x, y)."""
    rows = paths.select(*keys, F.posexplode("path").alias("pos", "cell_id")).join(nodes.select("cell_id", F.col("cx").alias("x"), F.col("cy").alias("y")), "cell_id")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("geometry"))


def cells_deduped(points: DataFrame, keys: list[str], order: str, cell: str = "cell_id") -> DataFrame:
    """Without the points that stay in the cell of the one before."""
    b = free("before", points)
    before = F.lag(cell).over(Window.partitionBy(*keys).orderBy(order))
    return points.withColumn(b, before).where(F.col(b).isNull() | (F.col(b) != F.col(cell))).drop(b)
