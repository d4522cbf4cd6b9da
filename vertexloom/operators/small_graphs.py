"""Runs of force layouts inside one task for each graph, for graphs that fit there.

A run of ticks as queries pays some Spark stages for each tick, which a graph of a few hundred nodes isn't worth; with
many graphs it is the number of graphs that wants spreading. So graphs of at most `in_task` nodes are dealt over the
cluster whole, nodes and edges together, in lots, and their ticks are array operations on all graphs of one size in a lot
at once (up to CELLS pairs of nodes); each graph stops by itself. Larger ones go through the ticks as
queries in `force`, by the same formulas. The memory of a task is in_task squared numbers, a few times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.ingest import in_range, sizes
from vertexloom.sources.graphs import Graph


@dataclass
class Small:
    """One graph as arrays, or graphs of one size as arrays with a row for each; src and dst are places in x, counted through
    the rows. state holds what a layout keeps from tick to tick, as arrays with a row for each graph."""

    x: np.ndarray
    y: np.ndarray
    free: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    length: np.ndarray
    weight: np.ndarray
    state: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        return self.x.shape[-1]

    def only(self, rows: np.ndarray) -> Small:
        """The graphs where rows is true."""
        kept = rows[self.src // self.n]
        moved = lambda at: (np.cumsum(rows) - 1)[at[kept] // self.n] * self.n + at[kept] % self.n
        state = {k: tuple(x[rows] for x in v) if isinstance(v, tuple) else v[rows] for k, v in self.state.items()}
        return Small(self.x[rows], self.y[rows], self.free[rows], moved(self.src), moved(self.dst), self.length[kept], self.weight[kept], state)


LOT = 1 << 13  # pairs of nodes that are dealt together, as long as a graph has fewer
CELLS = 1 << 15  # pairs of nodes that are one array

Tick = Callable[[Small, int], tuple[np.ndarray, np.ndarray]]


def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dx, dy and distance from every node to every other: row i, column j is i - j."""
    dx, dy = a[..., :, None] - a[..., None, :], b[..., :, None] - b[..., None, :]
    return dx, dy, np.sqrt(dx * dx + dy * dy)


def away(g: Small, size: Callable, charge: np.ndarray | float = 1.0, skip: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all others of charge_i * charge_j * size(distance), along the line from them."""
    dx, dy, d = apart(g.x, g.y)
    q = np.broadcast_to(charge, g.x.shape)
    far = (d > skip) & ~np.eye(g.n, dtype=bool)
    f = np.where(far, q[..., :, None] * q[..., None, :] * size(np.where(far, d, 1.0)) / np.where(far, d, 1.0), 0.0)
    return (dx * f).sum(axis=-1), (dy * f).sum(axis=-1)


def along(g: Small, size: Callable, skip: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Pulls along edges by size(distance, edges), on both ends; size gets the places of the edges that count."""
    x, y = g.x.reshape(-1), g.y.reshape(-1)
    dx, dy = x[g.dst] - x[g.src], y[g.dst] - y[g.src]
    d = np.sqrt(dx * dx + dy * dy)
    at = np.flatnonzero((g.src != g.dst) & (d > skip))
    f = size(d[at], at) / d[at]
    fx, fy = dx[at] * f, dy[at] * f
    both = lambda v: (np.bincount(g.src[at], v, x.size) - np.bincount(g.dst[at], v, x.size)).reshape(g.x.shape)
    return both(fx), both(fy)


def degrees(g: Small) -> np.ndarray:
    return (np.bincount(g.src, minlength=g.x.size) + np.bincount(g.dst, minlength=g.x.size)).reshape(g.x.shape)


def hops(g: Small) -> np.ndarray:
    """Hops between all nodes, inf where there is no path."""
    own = np.eye(g.n, dtype=np.float32)
    near = np.zeros((*g.x.shape, g.n), np.float32)
    flat = near.reshape(g.x.size, g.n)
    flat[g.src, g.dst % g.n] = flat[g.dst, g.src % g.n] = 1
    near = near * (1 - own)
    out = np.broadcast_to(np.where(own > 0, 0.0, np.inf), near.shape).copy()
    front, step = np.broadcast_to(own, near.shape), 0
    while front.any():
        step += 1
        front = ((front @ near > 0) & np.isinf(out)).astype(np.float32)
        out[front > 0] = step
    return out


def fruchterman_reingold_tick(size, temperature: Callable[[int], float], distance: float | None = None, gravity: float = 0.1) -> Tick:
    w, h = size

    def tick(g: Small, t: int):
        k = float(distance) if distance else np.sqrt(w * h / g.n)
        (ax, ay), (px, py) = away(g, lambda d: 1 / d, k), along(g, lambda d, _: d * d)
        fx, fy = ax + px / k + gravity * (w / 2 - g.x), ay + py / k + gravity * (h / 2 - g.y)
        f = np.sqrt(fx * fx + fy * fy)
        s = np.where(f > 0, np.minimum(f, temperature(t)) / np.where(f > 0, f, 1.0), 0.0)
        return np.clip(g.x + fx * s, 0.0, w), np.clip(g.y + fy * s, 0.0, h)

    return tick


def spring_tick(size, stiffness: float = 0.1, spring_length: float = 100.0, repulsion: float = 10_000.0, damping: float = 0.5, gravity: float = 0.0) -> Tick:
    w, h = size

    def tick(g: Small, t: int):
        rest = np.where(np.isnan(g.length) | (g.length == 0), spring_length, g.length)
        (ax, ay), (px, py) = away(g, lambda d: repulsion / (d * d)), along(g, lambda d, at: stiffness * (d - rest[at]))
        vx, vy = g.state.get("v", (0.0, 0.0))
        vx = np.where(g.free, (vx + ax + px + gravity * (w / 2 - g.x)) * damping, 0.0)
        vy = np.where(g.free, (vy + ay + py + gravity * (h / 2 - g.y)) * damping, 0.0)
        g.state["v"] = vx, vy
        return g.x + vx, g.y + vy

    return tick


def force_atlas2_tick(size, scaling: float = 2.0, gravity: float = 1.0, strong: bool = False, linlog: bool = False, influence: float = 1.0, tolerance: float = 1.0) -> Tick:
    w, h = size

    def tick(g: Small, t: int):
        mass = degrees(g) + 1.0
        weight = np.where(np.isnan(g.weight), 1.0, g.weight) ** influence
        (ax, ay), (px, py) = away(g, lambda d: scaling / d, mass, 0.01), along(g, lambda d, at: weight[at] * (np.log1p(d) if linlog else d), 0.01)
        dx, dy = w / 2 - g.x, h / 2 - g.y
        d = np.sqrt(dx * dx + dy * dy)
        pull = gravity * mass * (1.0 if strong else np.where(d > 0.01, 1 / np.where(d > 0.01, d, 1.0), 0.0))
        fx, fy = ax + px + dx * pull, ay + py + dy * pull
        lx, ly = g.state.get("f", (0.0, 0.0))
        swing, drive = np.hypot(fx - lx, fy - ly), np.hypot(fx + lx, fy + ly) / 2
        swung = (mass * swing).sum(axis=-1, keepdims=True)
        goal = np.where(swung > 0, tolerance * (mass * drive).sum(axis=-1, keepdims=True) / np.where(swung > 0, swung, 1.0), 1.0)
        speed = np.minimum(goal, 1.5 * g.state.get("speed", 1.0))
        f = np.hypot(fx, fy)
        step = np.where(f >= 0.01, np.minimum(speed / (1 + speed * np.sqrt(swing)), 10 / np.where(f > 0, f, 1.0)), 0.0)
        g.state["f"], g.state["speed"] = (fx, fy), speed
        return g.x + fx * step, g.y + fy * step

    return tick


def yifan_hu_tick(size, distance: float | None = None, strength: float = 0.2, shrink: float = 0.9) -> Tick:
    """Repulsion C K^2 / d, attraction d^2 / K; nodes move by their force, one step at most, which first shrinks if the
    energy rose and grows after five falls in a row."""
    w, h = size

    def tick(g: Small, t: int):
        k = float(distance) if distance else np.sqrt(w * h / g.n)
        (ax, ay), (px, py) = away(g, lambda d: strength * k * k / d), along(g, lambda d, _: d * d / k)
        fx, fy = ax + px, ay + py
        f = np.hypot(fx, fy)
        step, energy, falls = g.state.get("s", (k / 10, np.inf, 0))
        now = (f**2).sum(axis=-1, keepdims=True)
        falls = np.where(now < energy, falls + 1, 0)
        step = np.where(falls >= 5, step / shrink, np.where(now >= energy, step * shrink, step))
        g.state["s"] = step, now, np.where(falls >= 5, 0, falls)
        s = np.where(f > 0, np.minimum(f, step) / np.where(f > 0, f, 1.0), 0.0)
        return g.x + fx * s, g.y + fy * s

    return tick


def stress_tick(edge_length: float = 100.0, none: float | None = None) -> Tick:
    """One majorisation step; pairs without a path are `none` hops apart, or the greater of n and 1.5 times the longest."""

    def tick(g: Small, t: int):
        if "d" not in g.state:
            d = hops(g)
            most = np.where(np.isfinite(d), d, 0.0).max(axis=(-2, -1), initial=0.0, keepdims=True)
            g.state["d"] = np.where(np.isfinite(d), d, none if none is not None else np.maximum(1.5 * most, g.n)) * edge_length
        ideal = g.state["d"] + np.eye(g.n)
        dx, dy, r = apart(g.x, g.y)
        w = np.where(np.eye(g.n, dtype=bool), 0.0, 1 / (ideal * ideal))
        near = r <= 1e-12
        pull = np.where(near, 0.0, ideal / np.where(near, 1.0, r))
        total = w.sum(axis=-1)
        if g.n < 2:
            return g.x, g.y
        return (w * (g.x[..., None, :] + pull * dx)).sum(axis=-1) / total, (w * (g.y[..., None, :] + pull * dy)).sum(axis=-1) / total

    return tick


def settled(own: Small, tick: Tick, iterations: int, every: int, enough: float) -> tuple[np.ndarray, np.ndarray]:
    """Places after a run of graphs of one size; a graph that hardly moves is left out of further ticks."""
    x, y = own.x.copy(), own.y.copy()
    live, t = np.arange(len(x)), 0
    while t < iterations and len(live):
        old = own.x, own.y
        for _ in range(min(every, iterations - t)):
            a, b = tick(own, t)
            own.x, own.y = np.where(own.free, a, own.x), np.where(own.free, b, own.y)
            t += 1
        x[live], y[live] = own.x, own.y
        moving = np.hypot(own.x - old[0], own.y - old[1]).mean(axis=-1) >= enough * every
        if not moving.all():
            own, live = own.only(moving), live[moving]
    return x, y


def run_in_tasks(g: Graph, tick: Tick, iterations: int, every: int = 5, enough: float = 1e-3) -> DataFrame:
    """The nodes of g after a run, as `force.run` makes it: each graph in one task, graphs of one size side by side."""
    schema = g.nodes.schema

    def settle(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return nodes.drop_columns(["__lot"])
        ids = pa.chunked_array([*nodes["graph_id"].chunks, *edges["graph_id"].chunks]).combine_chunks()
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        of, ends = code[: nodes.num_rows], code[nodes.num_rows :]
        order = np.lexsort((nodes["idx"].to_numpy(), of))
        nodes, of = nodes.drop_columns(["__lot"]).take(pa.array(order)), of[order]
        column = lambda t, c, kind=np.float64: t[c].to_numpy(zero_copy_only=False).astype(kind)
        fixed = np.nan_to_num(column(nodes, "fixed")) if "fixed" in nodes.column_names else np.zeros(nodes.num_rows)
        x, y, free = column(nodes, "x"), column(nodes, "y"), fixed == 0
        src, dst, length, weight = column(edges, "src", np.int64), column(edges, "dst", np.int64), column(edges, "length"), column(edges, "weight")
        by_graph = np.argsort(ends, kind="stable")
        size = np.bincount(of)
        first = np.cumsum(size) - size
        for n in np.unique(size[size > 0]):
            alike, most = np.flatnonzero(size == n), max(1, CELLS // int(n * n))
            for start in range(0, len(alike), most):
                some = alike[start : start + most]
                rows = first[some][:, None] + np.arange(n)
                held = by_graph[np.isin(ends[by_graph], some)]
                at = np.searchsorted(some, ends[held]) * n
                own = Small(x[rows], y[rows], free[rows], at + src[held], at + dst[held], length[held], weight[held])
                x[rows], y[rows] = settled(own, tick, iterations, every, enough)
        for c, v in (("x", x), ("y", y)):
            nodes = nodes.set_column(nodes.column_names.index(c), c, pa.array(v, pa.float64()))
        return nodes

    pairs = sizes(g).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    lot = F.pmod(F.xxhash64("graph_id"), F.lit(-(-int(pairs) // LOT) or 1)).alias("__lot")
    edges = in_range(g).select(lot, "graph_id", "src", "dst", F.col("length").cast("double").alias("length"), F.col("weight").cast("double").alias("weight"))
    return g.nodes.select(lot, *g.nodes.columns).groupBy("__lot").cogroup(edges.groupBy("__lot")).applyInArrow(settle, schema)


def by_size(g: Graph, in_task: int) -> tuple[Graph, Graph | None]:
    """g's graphs of at most in_task nodes, and the others (None if there are none)."""
    small = sizes(g).select("graph_id", (F.col("n") <= in_task).alias("fits"))
    if small.where("not fits").isEmpty():
        return g, None
    part = lambda where: Graph(*(df.join(small.where(where).select("graph_id"), "graph_id", "left_semi") for df in (g.nodes, g.edges)))
    return part("fits"), part("not fits")
