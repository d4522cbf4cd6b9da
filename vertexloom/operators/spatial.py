"""A pyramid of square cells (a region quadtree's levels): their masses, and far forces by interaction lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.lineage import cut, kept


def cell_pyramid(nodes: DataFrame, levels: int = 8, padding: float = 10.0, mass: str | None = None) -> DataFrame:
    """graph_id, level, cx, cy, mass, x, y: each cell's mass and centre of mass, for levels 0 .. levels - 1.

    Level l has 2^l x 2^l cells over the padded square around a graph's nodes. The finest level is summed
    from the nodes, each coarser one from the one below.
    """
    m = F.col(mass) if mass else F.lit(1.0)
    box = nodes.groupBy("graph_id").agg(((F.min("x") + F.max("x")) / 2).alias("mx"), ((F.min("y") + F.max("y")) / 2).alias("my"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 2 + padding).alias("half"))
    last = levels - 1
    at = lambda c, o: F.greatest(F.lit(0), F.least(F.lit(2**last - 1), F.floor((F.col(c) - F.col(o) + F.col("half")) / (2 * F.col("half")) * 2**last))).cast("int")
    fine = nodes.join(box, "graph_id").groupBy("graph_id", at("x", "mx").alias("cx"), at("y", "my").alias("cy")).agg(F.sum(m).alias("mass"), F.sum(m * F.col("x")).alias("sx"), F.sum(m * F.col("y")).alias("sy"))
    every = fine.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level"), "cx", "cy", "mass", "sx", "sy")
    up = lambda c: F.expr(f"cast(shiftright({c}, {last} - level) as int)")
    summed = every.groupBy("graph_id", "level", up("cx").alias("cx"), up("cy").alias("cy")).agg(F.sum("mass").alias("mass"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    return summed.select("graph_id", "level", "cx", "cy", "mass", (F.col("sx") / F.col("mass")).alias("x"), (F.col("sy") / F.col("mass")).alias("y"))


LEAF = 16  # bodies in a finest cell
DEEPEST = 14  # levels of cells at most; what lies closer than 2^-14 of the drawing meets in pairs
TILE = 5  # levels of cells in a tile, which a task takes whole
PAIRS = 1_000_000  # pairs of bodies that a task looks at together


def _bodies(nodes: DataFrame, charge: str | None) -> tuple[DataFrame, DataFrame]:
    """(placed, bodies): nodes with the charge q, and the distinct places x, y with the charge of all nodes there and their
    cell cx, cy of the deepest level."""
    q = F.col(charge).cast("double") if charge else F.lit(1.0)
    placed = nodes.where("x is not null and y is not null").select("graph_id", "idx", "x", "y", q.alias("q"))
    box = placed.groupBy("graph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"))
    at = lambda c, o: F.least(F.lit(2**DEEPEST - 1), F.floor((F.col(c) - F.col(o)) / F.col("side") * 2**DEEPEST)).cast("int")
    bodies = placed.groupBy("graph_id", "x", "y").agg(F.sum("q").alias("q")).join(F.broadcast(box), "graph_id")
    return placed, bodies.select("graph_id", "x", "y", "q", at("x", "x0").alias("cx"), at("y", "y0").alias("cy"), F.col("x0"), F.col("y0"))


def _depths(bodies: DataFrame, leaf: int) -> DataFrame:
    """graph_id, depth: the first level whose fullest cell holds at most `leaf` bodies. Levels with fewer than a cell for each
    `leaf` bodies are passed over; of the others four are tried first."""
    size = bodies.groupBy("graph_id").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.ceil(F.log(F.col("n") / leaf) / F.log(F.lit(4.0)) - 1e-9))).cast("int")
    size = cut(size.select("graph_id", least.alias("least")))
    up = lambda c: F.expr(f"shiftright({c}, {DEEPEST} - level)")

    def fits(some: DataFrame, last) -> DataFrame:
        tried = bodies.select("graph_id", "cx", "cy").join(F.broadcast(some), "graph_id").withColumn("level", F.explode(F.sequence("least", last)))
        counted = tried.groupBy("graph_id", "level", up("cx").alias("cx"), up("cy").alias("cy")).agg(F.count("*").alias("n"))
        fullest = counted.groupBy("graph_id", "level").agg(F.max("n").alias("n"))
        return fullest.groupBy("graph_id").agg(F.min(F.when(F.col("n") <= leaf, F.col("level"))).alias("depth"))

    found = cut(fits(size, F.least(F.col("least") + 3, F.lit(DEEPEST))))
    rest = size.join(found.where("depth is null"), "graph_id", "left_semi")
    if rest.isEmpty():
        return found
    later = fits(rest, F.lit(DEEPEST)).select("graph_id", F.coalesce("depth", F.lit(DEEPEST)).alias("depth"))
    return found.where("depth is not null").unionByName(later)


def interaction_lists(cells: DataFrame) -> DataFrame:
    """Pairs of cells (graph_id, level, cx, cy) as those with sx, sy beside: the children of a cell's parent's neighbours that
    aren't its own neighbours. Every two cells of a level that aren't neighbours are such a pair once on some level above or
    at it, so the forces of all levels' pairs and of neighbours on the finest add up to all."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(6) for b in range(6)))
    parent = lambda c: F.shiftleft(F.shiftright(c, 1) - 1, 1)
    around = cells.select("graph_id", "level", "cx", "cy", F.explode(steps).alias("s"))
    around = around.select("graph_id", "level", "cx", "cy", (parent("cx") + F.col("s.a")).alias("sx"), (parent("cy") + F.col("s.b")).alias("sy"))
    away = around.where("abs(sx - cx) > 1 or abs(sy - cy) > 1")
    held = cells.select("graph_id", "level", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    return away.join(held, ["graph_id", "level", "sx", "sy"])


SUMS = ["m", "sx", "sy", "sxx", "sxy", "syy"]
MOMENTS = ["m", "mx", "my", "mxx", "mxy", "myy"]


def _tile_cells(bodies: DataFrame) -> DataFrame:
    """graph_id, x0, y0, depth, level, cx, cy and the cell's sums of q, qx, qy, qxx, qxy, qyy (from x0, y0 on), for the cells of
    each tile's own level and of those below it."""

    def summed(table: pa.Table) -> pa.Table:
        depth = table["depth"][0].as_py()
        cx, cy, x, y, q = (table[c].to_numpy() for c in ("cx", "cy", "x", "y", "q"))
        x, y = x - table["x0"][0].as_py(), y - table["y0"][0].as_py()
        parts = []
        for level in range(depth - min(TILE, depth), depth + 1):
            cell, back = np.unique((cx.astype(np.int64) >> (depth - level) << 32) + (cy >> (depth - level)), return_inverse=True)
            parts.append([np.full(len(cell), level), cell >> 32, cell & 0xFFFFFFFF, *(np.bincount(back, v) for v in (q, q * x, q * y, q * x * x, q * x * y, q * y * y))])
        level, own_x, own_y, *sums = (np.concatenate(c) for c in zip(*parts, strict=True))
        same = [table[c].take(pa.array(np.zeros(len(level), np.int64))) for c in ("graph_id", "x0", "y0", "depth")]
        return pa.table([*same, *(pa.array(v, pa.int32()) for v in (level, own_x, own_y)), *map(pa.array, sums)], ["graph_id", "x0", "y0", "depth", "level", "cx", "cy", *SUMS])

    schema = "graph_id string, x0 double, y0 double, depth int, level int, cx int, cy int, " + ", ".join(f"{c} double" for c in SUMS)
    return kept(bodies.groupBy("graph_id", "tx", "ty").applyInArrow(summed, schema))


def _moments(sums: DataFrame) -> DataFrame:
    """Cells with mass m, centre of mass mx, my, and second moments about it, from their sums."""
    mx, my = F.col("sx") / F.col("m"), F.col("sy") / F.col("m")
    return sums.where("m <> 0").select(
        "graph_id", "depth", "level", "cx", "cy", "m", (F.col("x0") + mx).alias("mx"), (F.col("y0") + my).alias("my"),
        (F.col("sxx") - F.col("m") * mx * mx).alias("mxx"), (F.col("sxy") - F.col("m") * mx * my).alias("mxy"), (F.col("syy") - F.col("m") * my * my).alias("myy"),
    )


def _far(x: np.ndarray, y: np.ndarray, s: np.ndarray, power: float) -> np.ndarray:
    """The field at (x, y) of cells s (rows of MOMENTS): sum of q D / |D|^(power + 1), D from the bodies to (x, y), to the
    third order in the cell's size over the distance (the first order is 0 about the centre of mass)."""
    k = power + 1
    m, mx, my, xx, xy, yy = s
    dx, dy = x - mx, y - my
    r2 = dx * dx + dy * dy
    near = r2 ** (-k / 2)
    along = (xx * dx * dx + 2 * xy * dx * dy + yy * dy * dy) / r2
    common = m + (k * (k + 2) * along - k * (xx + yy)) / (2 * r2)
    return np.stack([near * (dx * common - k * (xx * dx + xy * dy) / r2), near * (dy * common - k * (xy * dx + yy * dy) / r2)])


def _tile_field(power: float, skip: float):
    """The field at a tile's bodies. Rows of a tile (kind 0): its bodies and those beside it (x, y, q); 1: cells of its
    levels, its own and two round it; 2: cells that act on the whole tile."""

    def field(table: pa.Table) -> pa.Table:
        depth, tx, ty = (table[c][0].as_py() for c in ("depth", "tx", "ty"))
        k = min(TILE, depth)
        kind, level, cx, cy = (table[c].to_numpy().astype(np.int64) for c in ("kind", "level", "cx", "cy"))
        value = np.stack([table[c].to_numpy() for c in MOMENTS])
        # bodies in order of their cells, with a rim of one cell round the tile
        wide = (1 << k) + 2
        place = (cx - (tx << k) + 1) * wide + cy - (ty << k) + 1
        body = np.flatnonzero(kind == 0)
        body = body[np.lexsort((value[1, body], value[0, body], place[body]))]
        x, y, q = value[:3, body]
        first = np.concatenate([[0], np.cumsum(np.bincount(place[body], minlength=wide * wide))])
        own = np.flatnonzero((cx[body] >> k == tx) & (cy[body] >> k == ty))
        at, bx, by, px, py = place[body][own], cx[body][own], cy[body][own], x[own], y[own]
        out, acted = np.zeros((2, len(own))), np.zeros(len(own), bool)
        for row in (-wide, 0, wide):  # three cells beside each other are one stretch of bodies
            low, high = first[at + row - 1], first[at + row + 2]
            ends = np.cumsum(high - low)
            begin = 0
            while begin < len(own):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                n = (high - low)[begin:end]
                i = np.repeat(np.arange(begin, end), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)
                dx, dy = px[i] - x[j], py[i] - y[j]
                r2 = dx * dx + dy * dy
                met = (r2 > skip * skip) & (r2 > 0)
                i, f = i[met], q[j[met]] * r2[met] ** (-(power + 1) / 2)
                acted[i] = True
                out[0] += np.bincount(i, dx[met] * f, len(own))
                out[1] += np.bincount(i, dy[met] * f, len(own))
                begin = end
        for of in range(max(2, depth - k + 1), depth + 1):
            span, x0, y0 = (1 << (of - depth + k)) + 4, (tx << (of - depth + k)) - 2, (ty << (of - depth + k)) - 2
            cell = np.flatnonzero((kind == 1) & (level == of))
            grid = np.full(span * span, -1)
            grid[(cx[cell] - x0) * span + cy[cell] - y0] = cell
            ox, oy = bx >> (depth - of), by >> (depth - of)
            for a in range(6):
                for b in range(6):
                    sx, sy = ((ox >> 1) - 1 << 1) + a, ((oy >> 1) - 1 << 1) + b
                    source = grid[(sx - x0) * span + sy - y0]
                    i = np.flatnonzero((source >= 0) & ((abs(sx - ox) > 1) | (abs(sy - oy) > 1)))
                    acted[i] = True
                    out[:, i] += _far(px[i], py[i], value[:, source[i]], power)
        for cell in np.flatnonzero(kind == 2):
            acted[:] = True
            out += _far(px, py, value[:, cell : cell + 1], power)
        same = table["graph_id"].take(pa.array(np.zeros(int(acted.sum()), np.int64)))
        return pa.table([same, *(pa.array(v[acted]) for v in (px, py, *out))], ["graph_id", "x", "y", "fx", "fy"])

    return field


def interaction_forces(nodes: DataFrame, power: float = 1.0, strength: float = 1.0, charge: str | None = None, leaf: int = LEAF, skip: float = 0.0) -> DataFrame:
    """graph_id, idx, fx, fy: the sum over all others of strength * charge_i * charge_j / distance^power along the line from them.

    A cell acts on another as one body with second moments if the two aren't neighbours but their parents are; neighbours on
    the finest level act body by body, where closer than `skip` not at all. Cells are split until each holds at most `leaf`
    bodies, so the work is that of nodes times levels, at most 27 cells on each level and 9 * leaf bodies a node. Nodes at the
    same place are one body. Bodies are dealt by tiles of 2^TILE by 2^TILE finest cells, with the bodies and cells round a tile
    that act on those in it; so a body is sent a few times, however many levels there are, and a tile holds leaf * 4^TILE
    bodies at most (but where cells of the deepest level hold more than `leaf`). Nodes without a place, or
    on which nothing acts, have no row.
    """
    placed, bodies = _bodies(nodes, charge)
    bodies = kept(bodies.withColumn("graph_id", F.col("graph_id").cast("string")))
    bodies = bodies.join(F.broadcast(_depths(bodies, leaf)), "graph_id").withColumn("depth", F.col("depth").cast("int"))
    down = lambda c: F.expr(f"shiftright({c}, {DEEPEST} - depth)")
    high = lambda c: F.expr(f"shiftright({c}, least({TILE}, depth))")
    bodies = bodies.withColumn("cx", down("cx")).withColumn("cy", down("cy"))
    tiled = bodies.withColumn("tx", high("cx")).withColumn("ty", high("cy"))
    cells = _tile_cells(tiled)

    def beside(df: DataFrame, rim: int, shift: str) -> DataFrame:
        """df once for each tile whose rim it is in."""
        near = lambda c: [F.expr(f"shiftright({c} + {d}, {shift})") for d in (-rim, 0, rim)]
        around = F.array_distinct(F.array(*(F.struct(a.alias("tx"), b.alias("ty")) for a in near("cx") for b in near("cy"))))
        return df.withColumn("t", F.explode(around)).select("*", "t.tx", "t.ty").drop("t")

    columns = ["graph_id", "tx", "ty", "kind", "depth", "level", "cx", "cy", *MOMENTS]
    tiles = cells.where(f"level = depth - least({TILE}, depth)")
    coarse = tiles.where("level >= 2").withColumnsRenamed({"level": "finest"}).withColumn("level", F.explode(F.sequence(F.lit(2), F.col("finest"))))
    up = lambda c: F.expr(f"shiftright({c}, finest - level)")
    coarse = coarse.groupBy("graph_id", "depth", "level", up("cx").alias("cx"), up("cy").alias("cy")).agg(*(F.sum(c).alias(c) for c in SUMS), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    coarse = cut(_moments(coarse))
    lists = interaction_lists(coarse.select("graph_id", "level", "cx", "cy")).join(coarse.withColumnsRenamed({"cx": "sx", "cy": "sy"}), ["graph_id", "level", "sx", "sy"])
    above = tiles.where("level >= 2").select("graph_id", F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("level").alias("finest"), F.explode(F.sequence(F.lit(2), F.col("level"))).alias("level"))
    above = above.withColumn("cx", F.expr("shiftright(tx, finest - level)")).withColumn("cy", F.expr("shiftright(ty, finest - level)"))
    whole = above.join(lists, ["graph_id", "level", "cx", "cy"]).withColumn("kind", F.lit(2)).select(columns)
    inner = beside(_moments(cells.where(f"level > depth - least({TILE}, depth)")), 2, f"level - depth + least({TILE}, depth)").withColumn("kind", F.lit(1)).select(columns)
    none = F.lit(0.0)
    met = beside(bodies, 1, f"least({TILE}, depth)").withColumn("kind", F.lit(0)).withColumn("level", F.col("depth"))
    met = met.select(*columns[:8], F.col("x").alias("m"), F.col("y").alias("mx"), F.col("q").alias("my"), none.alias("mxx"), none.alias("mxy"), none.alias("myy"))
    every = met.unionByName(inner).unionByName(whole)
    # what is beside no body is left out
    every = every.join(tiles.select("graph_id", F.col("cx").alias("tx"), F.col("cy").alias("ty")), ["graph_id", "tx", "ty"], "left_semi")
    # kept, as a tick reads its forces several times
    field = kept(every.groupBy("graph_id", "tx", "ty").applyInArrow(_tile_field(power, skip), "graph_id string, x double, y double, fx double, fy double"))
    own = placed.join(field, ["graph_id", "x", "y"])
    return own.select("graph_id", "idx", (strength * F.col("q") * F.col("fx")).alias("fx"), (strength * F.col("q") * F.col("fy")).alias("fy"))
