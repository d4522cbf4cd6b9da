"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree splits on random directions at the median of a bounded sample (sample_rows vectors, the only thing
that is fitted); every vector is indexed, in one leaf of each tree. A query walks all trees through one
priority queue: what a node costs is the sum of the squared margins by which the query stands on the other
side of the splits above it, and the cheapest node of any tree is opened next, until `share` of the forest's
leaves have been visited. The vectors in visited leaves are ranked by their exact inner products in double
precision. For maximum inner product, vectors get one more coordinate that makes their norms equal
(queries get zero there), so that the nearest ones also have the largest products.

Plan: equal vectors are one class, searched once, with its k + 1 smallest ids (more can never be in a result),
so a vector that a third of all rows hold is one candidate and one query. Classes are dealt to shards of
whole leaves (a leaf that is larger than a shard is split over several); a query goes once to each shard
that holds leaves it visits, and each shard returns its k + 1 best. Queries are dealt in blocks of ask_rows, so a task
holds a shard and a block, however many queries there are. What the driver holds is the sample, the
forest and the sizes of its leaves, all bounded by sample_rows, trees and max_depth.

Recall depends on the data: on vectors without any structure (the test tables' background) it takes four fifths of
all vectors to find 92 to 99 % of the neighbours, so `share` is set for those; clustered vectors need far less.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; a null vec_id takes no part; of rows that repeat a vec_id with the same vector one
counts; ties go to the smaller vec_id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import cut


@dataclass
class Forest:
    """planes: trees x inner nodes x (dimension + 1), in heap order; cuts: trees x inner nodes."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    norm: float

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each vector."""
        x, out = self.lifted(x), np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.planes[t][node]).sum(axis=1) > self.cuts[t][node])
            out[:, t] = node - (self.leaves - 1)
        return out

    def visits(self, q: np.ndarray, number: int, held: np.ndarray, least: int) -> list[list[int]]:
        """For each query the first `number` leaves (tree * leaves + leaf) that the shared queue opens, and more until they
        hold `least` vectors; held: the vectors of each leaf."""
        x = np.hstack([q, np.zeros((len(q), 1))])
        margins = np.stack([x @ self.planes[t].T - self.cuts[t] for t in range(len(self.planes))], axis=1)
        inner, out = self.leaves - 1, []
        for margin in margins:
            queue = [(0.0, t, 0) for t in range(len(margin))]
            found: list[int] = []
            rows = 0
            while queue and (len(found) < number or rows < least):
                cost, t, node = heapq.heappop(queue)
                if node >= inner:
                    found.append(t * self.leaves + node - inner)
                    rows += int(held[found[-1]])
                    continue
                m = float(margin[t, node])
                near = 2 * node + (2 if m > 0 else 1)
                heapq.heappush(queue, (cost, t, near))
                heapq.heappush(queue, (cost + m * m, t, 4 * node + 3 - near))
            out.append(found)
        return out


def fit_forest(sample: np.ndarray, rows: int, norm: float, trees: int = 4, leaf_rows: int = 200, max_depth: int = 11, seed: int = 42) -> Forest:
    rng = np.random.default_rng(seed)
    depth = int(np.clip(np.round(np.log2(max(1, rows) / leaf_rows)), 1, max_depth))
    inner = (1 << depth) - 1
    forest = Forest(rng.standard_normal((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)), depth, norm)
    forest.planes /= np.linalg.norm(forest.planes, axis=2, keepdims=True)
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            side = (x * forest.planes[t][node]).sum(axis=1)
            for k in range((1 << level) - 1, (2 << level) - 1):
                if (own := node == k).any():
                    forest.cuts[t, k] = np.median(side[own])
            node = 2 * node + 1 + (side > forest.cuts[t][node])
    return forest


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, v as array<double>."""
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    own = own.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("v") == (length.n if length else -1)).dropDuplicates(["vec_id", "v"])


def search(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 4, share: float = 0.35, leaf_rows: int = 100, sample_rows: int = 20_000, shard_rows: int = 16_384, ask_rows: int = 8192, max_depth: int = 11, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors (vec_id, embedding, ...) whose
    vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut(usable(vectors).withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(seed), "v")))
    query = F.pmod("vec_id", F.lit(every)) == 0
    classes = cut(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"), F.max(query).alias("asked")))
    count, norm = classes.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))).first()
    if not count:
        return empty
    few = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").toArrow()
    forest = fit_forest(_matrix(few["v"]), count, norm, trees, leaf_rows, max_depth, seed)
    shared = context.broadcast(forest)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.leaf_of(_matrix(batch.column(1))) + np.arange(trees) * shared.value.leaves
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.tolist(), pa.list_(pa.int32()))], ["rep", "v", "leaves"])

    placed = classes.select("rep", "v").mapInArrow(leaves, "rep long, v array<double>, leaves array<int>").select("rep", "v", F.explode("leaves").alias("leaf"))
    placed = cut(placed)
    sizes = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # trees * 2 ** max_depth rows at most
    shards, held = {}, [0]
    for leaf in sorted(sizes):
        if sizes[leaf] > shard_rows:
            parts = -(-sizes[leaf] // shard_rows)
            shards[leaf] = list(range(len(held), len(held) + parts))
            held += [shard_rows] * parts + [0]
        else:
            if held[-1] + sizes[leaf] > shard_rows:
                held.append(0)
            held[-1] += sizes[leaf]
            shards[leaf] = [len(held) - 1]
    where = context.broadcast(shards)
    held_by = np.zeros(trees * forest.leaves, np.int64)
    held_by[list(sizes)] = list(sizes.values())
    weights = context.broadcast(held_by)
    asks = classes.where("asked").count()
    blocks = max(1, -(-asks // ask_rows))
    number = max(1, round(share * trees * forest.leaves))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[int, int, list[int]]] = []
            for i, visited in enumerate(shared.value.visits(_matrix(batch.column(1)), number, weights.value, 10 * trees * (k + 1))):
                by: dict[int, list[int]] = {}
                for leaf in visited:
                    for s in where.value.get(leaf, ()):
                        by.setdefault(s, []).append(leaf)
                out += [(i, s, own) for s, own in by.items()]
            at = pa.array([i for i, *_ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([s for _, s, _ in out], pa.int32()), pa.array([x for *_, x in out], pa.list_(pa.int32()))], ["asks", "q", "shard", "leaves"])

    asked = classes.where("asked").select("rep", "v").mapInArrow(routed, "asks long, q array<double>, shard int, leaves array<int>")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("asks"), F.lit(blocks)).cast("int"))
    own = spark.createDataFrame(list(shards.items()), "leaf int, parts array<int>")
    dealt = placed.join(F.broadcast(own), "leaf").withColumn("shard", F.expr("parts[cast(pmod(xxhash64(rep), size(parts)) as int)]"))

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, k + 1, trees)

    dealt = dealt.select("shard", "leaf", "rep", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    near = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(ranked, "asks long, rep long, score double")
    return _expanded(near, rows, k, query)


def _best(asks: pa.Table, held: pa.Table, k: int, copies: int) -> pa.Table:
    """The k best candidates of each query among the leaves it visits here; a vector is held once for each tree."""
    schema = pa.schema([("asks", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
    if not asks.num_rows or not held.num_rows:
        return schema.empty_table()
    leaf = held["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf, rep, v = leaf[order], held["rep"].to_numpy()[order], _matrix(held["v"])[order]
    bounds = {int(x): (np.searchsorted(leaf, x), np.searchsorted(leaf, x, side="right")) for x in np.unique(leaf)}
    q, names, wanted, out = _matrix(asks["q"]), asks["asks"].to_numpy(), asks["leaves"].to_pylist(), []
    for start in range(0, len(q), 128):
        block = q[start : start + 128]
        scores = np.full((len(block), len(v)), -np.inf)
        visitors: dict[int, list[int]] = {}
        for i, own in enumerate(wanted[start : start + 128]):
            for x in own:
                visitors.setdefault(x, []).append(i)
        for x, who in visitors.items():
            a, b = bounds.get(x, (0, 0))
            if a < b:
                scores[who, a:b] = block[who] @ v[a:b].T
        for i, row in enumerate(scores):
            most = k * copies
            least = np.partition(row, len(row) - most)[len(row) - most] if len(row) > most else -np.inf
            slack = 1e-9 * max(1.0, abs(float(least))) if np.isfinite(least) else 0.0
            some = np.flatnonzero(row >= least - slack) if np.isfinite(least) else np.flatnonzero(row > -np.inf)
            some = some[np.unique(rep[some], return_index=True)[1]]
            exact = (v[some] * block[i]).sum(axis=1)  # one way of adding for every pair, so that equal ones tie
            some = some[np.lexsort((rep[some], -exact))[:k]] if len(some) else some
            exact = (v[some] * block[i]).sum(axis=1)
            out.append((np.full(len(some), names[start + i]), rep[some], exact))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.Table.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], schema=schema)


def _expanded(near: DataFrame, rows: DataFrame, k: int, query) -> DataFrame:
    """From classes to rows: the smallest ids of each class found, without the query's own."""
    best = lambda *by: W.Window.partitionBy(*by).orderBy(F.desc("score"), "rep")
    top = near.distinct().withColumn("r", F.row_number().over(best("asks"))).where(F.col("r") <= k + 1).drop("r")
    salted = rows.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(W.Window.partitionBy("h1", "h2", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    first = salted.withColumn("r", F.row_number().over(W.Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.collect_list("vec_id").alias("ids"))
    spread = top.join(ids.select("rep", "ids"), "rep").select("asks", "score", F.explode("ids").alias("vec_id"))
    listed = spread.withColumn("r", F.row_number().over(W.Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = listed.groupBy("asks").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    asking = rows.where(query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(ids.select("h1", "h2", F.col("rep").alias("asks")), ["h1", "h2"])
    own = asking.join(lists, "asks").select("query_id", F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op9_projection_forest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of embeddings whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
