"""Forests of a graph and what their tours tell: spanning forests, places on a tour, least and greatest values below a node.

Every loop doubles what it reaches, so rounds grow with the logarithm of the number of nodes, whatever the depth of a
tree, and each round holds one row for each edge, dart or node. The long loops run on a part only: tours are ranked by one
dart in 16, values below a node by stretches of 4,096 places. Nothing is gathered by node: a tour's turns round a node
are taken from blocks of 4,096 edge numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from vertexloom.plans.lineage import Rounds, cut, kept

NEAR = 13  # darts whose numbers agree but for so many bits are put in order together
STOPS = 16  # one dart in so many is ranked by doubling, the others by the next of these
STRETCH = 12  # places whose numbers agree but for so many bits are in one stretch


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, eid) of a spanning forest; (graph_id, node, root) of every node with edges.

    edges: graph_id, eid (unique in a graph), src, dst; loops are passed over. In each round every tree takes the edge to
    another tree whose eid has the least hash, and trees that are joined become one: half of the trees go at least. Hashes
    keep the chains of taken edges short where eids follow a path.
    """
    rounds = Rounds(edges.sparkSession)
    state = rounds(edges.where("src <> dst").select("graph_id", "eid", F.col("src").alias("a"), F.col("dst").alias("b")))
    ends = edges.where("src <> dst").select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = kept(ends.withColumn("root", F.col("node")))
    tree = []
    while not state.isEmpty():
        both = state.unionByName(state.select("graph_id", "eid", F.col("b").alias("a"), F.col("a").alias("b")))
        taken = kept(both.groupBy("graph_id", "a").agg(F.min(F.struct(F.xxhash64("eid"), "eid", "b")).alias("t")).select("graph_id", "a", "t.eid", "t.b"))
        tree.append(taken.select("graph_id", "eid"))
        # trees point along their edges; of two that point at each other the lesser one is the root
        back = taken.select("graph_id", F.col("a").alias("b"), F.col("b").alias("back"))
        up = taken.join(back, ["graph_id", "b"]).select("graph_id", "a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("b"))
        up = _pointed(up)
        one = up.select("graph_id", F.col("a").alias("root"), F.col("b").alias("to"))
        labels = kept(labels.join(one, ["graph_id", "root"], "left").select("graph_id", "node", F.coalesce("to", "root").alias("root")))
        other = up.select("graph_id", F.col("a").alias("b"), F.col("b").alias("v"))
        joined = state.join(up.withColumnRenamed("b", "u"), ["graph_id", "a"]).join(other, ["graph_id", "b"]).where("u <> v")
        least = joined.groupBy("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("eid").alias("eid"))
        state = rounds(least.select("graph_id", "eid", "a", "b"))
    none = edges.select("graph_id", "eid").limit(0)
    return kept(reduce(DataFrame.unionByName, tree, none).distinct()), labels


def _pointed(up: DataFrame) -> DataFrame:
    """graph_id, a, b with b the end of the pointers that a's leads to (a root points at itself)."""
    rounds = Rounds(up.sparkSession)
    up = rounds(up.withColumn("moved", F.lit(True)))
    while not up.where("moved").isEmpty():
        on = up.select("graph_id", F.col("a").alias("b"), F.col("b").alias("to"))
        for _ in range(2):
            up = up.join(on, ["graph_id", "b"]).select("graph_id", "a", F.col("to").alias("b"), (F.col("to") != F.col("b")).alias("moved"))
        up = rounds(up)
    return kept(up.drop("moved"))


def tours(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """graph_id, root, eid, parent, node, first, last: the tree edge above each node but the roots, and its places on the
    walk round the tree from its root: first on the way down, last on the way up. What is below the node has its places
    between these two.

    tree: graph_id, eid, src, dst; labels as `spanning_forest` gives them.
    """
    out = tree.select("graph_id", (F.col("eid") * 2).alias("dart"), F.col("src").alias("at"), F.col("dst").alias("to"))
    out = out.unionByName(tree.select("graph_id", (F.col("eid") * 2 + 1).alias("dart"), F.col("dst").alias("at"), F.col("src").alias("to")))
    out = cut(out.withColumn("near", F.shiftright("dart", NEAR)))
    turn = out.withColumn("turn", F.lead("dart").over(W.Window.partitionBy("graph_id", "at", "near").orderBy("dart")))
    by_near = out.groupBy("graph_id", "at", "near").agg(F.min("dart").alias("least"))
    following = by_near.select("graph_id", "at", "near", F.lead("least").over(W.Window.partitionBy("graph_id", "at").orderBy("near")).alias("following"))
    least = by_near.groupBy("graph_id", "at").agg(F.min("least").alias("least"))
    turn = turn.join(following, ["graph_id", "at", "near"]).join(least, ["graph_id", "at"])
    # who comes in by a dart goes on with the one after its reverse; a walk ends where it would leave its root anew
    ends = turn.join(labels.select("graph_id", F.col("node").alias("at"), "root"), ["graph_id", "at"])
    ahead = F.coalesce("turn", "following", F.when(F.col("at") != F.col("root"), F.col("least")))
    state = ends.select("graph_id", "root", F.col("dart").bitwiseXOR(F.lit(1).cast("long")).alias("dart"), F.col("to").alias("at"), F.col("at").alias("to"), ahead.alias("next"))
    state = kept(_ranked(state.withColumn("left", F.col("next").isNotNull().cast("long"))))
    length = state.groupBy("graph_id", "root").agg(F.max("left").alias("most"))
    placed = state.join(length, ["graph_id", "root"]).select("graph_id", "root", F.shiftright("dart", 1).alias("eid"), F.struct((F.col("most") - F.col("left")).alias("place"), "at", "to").alias("d"))
    found = placed.groupBy("graph_id", "root", "eid").agg(F.min("d").alias("down"), F.max("d").alias("up"))
    return kept(found.select("graph_id", "root", "eid", F.col("down.at").alias("parent"), F.col("down.to").alias("node"), F.col("down.place").alias("first"), F.col("up.place").alias("last")))


def _ranked(state: DataFrame) -> DataFrame:
    """state (graph_id, dart, next, left, ...; left is 1 where there is a next) with left the number of darts to the walk's end.

    All darts go on to the next stop only, some tens of darts away; stops alone double their way to the end.
    """
    stop = lambda c: F.pmod(F.xxhash64(c), F.lit(STOPS)) == 0
    state = _doubled(state, F.col("next").isNotNull() & ~stop("next"))
    stops = _doubled(state.where(stop("dart")).select("graph_id", "dart", "next", "left"), F.col("next").isNotNull())
    further = stops.select("graph_id", F.col("dart").alias("next"), F.col("left").alias("more"))
    return state.join(further, ["graph_id", "next"], "left").withColumn("left", F.col("left") + F.coalesce("more", F.lit(0))).drop("next", "more")


def _doubled(state: DataFrame, moves: Column) -> DataFrame:
    """state with each dart's next moved along as long as it `moves`, and left the number of darts to it."""
    names, rounds = state.columns, Rounds(state.sparkSession)
    state = rounds(state)
    while not state.where(moves).isEmpty():
        far = state.select("graph_id", F.col("dart").alias("key"), F.col("next").alias("further"), F.col("left").alias("more"))
        for _ in range(2):  # a place and the next, and the next but one from there: three times as far a round
            step = state.withColumn("key", F.when(moves, F.col("next"))).join(far, ["graph_id", "key"], "left")
            went = F.col("key").isNotNull()
            state = step.select(*(F.when(went, F.col("further")).otherwise(F.col("next")).alias(c) if c == "next" else (F.col("left") + F.coalesce("more", F.lit(0))).alias(c) if c == "left" else c for c in names))
        state = rounds(state)
    return state


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each stretch adds to its nodes' values, and its own least and greatest value (node is null, first its number).

    Rows come by graph_id, root and place. A node whose places are in one stretch gets its values; another gets those from
    its first place on, and with them the whole stretches between (first, last), and those up to its last place.
    """

    def cuts(t: pa.Table) -> np.ndarray:
        """Where stretches begin."""
        g, root, block = t["graph_id"], t["root"].to_numpy(), t["block"].to_numpy()
        other = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy().astype(bool)
        return np.flatnonzero(np.append(True, other | (root[1:] != root[:-1]) | (block[1:] != block[:-1])))

    def done(t: pa.Table, begin: np.ndarray) -> pa.RecordBatch:
        place, first, last, low, high = (t[c].to_numpy() for c in ("place", "first", "last", "low", "high"))
        end = np.append(begin[1:], len(place)) - 1
        of = np.repeat(np.arange(len(begin)), end - begin + 1)
        mask = (1 << STRETCH) - 1
        key = (of << STRETCH) | (place & mask)
        lone, down, here = first >> STRETCH == last >> STRETCH, place == first, np.arange(len(place))
        own = np.flatnonzero(down | ~lone)
        i = np.where(down, here, begin[of])[own]
        j = np.where(down, np.where(lone, np.searchsorted(key, (of << STRETCH) | (last & mask)), end[of]), here)[own]
        i, j = np.append(i, begin), np.append(j, end)
        k = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        least, most = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for q in range(int(k.max(initial=0)) + 1):
            some = np.flatnonzero(k == q)
            a, b = i[some], j[some] + 1 - (1 << q)
            least[some], most[some] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
            half = 1 << q
            low, high = (f(x[:-half], x[half:]) if len(x) > half else x for f, x in ((np.minimum, low), (np.maximum, high)))
        after, before = (first[own] >> STRETCH) + 1, (last[own] >> STRETCH) - 1
        none = ~down[own] | (after > before)
        rows = t.select(["graph_id", "root"]).take(pa.array(np.append(own, begin)))
        node = pa.array(np.append(t["node"].to_numpy()[own], begin), mask=np.append(np.zeros(len(own), bool), np.ones(len(begin), bool)))
        first = pa.array(np.append(after, t["block"].to_numpy()[begin]), mask=np.append(none, np.zeros(len(begin), bool)))
        last = pa.array(np.append(before, begin), mask=np.append(none, np.ones(len(begin), bool)))
        columns = [c.combine_chunks() for c in rows.columns]
        return pa.RecordBatch.from_arrays([*columns, node, first, last, pa.array(least), pa.array(most)], ["graph_id", "root", "node", "first", "last", "low", "high"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        begin = cuts(held)
        if len(begin) > 1:
            yield done(held.slice(0, begin[-1]).combine_chunks(), begin[:-1])
            held = held.slice(begin[-1])
    if held is not None:
        yield done(held.combine_chunks(), cuts(held))


def below(tour: DataFrame, values: DataFrame) -> DataFrame:
    """graph_id, root, node, low, high: the least and the greatest value of each node of `tours` and of all below it.

    values: graph_id, node, low, high. A node's stretch of the tour is told from the ends of it in their stretches of 4,096
    places, and from the whole stretches between, which `_between` finds.
    """
    own = tour.join(values, ["graph_id", "node"]).select("graph_id", "root", "node", "first", "last", F.col("low").cast("long"), F.col("high").cast("long"))
    places = own.withColumn("place", F.explode(F.array("first", "last"))).withColumn("block", F.shiftright("place", STRETCH))
    dealt = places.repartition("graph_id", "root", "block").sortWithinPartitions("graph_id", "root", "place")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in own.columns)
    found = kept(dealt.mapInArrow(_within, kinds))
    whole = found.where("node is null").select("graph_id", "root", F.col("first").alias("place"), "low", "high")
    between = _between(found.where("node is not null and first is not null").select("graph_id", "root", "node", "first", "last"), whole)
    parts = found.where("node is not null").select("graph_id", "root", "node", "low", "high").unionByName(between)
    return parts.groupBy("graph_id", "root", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _between(asked: DataFrame, state: DataFrame) -> DataFrame:
    """graph_id, root, node, low, high: the least and the greatest value of the places first to last.

    asked: graph_id, root, node, first, last; state: graph_id, root, place, low, high. In round k each place knows the values
    of 4^k places from it on; a stretch of 4^k places and less than 4^(k+1) takes the four that cover it.
    """
    rounds = Rounds(asked.sparkSession)
    size = F.col("last") - F.col("first") + 1
    asked = asked.withColumn("k", F.floor((F.length(F.bin(size)) - 1) / 2))
    most = asked.agg(F.max("k")).first()[0]
    answers = asked.select("graph_id", "root", "node", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")).limit(0)
    for k in range(0 if most is None else most + 1):
        reach = 1 << 2 * k
        parts = F.array_distinct(F.array(*(F.least(F.col("first") + i * reach, F.col("last") + 1 - reach) for i in range(4))))
        some = asked.where(F.col("k") == k).select("graph_id", "root", "node", F.explode(parts).alias("place"))
        found = some.join(state, ["graph_id", "root", "place"]).groupBy("graph_id", "root", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        answers = answers.unionByName(kept(found))
        if k < most:
            spread = state.withColumn("place", F.explode(F.array(*(F.col("place") - i * reach for i in range(4))))).where("place >= 0")
            state = rounds(spread.groupBy("graph_id", "root", "place").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    return answers
