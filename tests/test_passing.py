import os
import random

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import force
from vertexloom.plans.lineage import Rounds, cleaning, kept, passing, use_checkpoint_dir
from vertexloom.sources import graphs


def tables(spark):
    use_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(folder) if d.startswith("table-")}


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def small(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(150)], "idx long, x double, y double")
    edges = spark.createDataFrame([(i, rng.randrange(150)) for i in range(150)], "src long, dst long")
    return graphs.graph(nodes, edges).settled()


def test_tables_and_shuffles_leave_no_files(spark):
    numbers = spark.range(1000).withColumn("k", F.col("id") % 7)
    made, before = [], tables(spark)

    def make():
        made.append(kept(numbers.groupBy("k").count()))
        made.append(passing(spark, lambda: kept(made[0]).where("k > 2")))
        return made[1].join(made[0], ["k", "count"])

    held = shuffles(spark)
    out = passing(spark, make)
    assert len(tables(spark) - before) == 1 and not shuffles(spark) - held
    assert sorted(r.k for r in out.collect()) == [3, 4, 5, 6]
    with cleaning():
        rounds = Rounds(spark)(numbers.groupBy("k").count())
    assert not shuffles(spark) - held and sorted(r.k for r in rounds.collect()) == list(range(7))


def test_what_fails_holds_nothing_open(spark):
    with pytest.raises(ZeroDivisionError):
        passing(spark, lambda: 1 / 0)
    before = tables(spark)
    kept(spark.range(3))
    assert len(tables(spark) - before) == 1


def test_runs_leave_no_tables_of_their_ticks(spark):
    g, before = small(spark), tables(spark)
    ticks = force.run(lambda nodes, _: force.yifan_hu_tick(g, nodes, leaf=6), g.nodes, 3)
    assert tables(spark) == before and ticks.count() == 150


def test_a_tick_in_steps_is_the_tick(spark):
    g = small(spark)
    once = {r.idx: (r.x, r.y, r.energy, r.step) for r in force.yifan_hu_tick(g, g.nodes).collect()}
    steps = {r.idx: (r.x, r.y, r.energy, r.step) for r in passing(spark, lambda: force.yifan_hu_tick(g, g.nodes, leaf=150)).collect()}
    assert once.keys() == steps.keys() and all(once[i] == pytest.approx(steps[i], rel=1e-9) for i in once)
