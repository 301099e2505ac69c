"""Connected components of a pair list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut_anew


#: Edges or nodes per task: small frames are not spread over the session's partitions.
ROWS_PER_TASK = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` (bigint); the
    component is its smallest node.

    In each round every node points at the first of itself and its neighbours, or
    at what that one points at, and the edges are relabelled by the pointers;
    edges within one label vanish, and labels that are still to be joined keep
    an edge.  The order is that of the ids in every other round, which takes in
    a star at once, and that of a hash of the ids in the rounds between, which
    shortens any chain by a constant factor.  Minima are map-side combined and
    relabelling is a plain join, so a node with any number of edges is never
    gathered in one task.
    """
    cur = cut_anew(edges.select("a", "b").filter("a <> b").distinct())
    done = cur.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    rounds, tasks = 0, None
    while n := cur.agg(F.count(F.lit(1))).first()[0]:
        tasks = tasks or 2 * n // ROWS_PER_TASK + 1  # the frames only shrink from here
        cur = cur.coalesce(tasks)
        both = cur.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
                                            F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
        near = both.select("e.node", "e.to")
        if rounds % 2:
            key = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)), F.col(c).alias("id"))  # noqa: E731, B023
            up = (near.withColumn("k", key("to")).groupBy("node").agg(F.min("k").alias("m"))
                  .select("node", F.least("m", key("node"))["id"].alias("up")))
        else:
            up = near.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = up.coalesce(tasks)
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = cut_anew(up.join(far, "up").select("node", "far").coalesce(tasks))
        done = (done.join(step.withColumnRenamed("node", "component"), "component", "left")
                .select("node", F.coalesce("far", "component").alias("component")))
        cur = cut_anew(cur.join(step.select(F.col("node").alias("a"), F.col("far").alias("_a")), "a")
                  .join(step.select(F.col("node").alias("b"), F.col("far").alias("_b")), "b")
                  .filter("_a <> _b")
                  .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().coalesce(tasks))
        rounds += 1
    done = cut_anew(done.coalesce(tasks or 1))
    if rounds < 2:  # the ids' order alone leaves the smallest node as the label
        return done
    least = done.groupBy("component").agg(F.min("node").alias("least"))
    return cut_anew(done.join(least, "component").select("node", F.col("least").alias("component")).coalesce(tasks))
