"""Connected components of an edge table, and the nodes that fall in a contest of first claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(spark: SparkSession) -> None:
    """Sets the folder of checkpoints to the one that the cluster names, or to one in the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable from each id of the undirected edges (a, b).

    Each b hangs on the smallest of its a's. What is left to join are those of its a's that aren't
    this one, and each b that is an a too; a b that is neither only takes the label of what it hangs on,
    and takes no part in the rounds. checkpoint() cuts the lineage in the folder that the cluster
    names. Ids may be of any type that can be ordered, structs as well.
    """
    checkpointed(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b").checkpoint()
    seen = edges.groupBy("a").agg(F.min("b").alias("l")).select("a", F.least("a", "l").alias("l"))
    hung = edges.groupBy("b").agg(F.min("a").alias("m"), F.max("a").alias("last")).join(seen.select(F.col("a").alias("b"), F.lit(True).alias("both")), "b", "left")
    apart = edges.join(hung.where("m < last").select("b", "m"), "b").where("a <> m").select("a", F.col("m").alias("b"))
    core = joined_up(apart.unionByName(hung.where("both").select(F.col("b").alias("a"), F.col("m").alias("b"))), rounds)
    # the smallest id of a component may be one that hangs
    least = core.join(seen, core.id == seen.a).groupBy("component").agg(F.min("l").alias("least"))
    known = core.join(least, "component").select(F.col("id").alias("a"), "least").checkpoint()
    labels = seen.join(known, "a", "left").select("a", F.coalesce("least", "l").alias("component"))
    hanging = hung.where("both is null").select("b", F.col("m").alias("a")).join(labels, "a").select(F.col("b").alias("id"), "component")
    return labels.withColumnRenamed("a", "id").unionByName(hanging)


def joined_up(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, component) as above. Labels move to neighbours and jump along labels, so rounds grow with the
    logarithm of the longest path; an error is raised if they don't suffice."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).checkpoint()
    before = None
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("nl")), "b").groupBy("a").agg(F.min("nl").alias("nl"))
        moved = labels.join(near, "a").select("a", F.least("l", "nl").alias("l"))
        ahead = moved.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        labels = moved.join(ahead, "l", "left").select("a", F.least("l", F.coalesce("ll", "l")).alias("l")).checkpoint()
        total = labels.agg(F.sum(F.xxhash64("l").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"components unfinished after {rounds} rounds")
    return labels.select(F.col("a").alias("id"), F.col("l").alias("component"))


def fallen(conflicts: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id): the nodes that fall if all are taken in order and one falls that an earlier standing one contests.

    conflicts (a, b): a comes before b and would make it fall. In each round the nodes that nothing
    contests any more stand for good and what they contest falls, so rounds grow with the longest
    chain of contests, not with the number of nodes; an error is raised if they don't suffice.
    """
    checkpointed(conflicts.sparkSession)
    left = conflicts.where("a < b").distinct().checkpoint()
    out = left.select(F.col("b").alias("id")).limit(0)
    for _ in range(rounds):
        if left.isEmpty():
            return out.distinct()
        standing = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        down = left.join(standing, "a", "left_semi").select(F.col("b").alias("id")).distinct().checkpoint()
        out = out.unionByName(down)
        ends = left.join(down.withColumnRenamed("id", "b"), "b", "left_anti").join(standing, "a", "left_anti")
        left = ends.join(down.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b").checkpoint()
    raise RuntimeError(f"contests unfinished after {rounds} rounds")
