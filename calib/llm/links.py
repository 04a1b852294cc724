"""Connected components of links, as DataFrame rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calib.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the links; ``root`` is the smallest node reachable.

    Each round gives every node the smallest label among its neighbours and then the
    label of that label, so a path of n nodes takes about log n rounds.  NULL ends and
    self links are left out.  Every round is stored, so none is computed again.
    """
    pairs = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = materialize(pairs.union(pairs.select("y", "x")).distinct(), "links")
    labels = materialize(both.groupBy("x").agg(
        F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "y", "root": "r"}), "y").groupBy("x").agg(
            F.min("r").alias("r"))
        hooked = labels.join(near.withColumnRenamed("x", "node"), "node").select(
            "node", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        hooked = materialize(hooked, "hooked")
        jumped = hooked.join(hooked.select(F.col("node").alias("root"), F.col("root").alias("up")),
                             "root", "left")
        labels = materialize(jumped.select(
            "node", F.least("root", F.coalesce("up", "root")).alias("root"), "was"), "labels")
        if labels.where("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
