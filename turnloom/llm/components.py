"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnloom.sources.sinks import staged


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of a link ``(a, b)``; label is the smallest id of its component.

    A round lets every vertex point to the smallest of itself and its neighbours, follows the pointers to their roots by
    doubling, renames the ends of the links by the roots and
    drops loops. No two roots are neighbours, so the number of vertices at least halves where links are left. Each round is written to the shared
    folder: no lineage grows. Minima combine on the map side and both sides of each join come from files, so adaptive
    execution can split a vertex with many links. Repeated links, loops and nulls are harmless; an empty table gives none.
    """
    spark = links.sparkSession
    edges = staged(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "step")
        while True:
            near, far, last = step.alias("near"), step.alias("far"), step.alias("last")
            jumped = near.join(far, F.col("near.to") == F.col("far.a")).join(last, F.col("far.to") == F.col("last.a"))
            jumped = staged(jumped.select("near.a", F.col("last.to").alias("to"), (F.col("last.to") != F.col("far.to")).alias("moved")), "step")
            step = jumped.select("a", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = step.select(F.col("a").alias("id"), F.col("to").alias("label"))
        else:
            old = labels.join(step, labels["label"] == step["a"], "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = staged(old, "labels")
        left, right = step.select("a", F.col("to").alias("x")), step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = staged(edges.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return spark.createDataFrame([], "id long, label long") if labels is None else labels
