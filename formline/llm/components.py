"""Connected components of a large edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): every id of an edge with the smallest id it is connected to.

    Each round an id takes the smallest label among its own, its neighbours' and its label's label,
    so the number of rounds grows with the logarithm of long paths.  Neighbour minima are combined
    before the shuffle, so a hub with very many edges is no hot task.  Each round's table is written.
    """
    both = written(edges.select(F.col(a).alias("id"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "comp"), "to").groupBy("id").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        up = labels.select(F.col("id").alias("next"), F.col("comp").alias("up"))
        new = written(stepped.join(up, "next", "left").select("id", F.least("next", F.coalesce("up", "next")).alias("comp"), "was"), "labels")
        labels = new.select("id", "comp")
        if new.where("comp != was").isEmpty():
            return labels
