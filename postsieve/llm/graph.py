"""Connected components by joins, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.base import settle


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, comp) of every node that has a link: comp is the smallest node it reaches.

    Each round gives a node the smallest label among itself and its neighbours, then the label of
    that label, until nothing changes. Rounds are written and read again; minima are combined
    before each shuffle. Nulls on either side, self links and repeats are left out.
    """
    plain = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = settle(
        plain.unionAll(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = settle(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = (
            edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("heard"))
        )
        lower = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp")
        )
        # the label's own label; a label is a node that has a link, so the join finds it
        ahead = labels.select(F.col("node").alias("at"), F.col("comp").alias("next"))
        after = settle(
            lower.join(ahead, F.col("comp") == F.col("at"))
            .select("node", "old", F.least("comp", "next").alias("comp")),
            "labels",
        )
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            return labels
