"""Connected components of a table of links: those of the graph, on links without repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import written
from tracelake.operators import reach


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the links (a, b); ``component`` is the smallest node it reaches.

    The driver holds a thread for each shuffle of the last minute, and rounds are many and small: they have two shuffles each, of as many
    parts as Spark finds fit.
    """
    edges = links.select(F.lit(0).alias("repo_id"), F.col("a").alias("source"), F.col("b").alias("target"))
    return written(reach.components(edges, most_rounds, lambda df, *_: df.repartition("node")).select("node", "component"), "components")
