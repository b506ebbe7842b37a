"""Connected components of a large graph by alternating large and small stars.

Edges live in tables of the shared folder; no node's neighbours are ever gathered: each step is a minimum by node
(summed before the shuffle) and an equi-join whose skewed keys adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.llm.common import discard, shared_dir


def local_forest(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each node's component, over links i-j among n nodes of one task."""
    labels = np.arange(n) if labels is None else labels
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def components(edges: DataFrame, tag: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with an edge, its component's smallest node included.

    edges: two long columns u, v; loops, repeated and reversed edges are allowed, nulls are left out. A round is
    a large star and a small star; the number of rounds grows with the logarithm of the longest path. Raises if
    they have not settled after `most_rounds`, rather than return a part.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_dir(spark, tag)
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    def marked(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = marked(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = put(large)
        # every edge points from the larger node to the smaller one
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        now, new_path = put(small)
        before, mark = mark, marked(now)
        discard(spark, path)
        discard(spark, large_path)
        path = new_path
        if mark == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
