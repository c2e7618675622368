"""Connected components of an edge table without a graph library.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014). Before and between the steps every task contracts the edges that it holds to a star per component with
union-find, which shortens the chain of rounds; each round is written to the shared checkpoint folder, so
lineage stays short and a lost executor costs one round at most. Tables of earlier rounds are deleted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EDGES = "a long, b long"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="refrain-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Named tables in one fresh folder under the shared one: lineage ends at each, and each is deleted once it has served."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """The rows, written under a name that was not used before."""
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing still to be run reads."""
        files, root = fs.FileSystem.from_uri(self.folder)
        for name in names:
            files.delete_dir(f"{root}/{name}")


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars (node, smallest node known to be connected), loops left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if parent[x] != x]
    for k in range(0, len(nodes), 65536):
        part = nodes[k : k + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.fromiter(map(root, part), np.int64, len(part)))], names=["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; the component is its smallest node.

    Null ends and loops link nothing, but a node with a loop only is a component of its own.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    held = Scratch(edges.sparkSession)
    source = held.table("edges", edges.groupBy("a", "b").count().select("a", "b"))
    nodes = held.table("nodes", source.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    stars = held.table("stars0", source.where("a <> b").mapInArrow(contract, _EDGES).distinct())
    held.drop("edges")
    seen = None
    for k in range(1, rounds + 1):
        both = stars.select("a", "b").union(stars.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        stars = held.table(f"stars{k}", small.where("a <> b").distinct().mapInArrow(contract, _EDGES).distinct())
        held.drop(f"stars{k - 1}")
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = stars.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(found, nodes.node == found.a, "left").select("node", F.coalesce("component", "node").alias("component"))
