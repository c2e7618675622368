"""Operator 3: Hilbert-curve sharding: near rows in metadata space land in one shard, shards differ by one row at most.

Several metadata dimensions are quantised at quantiles of the whole table (strings as whole strings, in byte order,
from the counts of their distinct values), the cell's index along a Hilbert curve
gives the order, and the order is cut into runs of equal row counts (the ``rows`` law). A cell that holds a third
of all rows is no single task: its rows are spread by hash over sub-cells of about 1 / ``parts`` of all rows, and
a row's place is the count of all rows in earlier sub-cells plus its rank in its own, by checksum of the text,
then id. The table of sub-cells has at most 2^(3 * bits) + ``parts`` rows, whatever the corpus holds.

Cases: null metadata sorts first; a null text has size 1 and the checksum of the empty text; null ids sort
first; repeated rows each get a place of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import stored

_ROWS = "doc_id long, size long, text_crc32 long, lang string, source string"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows of ``cells``), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def string_cuts(values: DataFrame, steps: int) -> list[tuple[str, int, int]]:
    """Values of (value string, n long) that hold quantiles k / steps of the n, in byte order, with the quantiles below and in each.

    Distinct values are range-partitioned and counted up within the partitions; only partition sums and the cuts
    themselves, at most ``steps``, reach the driver.
    """
    spark = values.sparkSession
    ranged = stored(values.where("value is not null").repartitionByRange("value").withColumn("part", F.spark_partition_id()), spark)
    ahead, total = [], 0
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        ahead.append((r.part, total))
        total += r.n
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.col("ahead")
    step = lambda rows: F.floor(rows.cast("decimal(38,0)") * steps / total).cast("int")
    placed = ranged.join(F.broadcast(spark.createDataFrame(ahead, "part int, ahead long")), "part").withColumn("upto", upto)
    placed = placed.select("value", step(F.col("upto") - F.col("n")).alias("below"), step(F.col("upto")).alias("past")).where("past > below")
    return sorted(((r.value, r.below, r.past - r.below) for r in placed.collect()), key=lambda c: c[1])


def string_cell(value: Column, cuts: list[tuple[str, int, int]], steps: int) -> Column:
    """A value's place among the quantiles, so that few distinct values spread over all cells; null is in cell 0."""
    if not cuts:
        return F.lit(0).cast("long")
    cell = F
    for name, below, own in reversed(cuts):
        cell = cell.when(value > name, min(below + own, steps - 1)).when(value == name, min(below + own // 2, steps - 1))
    return F.coalesce(cell.otherwise(0), F.lit(0)).cast("long")


def shard(docs: DataFrame, shards: int = 8, bits: int = 5, parts: int = 4096) -> DataFrame:
    """Shard and slot of each document, ordered along a curve over (lang, source, size)."""
    spark = docs.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
            crc = [zlib.crc32(t.as_buffer()) if t.is_valid else 0 for t in texts]
            size = np.asarray(size, np.int64) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], names=[c.split()[0] for c in _ROWS.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = stored(narrow.mapInArrow(measure, _ROWS), spark)
    steps = 1 << bits
    strings = [string_cuts(rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")), steps) for c in ("lang", "source")]
    sizes = rows.agg(F.percentile_approx("size", [k / steps for k in range(1, steps)], 10_000)).first()[0]
    edges = np.array(sizes or [], np.int64)

    @F.pandas_udf("long")
    def along(lang, source, size):  # noqa: ANN001, ANN202
        import pandas as pd

        middle = (np.searchsorted(edges, size, "left") + np.searchsorted(edges, size, "right")) // 2
        return pd.Series(hilbert_index(np.stack([lang, source, middle], axis=1), bits))

    placed = stored(rows.select("doc_id", "size", "text_crc32", along(string_cell(F.col("lang"), strings[0], steps), string_cell(F.col("source"), strings[1], steps), "size").alias("curve"), F.monotonically_increasing_id().alias("row")), spark)
    total = placed.count()
    cells = placed.groupBy("curve").count().select("curve", F.ceil(F.col("count") * parts / max(total, 1)).alias("subs"))  # at most 2^(3 bits) rows
    placed = placed.join(F.broadcast(cells), "curve").withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")))
    per = placed.groupBy("curve", "sub").count()  # at most 2^(3 bits) + parts rows
    before = F.coalesce(F.sum("count").over(Window.orderBy("curve", "sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = per.select("curve", "sub", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("curve", "sub").orderBy("text_crc32", F.asc_nulls_first("doc_id"), "row")) - 1
    place = placed.withColumn("rank", rank).join(F.broadcast(ahead), ["curve", "sub"]).withColumn("place", F.col("before") + F.col("rank"))
    small, large = divmod(total, shards)  # the first `large` shards take one row more
    edge = large * (small + 1)
    at = F.when(F.col("place") < edge, F.expr(f"place div {small + 1}")).otherwise(F.expr(f"{large} + (place - {edge}) div {max(small, 1)}"))
    first = F.least(F.col("shard") * (small + 1), F.lit(large) + F.col("shard") * small)
    return (
        place.withColumn("shard", at.cast("int"))
        .withColumn("slot", F.col("place") - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
