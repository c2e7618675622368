"""Shared helpers: tables, the shared working folder, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators.graph import shared_folder, written

#: Rows of text handed to one numpy pass hold at most about so many bytes (one longer text is a pass of its own).
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A fresh folder under ``spark.checkpoint.dir``; a temporary one is made only where that is unset, as in tests.
work_dir = shared_folder


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: lineage ends there."""
    return written(df)


def doc_columns(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sieved(df: DataFrame, key: Column, keys: DataFrame, flag: str, bits: int = 1 << 25) -> DataFrame:
    """``df`` with a column ``flag``: false where the long ``key`` is certainly none of ``keys`` (a table of one long column).

    A bitmap of ``bits`` bits, as a table of at most bits / 64 rows (8 MB), is what is broadcast, whatever the number
    of keys; the more keys, the more rows are flagged for nothing, so the flag only spares rows a join that decides.
    """
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.select(F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod({keys.columns[0]}, 64) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    rows = df.withColumn("_key", key).join(F.broadcast(words), F.shiftright(F.pmod(F.col("_key"), F.lit(bits)), 6) == F.col("_word"), "left")
    hit = F.expr("getbit(_bits, cast(pmod(_key, 64) as int)) = 1")
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_key", "_word", "_bits")


def release() -> None:
    """Give memory that is free again back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the bytes of one text column stay near ``most``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= most:
            yield batch
            release()
            continue
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            n = n or 0
            if held and held + n > most:
                yield batch.slice(start, i - start)
                release()
                start, held = i, 0
            held += n
        yield batch.slice(start)
        del col, batch
        release()
