"""Candidate pairs: grams that two documents share, under a predicate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.config import ReuseConfig
from refrain.functions.types import give_back
from refrain.operators import index


def renamed(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns with the suffix of the target side, but those in ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + "2") for c in df.columns])


def spread(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rows over partitions by number, for work that is large beside the bytes: joined by bytes, partitions would be few."""
    return rows.repartition(index.parts(rows), *by)


def matches(dfpost: DataFrame, cfg: ReuseConfig, shard: int | None = None) -> DataFrame:
    """One row per shared gram of a source and a target document that pass ``filterpairs``.

    At most ``max_df`` squared rows come from one gram, as commoner grams are not in the index. The postings of a gram
    are one row until they are paired, and these rows meet by their least document: so most matches of two documents
    are made by one task, which counts them before anything is shuffled.
    """
    keys = index.keys(dfpost)
    one = [c for c in dfpost.columns if c not in (*keys, "df", "shard")]
    lists = dfpost.groupBy(*keys).agg(F.max("df").alias("df"), F.collect_list(F.struct(*one)).alias("_all"))
    near = spread(lists, F.array_min(F.transform("_all", lambda x: x["uid"])))
    twice = F.transform("_all", lambda x: F.struct(*[x[c].alias(c + "2") for c in one]))
    rows = near.select(*keys, "df", "_all", F.inline("_all")).select(*keys, "df", F.col("df").alias("df2"), *one, F.inline(twice))
    if shard is not None:
        rows = rows.where(F.pmod(F.col("uid2"), F.lit(cfg.shards)) == shard)
    return rows.where(cfg.filterpairs)


def merged_posts(rows: DataFrame, fields: list[str], cfg: ReuseConfig) -> DataFrame:
    """Matches as one row to chain at a time: per pair with ``all_pairs``, else per target with all its sources.

    Only pairs with at least ``min_match`` matches are kept. Columns: uid2, *fields2 [, ref], ``sources``
    array<struct<uid, meta, post array<struct<post2, df, post>>>> and ``prior`` map<uid, weight>. The matches of a
    target are sorted and not collected: a task holds a batch of them and the target that it ends in.
    """
    with_meta = bool(cfg.link_model and fields)
    target = ["uid2", *([f + "2" for f in fields] if with_meta else []), *(["ref"] if cfg.refpref else [])]
    meta = fields if with_meta else ["meta"]
    flat = (rows if with_meta else rows.withColumn("meta", F.lit(1))).select(*target, "uid", *[F.col(m).alias(f"_{m}") for m in meta], "post2", "df", "post")
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    held = ",".join(f"`{m}`:{kinds['_' + m]}" for m in meta)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in target), f"sources array<struct<uid:bigint,meta:struct<{held}>,post:array<struct<post2:int,df:int,post:int>>>>", "prior map<bigint,double>"])
    least, apart, size = cfg.min_match, cfg.all_pairs, len(target)

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, cols = batch.num_rows, batch.columns
        new_target = _changed(cols[:size])
        new_source = new_target | _changed(cols[size : size + 1 + len(meta)])
        counts = np.diff(np.append(np.flatnonzero(new_source), n))
        good = counts >= least
        kept = batch.filter(pa.array(np.repeat(good, counts)))
        firsts = np.flatnonzero(new_source)[good]
        sources = batch.take(pa.array(firsts, pa.int64()))
        which = np.cumsum(new_target)[firsts]
        starts = np.flatnonzero(np.ones(len(which), bool) if apart else np.append(True, which[1:] != which[:-1])[: len(which)])
        ends = np.append(starts, len(which))
        post = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[good])), pa.int32()), pa.StructArray.from_arrays([kept.column(c) for c in ("post2", "df", "post")], ["post2", "df", "post"]))
        uid = sources.column("uid")
        about = pa.StructArray.from_arrays([sources.column(f"_{m}") for m in meta], meta)
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([uid, about, post], ["uid", "meta", "post"]))
        # Rows of one source that differ in their metadata have one weight.
        ids = uid.to_numpy(zero_copy_only=False)
        other = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        other[starts] = True
        weights = pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(other))[ends], pa.int32()), pa.array(ids[other], pa.int64()), pa.array(np.ones(int(other.sum()))))
        rows_ = sources.take(pa.array(starts, pa.int64()))
        return pa.RecordBatch.from_arrays([*rows_.columns[:size], each, weights], names=[*target, "sources", "prior"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_changed(batch.columns[:size]))
            last = int(starts[-1])
            if rest and _changed(pa.concat_batches([rest[-1].slice(rest[-1].num_rows - 1), batch.slice(0, 1)]).columns[:size])[1]:
                yield merge(pa.concat_batches(rest))
                rest = []
            if last:
                yield merge(pa.concat_batches([*rest, batch.slice(0, last)]))
                rest = []
            rest.append(batch.slice(last))
            give_back()
        if rest:
            yield merge(pa.concat_batches(rest))

    order = [*target, "uid", *(f"_{m}" for m in meta), "post2", "df", "post"]
    return flat.repartition("uid2").sortWithinPartitions(*order).mapInArrow(run, schema)


def _changed(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the one before in any column (the first row does); null equals null and NaN equals NaN."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for col in columns:
        if pa.types.is_nested(col.type):
            values = [repr(x) for x in col.to_pylist()]
            out[1:] |= np.array([a != b for a, b in zip(values, values[1:])], bool)
            continue
        a, b = col.slice(1), col.slice(0, max(len(col) - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(col.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out[1:] |= pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out
