"""Operator 10: near duplicates by HyperMinHash sketches, with every link confirmed on full shingle sets.

A text's set is its distinct shingles of five words (with fewer words, the whole sequence), as 64-bit hashes.
The hash space is cut into ``REGISTERS`` buckets; a register holds, for the least hash of its bucket, the count
of leading zeros and ``MANTISSA`` further bits (HyperMinHash), or a mark for an empty bucket.

1. Rows with equal sets (by a 128-bit digest of the set) share a node, so copies cost one row each.
2. Registers are banded; nodes that share a band are partners. For banding, an empty register borrows from the
   first filled one in an order of its own, so a band of a short text is as telling as one of a long text. Two
   sets of Jaccard similarity 0.7 miss all of 40 bands of 3 with probability 6e-8.
3. In a band's bucket of up to ``small`` nodes all partners are taken; in a larger one, each node is paired
   with the least and the one before, which suffices to join a tight group. Partners are pruned by the
   collision-corrected register estimate, at five standard errors below the threshold, and confirmed exactly.
4. In the larger buckets, partners that step 3 left in different components are then all compared by sketches of
   ``WIDE`` registers, block against block in bounded tasks, pruned the same way, and confirmed exactly. Blocks
   follow components, and two blocks of one component are never compared. So a hot bucket loses no link, and no
   group is ever held in one task or expanded into all its pairs.
5. Components come from the confirmed links.

The matching registers of two sets are drawn without replacement from their union, so the standard error has
the factor for that: for short texts, most of whose shingles have a register of their own, estimates are sharp.

Words: A-Z are lower-cased, then runs of anything but ASCII white space.

Cases: null, empty and blank texts have an empty set, link with nothing and are kept; null ids belong to the
group of their text and never name it unless no id does; rows that share an id are one document of several
texts, and each row gets its own line; an empty table gives no rows; other columns are ignored. ``survivors``
keeps one row of each group, whatever its id, and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import chunks, doc_columns, sieved
from refrain.operators.graph import Scratch, connected_components

REGISTERS, WIDE, MANTISSA, ROWS_PER_BAND = 120, 960, 10, 3
BANDS = REGISTERS // ROWS_PER_BAND
EMPTY, NONE = np.uint16(0xFFFF), np.uint8(255)
_SKETCH = "doc_id long, n_shingles long, digest binary, sketch binary, text_id long"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BUCKETS = {count: np.array([(b * (1 << 64) + count - 1) // count for b in range(count)], np.uint64) for count in (REGISTERS, WIDE)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(trimmed)
    bounds = np.asarray(lists.offsets, np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    empty = np.asarray(pc.equal(pc.binary_length(trimmed), 0))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = hashes[np.asarray(coded.indices)] if len(hashes) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(h), np.uint64)
    if len(h) >= width:
        n = len(h) - width + 1
        acc = h[:n].copy()
        for k in range(1, width):
            acc *= _M2
            acc = (acc ^ (acc >> np.uint64(29))) + h[k : k + n]
        rolled[:n] = _mix(acc)
    out = []
    for a, b, none in zip(bounds[:-1].tolist(), bounds[1:].tolist(), empty.tolist()):
        if none:
            out.append(np.zeros(0, np.uint64))
        elif b - a < width:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes())], np.uint64))
        else:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits that stand for a set: among 10^11 sets, odds of 10^-17 that two share them."""
    return xxhash.xxh3_128_digest(s.tobytes())


def registers(sets: list[np.ndarray], count: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers, one row of uint16 per set."""
    edges = _BUCKETS[count]
    least = np.zeros((len(sets), count), np.uint64)
    filled = np.zeros((len(sets), count), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            filled[k] = at < np.append(at[1:], len(s))
            least[k] = s[np.minimum(at, len(s) - 1)]
    # Place within the bucket, stretched over 52 bits: leading zeros and the bits after the first one.
    x = np.clip((least - edges).astype(np.float64) / np.float64(2.0**64 / count), 2.0**-52, 1 - 2.0**-53)
    frac, exponent = np.frexp(x)  # x = frac * 2**exponent, frac in [0.5, 1)
    zeros = np.minimum(-exponent, 62).astype(np.uint16)
    bits = ((frac * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return np.where(filled, (zeros << np.uint16(MANTISSA)) | bits, EMPTY).astype(np.uint16)


def folded(reg: np.ndarray) -> np.ndarray:
    """Registers folded to a byte each, for comparing: equal ones stay equal, others meet once in 251; 255 is empty."""
    return np.where(reg == EMPTY, NONE, reg % 251).astype(np.uint8)


#: Row i: the registers that register i borrows from, in order.
_LENDERS = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS), axis=1)


def densified(reg: np.ndarray) -> np.ndarray:
    """Registers with empty ones filled from others; two sets agree in each with probability of their similarity still."""
    out = reg.copy()
    row, col = np.nonzero(reg == EMPTY)
    for k in range(REGISTERS):
        if not len(row):
            break
        lent = reg[row, _LENDERS[col, k]]
        out[row, col] = lent
        row, col = row[lent == EMPTY], col[lent == EMPTY]
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A key per band of densified registers."""
    r = reg.reshape(len(reg), BANDS, ROWS_PER_BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), r.shape[:2])
    for k in range(ROWS_PER_BAND):
        key = key * np.uint64(65537) + r[:, :, k]
    return _mix(key * _M1).astype(np.int64)


def chance_collisions(a: np.ndarray, b: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """Expected registers on which disjoint sets of these sizes agree by chance."""
    x, y = np.asarray(a, float) / count, np.asarray(b, float) / count
    total, out = x + y, 0.0
    for z in range(40):
        high, low = 2.0**-z, 2.0 ** -(z + 1)
        out = out + low / (1 << MANTISSA) * (np.exp(-total * low) - np.exp(-total * high))
    return count * x * y / np.maximum(total, 1e-9) * out


def estimate(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows p and q (registers or folded ones) of sets of n and m shingles, the
    registers used, and the matches by chance that were taken off."""
    empty, fold = (NONE, 1 / 251) if p.dtype == np.uint8 else (EMPTY, 0.0)
    used = np.maximum(((p != empty) | (q != empty)).sum(1), 1)
    same = ((p == q) & (p != empty)).sum(1)
    by_chance = (chance_collisions(n, m, p.shape[1]) + fold * used) * (1 - same / used)
    return np.maximum(same - by_chance, 0) / used, used, by_chance


def slack(used: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float, by_chance: np.ndarray | float = 0.0) -> np.ndarray:
    """Five standard errors of the estimate at ``threshold``, for registers drawn from the union without replacement."""
    union = (n + m) / (1 + threshold)
    rest = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    return 5 * np.sqrt((threshold * (1 - threshold) * rest + by_chance / np.maximum(used, 1)) / np.maximum(used, 1))


def sizes_allow(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9


def plausible(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether similarity ``threshold`` is within five standard errors of the estimate and the sizes allow it."""
    j, used, by_chance = estimate(p, q, n, m)
    return (j >= threshold - slack(used, n, m, threshold, by_chance) - 1e-9) & sizes_allow(n, m, threshold)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, digest of the set (null for an empty one), registers and a hash of the text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column(1))
            n = np.array([len(s) for s in sets], np.int64)
            raw = _fixed(registers(sets).tobytes(), 2 * REGISTERS, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), raw, batch.column(2)], names=["doc_id", "n_shingles", "digest", "sketch", "text_id"])

    return doc_columns(docs).withColumn("text_id", F.xxhash64("text")).mapInArrow(run, _SKETCH)


def _fixed(raw: bytes, width: int, rows: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(width), rows, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _matrix(column: pa.Array | pd.Series, kind: type = np.uint8) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) of (node, sketch)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            key = band_keys(densified(_matrix(part.column(1), np.uint16)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(np.asarray(part.column(0)), BANDS))], names=["key", "node"])


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n_shingles, sketch) with the sketch folded."""
    for batch in batches:
        small = folded(_matrix(batch.column(2), np.uint16)) if batch.num_rows else np.zeros((0, REGISTERS), np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _fixed(small.tobytes(), REGISTERS, batch.num_rows)], names=["node", "n_shingles", "sketch"])


def _partners(small: int):  # noqa: ANN202
    """Rows (kind, key or a, b) of sorted (key, class) rows: kind 0 are partners, kind 1 members of large buckets.

    Runs are streamed: of a large one only its first node and the one before are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def put(kind: int, a: int, b: int) -> None:
            out[0].append(kind)
            out[1].append(a)
            out[2].append(b)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["kind", "a", "b"])
            for x in out:
                x.clear()
            return batch

        key, held, last = None, [], None
        for batch in batches:
            keys, nodes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            # Buckets of one node, wholly inside the batch, are passed over at once.
            lone = np.ones(len(keys), bool)
            lone[1:] &= keys[1:] != keys[:-1]
            lone[:-1] &= keys[1:] != keys[:-1]
            if len(keys):
                lone[0] &= keys[0] != key
                lone[-1] = False
            for k, c in zip(keys[~lone].tolist(), nodes[~lone].tolist()):
                if k != key:
                    key, held, last = k, [c], c
                elif c != last:
                    if len(held) < small:
                        for x in held:
                            put(0, x, c)
                        held.append(c)
                    else:
                        if len(held) == small:  # it turns out to be a large bucket
                            for x in held:
                                put(1, key, x)
                            held.append(0)
                        put(0, held[0], c)
                        put(0, last, c)
                        put(1, key, c)
                    last = c
            if len(out[0]) > 1 << 16:
                yield flush()
        yield flush()

    return run


def _pruned(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Partners whose registers leave the threshold possible."""
    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("p"), F.col("n_shingles").alias("n"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("q"), F.col("n_shingles").alias("m"))

    @F.arrow_udf("boolean")
    def possible(p: pa.Array, q: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array(plausible(_matrix(p), _matrix(q), np.asarray(n), np.asarray(m), threshold)) if len(p) else pa.array([], pa.bool_())

    return pairs.join(left, "a").join(right, "b").where(possible("p", "q", "n", "m")).select("a", "b")


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The full set of a text, unhashed."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Partners linked by their full sets: 100 * common >= percent * union."""

    @F.arrow_udf("boolean")
    def linked(s: pa.Array, t: pa.Array) -> pa.Array:
        out, name, first, codec = [], None, set(), zstandard.ZstdDecompressor()
        for x, y in zip(s, t):  # one at a time: texts are unpacked only here
            x, y = x.as_py(), y.as_py()
            if x != name:
                name, first = x, shingles(codec.decompress(x))
            second = shingles(codec.decompress(y))
            common = len(first & second)
            out.append(100 * common >= percent * (len(first) + len(second) - common))
        return pa.array(out, pa.bool_())

    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "s"), ("b", "t")))
    return pairs.join(right, "b").join(left, "a").sortWithinPartitions("a").where(linked("s", "t")).select("a", "b")


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, wide) of (digest, text, node, large) whose text has that digest (rows of one id may have different texts).

    Texts are compressed; nodes of large buckets get a wide sketch too.
    """
    codec = zstandard.ZstdCompressor(level=3)
    for batch in chunks(batches):
        sets = shingle_sets(batch.column(1))
        own = np.array([digest(s) == d for s, d in zip(sets, batch.column(0).to_pylist())], bool)
        kept, sets = batch.filter(pa.array(own)), [s for s, mine in zip(sets, own) if mine]
        large = np.asarray(kept.column(3))
        at = np.flatnonzero(large)
        wide = iter(folded(registers([sets[k] for k in at], WIDE))) if len(at) else iter(())
        yield pa.RecordBatch.from_arrays(
            [kept.column(2), pa.array([codec.compress(t.as_buffer()) for t in kept.column(1).cast(pa.binary())], pa.binary()), pa.array([next(wide).tobytes() if x else None for x in large.tolist()], pa.binary())],
            names=["node", "text", "wide"],
        )


def close(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of p and j of q (folded sketches) with ``apart[i, j]`` that are plausible.

    A bit of each register, as a sign, gives the matches of all pairs at once by a product of matrices: of registers
    that differ, half agree in it. Pairs within six standard errors of enough matches are compared by all bits.
    """
    filled = [(x != NONE).astype(np.float32) for x in (p, q)]
    signs = [f * ((x & 1) * 2.0 - 1).astype(np.float32) for f, x in zip(filled, (p, q))]
    both = filled[0] @ filled[1].T
    used = filled[0].sum(1)[:, None] + filled[1].sum(1)[None, :] - both
    need = (threshold - slack(used, n[:, None], m[None, :], threshold)) * used
    hopeful = signs[0] @ signs[1].T >= need - 6 * np.sqrt(np.maximum(both - need, 1)) - 0.01
    i, j = np.nonzero(apart & hopeful & sizes_allow(n[:, None], m[None, :], threshold))
    good = [np.zeros(0, bool)] + [plausible(p[i[k : k + 4096]], q[j[k : k + 4096]], n[i[k : k + 4096]], m[j[k : k + 4096]], threshold) for k in range(0, len(i), 4096)]
    good = np.concatenate(good)
    return i[good], j[good]


def _across(member: DataFrame, block: int, threshold: float) -> DataFrame:
    """Plausible pairs of different components in the same bucket, of (key, node, component, n_shingles, wide).

    The members of a bucket fall into blocks of about ``block`` rows: those of a large component by hash, those of
    small ones together by hash of the component. A cell is a pair of blocks that are not of one large component.
    """
    per = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= block
    per = per.withColumn("own", own).withColumn("few", F.when(own, 0).otherwise(F.col("n")))
    each = per.groupBy("key").agg(F.count(F.lit(1)).alias("components"), F.ceil(F.sum("few") / block).cast("int").alias("groups"))
    # A block's name: the component for a large one, else null, and a number within it.
    big = per.where("own").select("key", "component", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    named = member.join(each.where("components > 1").select("key", "groups"), "key").join(big, ["key", "component"], "left")
    named = named.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("component"), F.col("groups"))).cast("int"))
    named = named.withColumn("block", F.struct(F.when(F.col("parts").isNotNull(), F.col("component")).alias("component"), "part"))
    blocks = named.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    # Every row goes to each cell of its block; the lesser block of a cell comes first.
    other = F.explode(F.filter("blocks", lambda x: x.component.isNull() | ~x.component.eqNullSafe(F.col("block.component"))))
    cells = named.join(blocks, "key").withColumn("other", other)
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("alone"), "node", "component", "n_shingles", "wide")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["left"]].sort_values("node")
        two = one if pdf["alone"].iloc[0] else pdf[~pdf["left"]]
        q, m, there, name = _matrix(two["wide"]), two["n_shingles"].to_numpy(), two["component"].to_numpy(), two["node"].to_numpy()
        a, b = [], []
        for k in range(0, len(one) if len(two) else 0, 512):
            part = one.iloc[k : k + 512]
            node = part["node"].to_numpy()
            apart = part["component"].to_numpy()[:, None] != there[None, :]
            if two is one:
                apart &= node[:, None] < name[None, :]
            i, j = close(_matrix(part["wide"]), q, part["n_shingles"].to_numpy(), m, apart, threshold)
            a.append(np.minimum(node[i], name[j]))
            b.append(np.maximum(node[i], name[j]))
        return pd.DataFrame({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    return cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _grouped(docs: DataFrame, percent: int, small: int, block: int) -> tuple[DataFrame, Scratch]:
    """Per row: doc_id, n_shingles, text_id, component (null without words), in a table of the returned folder."""
    docs, threshold = doc_columns(docs), percent / 100
    held = Scratch(docs.sparkSession)
    rows = held.table("rows", sketches(docs))
    # One row stands for a set, under the least of its ids (nulls last); its number is fixed once it is written.
    sets = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = held.table("reps", sets.withColumn("node", F.monotonically_increasing_id()))

    bucketed = reps.select("node", "sketch").mapInArrow(_bands, "key long, node long").repartition(F.col("key")).sortWithinPartitions("key", "node")
    found = held.table("found", bucketed.mapInArrow(_partners(small), "kind int, a long, b long"))
    folds = held.table("folds", reps.select("node", "n_shingles", "sketch").mapInArrow(_folds, "node long, n_shingles long, sketch binary"))
    pairs = held.table("pairs", _pruned(found.where("kind = 0").select("a", "b").distinct(), folds, threshold))
    held.drop("folds")

    # Texts of the nodes that may be compared: one scan, kept for both rounds; most other texts are spared the shuffle.
    large = held.table("large", found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node")))
    need = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("large")).union(large.select("node", F.lit(True))).groupBy("node").agg(F.max("large").alias("large"))
    who = held.table("who", reps.select("node", "rep", "digest").join(need, "node"))
    wanted = sieved(docs, F.xxhash64("doc_id"), who.select(F.xxhash64("rep").alias("rep")), "_maybe").where("_maybe")
    texts = held.table("texts", wanted.join(who, wanted.doc_id.eqNullSafe(who.rep)).select("digest", "text", "node", "large").mapInArrow(_own_text, "node long, text binary, wide binary").dropDuplicates(["node"]))
    held.drop("found", "who")

    links = held.table("links", _linked(pairs, texts, percent))
    if not large.isEmpty():
        side = reps.select("node", "n_shingles").join(texts.where("wide is not null").select("node", "wide"), "node")
        joined = connected_components(links)
        member = large.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        member = held.table("member", member.join(mixed, "key"))
        more = held.table("more", _across(member.join(side, "node"), block, threshold).join(pairs, ["a", "b"], "left_anti"))
        held.drop("member")
        links = links.unionByName(held.table("further", _linked(more, texts, percent)))
    held.drop("large", "pairs", "texts")
    joined = connected_components(links)
    named = reps.select("digest", "node").join(joined, "node", "left").select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    out = rows.join(named, rows.digest == named.d, "left").select("doc_id", "n_shingles", "text_id", "component")
    grouped = held.table("grouped", out)
    held.drop("rows", "reps", "links")
    return grouped, held


def components(docs: DataFrame, percent: int = 70, small: int = 12, block: int = 2048) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    rows, held = _grouped(docs, percent, small, block)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = held.table("out", out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    held.drop("grouped")
    return out


def survivors(docs: DataFrame, percent: int = 70, small: int = 12, block: int = 2048) -> DataFrame:
    """The rows of ``docs``, one row of each group of near duplicates: that of the least id, nulls last; all rows without words."""
    rows, held = _grouped(docs, percent, small, block)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    least = rows.where("component is not null").groupBy("component").agg(F.min(place).alias("least"))
    each = rows.where("component is not null").groupBy("doc_id", "text_id").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("n"))
    own = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.text_id") == F.col("text_id"))
    fate = each.join(least, "component").select(F.col("doc_id").alias("_of"), F.col("text_id").alias("_as"), own.alias("_own"), "n").where("not _own or n > 1").drop("n")
    fate = held.table("fate", fate)
    name = F.xxhash64(F.col("text").cast("string"))
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("_of")) & (name == F.col("_as"))
    flagged = sieved(docs, F.xxhash64(F.col("doc_id").cast("long"), name), fate.select(F.xxhash64("_of", "_as").alias("_hash")), "_maybe")
    maybe = flagged.where("_maybe").drop("_maybe")
    out = flagged.where("not _maybe").drop("_maybe").unionByName(maybe.join(fate, met, "left_anti"))
    repeated = fate.where("_own")
    if not repeated.isEmpty():  # rows equal in id and text: one of them
        again = maybe.join(repeated, met, "left_semi").withColumn("_as", name).dropDuplicates(["doc_id", "_as"]).drop("_as")
        out = out.unionByName(again)
    held.drop("grouped")
    return out
