"""Documents that share grams, counted over packed columns.

Postings go through two shuffles, by gram and by the least document of a gram, as arrays: a row is all that one task
sends to one partition. So the cost for a posting or a match is that of NumPy, and Spark sees rows again as counts. The
bytes of numbers lie apart, all first ones, then all second ones: upper ones are alike, so what Spark compresses is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.config import ReuseConfig
from refrain.functions.types import give_back
from refrain.operators import index

#: Postings that a task holds before it sends them on, or drops those of grams that are too common.
HELD = 1 << 20

#: Matches that are counted at a time.
MATCHES = 1 << 20

_POSTINGS = {"one": np.uint64, "two": np.uint32, "uid": np.int64, "post": np.int32}
_LISTS = {"sizes": np.int32, "uid": np.int64, "post": np.int32}


def _planes(kinds: dict[str, type]) -> list[str]:
    return [f"{c}{k}" for c, kind in kinds.items() for k in range(np.dtype(kind).itemsize)]


def _schema(kinds: dict[str, type]) -> str:
    return ", ".join(["part int", *(f"{c} binary" for c in _planes(kinds))])


def _packed(parts: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row per part; of each column the values and where those of each part begin (and the last ends)."""
    arrays = []
    for values, cuts in columns.values():
        offsets, size = pa.py_buffer(cuts.astype(np.int32)), values.itemsize
        planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T)
        arrays += [pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, pa.py_buffer(planes[k])]) for k in range(size)]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *arrays], names=["part", *_planes({c: v.dtype for c, (v, _) in columns.items()})])


def _unpacked(batch: pa.RecordBatch, kinds: dict[str, type]) -> list[np.ndarray]:
    """The values of all rows of each column."""

    def plane(name: str) -> np.ndarray:
        column = batch.column(batch.schema.get_field_index(name))
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)

    out = []
    for name, kind in kinds.items():
        planes = [plane(x) for x in _planes({name: kind})]
        out.append(np.ascontiguousarray(np.stack(planes, axis=1)).view(kind).ravel())
    return out


def _part(mixed: np.ndarray, parts: int) -> np.ndarray:
    """A partition by the upper bits."""
    return (((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the members of groups, one group after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _by_gram(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal grams together (and keeps theirs), where each gram starts in it, and how many there are of each.

    Upper bits of the first hash and the place are sorted as one number; where these bits don't tell grams apart, the rest does.
    """
    bits = np.uint64(len(one).bit_length())
    place = (np.uint64(1) << bits) - np.uint64(1)
    above = one - one.min()
    key = np.sort(((above << np.uint64(min(63, 64 - int(above.max()).bit_length()))) & ~place) | np.arange(len(one), dtype=np.uint64))
    order = (key & place).astype(np.int64)
    heads = _starts(key >> bits)
    next_ = lambda x: x[order[1:]] == x[order[:-1]]
    same = next_(one) & next_(two)
    inside = np.ones(len(one), bool)
    inside[heads] = False
    if (mixed := np.flatnonzero(inside[1:] & ~same)).size:
        for k in np.unique(np.searchsorted(heads, mixed, "right") - 1):
            some = order[heads[k] : heads[k + 1] if k + 1 < len(heads) else None]
            some[:] = some[np.lexsort((two[some], one[some]))]
        same = next_(one) & next_(two)
    starts = np.flatnonzero(np.append(True, ~same))
    return order, starts, np.diff(np.append(starts, len(one)))


def _trimmed(columns: list[np.ndarray], most: int, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """Postings by gram; of those that more than ``most`` documents hold one more than ``most`` stay, enough to tell it.

    With the number of each posting's document (``rows``), grams that occur more than once in a document go first.
    """
    order, starts, counts = _by_gram(columns[0], columns[1])
    if rows is not None:
        again = rows[order[1:]] == rows[order[:-1]]
        again[starts[1:] - 1] = False
        good = ~(np.append(again, False) | np.append(False, again))
        counts = np.add.reduceat(good, starts, dtype=np.int64)
        order, counts = order[good], counts[counts > 0]
        starts = np.cumsum(counts) - counts
    if len(counts) and counts.max() > most + 1:
        order = order[np.arange(len(order)) - np.repeat(starts, counts) <= most]
    return [c[order] for c in columns]


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*held)]


def _without_offsets(kinds: dict[str, type]) -> dict[str, type]:
    return {c: kind for c, kind in kinds.items() if c != "post"}


def lists(docs: DataFrame, cfg: ReuseConfig, offsets: bool) -> DataFrame:
    """The index of documents (uid, text) as packed lists: of each gram within the band the documents, by number, and ``offsets``."""
    postings, listed = (_POSTINGS, _LISTS) if offsets else map(_without_offsets, (_POSTINGS, _LISTS))
    n, floating, least, most, parts = cfg.n, cfg.floating_ngrams, cfg.min_df, cfg.max_df, index.parts(docs)

    def send(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows, *columns = _joined(held)
        columns = _trimmed(columns, most, rows)
        part = _part(columns[0], parts)
        starts = _starts(part)
        return _packed(part[starts], {c: (x, np.append(starts, len(part))) for c, x in zip(postings, columns)})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, row = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            uids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("uid", "text"))
            good = texts.is_valid().to_numpy(zero_copy_only=False)
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1])
            group = np.cumsum(lengths) // index.TOGETHER
            for first, last in zip(s := _starts(group), np.append(s[1:], len(group))):
                rows = first + np.flatnonzero(good[first:last])
                which, one, two, posts = index.hashes_of(texts.take(pa.array(rows)).to_pylist(), n, floating)
                uid = uids.take(pa.array(rows)).to_numpy(zero_copy_only=False)[which]
                held.append([row + which, one, two, uid, *([posts] if offsets else [])])
                row += len(rows)
                size += len(one)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
            give_back()
        if size:
            yield send(held)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, 4 * HELD
        for batch in batches:
            held.append(_unpacked(batch, postings))
            size += len(held[-1][0])
            if size > limit:
                held = [_trimmed(_joined(held), most)]
                size = len(held[0][0])
                limit = max(4 * HELD, 2 * size)
        if size:
            one, two, *columns = _joined(held)
            held.clear()
            order, _, counts = _by_gram(one, two)
            del one, two
            good = (counts >= least) & (counts <= most)
            order, sizes = order[np.repeat(good, counts)], counts[good]
            columns = [c[order] for c in columns]
            order = np.lexsort((columns[0], np.repeat(np.arange(len(sizes)), sizes)))
            columns = [c[order] for c in columns]
            starts = np.cumsum(sizes) - sizes
            part = _part(columns[0][starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts)
            by = np.argsort(part, kind="stable")
            # No more than HELD postings (or one list) at a time.
            for a, b in zip(s := _starts(np.cumsum(sizes[by]) // HELD), np.append(s[1:], len(by))):
                some = by[a:b]
                firsts = _starts(part[some])
                rows, ends = _ragged(starts[some], sizes[some]), np.append(0, np.cumsum(sizes[some]))
                cuts = np.append(firsts, len(some))
                yield _packed(part[some][firsts], {"sizes": (sizes[some].astype(np.int32), cuts)} | {c: (x[rows], ends[cuts]) for c, x in zip(("uid", "post"), columns)})
        give_back()

    posted = docs.select("uid", "text").mapInArrow(post, _schema(postings)).repartitionById(parts, F.col("part"))
    return posted.mapInArrow(band, _schema(listed)).repartitionById(parts, F.col("part"))


def counted(docs: DataFrame, cfg: ReuseConfig, least: int, *, same: bool = False, offsets: bool = False, near: int | None = None) -> DataFrame:
    """(uid, uid2, matches) of documents (uid, text) with uid < uid2 and at least ``least`` grams in common.

    ``same`` counts a document with itself, too; ``offsets`` adds the least and greatest offsets of the matches (begin,
    last, begin2, last2); ``near`` counts only matches whose offsets differ by no more. A pair's matches are counted
    by the task of their grams' least document, and its counts are added up after a shuffle.
    """
    bounds = ("begin", "last", "begin2", "last2") if offsets else ()
    placed = offsets or near is not None
    kinds = _LISTS if placed else _without_offsets(_LISTS)

    def pairs(sizes: np.ndarray, uid: np.ndarray, post: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        by = np.argsort(uid[starts], kind="stable")
        rows, sizes = _ragged(starts[by], sizes[by]), sizes[by]
        post = post[rows] if placed else None
        ids, code = np.unique(uid[rows], return_inverse=True)
        after = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(len(rows)) - 1
        past = np.cumsum(after)
        if same:
            yield rows_of(ids, ids, np.bincount(code), [])
        first = 0
        while first < len(rows):
            done = past[first] - after[first]
            end = max(first + 1, int(np.searchsorted(past, done + MATCHES, "right")))
            some = after[first:end]
            a = np.repeat(np.arange(first, end), some)
            b = a + 1 + np.arange(len(a)) - np.repeat(past[first:end] - some - done, some)
            first = end
            if near is not None:
                good = np.abs(post[a].astype(np.int64) - post[b]) <= near
                a, b = a[good], b[good]
            key = code[a] * np.int64(len(ids)) + code[b]
            twice = code[a] == code[b]  # rows of one number meet in both orders, or not at all
            if offsets:
                order = np.argsort(key)
                key, p, p2 = key[order], post[a[order]], post[b[order]]
            else:
                key = np.sort(key)
            s = _starts(key)
            n = np.diff(np.append(s, len(key)))
            one, two = np.divmod(key[s], np.int64(len(ids)))
            ends = [f.reduceat(x, s) for x in (p, p2) for f in (np.minimum, np.maximum)] if offsets and len(s) else [np.empty(0, np.int32)] * len(bounds)
            if twice.any():
                n = np.where(one == two, 2 * n, n)
                good = (one != two) | same
                one, two, n, ends = one[good], two[good], n[good], [x[good] for x in ends]
            yield rows_of(ids[one], ids[two], n, ends)

    def rows_of(uid: np.ndarray, uid2: np.ndarray, n: np.ndarray, ends: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(uid2, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.int32()) for x in ends)], names=["uid", "uid2", "matches", *bounds])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_unpacked(batch, kinds))
            size += len(held[-1][1])
            if size >= 4 * HELD:
                yield from pairs(*_joined(held))
                held, size = [], 0
        if size:
            yield from pairs(*_joined(held))
        give_back()

    if same and offsets:
        raise ValueError("a document's matches with itself have no offsets")
    parts = lists(docs, cfg, placed).mapInArrow(count, ", ".join(["uid long", "uid2 long", "matches long", *(f"{c} int" for c in bounds)]))
    met = parts.repartition(index.parts(docs), "uid", "uid2").groupBy("uid", "uid2")
    return met.agg(F.sum("matches").alias("matches"), *[(F.min if c.startswith("begin") else F.max)(c).alias(c) for c in bounds]).where(F.col("matches") >= least)
