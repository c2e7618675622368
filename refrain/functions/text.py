"""Column functions on texts and alignments: Spark's own, and the cuts into lines over whole Arrow columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_text(text: Column | str, begin: Column | str, end: Column | str) -> Column:
    """Code points from ``begin`` up to ``end``; a negative begin counts as 0."""
    t, b, e = (F.col(x) if isinstance(x, str) else x for x in (text, begin, end))
    b = F.greatest(b, F.lit(0))
    return t.substr(b + 1, F.greatest(e - b, F.lit(0)))


#: White space: what ``[\s\x1c-\x1f\x85\p{Z}]`` holds.
_BLANKS = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def matches(s1: Column, s2: Column) -> Column:
    """Places where two aligned strings agree, case aside; white space agrees with any other."""
    blank = lambda c: c.isin(_BLANKS)
    pairs = F.zip_with(F.split(s1, ""), F.split(s2, ""), lambda a, b: F.coalesce((a == b) | (F.lower(a) == F.lower(b)) | (blank(a) & blank(b)), F.lit(False)))
    return F.when((F.length(s1) == 0) | (F.length(s2) == 0), 0).otherwise(F.size(F.filter(pairs, lambda x: x))).cast("int")


def text_lines(text: Column) -> Column:
    """array<struct<begin int, text string>>: lines with their ends and offsets; line ends are those that Python's ``splitlines`` knows."""

    def run(text: pa.Array) -> pa.Array:
        return _in_parts(_lines, text)

    return F.arrow_udf(run, "array<struct<begin:int,text:string>>")(text)


def unpad(alg: Column | str) -> Column:
    """An aligned string without its padding."""
    return F.translate(alg, "-", "")


def _points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and where each string starts in them (with the end of the last)."""
    at = np.frombuffer(strings.buffers()[1], np.int64 if pa.types.is_large_string(strings.type) else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


#: Bytes of strings whose lines are cut together; a batch holds up to 64 MB, and what is counted of it several times that.
_PART = 1 << 21


def _in_parts(kernel: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """A kernel over the rows of a batch, a few MB of strings at a time."""
    size = sum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns if pa.types.is_string(c.type))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // _PART)) + 1).tolist(), len(columns[0])]
    return pa.concat_arrays([kernel(*[c.slice(a, b - a) for c in columns]) for a, b in pairwise(cuts)])


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    return np.append(0, np.cumsum(flags))


#: Line ends of one byte.
_ENDS = np.isin(np.arange(256), [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E])


def _lines(texts: pa.Array) -> pa.Array:
    """The lines of all texts of a batch, in one pass over their bytes."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("text", pa.string())]))
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    data, at = _points(texts.fill_null(""))
    ends_here = _ENDS[data]
    after = np.append(data[1:], 0) if len(data) else data
    # Two bytes for U+0085, three for U+2028 and U+2029; a return goes with the new line after it in the same text.
    ends_here[1:] |= (data[:-1] == 0xC2) & (data[1:] == 0x85)
    ends_here[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] == 0xA8) | (data[2:] == 0xA9))
    ends_here &= ~((data == 0x0D) & (after == 0x0A))
    ends = np.union1d(np.flatnonzero(ends_here) + 1, at[1:][at[1:] > at[:-1]])
    starts = np.append(0, ends[:-1])[: len(ends)]
    row = np.searchsorted(at, starts, "right") - 1
    points = _before((data & 0xC0) != 0x80)
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    flat = pa.StructArray.from_arrays([pa.array(points[starts] - points[at[row]], pa.int32()), strings], fields=list(kind.value_type))
    per = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per, mask=np.append(missing, False)), flat, type=kind)


def _cut(begin: pa.Array, begin2: pa.Array, s1: pa.Array, s2: pa.Array) -> pa.Array:
    """Aligned strings cut after each line end of the second, all rows of a batch at once and in one pass over their bytes."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("begin2", pa.int32()), ("alg", pa.string()), ("alg2", pa.string())]))
    if not len(s2):
        return pa.array([], kind)
    missing = s1.is_null().to_numpy(zero_copy_only=False) | s2.is_null().to_numpy(zero_copy_only=False)
    (one, at1), (two, at2) = (_points(pa.array(np.where(missing, "", s.to_numpy(zero_copy_only=False)), pa.large_string()) if missing.any() else s) for s in (s1, s2))
    ends = np.union1d(np.flatnonzero(two == 10) + 1, at2[1:][at2[1:] > at2[:-1]])
    starts = np.append(0, ends[:-1])[: len(ends)]
    row = np.searchsorted(at2, starts, "right") - 1
    points2, hyphens2 = _before((two & 0xC0) != 0x80), _before(two == 45)
    first = (one & 0xC0) != 0x80
    points1, hyphens1, places = _before(first), _before(one == 45), np.append(np.flatnonzero(first), len(one))
    base, past = points1[at1[row]], points1[at1[row + 1]]
    low, high = (np.minimum(base + points2[x] - points2[at2[row]], past) for x in (starts, ends))
    from_, to = places[low], places[high]
    offset1 = low - base - (hyphens1[from_] - hyphens1[at1[row]])
    offset2 = points2[starts] - points2[at2[row]] - (hyphens2[starts] - hyphens2[at2[row]])
    cuts = np.unique(np.concatenate([from_, to]))
    parts = pa.LargeStringArray.from_buffers(max(len(cuts) - 1, 0), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(one)) if len(cuts) > 1 else pa.array([], pa.large_string())
    # A line without a part of the first string is empty.
    which = pa.array(np.searchsorted(cuts, from_), pa.int64(), mask=from_ == to)
    alg = parts.take(which).fill_null("").cast(pa.string())
    alg2 = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(two)).astype(np.int64)), pa.py_buffer(two)).cast(pa.string())
    b1, b2 = (b.to_numpy(zero_copy_only=False).astype(np.int64)[row] if not b.null_count else np.array([x or 0 for x in b.to_pylist()])[row] for b in (begin, begin2))
    flat = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (b1 + offset1, b2 + offset2)] + [alg, alg2], fields=list(kind.value_type))
    per = np.searchsorted(row, np.arange(len(s2) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per, mask=np.append(missing, False)), flat, type=kind)


def cut_lines(begin: Column, begin2: Column, s1: Column, s2: Column) -> Column:
    """The alignment cut after each line end of the target; offsets count characters without padding."""

    def run(begin: pa.Array, begin2: pa.Array, s1: pa.Array, s2: pa.Array) -> pa.Array:
        return _in_parts(_cut, begin, begin2, s1, s2)

    return F.arrow_udf(run, "array<struct<begin:int,begin2:int,alg:string,alg2:string>>")(begin, begin2, s1, s2)
