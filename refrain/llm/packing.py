"""Operator 4: best-fit packing of token runs into sequences, with a bounded number of open bins.

Each task packs the pieces that it tokenises itself: no row is shuffled. Pieces come in batches of about 8 MB of
text, and those of a batch are placed longest first, as a buffer of that size lets an online packer do. Open bins are kept by
free space, and the set of free spaces in use is one integer with a bit per free space, so the tightest bin
that takes a piece is found by masking and taking the lowest set bit. When more than ``open_bins`` bins are
open, the fullest one closes.

Cases: a null or empty text is a document of the end id alone; repeated rows and equal ids are packed as often
as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from refrain.llm.common import chunks, doc_columns
from refrain.llm.tokens import encode_texts

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit over items of 1 to ``capacity`` units."""

    def __init__(self, capacity: int = 2048, open_bins: int = 1024):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.open = 0
        self.made = 0

    def _take(self, space: int) -> int:
        b = self.free[space].pop()
        if not self.free[space]:
            self.mask ^= 1 << space
        return b

    def add(self, length: int) -> tuple[int, int]:
        """The bin of an item and its offset there."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            space, b = self.capacity, self.made
            self.made += 1
            self.open += 1
        left = space - length
        if left == 0:
            self.open -= 1
        else:
            if not self.free[left]:
                self.mask |= 1 << left
            self.free[left].append(b)
            if self.open > self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
        return b, self.capacity - space


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in chunks(batches):
            ids, bounds = encode_texts(batch.column(1), tokenizer)
            raw = ids.astype("<u4", copy=False).tobytes()
            tail = np.array([end_id], "<u4").tobytes()
            pieces: list[tuple[int, int, int, int, int]] = []
            for doc, lo, hi in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n, whole = hi - lo + 1, memoryview(raw[4 * lo : 4 * hi] + tail)
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    pieces.append((doc, piece, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)])))
            pieces.sort(key=lambda p: -p[3])  # stable: ties stay as they came
            placed = [bins.add(p[3]) for p in pieces]
            rows = [*zip(*pieces), [base + b for b, _ in placed], [offset for _, offset in placed]]
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return doc_columns(docs).mapInArrow(run, SCHEMA)
