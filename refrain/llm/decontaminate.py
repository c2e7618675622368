"""Operator 8: a positional inverted index, split by documents, that answers phrase and proximity queries.

Every index block holds the postings (positions within the block, by term) of a run of whole training texts, all
terms included. ``build`` stores the blocks as Arrow files in the shared folder, one file per task, and queries are
answered from these alone. A test item is looked up from its rarest terms: for the rarest term of a window the
postings are shifted by its place in the item, intersected with the shifted postings of the next rarest, and the
surviving places are compared word by word. A proximity match is the smallest span of at most ``slop`` words of one
document around a posting of the item's rarest term that holds its ``terms`` rarest distinct terms, by their counts
over all documents (all of them, if the item has fewer; an item whose rarest term is in no document has none).

The test items are sent to the tasks in blocks of at most ``block_bytes`` of text; each block is one pass over
the index, and with more than one block the hits are merged per document afterwards. Nothing grows with the corpus
but the index. ``clean``, a filter of one pass, indexes the items' terms only and stores nothing.

Words: A-Z are lower-cased, then runs of digits, letters a-z and everything beyond ASCII.

Cases: a null or empty text has no words and no hits; null items and items without words match nothing; an item
with fewer words than the window is one window; items of equal text each count; items with a null id hit words
but are not listed, and their proximity matches have a null item; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import chunks, doc_columns, stored, work_dir

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Two rarest terms are intersected before words are compared; a doc boundary is a word that no item has.
_GAP, _OTHER = -2, -1
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NEAR = "item_id long, begin long, end long"
FULL = RESULT + ", n_near long, near array<struct<item_id: long, begin: long, end: long>>"
_SPAN = pa.struct([(c.split()[0], pa.int64()) for c in _NEAR.split(", ")])
_FILES = "path string, blocks long, documents long, words long"
#: One row per block; ``gaps`` holds the differences of the postings (int32), term after term.
_BLOCK = pa.schema([("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("gaps", pa.binary())])


def words(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class Block:
    """The inverted index of some texts, over the terms of ``vocabulary``."""

    def __init__(self, texts: list[bytes | None], vocabulary: dict[bytes, int]):
        get, parts, starts, at = vocabulary.get, [], [], 0
        self.lengths = np.zeros(len(texts), np.int64)
        gap = np.array([_GAP], np.int32)
        for k, text in enumerate(texts):
            ws = words(text)
            self.lengths[k] = len(ws)
            starts.append(at)
            parts += (np.fromiter((get(w, _OTHER) for w in ws), np.int32, len(ws)), gap)
            at += len(ws) + 1
        self.terms = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.starts = np.array(starts, np.int64)
        known = np.flatnonzero(self.terms >= 0)
        order = known[np.argsort(self.terms[known], kind="stable")]
        self.order = order
        bounds = np.searchsorted(self.terms[order], np.arange(len(vocabulary) + 1))
        self.first, self.past = bounds[:-1], bounds[1:]

    @classmethod
    def opened(cls, row: pa.RecordBatch, vocabulary: dict[bytes, int]) -> Block:
        """A stored block, its terms numbered by ``vocabulary``."""
        block, get = cls.__new__(cls), vocabulary.get
        block.lengths = row["n_words"].values.to_numpy()
        past = np.cumsum(block.lengths + 1)
        block.starts = past - block.lengths - 1
        counts, block.order = row["counts"].values.to_numpy(), _postings(row)
        codes = np.fromiter((get(w, _OTHER) for w in row["terms"].values.to_pylist()), np.int32, len(counts))
        block.terms = np.full(int(past[-1]), _GAP, np.int32)
        block.terms[block.order] = np.repeat(codes, counts)
        ends, known = np.cumsum(counts), codes >= 0
        block.first, block.past = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        block.first[codes[known]], block.past[codes[known]] = (ends - counts)[known], ends[known]
        return block

    def postings(self, term: int) -> np.ndarray:
        """Sorted positions of a term in the block."""
        return self.order[self.first[term] : self.past[term]]

    def df(self, term: int) -> int:
        return int(self.past[term] - self.first[term])

    def phrase(self, item: np.ndarray, window: int) -> list[tuple[int, int]]:
        """Maximal runs [first, past) of block positions covered by windows of the item."""
        n = len(item)
        size = min(window, n)
        if not size:
            return []
        dfs = np.array([self.df(t) for t in item])
        found: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()
        w = 0
        while w + size <= n:
            inside = dfs[w : w + size]
            if (zero := np.flatnonzero(inside == 0)).size:
                w += int(zero[-1]) + 1
                continue
            rank = np.argsort(inside, kind="stable")
            anchor = w + int(rank[0])
            last = min(anchor, n - size)  # windows w..last hold the anchor
            begin = self.postings(item[anchor]) - anchor
            if last == w and size > 1:  # one window alone: the next rarest term must be in place too
                second = w + int(rank[1])
                begin = begin[np.isin(begin, self.postings(item[second]) - second, assume_unique=True)]
            for k0 in range(0, len(begin), 1 << 16):
                at = begin[k0 : k0 + (1 << 16), None] + np.arange(w, last + size)
                ok = (at >= 0) & (at < len(self.terms))
                same = (self.terms[np.where(ok, at, 0)] == item[w : last + size]) & ok
                run = np.zeros((len(same), same.shape[1] + 1), np.int32)
                np.cumsum(same, axis=1, out=run[:, 1:])
                for i, k in zip(*np.nonzero(run[:, size:] - run[:, :-size] == size)):
                    first = int(at[i, k])
                    if (first, w + k) not in seen:
                        seen.add((first, w + k))
                        found.append((first, first + size))
            w = last + 1
        found.sort()
        merged: list[tuple[int, int]] = []
        for a, b in found:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def near(self, rare: list[int], slop: int) -> list[tuple[int, int]]:
        """The smallest spans of at most ``slop`` positions of one document around postings of the first term that hold all terms.

        Of spans of equal size around a posting the last counts.
        """
        if not rare or any(self.df(t) == 0 for t in rare):
            return []
        base, others = self.postings(rare[0]), [self.postings(t) for t in rare[1:]]
        doc = self.documents(base)
        first, past = self.starts[doc], self.starts[doc] + self.lengths[doc]
        for p in others:  # postings without the other term around them are dropped
            k = np.searchsorted(p, np.maximum(base - slop + 1, first))
            keep = (k < len(p)) & (p[np.minimum(k, len(p) - 1)] < np.minimum(base + slop, past))
            base, first, past = base[keep], first[keep], past[keep]
            if not base.size:
                return []
        begin, size = base.copy(), np.full(len(base), slop + 1)
        for back in range(slop):
            lo, hi, fits = base - back, base, base - back >= first
            for p in others:
                k = np.searchsorted(p, lo)
                fits &= k < len(p)
                hi = np.maximum(hi, p[np.minimum(k, len(p) - 1)])
            better = fits & (hi < past) & (hi - lo + 1 < size)
            begin[better], size[better] = lo[better], (hi - lo + 1)[better]
        keep = size <= slop
        return sorted(set(zip(begin[keep].tolist(), (begin + size)[keep].tolist())))

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _postings(row: pa.RecordBatch) -> np.ndarray:
    return np.cumsum(np.frombuffer(row["gaps"][0].as_buffer(), np.int32), dtype=np.int64)


def _block(ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """The index of some texts over all their terms, as it is stored."""
    vocabulary: dict[bytes, int] = {}
    codes, places, lengths, at = [], [], [], 0
    for text in texts:
        ws = words(text)
        codes.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int32, len(ws)))
        places.append(np.arange(at, at + len(ws), dtype=np.int32))
        lengths.append(len(ws))
        at += len(ws) + 1
    terms = np.concatenate(codes)
    order = np.concatenate(places)[np.argsort(terms, kind="stable")]
    row = [ids.to_pylist(), lengths, list(vocabulary), np.bincount(terms, minlength=len(vocabulary)), np.diff(order, prepend=np.int32(0)).astype(np.int32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK.types)], schema=_BLOCK)


def build(docs: DataFrame) -> DataFrame:
    """Store the index in the shared folder; one row per file, which has its name once it is whole."""
    folder = work_dir(docs.sparkSession)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, out, row = f"postings-{uuid.uuid4().hex}.arrow", None, {"blocks": 0, "documents": 0, "words": 0}
        for batch in chunks(batches):
            if out is None:
                sink = files.open_output_stream(f"{root}/{name}.part")
                out = pa.ipc.new_file(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            block = _block(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist())
            out.write_batch(block)
            row = {"blocks": row["blocks"] + 1, "documents": row["documents"] + batch.num_rows, "words": row["words"] + int(block["n_words"].values.to_numpy().sum())}
        if out is not None:
            out.close()
            sink.close()
            files.move(f"{root}/{name}.part", f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", **row}], pa.schema([("path", pa.string()), ("blocks", pa.int64()), ("documents", pa.int64()), ("words", pa.int64())]))

    return stored(doc_columns(docs).mapInArrow(save, _FILES), docs.sparkSession)


def _paths(index: DataFrame) -> DataFrame:
    """The files of an index, numbered and one to a task."""
    rows = [(k, r.path) for k, r in enumerate(index.orderBy("path").collect())]  # one row per task of ``build``
    return index.sparkSession.createDataFrame(rows, "file long, path string").repartition(max(1, min(len(rows), 4096)))


def _blocks(path: str, fields: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        held = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=fields))
        for k in range(held.num_record_batches):
            yield held.get_batch(k)


def _rarest(paths: DataFrame, vocabulary: dict[bytes, int], items: list[tuple[int | None, np.ndarray]], terms: int) -> list[list[int]]:
    """The rarest distinct terms of every item by their counts over all documents, the rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for path in batch.column(1).to_pylist():
                for row in _blocks(path, [2, 3]):
                    codes = np.fromiter((vocabulary.get(w, _OTHER) for w in row["terms"].values.to_pylist()), np.int64)
                    held[codes[codes >= 0]] += row["counts"].values.to_numpy()[codes >= 0]
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(held[known])], names=["term", "n"])

    total = np.zeros(len(vocabulary), np.int64)
    counted = paths.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total[counted["term"].to_numpy()] = counted["n"].to_numpy()
    rank = np.zeros(len(vocabulary), np.int64)
    rank[[vocabulary[w] for w in sorted(vocabulary, key=lambda w: (total[vocabulary[w]], w))]] = np.arange(len(vocabulary))
    return [sorted(set(coded.tolist()), key=lambda t: rank[t])[:terms] for _, coded in items]


def _items(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Test items in blocks of bounded size, streamed through the driver."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        ws = words(r.text)
        if ws:
            block.append((r.item_id, ws))
            held += len(r.text)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _coded(items: list[tuple[int | None, list[bytes]]]) -> tuple[dict[bytes, int], list[tuple[int | None, np.ndarray]]]:
    vocabulary: dict[bytes, int] = {}
    return vocabulary, [(i, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int32)) for i, ws in items]


def digest(ids: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _hits(block: Block, items: list[tuple[int | None, np.ndarray]], window: int) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """Per document of the block: hit intervals (in words of the document) and the items with windows there."""
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    names: dict[int, set[int]] = defaultdict(set)
    for item_id, coded in items:
        for a, b in block.phrase(coded, window):
            d = int(block.documents(np.array(a)))
            spans[d].append((a - int(block.starts[d]), b - int(block.starts[d])))
            if item_id is not None:
                names[d].add(item_id)
    return spans, names


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def answer(index: DataFrame, benchmark: DataFrame, window: int = 10, terms: int = 6, slop: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document of a stored index: its words, those inside any occurrence of a window of an item, the items found
    so, and the proximity matches (spans in words of the document)."""
    paths = _paths(index)

    def one(items: list[tuple[int | None, np.ndarray]], rare: list[list[int]], vocabulary: dict[bytes, int], whole: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for file, path in ((f, p) for batch in batches for f, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for number, row in enumerate(_blocks(path)):
                    block = Block.opened(row, vocabulary)
                    spans, names = _hits(block, items, window)
                    near: dict[int, list[dict[str, int | None]]] = defaultdict(list)
                    for (item_id, _), codes in zip(items, rare):
                        for a, b in block.near(codes, slop):
                            d = int(block.documents(np.array(a)))
                            near[d].append({"item_id": item_id, "begin": a - int(block.starts[d]), "end": b - int(block.starts[d])})
                    keys = range(len(block.lengths))
                    ids, n, close = row["doc_id"].values, pa.array(block.lengths), [near.get(k, []) for k in keys]
                    if whole:
                        yield _result(ids, n, [spans.get(k, []) for k in keys], [names.get(k, set()) for k in keys], close)
                    else:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file] * len(n), pa.int64()), pa.array([number] * len(n), pa.int64()), pa.array(keys, pa.int64()), ids, n, pa.array([[x for s in spans.get(k, []) for x in s] for k in keys], pa.list_(pa.int64())), pa.array([sorted(names.get(k, ())) for k in keys], pa.list_(pa.int64())), pa.array(close, pa.list_(_SPAN))],
                            names=["file", "block", "row", "doc_id", "n_words", "spans", "items", "near"],
                        )

        return run

    blocks = _items(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    vocabulary, items = _coded(first)
    rare = _rarest(paths, vocabulary, items, terms)
    if second is None:
        return paths.mapInArrow(one(items, rare, vocabulary, True), FULL)
    # Documents are told apart by their place in the index, as ids and texts may repeat.
    partial = "file long, block long, row long, doc_id long, n_words long, spans array<long>, items array<long>, near array<struct<item_id: long, begin: long, end: long>>"
    parts = [paths.mapInArrow(one(items, rare, vocabulary, False), partial)]
    rest = second
    while rest is not None:
        vocabulary, items = _coded(rest)
        rare = _rarest(paths, vocabulary, items, terms)
        parts.append(paths.mapInArrow(one(items, rare, vocabulary, False), partial).where("size(spans) > 0 or size(near) > 0"))
        rest = next(blocks, None)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(x[k], x[k + 1]) for x in xs for k in range(0, len(x), 2)] for xs in batch.column(2).to_pylist()]
            yield _result(batch.column(0), batch.column(1), spans, [{i for x in xs for i in x} for xs in batch.column(3).to_pylist()], [[m for x in xs for m in x] for xs in batch.column(4).to_pylist()])

    grouped = union.groupBy("file", "block", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"), F.collect_list("near").alias("near")).drop("file", "block", "row")
    return grouped.mapInArrow(merge, FULL)


def _result(ids: pa.Array, n: pa.Array, spans: list[list[tuple[int, int]]], names: list[set[int]], near: list[list[dict[str, int | None]]]) -> pa.RecordBatch:
    hit = [covered(x) for x in spans]
    near = [sorted(x, key=lambda m: (m["begin"], m["end"], m["item_id"] is not None, m["item_id"] or 0)) for x in near]
    return pa.RecordBatch.from_arrays(
        [ids, n, pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([digest(x) for x in names], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array([len(x) for x in near], pa.int64()), pa.array(near, pa.list_(_SPAN))],
        names=[*(c.split()[0] for c in RESULT.split(", ")), "n_near", "near"],
    )


def match(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """Store the index of the documents and answer all items from it: exact windows and proximity matches."""
    return answer(build(docs), benchmark, **options)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The exact matches alone."""
    return match(docs, benchmark, window=window, block_bytes=block_bytes).select(*(c.split()[0] for c in RESULT.split(", ")))


def _hit_column(vocabulary: dict[bytes, int], items: list[tuple[int | None, np.ndarray]], window: int) -> Column:
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for batch in chunks([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])]):
            spans, _ = _hits(Block(batch.column(0).cast(pa.binary()).to_pylist(), vocabulary), items, window)
            out += [k in spans for k in range(batch.num_rows)]
        return pa.array(out, pa.bool_())

    return hit(F.col("text").cast("string"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item; one pass, without a shuffle, per block of items."""
    for block_items in _items(benchmark, block_bytes):
        docs = docs.where(~_hit_column(*_coded(block_items), window))
    return docs


def near_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 6, slop: int = 12, block_bytes: int = 8 << 20) -> DataFrame:
    """Proximity matches: (doc_id, item_id, begin, end) in words, where an item's rarest terms lie close together."""
    return match(docs, benchmark, terms=terms, slop=slop, block_bytes=block_bytes).select("doc_id", F.inline("near"))


def postings(docs: DataFrame) -> DataFrame:
    """The stored index as a table: one row per term and document, with the term's positions in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(1).to_pylist()):
            for row in _blocks(path):
                block, order = Block.opened(row, {}), _postings(row)
                term, doc = np.repeat(np.arange(len(row["counts"].values)), row["counts"].values.to_numpy()), block.documents(order)
                head = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(doc, prepend=-1))
                bounds = pa.array([*head.tolist(), len(order)], pa.int32())
                at = pa.ListArray.from_arrays(bounds, pa.array(order - block.starts[doc], pa.int32()))
                yield pa.RecordBatch.from_arrays([row["terms"].values.take(pa.array(term[head])).cast(pa.string()), row["doc_id"].values.take(pa.array(doc[head])), at], names=["term", "doc_id", "positions"])

    return _paths(build(docs)).mapInArrow(run, "term string, doc_id long, positions array<int>")
