"""The n-gram index: postings, document frequencies, the frequency band."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.config import ReuseConfig
from refrain.functions.types import give_back

_LETTERS = regex.compile(r"\p{L}+")

#: Bytes of input for one partition of postings (about 1.5 million of them).
PART = 8 << 20


def grams(text: str, n: int, floating: bool = False) -> list[tuple[str, int]]:
    """Runs of n letters (lower-cased, other characters skipped) that occur once, with the offset of the first letter.

    Without ``floating`` a run starts right after a non-letter (or the start of the text). Offsets are code points.
    """
    runs = [(m.start(), m[0]) for m in _LETTERS.finditer(text)]
    if not runs:
        return []
    letters = "".join(r for _, r in runs)
    if len(letters) < n:
        return []
    low = letters.lower()
    if len(low) != len(letters):  # a letter became two
        each = [c.lower() for c in letters]
        gram = lambda k: "".join(each[k : k + n])
    else:
        gram = lambda k: low[k : k + n]
    found: list[tuple[str, int]] = []
    at, last = 0, len(letters) - n
    for start, run in runs:
        if at > last:
            break
        for k in range(at, min(at + len(run) - 1, last) + 1) if floating else (at,):
            found.append((gram(k), start + k - at))
        at += len(run)
    often = Counter(g for g, _ in found)
    return [(g, p) for g, p in found if often[g] == 1]


#: Characters of texts whose grams are made together.
TOGETHER = 1 << 18


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is a letter and its lower case (where that is one character)."""
    points = [chr(c) for c in range(0x110000)]
    letter = np.zeros(len(points), bool)
    low = np.arange(len(points), dtype=np.uint32)
    for m in _LETTERS.finditer("".join(points)):
        letter[m.start() : m.end()] = True
        for c in range(m.start(), m.end()):
            if len(x := points[c].lower()) == 1:
                low[c] = ord(x)
    return letter, low


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    raised = lambda x: np.append(np.uint64(1), np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64))
    return raised(base), raised(pow(base, -1, 1 << 64))


def grams_of(texts: list[str], n: int, floating: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """What ``grams`` gives for every text, in any order: number of the text, gram, offset.

    Windows of all texts are told apart by a hash modulo 2**64; those with equal hashes are compared by letters. Texts
    with a letter that becomes two, or whose lower case depends on its neighbours, go through ``grams``.
    """
    plain, one_by_one = _apart(texts, n, floating)
    which, feats, posts = _together(plain, n, floating)
    if one_by_one:
        ks, gs, ps = zip(*one_by_one)
        which, posts = np.append(which, np.array(ks)), np.append(posts, np.array(ps, np.int32))
        feats = pa.concat_arrays([feats, pa.array(gs, pa.string())])
    return which, feats, posts


def hashes_of(texts: list[str], n: int, floating: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``grams_of`` gives, with two hashes (64 and 32 bits) in place of each gram: number of the text, hashes, offset.

    Grams that occur more than once in a text are there, too, as whoever sorts the hashes can leave them out. Both hashes
    are sums (modulo 2**64; the second is the upper half of its sum) of mixed triples of letters times fixed random numbers.
    """
    plain, one_by_one = _apart(texts, n, floating)
    low, start, doc, offset = _windows(plain, n, floating)
    one, two = _hashed(low, start, n)
    for size in sorted({len(g) for _, g, _ in one_by_one}):
        ks, gs, ps = zip(*(x for x in one_by_one if len(x[1]) == size))
        more = _hashed(np.frombuffer("".join(gs).encode("utf-32-le"), np.uint32), np.arange(len(gs)) * size, size)
        one, two = np.append(one, more[0]), np.append(two, more[1])
        doc, offset = np.append(doc, np.array(ks)), np.append(offset, np.array(ps, np.int32))
    return doc, one, (two >> np.uint64(32)).astype(np.uint32), offset


def _hashed(points: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``n`` code points from each start on."""
    width = min(n, 3)
    z = points.astype(np.uint64) + np.uint64(1)
    for j in range(1, width):
        z[:-j] |= (points[j:] + np.uint64(1)) << np.uint64(21 * j)
    # Every step is one to one, so that triples stay apart.
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x94D049BB133111EB)
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    places = [*range(0, n - width + 1, width), *([n - width] if n % width else [])]
    for j, (a, b) in zip(places, _multipliers(len(places))):
        x = z[start + j]
        one += a * x
        two += b * x
    return one, two


@cache
def _multipliers(size: int) -> np.ndarray:
    """``size`` rows of two odd random numbers (SplitMix64), the same for every size as far as they go."""
    z = np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) | np.uint64(1)).reshape(-1, 2)


def _apart(texts: list[str], n: int, floating: bool) -> tuple[list[str], list[tuple[int, str, int]]]:
    """Texts whose windows can be made together (others are empty), and the grams of the others with their numbers."""
    odd = {k for k, t in enumerate(texts) if "İ" in t or "Σ" in t}
    return [("" if k in odd else t) for k, t in enumerate(texts)], [(k, g, p) for k in sorted(odd) for g, p in grams(texts[k], n, floating)]


def _windows(texts: list[str], n: int, floating: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, where grams start among them; of each gram the text and the offset in it."""
    letter, lower = _characters()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    at = np.flatnonzero(letter[points])
    low = lower[points[at]]
    past = np.searchsorted(at, ends)
    if floating:
        start = np.arange(len(at))
    else:
        first = np.append(True, at[1:] - at[:-1] != 1)[: len(at)]
        first[np.append(0, past[:-1])[np.diff(past, prepend=0) > 0]] = True
        start = np.flatnonzero(first)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, past), prepend=0))
    fits = start + n <= past[doc]
    start, doc = start[fits], doc[fits]
    return low, start, doc, (at[start] - np.append(0, ends)[doc]).astype(np.int32)


def _together(texts: list[str], n: int, floating: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    low, start, doc, offset = _windows(texts, n, floating)
    up, down = _powers(max(TOGETHER, 1 << int(len(low)).bit_length()))
    summed = np.append(np.uint64(0), np.cumsum((low + np.uint64(1)) * down[: len(low)], dtype=np.uint64))
    key = (summed[start + n] - summed[start]) * up[start] * np.uint64(0xD6E8FEB86659FD93) + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if same.any():
        # Members of a group of equal keys are all one gram, unless keys collide.
        a, b = order[:-1][same], order[1:][same]
        equal = doc[a] == doc[b]
        for j in range(n):
            equal &= low[start[a] + j] == low[start[b] + j]
        if equal.all():
            often = np.zeros(len(start), bool)
            often[a] = often[b] = True
        else:
            windows = [(d, low[s : s + n].tobytes()) for d, s in zip(doc, start)]
            counts = Counter(windows)
            often = np.array([counts[w] > 1 for w in windows])
        start, doc, offset = start[~often], doc[~often], offset[~often]
    width = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800) + (low >= 0x10000)
    byte = np.append(0, np.cumsum(width))
    data = np.frombuffer(low.tobytes().decode("utf-32-le").encode(), np.uint8)
    lengths = byte[start + n] - byte[start]
    short = lengths == n
    start, lengths, doc, offset = (np.concatenate([x[short], x[~short]]) for x in (start, lengths, doc, offset))
    count = int(short.sum())
    parts = [np.lib.stride_tricks.sliding_window_view(data, n)[byte[start[:count]]].ravel()] if count else []
    if count < len(start):
        wide = lengths[count:]
        past = np.cumsum(wide)
        parts.append(data[np.repeat(byte[start[count:]] - (past - wide), wide) + np.arange(past[-1])])
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    feats = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts) if parts else b""))
    return doc, feats, offset


def postings(docs: DataFrame, cfg: ReuseConfig) -> DataFrame:
    """(uid, *fields, feat, post) for documents (uid, *fields, text).

    A text's grams are counted where the text is, so gram counts within a document need no shuffle.
    """
    keep = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "feat string", "post int"])
    n, floating = cfg.n, cfg.floating_ngrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, held, size = batch.column(batch.schema.get_field_index("text")), [], [], 0
            for k in range(batch.num_rows):
                if texts[k].is_valid:
                    numbers.append(k)
                    held.append(texts[k].as_py())
                    size += len(held[-1])
                if held and (size > TOGETHER or k == batch.num_rows - 1):
                    which, feats, posts = grams_of(held, n, floating)
                    rows = batch.select(keep).take(pa.array(np.array(numbers)[which], pa.int64()))
                    made = pa.RecordBatch.from_arrays([*rows.columns, feats, pa.array(posts, pa.int32())], names=[*keep, "feat", "post"])
                    # No more than about as many rows at a time as Spark's own batches.
                    for first in range(0, made.num_rows, 50_000):
                        yield made.slice(first, 50_000)
                    numbers, held, size = [], [], 0
            give_back()

    out = docs.select(*keep, "text").mapInArrow(run, schema)
    return out.withColumn("feat", F.xxhash64("feat")) if cfg.hash_features else out


def parts(df: DataFrame) -> int:
    """Partitions for what is made from the tables under ``df``: more as these grow, so that one is sorted or counted in memory."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # rows without a table have no size
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, min(known // PART, 10_000))


def doc_freq(posts: DataFrame) -> DataFrame:
    """In how many documents each gram occurs.

    Most grams occur in one document only, so counting before the shuffle would hold them all and spare next to none.
    """
    return posts.select("feat").repartition(parts(posts), "feat").groupBy("feat").agg(F.count(F.lit(1)).cast("int").alias("df"))


def df_band(freq: DataFrame, cfg: ReuseConfig) -> DataFrame:
    return freq.where(F.col("df").between(cfg.min_df, cfg.max_df))


def keys(df: DataFrame) -> list[str]:
    """The columns that name a gram: ``feat``, and ``feat2`` where a second hash stands beside a first."""
    return [c for c in ("feat", "feat2") if c in df.columns]


def index(posts: DataFrame, cfg: ReuseConfig) -> DataFrame:
    """Postings of grams within the band, with df and the target's shard.

    The postings are shuffled once, by gram, and counted where they meet: the count is a window over sorted rows, so
    a gram that most documents hold is passed over a part at a time (its rows may go to disk) and never collected.
    """
    df = F.count(F.lit(1)).over(Window.partitionBy(*keys(posts))).cast("int")
    return posts.repartition(parts(posts), *keys(posts)).withColumn("df", df).where(F.col("df").between(cfg.min_df, cfg.max_df)).withColumn("shard", F.pmod(F.col("uid"), F.lit(cfg.shards)).cast("int"))
