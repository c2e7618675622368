"""Operator 1: a toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words. It is fitted to labelled rows whose crc32 of the id modulo 5 is not
0, at most ``per_class`` of each label (chosen by hash of the id; the only sample, weighted back to the label
counts), by proximal gradient steps with an L1 term
that chooses features, and again without it on those chosen. For every labelled text that names an identity group, copies
are made in which the term is swapped for the others of its group, with all features that the term alone gives (its
beginnings too), and the squared change of the score's log-odds is penalised; so mentions of the groups of a line
move the score alike.

Features are the words of the text and their beginnings of 4 to 8 bytes, which catch inflected forms (A-Z
lower-cased, runs of letters and digits), each counted once per text; labels, lang, source and
doc_id are never inputs of a score.

Cases: null and empty texts score as texts without words; labels that are null are left out, of repeated labels
the larger counts; without usable labels of both kinds every score is the rate of label 1, or 0; repeated rows
score alike; a null id counts as held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import chunks, doc_columns
from refrain.llm.decontaminate import words

#: Terms for people, by kind and language: swaps stay within a line.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american", "mexican"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "ausländer", "deutsche", "türken"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "français", "arabes"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "españoles", "gitanos"),
)


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float
    _memo: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, compare=False, repr=False)

    def score(self, text: bytes | str | None) -> float:
        z, w, memo = self.bias, self.weights, self._memo
        present: set[bytes] = set()
        for x in set(words(text)):
            known = memo.get(x)
            if known is None:
                known = tuple(t for t in traits(x) if t in w)
                if len(x) <= 40:
                    memo[x] = known
            if known:
                present.update(known)
        if len(memo) > 150_000:
            memo.clear()
        for x in sorted(present):  # in one order, so that equal texts score alike to the last bit
            z += w[x]
        return float(1 / (1 + np.exp(-z)))


def traits(word: bytes) -> list[bytes]:
    """A word and its beginnings."""
    return [word, *(b"^" + word[:n] for n in range(4, 9) if len(word) > n)]


def _swaps(present: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
    for line in IDENTITY:
        terms = [t.encode() for t in line]
        for a in terms:
            if a in present:
                yield from ((a, b) for b in terms if b != a)


def fit(texts: list[set[bytes]], labels: np.ndarray, weight: np.ndarray, vocabulary: int = 1024, min_docs: int = 4, l1: float = 5e-4, l2: float = 3e-4, counterfactual: float = 1.0, steps: int = 200) -> Model:
    """Fit to sets of words; ``weight`` is the number of rows that each example stands for."""
    rate = float(np.average(labels, weights=weight)) if len(labels) else 0.0
    if not 0 < rate < 1:
        return Model({}, 30.0 if rate == 1 else -30.0)
    seen, memo = [Counter(), Counter()], {w: traits(w) for w in set().union(*texts)}
    for t, y in zip(texts, labels):
        seen[int(y)].update(set(chain.from_iterable(map(memo.__getitem__, t))))
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    odds = {w: (np.log((seen[1][w] + 0.5) / (n[1] + 1)) - np.log((seen[0][w] + 0.5) / (n[0] + 1))) * np.sqrt(seen[0][w] / n[0] + seen[1][w] / n[1]) for w in seen[0].keys() | seen[1].keys() if seen[0][w] + seen[1][w] >= min_docs}
    chosen = sorted(odds, key=lambda w: (-abs(odds[w]), w))[:vocabulary]
    named = {t.encode() for line in IDENTITY for t in line}
    column = {w: k for k, w in enumerate(dict.fromkeys([*chosen, *sorted(named)]))}
    x = np.zeros((len(texts), len(column)), np.float32)
    y, sw = labels.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    moves: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()  # weight of the swaps by the columns that they switch off and on
    starts = {w[:4] for w in named}
    for k, t in enumerate(texts):
        x[k, [column[f] for f in chain.from_iterable(map(memo.__getitem__, t)) if f in column]] = 1
        swaps = list(_swaps(t & named))
        alike = [w for w in t if w[:4] in starts] if swaps else []
        for a, b in swaps:
            stay = set(chain.from_iterable(memo[w] for w in alike if w != a))  # features that other words give
            off, on = set(traits(a)), set(traits(b))
            moves[tuple(sorted(column[f] for f in off - on - stay if f in column)), tuple(sorted(column[f] for f in on - off - stay if f in column))] += sw[k] / len(swaps)
    pull = np.zeros((len(column), len(column)))  # the penalty is v @ pull @ v
    for (off, on), share in moves.items():
        at, sign = [*off, *on], np.array([1.0] * len(off) + [-1.0] * len(on))
        pull[np.ix_(at, at)] += counterfactual * float(share) * np.outer(sign, sign)
    pull = pull.astype(np.float32)
    start = float(np.log(rate / (1 - rate)))

    def descend(x: np.ndarray, pull: np.ndarray, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient steps; ``pull`` penalises the squared change of the log-odds under swaps."""
        w, bias = np.zeros(x.shape[1], np.float32), start
        v, vb, t = w.copy(), bias, 1.0
        felt = np.flatnonzero(pull.any(0))
        steepest = float(np.linalg.eigvalsh(pull[np.ix_(felt, felt)].astype(float))[-1]) if len(felt) else 0.0
        size = 1.0 / (0.25 * float((x * x).sum(1) @ sw + 1) + 2 * steepest + l2)
        for _ in range(steps):
            g = (1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30))) - y) * sw
            grad = x.T @ g + l2 * v + 2 * (pull @ v)
            new = v - size * grad
            new = np.sign(new) * np.maximum(np.abs(new) - size * l1, 0)
            nb = vb - size * float(g.sum())
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
            w, bias, t = new, nb, nt
        return w, bias

    first, bias = descend(x, pull, l1, 0.0, steps)
    # The L1 term chooses the features and shrinks them; they are fitted again without it. Identity terms take part in swaps.
    terms = np.isin(np.arange(len(first)), [column[w] for w in named])
    used = np.flatnonzero((first != 0) | (terms & pull.any(0)))
    again, bias = descend(np.ascontiguousarray(x[:, used]), np.ascontiguousarray(pull[np.ix_(used, used)]), 0.0, l2, 2 * steps)
    w = np.zeros(len(first), np.float32)
    w[used] = again
    return Model({word: float(w[k]) for word, k in column.items() if w[k] != 0}, float(bias))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    """Fit on at most ``per_class`` labelled rows of each label that are not held out."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    totals = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, int] = {}
    for y in (0, 1):
        for r in usable.where(F.col("toxic") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            chosen[r.doc_id] = y
    if not chosen:
        return fit([], np.zeros(0), np.zeros(0))
    ids = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")  # 2 * per_class rows at most

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([b" ".join(sorted(set(words(t)))) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["toxic", "words"])

    rows = doc_columns(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").mapInArrow(distinct, "toxic int, words binary").distinct().toArrow()
    y = rows["toxic"].to_numpy().astype(int)
    held = rows["words"].to_pylist()
    order = sorted(range(len(y)), key=lambda k: (y[k], held[k]))  # tasks end in any order
    sets = [set(held[k].split()) for k in order]
    y = y[order]
    weight = np.array([totals[int(v)] / max(1, (y == v).sum()) for v in y]) if len(y) else np.zeros(0)
    return fit(sets, y, weight)


def score_column(model: Model, text: str = "text") -> Column:
    """The score as a column over whole texts, batch by batch."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
