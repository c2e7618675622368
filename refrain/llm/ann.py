"""Operator 7: approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are hashed into shards of at most about ``shard_rows`` distinct vectors. In a shard, vectors fall into bands
of almost equal length (``ratio``), as a graph over vectors of very unequal lengths can't be walked by inner product.
Each band has a graph over its directions: nodes are inserted in batches, a greedy search from the medoid proposes
neighbours, relaxed distance pruning (factor ``alpha``) keeps a diverse set of at most ``degree`` out-edges, and
reverse edges are added and pruned alike. Queries run a beam search in the bands of every shard, longest vectors
first, until no vector of a band can come among the best by its length; what is found is ranked by inner product in
double precision on the original vectors.

The beam starts at ``beam``. When a band's graph is built, up to 64 of the shard's vectors are searched and compared
with all of the band; the beam is doubled, up to four times its width, until 0.96 of their neighbours are found, and a
band where that doesn't suffice, or that is hardly larger than the beam, is compared as a whole.

Equal vectors share one node that lists its ids, so a large group of copies costs one node; of a node no more ids
than can be returned are ever needed, the least ones. Shards and query blocks are files in the shared folder; a
task serves one query block on one shard, so neither queries nor vectors are broadcast.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids;
vectors of another length than the first ones take no part; repeated rows of one id and vector count once; with fewer
candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import stored, work_dir

_FILES = "kind string, name int, path string, items long"
_FOUND = "query_id long, vec_id long, score double"


class Graph:
    """A robust-pruned directed graph over the rows of ``points`` (float32, squared distance)."""

    def __init__(self, points: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, seed: int = 3, edges: np.ndarray | None = None, start: int | None = None):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.degree = degree
        n = len(points)
        if edges is not None:
            self.edges, self.start = edges, int(start)
            return
        self.start = int(np.argmin(self._distance(self.points.mean(0, dtype=np.float64).astype(np.float32)))) if n else 0
        self.edges = np.full((n, degree), -1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        done, size = 0, 16
        while done < n:
            part = order[done : done + size]
            self._insert(part, width, alpha)
            done += len(part)
            size = min(512, max(16, done // 8))

    def _distance(self, q: np.ndarray) -> np.ndarray:
        return self.norms - 2 * (self.points @ q)

    def _insert(self, nodes: np.ndarray, width: int, alpha: float) -> None:
        near, _, seen = self.search(self.points[nodes], width, True)
        cand = np.concatenate([near, seen, self.edges[nodes]], axis=1)
        if self.start not in nodes:
            cand = np.concatenate([cand, np.full((len(nodes), 1), self.start, cand.dtype)], axis=1)
        # nodes of one batch may be neighbours too: the nearest few of the batch are proposed
        if len(nodes) > 1:
            p = self.points[nodes]
            d = self.norms[nodes][None, :] - 2 * (p @ p.T)
            np.fill_diagonal(d, np.inf)
            k = min(8, len(nodes) - 1)
            cand = np.concatenate([cand, nodes[np.argpartition(d, k - 1, axis=1)[:, :k]]], axis=1)
        self.edges[nodes] = self._prune(nodes, cand, alpha)
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        back = np.full((len(heads), most), -1, np.int32)
        back[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        have = (self.edges[heads] >= 0).sum(1)
        merged = np.concatenate([self.edges[heads], back], axis=1)
        fits = have + count <= self.degree
        if fits.any():
            rows = merged[fits]
            rows = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), 1)[:, : self.degree]
            self.edges[heads[fits]] = rows
        full = np.flatnonzero(~fits)
        for k in range(0, len(full), 512):
            f = full[k : k + 512]
            self.edges[heads[f]] = self._prune(heads[f], merged[f], alpha)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """Out-edges for nodes from candidate rows: nearest first, dropping those much nearer to a kept one."""
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        vec = self.points[cand]
        own = self.points[nodes]
        d = np.where(cand >= 0, self.norms[cand] - 2 * np.einsum("bcd,bd->bc", vec, own, optimize=True) + self.norms[nodes][:, None], np.inf)
        keep = min(d.shape[1], 3 * self.degree)
        order = np.argsort(d, axis=1)[:, :keep]
        cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
        vec = np.take_along_axis(vec, order[:, :, None], 1)
        between = vec @ vec.transpose(0, 2, 1)
        n = self.norms[cand]
        between = n[:, :, None] + n[:, None, :] - 2 * between
        out = np.full((len(nodes), self.degree), -1, np.int32)
        alive, count, rows = np.isfinite(d), np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for c in range(keep):
            take = alive[:, c] & (count < self.degree)
            if not take.any():
                continue
            r = rows[take]
            out[r, count[r]] = cand[r, c]
            count[r] += 1
            alive[r] &= alpha * alpha * between[r, c] > d[r]
        return out

    def search(self, queries: np.ndarray, width: int, trail: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search of many queries in step: (nodes, distances without the query's norm, expanded nodes), -1 padded."""
        b, n = len(queries), len(self.points)
        width = min(width, max(n, 1))
        beam = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        open_ = np.zeros((b, width), bool)
        seen = np.zeros((b, n), bool)
        beam[:, 0], open_[:, 0] = self.start, True
        dist[:, 0] = self.norms[self.start] - 2 * (queries @ self.points[self.start])
        seen[:, self.start] = True
        active, path = np.arange(b), []
        while len(active):
            cost = np.where(open_[active], dist[active], np.inf)
            best = cost.argmin(1)
            go = np.isfinite(cost[np.arange(len(active)), best])
            active, best = active[go], best[go]
            if not len(active):
                break
            at = beam[active, best]
            open_[active, best] = False
            if trail:
                step = np.full(b, -1, np.int32)
                step[active] = at
                path.append(step)
            nxt = self.edges[at]
            new = (nxt >= 0) & ~seen[active[:, None], nxt]
            r, c = np.nonzero(new)
            seen[active[r], nxt[r, c]] = True
            d = np.full(nxt.shape, np.inf, np.float32)
            flat = nxt[r, c]
            d[r, c] = self.norms[flat] - 2 * np.einsum("ij,ij->i", self.points[flat], queries[active[r]])
            nodes = np.concatenate([beam[active], nxt], axis=1)
            dists = np.concatenate([dist[active], d], axis=1)
            opens = np.concatenate([open_[active], new], axis=1)
            top = np.argpartition(dists, width - 1, axis=1)[:, :width] if dists.shape[1] > width else np.argsort(dists, axis=1)
            beam[active] = np.take_along_axis(nodes, top, 1)
            dist[active] = np.take_along_axis(dists, top, 1)
            open_[active] = np.take_along_axis(opens, top, 1)
            beam[active] = np.where(np.isfinite(dist[active]), beam[active], -1)
        order = np.argsort(dist, axis=1)
        steps = np.stack(path, axis=1) if path else np.zeros((b, 0), np.int32)
        return np.take_along_axis(beam, order, 1), np.take_along_axis(dist, order, 1), steps


class Bands:
    """The vectors of a shard by length, longest first, with a graph per band (or none, where a band is compared as a whole)."""

    def __init__(self, points: np.ndarray, k: int, ratio: float, degree: int, width: int, beam: int):
        """``points`` are sorted by falling length."""
        length = np.sqrt((points**2).sum(1))
        bounds = [0]
        while bounds[-1] < len(points):
            bounds.append(int(np.searchsorted(-length, -length[bounds[-1]] / ratio, "right")))
        self.points, self.top, self.bounds = points, length[bounds[:-1]], bounds
        asked = points[:: max(1, len(points) // 64)]
        self.graphs, self.beams = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            graph, best = None, b - a
            if best > 2 * beam:
                graph = Graph(_directions(points[a:b]), degree, width)
                fit = [w for w in (beam, 2 * beam, 4 * beam) if w < best]
                best = next((w for w in fit if _recall(graph, points[a:b], asked, k, w) >= 0.96), best)
            self.graphs.append(graph if best < b - a else None)
            self.beams.append(best)

    def arrays(self) -> dict[str, np.ndarray]:
        """What a file keeps."""
        edges = [g.edges for g in self.graphs if g]
        return {"points": self.points, "top": self.top, "bounds": np.array(self.bounds), "beams": np.array(self.beams), "starts": np.array([g.start if g else -1 for g in self.graphs]), "edges": np.concatenate(edges) if edges else np.zeros((0, 1), np.int32)}

    @classmethod
    def opened(cls, held: dict[str, np.ndarray]) -> Bands:
        out, at = cls.__new__(cls), 0
        out.points, out.top, out.bounds, out.beams, out.graphs = held["points"], held["top"], held["bounds"].tolist(), held["beams"].tolist(), []
        for a, b, start in zip(out.bounds[:-1], out.bounds[1:], held["starts"].tolist()):
            out.graphs.append(None if start < 0 else Graph(_directions(out.points[a:b]), held["edges"].shape[1], edges=held["edges"][at : at + b - a], start=start))
            at += (b - a) * (start >= 0)
        return out

    def search(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the nodes found that have one of its k greatest inner products, or tie with them but for rounding."""
        size = np.sqrt((queries**2).sum(1))
        flat, margin = _directions(queries), 1e-9 * size * (self.top[0] if len(self.top) else 0)
        best = np.full((len(queries), k), -np.inf)
        nodes: list[list[np.ndarray]] = [[] for _ in queries]
        scores: list[list[np.ndarray]] = [[] for _ in queries]
        for a, b, top, graph, beam in zip(self.bounds[:-1], self.bounds[1:], self.top, self.graphs, self.beams):
            act = np.flatnonzero(size * top >= best[:, 0] - margin)
            if not len(act):
                break
            if graph is None:
                near, score = np.broadcast_to(np.arange(b - a), (len(act), b - a)), queries[act] @ self.points[a:b].T
            else:
                near, _, _ = graph.search(flat[act], beam)
                score = np.where(near >= 0, np.einsum("qnd,qd->qn", self.points[a + near], queries[act]), -np.inf)
            best[act] = np.partition(np.concatenate([best[act], score], axis=1), score.shape[1], axis=1)[:, -k:]
            best[act] = np.sort(best[act], axis=1)
            for i, q in enumerate(act.tolist()):
                good = np.flatnonzero((score[i] >= best[q, 0] - margin[q]) & (score[i] > -np.inf))
                nodes[q].append(a + near[i, good])
                scores[q].append(score[i, good])
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *n])[np.concatenate([none, *s]) >= best[q, 0] - margin[q]] for q, (n, s) in enumerate(zip(nodes, scores))]


def _directions(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v**2).sum(1, keepdims=True))
    return (v / np.where(length > 0, length, 1)).astype(np.float32)


def _recall(graph: Graph, points: np.ndarray, queries: np.ndarray, k: int, beam: int) -> float:
    """The share of the k greatest inner products that a beam finds."""
    all_ = queries @ points.T
    edge = np.partition(all_, -k, axis=1)[:, -k]
    near, _, _ = graph.search(_directions(queries), beam)
    found = np.where(near >= 0, np.take_along_axis(all_, np.maximum(near, 0), 1), -np.inf)
    return float(np.minimum((found >= edge[:, None]).sum(1), k).mean() / k)


def _save(folder: str, name: str, **arrays: np.ndarray) -> str:
    """One file of arrays, moved into place when whole."""
    import uuid

    files, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}-{uuid.uuid4().hex}.npz"
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with files.open_output_stream(path + ".part") as out:
        out.write(buffer.getvalue())
    files.move(path + ".part", path)
    return path


def _load(folder: str, path: str) -> dict[str, np.ndarray]:
    files, _ = fs.FileSystem.from_uri(folder)
    with files.open_input_file(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


def valid(embeddings: DataFrame) -> DataFrame:
    """Distinct (vec_id, vector) rows that can take part."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return rows.where(good).dropDuplicates(["vec_id", "v"])


def search(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = 12288, degree: int = 40, width: int = 72, beam: int = 128, query_block: int = 1024, ratio: float = 1.15) -> DataFrame:
    """The k nearest found of each vector whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = stored(valid(embeddings), spark)
    count, dim = rows.agg(F.count(F.lit(1)), F.mode(F.size("v"), deterministic=True)).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == dim)
    folder = work_dir(spark)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    shards = -(-count // shard_rows)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // query_block))

    def matrix(column: pd.Series) -> np.ndarray:
        return np.array(column.tolist(), np.float64)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        v = matrix(pdf["v"])
        order = np.lexsort((pdf["vec_id"].to_numpy(), *v.T[::-1]))
        v, ids = v[order], pdf["vec_id"].to_numpy()[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]).any(1)])
        first = np.flatnonzero(new)
        fall = np.argsort(-(v[first] ** 2).sum(1), kind="stable")
        past = np.append(first[1:], len(v))
        bands = Bands(v[first[fall]], k + 1, ratio, degree, width, beam)
        shard = int(pdf["shard"].iloc[0])
        path = _save(folder, f"shard-{shard}", first=first[fall], past=past[fall], ids=ids, **bands.arrays())
        return pd.DataFrame({"kind": ["shard"], "name": [shard], "path": [path], "items": [len(v)]})

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        block = int(pdf["block"].iloc[0])
        path = _save(folder, f"queries-{block}", v=matrix(pdf["v"]), ids=pdf["vec_id"].to_numpy())
        return pd.DataFrame({"kind": ["block"], "name": [block], "path": [path], "items": [len(pdf)]})

    # Equal vectors meet in one shard, as the hash is of the vector.
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    made = stored(sharded.groupBy("shard").applyInPandas(build, _FILES).unionByName(blocked.groupBy("block").applyInPandas(keep, _FILES)), spark)
    # The grid of (shard, block) pairs of file names: every block names every shard by number, then meets its file.
    left = made.where("kind = 'block'").select(F.col("path").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("name"))
    grid = left.join(made.where("kind = 'shard'").select("name", F.col("path").alias("shard")), "name").select("shard", "block")
    cells = shards * blocks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bands, data = None, None, {}
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != held:
                    held, data = shard, _load(folder, shard)
                    bands = Bands.opened(data)
                q = _load(folder, block)
                for a in range(0, len(q["ids"]), 256):
                    v, ids = q["v"][a : a + 256], q["ids"][a : a + 256]
                    out: tuple[list, list, list] = ([], [], [])
                    for x, i, found in zip(v, ids, bands.search(v, k + 1)):  # one may be the query itself
                        score = (bands.points[found] * x).sum(1)
                        have = 0
                        for f in np.lexsort((data["ids"][data["first"][found]], -score)):
                            lo, hi = data["first"][found[f]], data["past"][found[f]]
                            some = data["ids"][lo : min(hi, lo + k + 1)]
                            some = some[some != i][:k]
                            if have >= k and score[f] < edge:  # noqa: F821
                                break
                            out[0].extend([i] * len(some))
                            out[1].extend(some.tolist())
                            out[2].extend([float(score[f])] * len(some))
                            have += len(some)
                            edge = score[f]
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = grid.repartition(max(1, min(cells, 20_000)), "shard", "block").sortWithinPartitions("shard").mapInArrow(ask, _FOUND)
    # An id with several vectors counts by its best one.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
