"""Operator 2: url verdicts by rules, else by gradient-boosted trees on lexical features.

A rule is a host and a path prefix; it fits its host and all subdomains where the url's path starts with its
path, and the longest fitting rule decides. Other urls are judged by trees over lexical features: lengths, depth,
digit ratio, entropy, parameter counts, and statistics of the host's last label. The trees are fitted here to
labelled urls: by default a bounded sample (``most`` rows, by hash of the url) of the urls that a rule decides,
with the rule's verdict as label. The count of a suffix is taken over all pages; the smoothed shares of blocked urls by
suffix and by first path segment come from the sample, for each of its rows from the other four of five folds.

Cases: null urls and urls without ``://`` have an empty host and path, fit no rule and are judged by the trees on
empty features; without labelled urls of both kinds the verdict is the one kind there is, or allow; repeated
rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host/path); the part up to the first slash is the host, the rest, with the slash, the path prefix.
RULES: tuple[tuple[str, str], ...] = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FEATURES = ("length", "host_length", "path_length", "depth", "host_depth", "digits", "path_digits", "entropy", "parameters", "ampersands", "hyphens", "vowels", "secure", "fragment", "suffix_count", "suffix_blocked", "first_segment", "extension")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer rules are tested first
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def features(urls: list[str | None], hosts: list[str], paths: list[str], counts: list[int], blocked: list[float], segments: list[float]) -> np.ndarray:
    """One row of ``FEATURES`` per url; counts, blocked and segments are the statistics of its suffix and first segment."""
    rows = []
    for url, host, path, count, block, segment in zip(urls, hosts, paths, counts, blocked, segments):
        url = url or ""
        n = len(url)
        letters = Counter(url)
        entropy = -sum(c / n * np.log2(c / n) for c in letters.values()) if n else 0.0
        parts = [p for p in path.split("/") if p]
        digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
        query = url.partition("?")[2].partition("#")[0]
        rows.append((n, len(host), len(path), len(parts), host.count("."), digits(url), digits(path), entropy, query.count("="), query.count("&"), url.count("-"), sum(host.count(v) for v in "aeiou") / max(1, len(host)), url.startswith("https"), "#" in url, np.log1p(count), block, segment, "." in (parts[-1] if parts else "")))
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of fixed depth: per tree the feature and cut of each inner node, and the leaf values."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins."""
    mean = float(y.mean()) if len(y) else 0.0
    inner, leaves = 2**depth - 1, 2**depth
    if not 0 < mean < 1:
        return Trees(30.0 if mean == 1 else -30.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    start = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), start)
    out: tuple[list, list, list] = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p) + 1e-9
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf, 0)
            if len(here) > 1:
                gs, hs = g[here].sum(), h[here].sum()
                for f, c in enumerate(cuts):
                    if len(c):
                        gl = np.cumsum(np.bincount(coded[here, f], g[here], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(coded[here, f], h[here], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        b = int(gain.argmax())
                        if gain[b] > best[0]:
                            best = (float(gain[b]), f, float(c[b]), b)
            feature[k], cut[k] = best[1], best[2]
            right = x[here, best[1]] > best[2]
            node[here] = 2 * k + 1 + right
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        z += leaf[at]
        for o, v in zip(out, (feature, cut, leaf)):
            o.append(v)
    return Trees(start, *(np.array(o) for o in out))


def first_segment(path: str) -> str:
    return next((p for p in path.split("/") if p), "")


def shares(keys: list[str], y: np.ndarray, use: np.ndarray, weight: float = 20.0) -> tuple[dict[str, float], float]:
    """Shares of label 1 by key over the rows in use, drawn towards their mean, and that mean."""
    mean = float(y[use].mean()) if use.any() else 0.5
    n, ones = Counter(), Counter()
    for i in np.flatnonzero(use).tolist():
        n[keys[i]] += 1
        ones[keys[i]] += y[i]
    return {k: float((ones[k] + weight * mean) / (c + weight)) for k, c in n.items()}, mean


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: int = 20_000, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    ``labelled`` (url, blocked 0/1) replaces the default labels; at most ``most`` of its rows are used.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        train = rows.where("rule is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("blocked"))
    else:
        h, p = host_and_path(F.col("url"))
        train = labelled.where("url is not null and blocked in (0, 1)").select("url", h.alias("host"), p.alias("path"), "blocked")
    # How many pages have a suffix, over all of them; Spark picks the join by the table's size.
    suffix = F.substring_index("host", ".", -1)
    common = rows.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("count"))
    counted = lambda df: df.withColumn("suffix", suffix).join(common, "suffix", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    sample = counted(train.distinct().orderBy(F.xxhash64("url"), "url", "blocked").limit(most)).toPandas().sort_values(["url", "blocked"], ignore_index=True)
    y = sample["blocked"].to_numpy().astype(float)
    keys = [sample["suffix"].tolist(), [first_segment(p) for p in sample["path"]]]
    fold = np.array([zlib.crc32(u.encode()) % 5 for u in sample["url"]], np.int64)
    unseen = [np.zeros(len(y)), np.zeros(len(y))]
    for f in range(5):
        there = np.flatnonzero(fold == f)
        for out, key in zip(unseen, keys):
            known, mean = shares(key, y, fold != f)
            out[there] = [known.get(key[i], mean) for i in there]
    model = boost(features(sample["url"].tolist(), sample["host"].tolist(), sample["path"].tolist(), sample["count"].tolist(), *unseen), y)
    (blocked, mean), (segments, _) = (shares(key, y, fold >= 0) for key in keys)

    @F.arrow_udf("double")
    def score(url: pa.Array, host: pa.Array, path: pa.Array, count: pa.Array) -> pa.Array:
        hosts, paths = host.to_pylist(), path.to_pylist()
        known = [blocked.get(h.rpartition(".")[2], mean) for h in hosts], [segments.get(first_segment(p), mean) for p in paths]
        return pa.array(model.score(features(url.to_pylist(), hosts, paths, count.to_pylist(), *known)))

    judged = counted(rows).withColumn("score", score("url", "host", "path", "count"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
