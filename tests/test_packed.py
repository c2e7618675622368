"""Pairs counted over packed columns: against plain loops, and what goes through a shuffle."""

from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from refrain.config import ReuseConfig
from refrain.operators import index, packed
from refrain.plans import catalogue

CFG = ReuseConfig(n=5, max_df=6, min_match=2)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = [a + b for a in ("stone", "River", "cloud", "İstan", "ΟΔΟΣ", "naïve", "𝒜lpha", "x", "gate-", "mirro") for b in ("path", "song", "Light", "ς", "field", "keeper", "-way", "ß", "mirror", "1")]
    made = [" ".join(rng.choice(words, int(rng.integers(0, 25)))) for _ in range(60)] + ["", "a", "stone", "common phrase here"]
    made = [t + " " + made[k // 4][:40] for k, t in enumerate(made)]
    return [(int(k * 7919 % 64 - 20), t + " all of them hold this") for k, t in enumerate(made)]


def brute(texts, cfg, same=False, near=None):
    holders = defaultdict(list)
    for uid, text in texts:
        for gram, at in index.grams(text, cfg.n, cfg.floating_ngrams):
            holders[gram].append((uid, at))
    found = defaultdict(list)
    for rows in holders.values():
        if cfg.min_df <= len(rows) <= cfg.max_df:
            for u, a in rows:
                for v, b in rows:
                    if (u < v or same and u == v) and (near is None or abs(a - b) <= near):
                        found[u, v].append((a, b))
    return {k: v for k, v in found.items() if len(v) >= cfg.min_match}


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
@pytest.mark.parametrize("floating", [False, True])
def test_counts_are_those_of_a_plain_loop(spark, texts, monkeypatch, held, floating):
    """With steps so small that lists, postings and matches go over many of them, and with grams beyond the band."""
    monkeypatch.setattr(packed, "HELD", held)
    monkeypatch.setattr(packed, "MATCHES", held)
    cfg = replace(CFG, floating_ngrams=floating)
    docs = spark.createDataFrame([*texts, (1000, None)], "uid long, text string").repartition(3)
    for options in ({}, {"same": True}, {"near": 9}):
        got = packed.counted(docs, cfg, cfg.min_match, **options).collect()
        want = brute(texts, cfg, **options)
        assert want and Counter({(r.uid, r.uid2): r.matches for r in got}) == Counter({k: len(v) for k, v in want.items()}) and len(got) == len(want)
    got = packed.counted(docs, cfg, cfg.min_match, offsets=True).collect()
    ends = {k: (len(v), min(a for a, _ in v), max(a for a, _ in v), min(b for _, b in v), max(b for _, b in v)) for k, v in brute(texts, cfg).items()}
    assert {(r.uid, r.uid2): (r.matches, r.begin, r.last, r.begin2, r.last2) for r in got} == ends


@pytest.mark.parametrize("same", [False, True])
def test_rows_of_one_number(spark, texts, same):
    """Rows that share their number meet in both orders with ``same``, and else not at all."""
    rows = [(u // 3, t) for u, t in texts]
    got = packed.counted(spark.createDataFrame(rows, "uid long, text string"), CFG, CFG.min_match, same=same).collect()
    assert {(r.uid, r.uid2): r.matches for r in got} == {k: len(v) for k, v in brute(rows, CFG, same).items()}


def test_grams_with_equal_first_hashes_stay_apart():
    one, two = np.array([7, 7, 9, 7, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.uint32)
    order, starts, counts = packed._by_gram(one, two)
    assert [(int(one[order[s]]), int(two[order[s]]), int(c)) for s, c in zip(starts, counts)] == [(7, 1, 2), (7, 2, 2), (9, 1, 1)]


def test_hashes_with_equal_upper_bits_are_told_apart():
    rng = np.random.default_rng(2)
    one, two = (rng.integers(0, 4, 400).astype(np.uint64) + np.uint64(1 << 63)) ^ rng.integers(0, 2, 400).astype(np.uint64) << np.uint64(61), rng.integers(0, 3, 400).astype(np.uint32)
    order, starts, counts = packed._by_gram(one, two)
    groups = [order[s : s + c] for s, c in zip(starts, counts)]
    assert all((np.diff(g) > 0).all() for g in groups)
    assert sorted((int(one[g[0]]), int(two[g[0]]), len(g)) for g in groups) == sorted((a, b, n) for (a, b), n in Counter(zip(one.tolist(), two.tolist())).items())


def test_a_gram_of_most_documents_is_not_held():
    n = 5000
    columns = [np.append(np.zeros(n, np.uint64), np.uint64(3)), np.zeros(n + 1, np.uint32), np.arange(n + 1), np.zeros(n + 1, np.int32)]
    kept = packed._trimmed(columns, 6)
    assert Counter(kept[0].tolist()) == {0: 7, 3: 1}


@pytest.mark.parametrize("floating", [False, True])
def test_hashes_tell_the_same_grams_apart(texts, floating):
    held = [t for _, t in texts]
    which, feats, posts = index.grams_of(held, 5, floating)
    which2, one, two, posts2 = index.hashes_of(held, 5, floating)
    grams = {(int(w), int(p)): f for w, f, p in zip(which, feats.to_pylist(), posts)}
    found = Counter(zip(which2.tolist(), one.tolist(), two.tolist()))
    hashes = {(w, p): (a, b) for w, a, b, p in zip(which2.tolist(), one.tolist(), two.tolist(), posts2.tolist()) if found[w, a, b] == 1}
    assert grams.keys() == hashes.keys()
    assert len(set(grams.values())) == len(set(hashes.values())) == len({(grams[k], hashes[k]) for k in grams})


@pytest.mark.parametrize("name", ["pairs_self", "uniform_prior", "span_edges"])
def test_neither_postings_nor_matches_are_rows(spark, sf_dir, name):
    """Rows of the two large shuffles are as many as tasks times partitions, and matches are made and counted in arrays."""
    found = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert found.count("MapInArrow") == 3 and "Window" not in found and found.count("Generate") == (name == "span_edges")
