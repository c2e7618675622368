"""What keeps the text-reuse steps in proportion to their input: where matches are made, what is shuffled and what is held."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.config import ReuseConfig
from refrain.functions import align
from refrain.operators import chain, index, pairs
from refrain.plans import catalogue
from refrain.plans.reuse import Reuse
from refrain.sources import corpus as source

CFG = ReuseConfig(n=15, output_format="parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def posted(spark, rows):
    return spark.createDataFrame(rows, "uid long, feat long, post int")


@pytest.fixture(scope="module")
def twins(spark):
    words = [f"{a}{b}" for a in ("stone", "river", "cloud", "ember", "winter", "garden") for b in ("path", "song", "light", "gate", "field", "keeper", "mirror")]
    text = " ".join(words)
    return spark.createDataFrame([("a", text), ("b", text.replace("river", "rivver", 1)), ("c", text + " and more"), ("d", "nothing of the kind")], "id string, text string")


def job(docs, **options):
    cfg = replace(CFG, **options)
    return Reuse(source.with_uid(docs, cfg), cfg)


def test_postings_are_shuffled_once(spark):
    posts = posted(spark, [(u, g, 0) for g in range(20) for u in range(g + 1)])
    cfg = replace(CFG, max_df=10)
    found = index.index(posts, cfg)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert {(r.feat, r.df) for r in found.collect()} == {(g, g + 1) for g in range(1, 10)}


def test_two_documents_meet_in_one_task(spark):
    posts = posted(spark, [(u, g, g) for g in range(300) for u in (4, 7)] + [(u, g, g) for g in range(300, 600) for u in (5, 6, 9)])
    found = pairs.matches(index.index(posts, CFG), CFG).withColumn("task", F.spark_partition_id()).groupBy("uid", "uid2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"))
    assert sorted(map(tuple, found.collect())) == [(4, 7, 300, 1), (5, 6, 300, 1), (5, 9, 300, 1), (6, 9, 300, 1)]


@pytest.mark.parametrize("apart", [False, True])
def test_merged_posts_over_many_batches(spark, apart):
    """Targets that go over several batches, with null and NaN metadata; sources with too few matches go."""
    rng = np.random.default_rng(3)
    rows = [(int(u2), int(u), [None, float("nan"), 2.0][int(u) % 3], int(p2), 2, int(p)) for u2, u, p2, p in rng.integers(0, (6, 9, 400, 400), (900, 4))]
    cfg = replace(CFG, all_pairs=apart, link_model="size", min_match=14)
    df = spark.createDataFrame(rows, "uid2 long, uid long, size double, post2 int, df int, post int").withColumn("size2", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = pairs.merged_posts(df, ["size"], cfg).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for u2, u, _, p2, d, p in rows:
        want.setdefault((u2, u), []).append((p2, d, p))
    want = {k: sorted(v) for k, v in want.items() if len(v) >= 14}
    assert {(r.uid2, s.uid): [tuple(m) for m in s.post] for r in got for s in r.sources} == want
    assert len(got) == (len(want) if apart else len({k[0] for k in want}))
    assert all(r.prior == {s.uid: 1.0 for s in r.sources} for r in got)


def test_matches_stay_out_of_the_chained_rows(twins):
    rows = job(twins).chained()
    assert rows.columns == ["uid2", "src"]
    assert sorted(len(r.src) for r in rows.collect()) and "ArrowEvalPython" not in plan(rows)


def test_matches_are_merged_without_python_rows():
    import pyarrow as pa

    one = [{"uid": 7, "post": [{"post2": 5, "df": 2, "post": 9}, {"post2": 1, "df": 3, "post": 4}]}, {"uid": 3, "post": [{"post2": 5, "df": 2, "post": 8}]}]
    kind = pa.list_(pa.struct([("uid", pa.int64()), ("post", pa.list_(pa.struct([(c, pa.int32()) for c in ("post2", "df", "post")])))]))
    rows = pa.array([[], one, one[:1]], kind)
    assert chain.merge_matches(rows[1].values) == [(1, 3, [(7, 4)]), (5, 2, [(3, 8), (7, 9)])]
    assert chain.merge_matches(rows[2].values) == [(1, 3, [(7, 4)]), (5, 2, [(7, 9)])]


@pytest.mark.parametrize("name", ["link_spans", "passage_edges", "vertices"])
def test_extents_are_made_once(spark, sf_dir, name):
    """Both sides of the passages come from one table, so texts are not read and paired again for each."""
    assert "MapInArrow" not in plan(catalogue.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("left", [False, True])
def test_a_copied_edge_is_not_searched(monkeypatch, left):
    rng, beam = np.random.default_rng(5), align._edge_beam
    c = align.Costs(0.8)
    cases = []
    for _ in range(200):
        s2 = "".join(rng.choice(list("ab \n-C"), int(rng.integers(1, 40))))
        extra = "".join(rng.choice(list("ab \n"), int(rng.integers(0, 25))))
        cases.append((extra + s2, s2) if left else (s2 + extra, s2))
    for s1, s2 in cases:
        for lines_, floating in ((False, False), (True, False), (False, True)):
            one, two = (s1[::-1], s2[::-1]) if left else (s1, s2)
            assert beam(one, two, c, 20, lines_, floating) == (len(s2), len(s2))
    monkeypatch.setattr(align, "_edge_beam", None)
    for s1, s2 in cases:
        a1, a2 = align.align_edge(s1, s2, left)
        assert a1 == a2 and a1 == (s2.lstrip() if left else s2)
