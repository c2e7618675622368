"""What keeps a row's work in proportion to the row: lines, locations, regions and grams by whole Arrow columns."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refrain.config import ReuseConfig
from refrain.functions import text, types
from refrain.operators import index, locations
from refrain.plans import catalogue


def cut_plainly(begin, begin2, s1, s2):
    out, at = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", s2):
        one = s1[at : at + len(line)]
        out.append({"begin": begin, "begin2": begin2, "alg": one, "alg2": line})
        at, begin, begin2 = at + len(line), begin + len(one) - one.count("-"), begin2 + len(line) - line.count("-")
    return out


def aligned(rows):
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def test_lines_are_cut_as_by_hand():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("a-\né😀") for _ in range(n))
    for turn in range(300):
        rows = []
        for _ in range(rng.randint(0, 6)):
            n = rng.randint(0, 12)
            rows.append((rng.randint(0, 9), rng.randint(0, 9), None if rng.random() < 0.1 else word(max(0, n + rng.choice((0, 0, 0, -1, 2)))), None if rng.random() < 0.1 else word(n)))
        skip = turn % 2 if len(rows) > 2 else 0
        got = text._cut(*[a.slice(skip) for a in aligned(rows)]).to_pylist()
        assert got == [None if None in r else cut_plainly(*r) for r in rows[skip:]]


def test_texts_are_split_as_by_hand():
    rng = random.Random(3)
    for turn in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029\u2027é😀") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        skip = turn % 2 if len(texts) > 2 else 0
        want = []
        for t in texts[skip:]:
            cut = (t or "").splitlines(keepends=True)
            want.append(None if t is None else [{"begin": len("".join(cut[:k])), "text": x} for k, x in enumerate(cut)])
        assert text._lines(pa.array(texts, pa.string()).slice(skip)).to_pylist() == want


def test_lines_are_cut_in_parts(monkeypatch):
    monkeypatch.setattr(text, "_PART", 8)
    texts = ["a\nb", None, "long é line\nand\nmore", "", "x\n" * 9]
    seen = []
    kernel = lambda part: seen.append(len(part)) or text._lines(part)
    assert text._in_parts(kernel, pa.array(texts, pa.string())).to_pylist() == text._lines(pa.array(texts, pa.string())).to_pylist()
    assert len(seen) > 2 and sum(seen) == len(texts)


def test_locations_are_those_of_each_passage(spark):
    """Also where locations are out of order, missing or none."""
    rng = random.Random(4)
    rows = []
    for k in range(200):
        spans = [(b, b + rng.randint(0, 9)) for b in (rng.randint(0, 40) for _ in range(rng.randint(0, 5)))]
        items = sorted((rng.randint(0, 40), rng.randint(0, 9)) for _ in range(rng.randint(0, 6)))
        if k % 3 == 0:
            rng.shuffle(items)
        rows.append((k, spans, None if k % 20 == 7 else [(f"p{j}", s, n) for j, (s, n) in enumerate(items)]))
    df = spark.createDataFrame(rows, "k int, spans array<struct<b:int,e:int>>, locs array<struct<loc:string,start:bigint,length:bigint>>")
    many = lambda f: f(F.col("spans"), F.transform("spans", lambda x: x["b"]), F.transform("spans", lambda x: x["e"]), F.col("locs"))
    got = df.select("k", "locs", F.inline(F.arrays_zip(many(locations.overlapping_locs).alias("o"), many(locations.sliced_locs).alias("s"))))
    got = got.toDF("k", "locs", "o", "s").select("k", "o", "s", F.transform(locations.overlapping(F.col("locs"), F.col("o.passage.b"), F.col("o.passage.e")), lambda x: x["loc"]).alias("o1"), locations.slice_locs(F.col("o.passage.b"), F.col("o.passage.e"), F.col("locs")).alias("s1")).collect()
    assert len(got) == sum(len(r[1]) for r in rows)
    for r in got:
        assert (r.o.locs or None) == (r.o1 or None) and (r.s.locs or None) == (r.s1 or None)


def test_many_locations_are_searched():
    """What a passage costs does not grow with the locations of its text."""
    took = []
    for n in (2_000, 40_000):
        x = pa.array([list(range(0, 10 * n, 10))], pa.list_(pa.int64()))
        y = pa.array([list(range(10, 10 * n + 10, 10))], pa.list_(pa.int64()))
        for f in (locations._overlapped, locations._sliced):
            began = time.perf_counter()
            got = f(x, y, x, y)
            took.append((time.perf_counter() - began) / n)
            assert len(got.values) == n
    assert max(took[2:]) < 20 * max(took[:2]) and max(took[2:]) < 1e-4


def test_many_lines_are_cut_in_one_pass():
    """What each line costs does not grow with its text."""
    took = []
    for n in (20_000, 400_000):
        s = "é-b\n" * n
        columns = aligned([(0, 0, s, s)])
        best = []
        for _ in range(3):
            began = time.perf_counter()
            got = text._cut(*columns)
            best.append(time.perf_counter() - began)
        assert len(got.values) == n and got.values[n - 1].as_py() == {"begin": 3 * (n - 1), "begin2": 3 * (n - 1), "alg": "é-b\n", "alg2": "é-b\n"}
        took.append(min(best) / n)
    assert took[1] < 8 * took[0]


def test_a_row_is_python_objects_while_it_is_computed(spark):
    """Arguments of a row are made when its turn comes, not for the batch at once."""
    made = []

    class Column(list):
        def __getitem__(self, k):
            value = list.__getitem__(self, k)
            return type("Cell", (), {"as_py": lambda _: made.append(value) or value})()

    seen = []
    run = types.by_row(lambda x: seen.append(len(made)) or x, "int").func
    assert run(Column(range(1000))).to_pylist() == list(range(1000))
    assert seen == list(range(1, 1001))


@pytest.mark.parametrize("floating", [False, True])
@pytest.mark.parametrize("collide", [False, True])
def test_grams_of_many_texts_are_those_of_each(monkeypatch, floating, collide):
    """Also where hashes collide, and with letters whose lower case is longer or hangs on its neighbours."""
    if collide:
        monkeypatch.setattr(index, "_powers", lambda size: (np.zeros(size + 1, np.uint64),) * 2)
    rng = random.Random(2)
    for turn in range(300):
        texts = ["".join(rng.choice("abAé ßİΣσ😀ǅ中\U00010400\n-"[0 if turn % 2 else 8 :] + "ab ") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 5))]
        n = rng.randint(1, 4)
        which, feats, posts = index.grams_of(texts, n, floating)
        got = sorted(zip(which.tolist(), feats.to_pylist(), posts.tolist()))
        assert got == sorted((k, g, p) for k, t in enumerate(texts) for g, p in index.grams(t, n, floating))


def test_partitions_grow_with_the_input(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(index, "PART", 1 << 13)
    least = 30  # documents are 290 kB
    assert catalogue.dfpost(spark, sf_dir).rdd.getNumPartitions() >= least
    freq = catalogue.doc_freq(spark, sf_dir)
    assert freq.rdd.getNumPartitions() >= least
    shuffled = freq._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[-1]
    assert "HashAggregate" not in shuffled  # nothing is counted before the shuffle
    made = spark.createDataFrame([(1, "ab cd ef gh", "x")], "uid long, text string, source string")
    assert index.parts(index.postings(made, ReuseConfig(n=2))) == 4 * spark.sparkContext.defaultParallelism  # rows of no known size


def test_boxes_of_regions(spark, sf_dir):
    """Boxes as by hand, in as many tasks as there is work for, however few the bytes."""
    rng = random.Random(5)
    rows = [(k, [(rng.randint(0, 99), rng.randint(0, 9), tuple(rng.randint(0, 9) for _ in range(5))) for _ in range(rng.randint(0, 5))]) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, r array<struct<start:bigint,length:bigint,coords:struct<x:bigint,y:bigint,w:bigint,h:bigint,b:bigint>>>")
    for r in df.select("r", locations.bounding_box(F.col("r")).alias("x")).collect():
        if not r.r:
            assert r.x is None
            continue
        low, x, y = min(q.start for q in r.r), min(q.coords.x for q in r.r), min(q.coords.y for q in r.r)
        want = (low, max(q.start + q.length for q in r.r) - low, (x, y, max(q.coords.x + q.coords.w for q in r.r) - x, max(q.coords.y + q.coords.h for q in r.r) - y))
        assert tuple(r.x) == want
    assert catalogue.region_contained_boxes(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_freed_memory_goes_back_after_a_batch(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(types, "give_back", lambda: calls.append(1))
    run = types.by_row(lambda x: x, "int").func
    assert run(pa.array([1, 2, None])).to_pylist() == [1, 2, None] and run(pa.array([], pa.int32())).to_pylist() == []
    assert len(calls) == 2
