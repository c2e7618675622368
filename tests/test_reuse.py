"""The text-reuse engine: kernels on hand-made cases, operators, whole runs and their invariants."""

import json
import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain import cli
from refrain.config import ReuseConfig
from refrain.functions import align, text
from refrain.operators import chain, clusters, extents, graph, index, lines, linkmodel, locations, pairs
from refrain.plans.reuse import Reuse, run
from refrain.sources import corpus as source

POEM = """By the shore of the wide grey water stood a lantern and a keeper,
And the keeper told the evening every story that he knew,
How the ships came home in winter with their cargoes growing cheaper,
How the stars above the harbour were reflected in the blue.
Nobody but gulls were listening to the long and patient telling,
Yet he told it to the finish and he told it all anew."""
OTHER = "An unrelated notice about the price of grain, timber and salt at the spring market of the northern towns."
NOISY = POEM.replace("keeper", "keepr").replace("cargoes", "car-\ngoes").replace("stars above", "stars  above")


@pytest.fixture(scope="module")
def poems(spark):
    rows = [("a", "x", OTHER + "\n" + POEM), ("b", "y", "Printed again this week by popular demand of readers everywhere:\n" + NOISY + "\nAnd more news."), ("c", "z", "Some introduction first, of a good length too. " + POEM + " " + OTHER), ("d", "x", OTHER * 2), ("e", "y", None), (None, "y", "text")]
    return spark.createDataFrame(rows, "id string, group string, text string")


def job(poems, **options):
    cfg = replace(ReuseConfig(n=15, output_format="parquet"), **options)
    return Reuse(source.with_uid(poems, cfg), cfg)


# --- kernels ---


def test_grams():
    assert index.grams("", 3) == [] and index.grams("ab", 3) == []
    assert index.grams("abc", 3) == [("abc", 0)]
    assert index.grams("Ab-cd, ef1gh", 3) == [("abc", 0), ("cde", 3), ("efg", 7)]
    assert index.grams("ab cd", 3, floating=True) == [("abc", 0), ("bcd", 1)]
    assert index.grams("abc abc", 3) == []  # what occurs twice is no gram
    assert index.grams("😀ab c", 3) == [("abc", 1)]
    assert index.grams("İb c", 3) == [("i̇bc", 0)]


@pytest.mark.parametrize("floating", [False, True])
def test_grams_against_plain_windows(floating):
    rng = np.random.default_rng(0)
    for _ in range(300):
        t = "".join(rng.choice(list("ab1 -é"), int(rng.integers(0, 40))))
        at = [(i, c.lower()) for i, c in enumerate(t) if c.isalpha()]
        found = [("".join(c for _, c in at[k : k + 4]), at[k][0]) for k in range(len(at) - 3) if floating or k == 0 or at[k][0] - at[k - 1][0] > 1]
        assert index.grams(t, 4, floating) == [x for x in found if sum(y[0] == x[0] for y in found) == 1]


def one(*offsets, uid=5):
    return [(p2, 2, [(uid, p)]) for p2, p in offsets]


def test_chain_follows_one_source():
    (span,) = chain.chain(one((100, 300), (110, 310), (150, 350), (190, 391)), {5: 1.0}, 10, 600, 50)
    assert span == (5, 100, 200, 300, 401, [(100, 300), (110, 310), (150, 350), (190, 391)])


def test_chain_breaks_at_gaps_and_retrogrades():
    far = one((100, 100), (140, 140), (180, 180), (1200, 1200), (1240, 1240), (1280, 1280))
    assert [s[1:3] for s in chain.chain(far, {5: 1.0}, 10, 600, 50)] == [(100, 190), (1200, 1290)]
    back = one((100, 500), (140, 540), (180, 580), (220, 100), (260, 140), (300, 180))
    assert [s[1:5] for s in chain.chain(back, {5: 1.0}, 10, 600, 50)] == [(100, 190, 500, 590), (220, 310, 100, 190)]
    assert chain.chain(far[:2], {5: 1.0}, 10, 600, 60) == []  # 50 long
    assert chain.chain([], {}, 10, 600, 50) == []


def test_chain_takes_the_source_that_goes_on():
    found = [(100, 2, [(1, 10), (2, 40)]), (120, 2, [(2, 60)]), (140, 2, [(2, 80)]), (160, 2, [(1, 900), (2, 100)])]
    assert [s[0] for s in chain.chain(found, {1: 1.0, 2: 1.0}, 10, 600, 50)] == [2]


def test_chain_at_the_start_of_both():
    """A first match within n characters of both starts can be lost; seed_start keeps it. An anchor at 0 is left out."""
    found = one((5, 5), (12, 12), (20, 20), (28, 28), (36, 36), (44, 44), (52, 52))
    assert chain.chain(found, {5: 1.0}, 10, 600, 50) == []
    assert [s[1:3] for s in chain.chain(found, {5: 1.0}, 10, 600, 50, seed_start=True)] == [(5, 62)]
    found = one((0, 0), (30, 30), (60, 60), (90, 90))
    assert [s[1] for s in chain.chain(found, {5: 1.0}, 10, 600, 50, seed_start=True)] == [30]


def edit_cost(s1, s2, c):
    best = {(0, 0): 0.0}
    for i in range(len(s1) + 1):
        for j in range(len(s2) + 1):
            options = [best[i, j]] if (i, j) == (0, 0) else []
            if i:
                options.append(best[i - 1, j] + c.edit)
            if j:
                options.append(best[i, j - 1] + c.edit)
            if i and j and (d := align._diagonal(s1[i - 1], s2[j - 1], c)) is not None:
                options.append(best[i - 1, j - 1] + d)
            best[i, j] = min(options)
    return best[len(s1), len(s2)]


@pytest.mark.parametrize("beam", [0, 1000])
def test_alignment_is_optimal(beam):
    rng, c = np.random.default_rng(1), align.Costs(0.8)
    for _ in range(120):
        s1, s2 = ("".join(rng.choice(list("abA -\n"), int(rng.integers(0, 9)))) for _ in range(2))
        a1, a2 = align.align(s1, s2, beam=beam, max_offset=100)
        assert len(a1) == len(a2)
        assert a1.replace("-", "") == s1.replace("-", "‐") and a2.replace("-", "") == s2.replace("-", "‐")
        cost = sum(c.edit if "-" in (x, y) else align._diagonal(x, y, c) for x, y in zip(a1, a2))
        assert cost == pytest.approx(edit_cost(s1.replace("-", "‐"), s2.replace("-", "‐"), c))


def plain_edge(s1, s2, c, complete_lines, floating):
    """The cheapest place to stop, over the whole table of offsets."""
    cost = np.full((len(s1) + 1, len(s2) + 1), np.inf)
    cost[0, 0], best = 0, (np.inf, 0, 0)
    for j in range(len(s2) + 1):
        for i in range(len(s1) + 1):
            if i:
                cost[i, j] = min(cost[i, j], cost[i - 1, j] + c.edit)
            if j:
                cost[i, j] = min(cost[i, j], cost[i, j - 1] + c.edit)
            if i and j and (d := align._diagonal(s1[i - 1], s2[j - 1], c)) is not None:
                cost[i, j] = min(cost[i, j], cost[i - 1, j - 1] + d)
            if align._may_finish(s2, j, complete_lines, floating):
                best = min(best, (cost[i, j] + c.finish + c.pad * (len(s2) - j), j, i))
    return best[0]


def test_edges_are_optimal_under_a_wide_beam():
    rng, c = np.random.default_rng(2), align.Costs(0.8)
    for k in range(120):
        s1, s2 = ("".join(rng.choice(list("abc D\n"), rng.integers(0, 14))) for _ in range(2))
        if k % 2:
            s2 = s1[:6] + s2
        for lines_, floating in ((False, False), (True, False), (False, True)):
            i, j = align._edge_beam(s1, s2, c, 400, lines_, floating)
            best = plain_edge(s1, s2, c, lines_, floating)
            head = edit_cost(s1[:i], s2[:j], c)
            assert (i, j) == (0, 0) and best == np.inf or abs(head + c.finish + c.pad * (len(s2) - j) - best) < 1e-9


def test_alignment_edges():
    assert align.align_edge("the same wordsX", "the same words. And", False)[1].startswith("the same words")
    assert all(a.endswith("one two") for a in align.align_edge("xx one two", "yyyyyy yy one two", True))
    for beam in (0, 20):
        assert align.align_edge("", "", True, beam=beam) == ("", "")
        assert align.align_edge("qqqq", "zzz zz", True, beam=beam)[0] == ""
        assert align.align_edge("abc", "", False, beam=beam) == ("", "")
    # Ending within a line is not allowed; with a long rest the line end is cheaper than going on.
    for beam in (0, 20):
        assert align.align_edge("word word\nnext", "word word\n" + "other " * 9, False, beam=beam, complete_lines=True) == ("word word", "word word")
    assert align.align("a-b", "a-b") == ("a‐b", "a‐b")
    assert align.align("ab", "") == ("ab", "--")


def test_chunks_and_matches():
    s1, s2, n = align.align_chunks(10, 50, "Hello old world", "hello new  world", [(56, 16)], 0.8, 20, 20)
    assert s1.replace("-", "") == "Hello old world" and s2.replace("-", "") == "hello new  world" and n == align.count_matches(s1, s2) >= 11


def test_count_matches_column(spark):
    rows = [("ab c", "AB\td"), ("", "x"), ("abc", "ab"), ("-a", "-a"), (None, "a")]
    got = spark.createDataFrame(rows, "x string, y string").select(text.matches(F.col("x"), F.col("y")).alias("n")).collect()
    assert [r.n for r in got][:4] == [align.count_matches(x, y) for x, y in rows[:4]]


def test_splice():
    ex = lambda b2, e2, b, e: {"begin2": b2, "end2": e2, "begin": b, "end": e, "text2": "t" * (e2 - b2), "text": "s" * (e - b), "anchors": [{"pos2": b2, "pos": b}, {"pos2": e2 - 1, "pos": e - 1}]}
    (joined,) = extents.splice([ex(0, 10, 0, 12), ex(8, 20, 9, 22)])
    assert (joined["begin2"], joined["end2"], joined["begin"], joined["end"], len(joined["text2"]), len(joined["text"])) == (0, 20, 0, 22, 20, 22)
    assert [a["pos2"] for a in joined["anchors"]] == [0, 9, 19]
    assert len(extents.splice([ex(0, 10, 0, 10), ex(2, 8, 2, 8)])) == 2  # held inside
    assert len(extents.splice([ex(0, 10, 0, 10), ex(10, 20, 10, 20)])) == 1  # touching
    assert len(extents.splice([ex(0, 10, 50, 60), ex(5, 20, 0, 20)])) == 2 and extents.splice([]) == []


# --- columns and tables ---


def test_lines(spark):
    texts = ["one\ntwo\r\nthree\x0bfour\x85five six", "", "\n\n", "no end"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.text_lines(F.col("t")).alias("x")).collect()
    for t, r in zip(texts, got):
        want, at = [], 0
        for line in t.splitlines(keepends=True):
            want.append((at, line))
            at += len(line)
        assert [tuple(x) for x in r.x] == want


def test_target_lines(spark):
    df = spark.createDataFrame([(10, 20, ("ab-\ncd", "abc\nc-"))], "b int, b2 int, alg struct<s1:string,s2:string>")
    got = df.select(F.inline(lines.target_lines(F.col("b"), F.col("b2"), F.col("alg")))).collect()
    assert [tuple(r) for r in got] == [(10, 20, "ab-\n", "abc\n", 3), (13, 24, "cd", "c-", 1)]


LOCS = [("p1", 0, 10), ("p2", 10, 10), ("p3", 25, 10), ("p4", 35, 5)]


@pytest.mark.parametrize(("begin", "end", "want"), [(0, 5, ["p1"]), (5, 15, ["p1", "p2"]), (21, 24, ["p2", "p3"]), (12, 40, ["p2", "p3", "p4"]), (12, 90, ["p2", "p3", "p4"])])
def test_slice_locs(spark, begin, end, want):
    df = spark.createDataFrame([(LOCS,)], "locs array<struct<loc:string,start:bigint,length:bigint>>")
    assert df.select(locations.slice_locs(F.lit(begin), F.lit(end), F.col("locs")).alias("x")).first().x == want


def test_locs_that_are_missing(spark):
    df = spark.createDataFrame([(None,), ([],)], "locs array<struct<loc:string,start:bigint,length:bigint>>")
    assert [r.x for r in df.select(locations.slice_locs(F.lit(1), F.lit(2), F.col("locs")).alias("x")).collect()] == [None, None]


def test_link_spans(spark):
    s1 = spark.createDataFrame([(1, 0, 100), (1, 200, 300), (1, 205, 295), (1, 500, 510), (2, 0, 10)], "uid long, begin int, end int")
    s2 = spark.createDataFrame([(1, 40, 100), (1, 0, 55), (3, 0, 10)], "uid long, begin int, end int")
    got = {tuple(r) for r in clusters.link_spans(s1, s2, 0.9, 0.5, width=64).collect()}
    assert got == {(1, 0, 100, 40, 100), (1, 205, 295, 200, 300)}


def test_merge_spans(spark):
    src = lambda u: (u, 0, 9)
    rows = [(1, 7, 0, 10, True, src(8)), (1, 7, 5, 20, False, src(7)), (1, 7, 20, 30, False, src(9)), (1, 7, 40, 50, None, None)]
    df = spark.createDataFrame(rows, "cluster long, uid long, begin int, end int, boiler boolean, src struct<uid:bigint,begin:int,end:int>")
    got = [(r.begin, r.end, r.boiler, [s.uid for s in r.src]) for r in clusters.merge_spans(df).orderBy("begin").collect()]
    assert got == [(0, 20, True, [8]), (20, 30, False, [9]), (40, 50, False, [])]
    shared = clusters.merge_spans(df, shared_sources=True).orderBy("begin").collect()
    assert [[s.uid for s in r.src] for r in shared] == [[], [], []]
    one_ = clusters.sized(df.limit(1).drop("src")).first()
    assert (one_.size, one_.pboiler) == (1, None)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs_ = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 5000 + k) for k in range(200)] + [(9, 9), (7777, 7777), (None, 3)]
    edges = spark.createDataFrame(pairs_, "a long, b long").repartition(7)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert dict(map(tuple, graph.connected_components(edges).collect())) == {x: root(x) for x in list(parent)}
    assert graph.connected_components(edges.limit(0)).count() == 0


# --- whole runs ---


def check_extents(poems, found):
    texts = {r.id: r.text for r in poems.na.drop(subset=["id", "text"]).collect()}
    for r in found:
        assert r.s1.replace("-", "") == texts[r.id][r.begin : r.end].replace("-", "‐")
        assert r.s2.replace("-", "") == texts[r.id2][r.begin2 : r.end2].replace("-", "‐")
        assert len(r.s1) == len(r.s2) and r.matches == align.count_matches(r.s1, r.s2)


@pytest.mark.parametrize("options", [{}, {"all_pairs": True}, {"beam": 0}, {"floating_ngrams": True}, {"complete_lines": True}, {"shards": 3}])
def test_pairwise(poems, options):
    found = job(poems, fields=("group",), **options).pairwise().collect()
    assert found and {"group", "group2", "id", "id2"} <= set(found[0].__fields__)
    check_extents(poems, found)
    assert max(r.matches for r in found) > 0.9 * len(POEM)


def test_best_source_spans_do_not_overlap(poems):
    rows = job(poems, filterpairs="uid <> uid2").chained().collect()
    for r in rows:
        assert all(a.end2 <= b.begin2 + 15 for a, b in zip(r.src, r.src[1:]))


def test_results_do_not_depend_on_partitions(spark, poems):
    def rows(shards, parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            return sorted(map(str, job(poems.repartition(parts), shards=shards).extents().collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)

    assert rows(1, 1) == rows(4, 8)


def test_clusters(poems):
    out = job(poems).output().collect()
    assert {r.id for r in out} >= {"a", "b", "c"} and all(r.size >= 2 for r in out)
    big = max(out, key=lambda r: len(r.text))
    assert len(big.text) > 0.9 * len(POEM) and len({r.cluster for r in out if len(r.text) > 300}) == 1
    texts = {r.id: r.text for r in poems.collect()}
    assert all(r.text == texts[r.id][r.begin : r.end] for r in out)


def test_predicates_and_fields(poems):
    found = job(poems, fields=("group = 'x' as ref",), filterpairs="ref and not ref2").extents().collect()
    assert found and all(r.ref and not r.ref2 for r in found)
    own = job(poems, filterpairs="uid = uid2").extents().collect()
    assert all(r.uid == r.uid2 for r in own)
    apart = job(poems, fields=("group as ref",), refpref=True, filterpairs="uid <> uid2").pairs()
    assert "ref" in apart.columns


def test_docwise_and_linewise(poems):
    doc = job(poems).docwise().collect()
    texts = {r.id: r.text for r in poems.collect()}
    hits = 0
    for r in doc:
        assert "".join(x.text for x in r.lines) == texts[r.id]
        for x in r.lines:
            for w in x.wits or []:
                assert w.alg2.replace("-", "").replace("‐", "-") in x.text
                hits += 1
    assert hits >= 5
    everything = job(poems, docwise=True, linewise=True).docwise().collect()
    assert len(everything) == 4
    found = job(poems).linewise().collect()
    for r in found:
        assert r.text.replace("‐", "-") == texts[r.id][r.begin : r.begin + len(r.text)] and r.text2.replace("‐", "-") == texts[r.id2][r.begin2 : r.begin2 + len(r.text2)]


def test_locations_and_pages(poems):
    locs = "transform(sequence(0, cast(length(text) div 50 as int)), i -> struct(concat('l', i) as loc, bigint(i * 50) as start, bigint(50) as length)) as locs"
    regions = "transform(sequence(0, cast(length(text) div 20 as int)), i -> struct(bigint(i * 20) as start, bigint(20) as length, struct(bigint(i) as x, bigint(2) as y, bigint(3) as w, bigint(4) as h, bigint(0) as b) as coords))"
    pages = f"array(struct('p' as id, bigint(1) as seq, {regions} as regions), struct('q' as id, bigint(2) as seq, array() as regions)) as pages"
    rich = poems.selectExpr("*", locs, "array(struct('p' as id, bigint(1) as seq, " + regions + " as regions)) as pages")
    assert pages
    j = job(rich)
    for r in j.output().collect():
        assert r.locs[0] == f"l{r.begin // 50}" and r.locs[-1] == f"l{(r.end - 1) // 50}"
        (page,) = r.pages
        (box,) = page.regions
        assert box.start == r.begin // 20 * 20 and box.start + box.length >= r.end and "b" not in box.coords
    for r in j.pairwise().collect():
        assert r.locs[0] == f"l{r.begin // 50}" and (r.pages is None or r.pages[0].regions[0].start >= r.begin)
    found = j.linewise().collect()
    assert any(r.pagesTokens for r in found) and all(x.startswith("l") for r in found for x in r.locs or [])
    assert j.docwise().count() > 0


def test_link_model(spark, sf_dir):
    cfg = ReuseConfig(id="doc_id", fields=("n_chars",), link_model="size", link_features="log(n_chars + 1) AS size")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    j = Reuse(source.with_uid(docs, cfg), cfg)
    stats = linkmodel.source_stats(j.chained())
    assert set(r.label for r in stats.select("label").distinct().collect()) <= {0, 1} and stats.where("weight <= 0").count() == 0
    for r in j.modelled().collect():
        assert all(0 < p < 1 for p in r.prior.values())


def test_run_keeps_stages(spark, poems, tmp_path):
    src, out = f"{tmp_path}/in.json", f"{tmp_path}/out"
    poems.write.json(src)
    cfg = ReuseConfig(n=15)
    assert run(spark, src, out, cfg) == ["dfpost", "pairs", "src", "extents", "clusters"]
    assert run(spark, src, out, cfg) == []
    assert run(spark, src, out, replace(cfg, gap=500)) == ["src", "extents", "clusters"]
    assert spark.read.json(f"{out}/out.json").count() >= 3
    assert run(spark, src, f"{tmp_path}/i", replace(cfg, to_index=True)) == ["dfpost"]
    assert run(spark, src, f"{tmp_path}/p", replace(cfg, to_pairs=True)) == ["dfpost", "pairs"]
    assert run(spark, src, f"{tmp_path}/e", replace(cfg, to_extents=True))[-1] == "extents"
    run(spark, src, f"{tmp_path}/w", replace(cfg, pairwise=True, docwise=True, output_format="parquet"))
    assert spark.read.parquet(f"{tmp_path}/w/align.parquet").count() >= 2 and "lines" in spark.read.parquet(f"{tmp_path}/w/out.parquet").columns
    run(spark, src, f"{tmp_path}/l", replace(cfg, linewise=True))
    assert "alg2" in spark.read.json(f"{tmp_path}/l/out.json").columns


def test_shards_are_stages(spark, poems, tmp_path):
    """Each shard of targets is written by itself: one that was lost is made again alone, and all give the whole."""
    src, out = f"{tmp_path}/in.json", f"{tmp_path}/out"
    poems.write.json(src)
    cfg = ReuseConfig(n=15, shards=3, to_pairs=True)
    assert run(spark, src, out, cfg) == ["dfpost", "pairs-0", "pairs-1", "pairs-2"]
    (lost,) = tmp_path.rglob("pairs-1-*.parquet")
    shutil.rmtree(lost)
    assert run(spark, src, out, cfg) == ["pairs-1"]
    whole = sorted(r.uid2 for r in job(poems).pairs().collect())
    assert whole and sorted(r.uid2 for r in job(poems, shards=3).pairs().collect()) == whole


def test_allpairs_preset_keeps_given_fields():
    for given in (["--fields", "a as gid"], ["--fields=a as gid"], ["--field", "a as gid"]):
        assert cli.configure(["in", "out", *given], "allpairs")[0].fields == ("a as gid",)
    cfg = cli.configure(["in", "out"], "allpairs")[0]
    assert (cfg.fields, cfg.all_pairs, cfg.filterpairs) == (("xxhash64(series) as gid",), True, "gid < gid2")


def test_other_text_column(poems):
    out = job(poems.withColumnRenamed("text", "body"), text="body").output()
    assert "body" in out.columns and "text" not in out.columns and out.count() >= 3


def test_command_line():
    cfg, a, b = cli.configure(["--fields", "date(date) as day", "-n", "10", "--minDF", "3", "--docw", "-f", "day < day2", "--", "in", "out"])
    assert (cfg.fields, cfg.n, cfg.min_df, cfg.docwise, cfg.filterpairs, a, b) == (("date(date) as day",), 10, 3, True, "day < day2", "in", "out")
    cfg, a, b = cli.configure(["in", "out"], "allpairs")
    assert cfg.all_pairs and cfg.filterpairs == "gid < gid2" and cfg.fields == ("xxhash64(series) as gid",) and (a, b) == ("in", "out")
    with pytest.raises(ValueError, match="pcopy"):
        ReuseConfig(pcopy=1.5)


def test_convert_and_schema(spark, poems, tmp_path):
    source.write_output(poems, f"{tmp_path}/a.parquet", "parquet")
    for a, b in (("a.parquet", "b.csv"), ("a.parquet", "c.json"), ("b.csv", "d.json")):
        source.convert(spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}")
    assert spark.read.json(f"{tmp_path}/d.json").where("id = 'd'").first().text == OTHER * 2
    assert "text" in [f["name"] for f in json.loads(source.json_schema(spark, f"{tmp_path}/c.json"))["fields"]]


def test_renamed_sides(poems):
    assert pairs.renamed(poems, ("id",)).columns == ["id", "group2", "text2"]
