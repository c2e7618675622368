"""Every operator against a plain version over whole tables, and over rows that are null, empty, repeated or odd."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from refrain.llm import ann, decontaminate, hilbert, near_dup, packing, pii, queries, tokenfile, toxicity, trie_count, url_filter  # noqa: E402
from refrain.llm.common import table  # noqa: E402

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one two three", "en", "a", 13),
    (4, "one two three", "en", "a", 13),
    (None, "no id at all, but a text of some words", "de", "b", 5),
    (None, None, None, None, None),
    (7, "İstanbul ß ŒUVRE naïve e\u0301té 东京 😀 don't they'll <|endoftext|> x\u00a0y\x1cz \u2028 q", "fr", "b", 9),
    (8, "tail " * 30_000, "en", "a", 150_000),
    (9, "z" * 120_000, "en", "a", 120_000),
    (-5, "Mail me: jane.doe@mail.example.com or +1 (456) 555-2186, 10.0.0.1; 4111 1111 1111 1111.", "en", "b", 80),
    (10, "1" * 50_000 + " @ a@b 1.2.3.4.5 256.1.1.1 x@y.zz@q.com", "en", "b", 80),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", "y") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, shard string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["table", "odd"])
def docs(request, spark, sf_dir, odd):
    return odd if request.param == "odd" else table(spark, sf_dir, "documents")


def encode(text, end):
    from tokenizers import Tokenizer

    encode.tk = getattr(encode, "tk", None) or Tokenizer.from_file(BPE)
    return [*encode.tk.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs):
    rows = packing.pack(docs, BPE).collect()
    want = sorted(((d, *p) for d, t in texts(docs) for p in _pieces(encode(t, 0))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.1 * math.ceil(total / 2048) + 3


def _pieces(ids):
    return [(k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]


def test_packing_bounds_open_bins():
    rng = np.random.default_rng(0)
    bins, held = packing.BestFit(100, 8), defaultdict(int)
    for n in rng.integers(1, 101, 5000).tolist():
        b, offset = bins.add(n)
        assert offset == held[b]
        held[b] += n
        assert held[b] <= 100 and bins.open <= 8 and bins.open == sum(map(len, bins.free))
    assert sum(held.values()) / (100 * len(held)) > 0.88


def test_token_files(docs):
    rows = {}
    for r in tokenfile.round_trip(docs, BPE, docs_per_shard=60).collect():
        rows.setdefault(r.start, []).append((r.doc_id, r.n_tokens, r.ids_crc32))
    want = sorted((d is not None, d or 0, crc(encode(t, 2)), len(encode(t, 2))) for d, t in texts(docs))
    at = 0
    for known, d, c, n in want:
        assert rows[at] == [(d if known else None, n, c)]
        at += n
    assert len(rows) == len(want)


def test_token_file_rejects_another_dictionary(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = tokenfile.write(odd, folder, BPE)
    from pyarrow import fs

    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.ShardReader(fs.LocalFileSystem(), manifest.first().path, tokenfile.train([np.random.default_rng(k).integers(0, 50, 200).astype("<u2").tobytes() for k in range(64)]))


def test_token_counts_against_library(docs):
    from tokenizers import Tokenizer, models

    score = trie_count.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram([("<unk>", -1000.0), *score.items()], unk_id=0))
    rows = sorted(((r.doc_id, r.n_tokens) for r in trie_count.count(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=str)

    def plain(word):  # the plain recurrence, without a trie
        word = trie_count.MARK + word
        best = [(0.0, 0)]
        low = min(score.values()) - 10
        for e in range(1, len(word) + 1):
            top = (best[e - 1][0] + low, -best[e - 1][1] - len(word[e - 1].encode()))
            for b in range(max(0, e - 40), e):
                if word[b:e] in score:
                    top = max(top, (best[b][0] + score[word[b:e]], -best[b][1] - 1))
            best.append((top[0], -top[1]))
        return best[-1]

    known = {}
    for _, t in texts(docs):
        for w in (t or "").split():
            known[w] = known.get(w) or plain(w)
    assert rows == sorted(((d, sum(known[w][1] for w in (t or "").split())) for d, t in texts(docs)), key=str)
    for w, (s, n) in list(known.items())[:3000]:  # the library finds no better segmentation of words that pieces cover
        got = model.encode(trie_count.MARK + w).tokens
        if len(w) < 100 and all(g in score for g in got):
            assert sum(score[g] for g in got) <= s + 1e-6 and (abs(sum(score[g] for g in got) - s) > 1e-9 or n <= len(got))


def test_trie_shares_prefixes():
    trie = trie_count.Trie({"a": -1.0, "ab": -1.5, "b": -1.0})
    assert trie.counts(["ababab", "ababa", "ababb"]) == {"ababab": 3, "ababa": 3, "ababb": 3}
    assert trie.steps == 7  # ababa, then b, then b below abab


def fold(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, bench):
    out = []
    windows = defaultdict(set)
    for i, t in bench:
        w = fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    for d, t in docs:
        w, hit, items = fold(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found is not None:
                    hit |= set(range(k, k + n))
                    items |= found - {None}
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 700])
def test_decontamination(spark, sf_dir, docs, block_bytes):
    extra = [(900, "one two three"), (901, None), (902, ""), (None, "no id at all"), (904, "tail tail tail tail tail tail tail tail tail tail tail"), (905, "Mail me: jane"), (905, "or +1 (456)")]
    bench = table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    got = sorted((tuple(r) for r in decontaminate.find(docs, bench, block_bytes=block_bytes).collect()), key=str)
    want = leaks(texts(docs), [(r.item_id, r.text) for r in bench.collect()])
    assert got == want
    clean = decontaminate.clean(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in want)


def test_decontamination_of_random_words(spark):
    rng = np.random.default_rng(5)
    row = lambda n: " ".join(rng.choice(list("aabc"), n))
    docs = spark.createDataFrame([(k, row(int(rng.integers(0, 200)))) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, row(int(rng.integers(1, 25)))) for k in range(40)], "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.find(docs, bench).collect()), key=str)
    assert got == leaks(texts(docs), [(r.item_id, r.text) for r in bench.collect()])


def test_near_matches_and_postings(spark):
    docs = spark.createDataFrame([(1, "x y rare z other q q q"), (2, "other q q q q q q q q rare"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "rare other")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.near_matches(docs, bench, 2, 5).collect()] == [(1, 7, 2, 5)]
    found = {(r.term, r.doc_id): r.positions for r in decontaminate.postings(docs).collect()}
    assert found[("q", 1)] == [5, 6, 7] and found[("rare", 2)] == [9]


def near_plain(docs, bench, terms, slop):
    """Around every place of an item's rarest term, the smallest span (of equal ones the last) that holds its rarest terms."""
    total, out = defaultdict(int), set()
    for _, t in docs:
        for w in fold(t):
            total[w] += 1
    for i, item in bench:
        rare = sorted(set(fold(item)), key=lambda w: (total[w], w.encode()))[:terms]
        for d, t in docs if rare else ():
            w = fold(t)
            for k in (k for k in range(len(w)) if w[k] == rare[0]):
                spans = [(b - a, -a, a, b) for a in range(max(0, k - slop + 1), k + 1) for b in range(k + 1, min(len(w), a + slop) + 1) if set(rare) <= set(w[a:b])]
                if spans:
                    out.add((d, i, *min(spans)[2:]))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_near_matches_of_random_words(spark, block_bytes):
    rng = np.random.default_rng(7)
    row = lambda n: " ".join(rng.choice(list("aaabbbcccdddefgh"), n))
    docs = spark.createDataFrame([(k, row(int(rng.integers(0, 40)))) for k in range(60)] + [(100, "p q r s other"), (101, "rare a b other")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(k, row(int(rng.integers(1, 8)))) for k in range(30)] + [(50, "rare other"), (51, "rare nowhere")], "item_id long, text string")
    want = near_plain(texts(docs), [(r.item_id, r.text) for r in bench.collect()], 3, 6)
    assert (101, 50, 0, 4) in want and len(want) > 100
    got = decontaminate.near_matches(docs, bench, 3, 6, block_bytes)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_index_query_returns_proximity_and_stores_the_index(spark, sf_dir):
    got = queries.op8_positional_index(spark, sf_dir).collect()
    docs, bench = texts(table(spark, sf_dir, "documents")), [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert sorted((r.doc_id, m.item_id, m.begin, m.end) for r in got for m in r.near) == near_plain(docs, bench, 6, 12)
    assert all(r.n_near == len(r.near) for r in got)
    index = decontaminate.build(table(spark, sf_dir, "documents"))
    assert index.agg(F.sum("documents"), F.sum("words")).first() == (len(docs), sum(len(fold(t)) for _, t in docs))
    again = decontaminate.answer(index, table(spark, sf_dir, "benchmark")).collect()  # from the stored files alone
    assert sorted(again, key=str) == sorted(got, key=str)


def sets_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = defaultdict(int)
    for ks in where.values():
        for a in range(len(ks)):
            for b in range(a):
                common[ks[b], ks[a]] += 1
    for (a, b), c in common.items():
        if 100 * c >= 70 * (len(sets[a]) + len(sets[b]) - c):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    low = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        low[root(k)].append(d)
    best = {r: min((d for d in ds if d is not None), default=None) for r, ds in low.items()}
    return sorted(((d, len(s), d if not s else best[root(k)], (d if not s else best[root(k)]) == d) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("small", [12, 2])
def test_near_duplicates(docs, small):
    got = sorted((tuple(r) for r in near_dup.components(docs, small=small, block=5).collect()), key=str)
    assert got == groups(texts(docs))


def test_near_duplicates_of_a_hot_group(spark):
    """A loose and large group: many variants of one text, most pairs of them close to the threshold."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    base = [words[k] for k in rng.integers(0, 3000, 150)]
    rows = []
    for k in range(260):
        t = list(base)
        for _ in range(int(rng.integers(0, 8))):
            t[int(rng.integers(0, 150))] = words[int(rng.integers(0, 3000))]
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small, block in ((2, 40), (12, 40), (2, 1000)):
        assert sorted((tuple(r) for r in near_dup.components(docs, small=small, block=block).collect()), key=str) == groups(rows)


def test_survivors(spark, odd):
    kept = near_dup.survivors(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "7", "8", "9", "-5", "10"])


def test_survivors_of_null_and_repeated_ids(spark):
    """Near copies without an id, texts under one id, and repeated rows: one row of each group stays."""
    words = [f"w{k}" for k in range(100)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), "quite another text " + " ".join(words[50:20:-1])
    rows = [(None, a), (None, b), (None, a), (None, c), (5, b), (5, c), (5, c), (3, c), (None, None), (None, ""), (6, " "), (6, " ")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _own string").repartition(3)
    kept = near_dup.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, b), (3, c), (None, None), (None, ""), (6, " "), (6, " ")], key=str)


@pytest.mark.parametrize("union, common", [(4, 3), (10, 7), (60, 42), (400, 280), (3000, 2100)])
def test_sketches_of_close_sets_meet(union, common):
    """Bands, narrow and wide sketches lose no pair at the threshold, however short the texts."""
    rng = np.random.default_rng(union)
    for _ in range(100):
        u = np.sort(rng.integers(0, 2**64, union, dtype=np.uint64))
        apart = rng.permutation(union)[common:]
        pair = [np.delete(u, apart[: len(apart) // 2]), np.delete(u, apart[len(apart) // 2 :])]
        n = np.array([[len(s)] for s in pair])
        narrow, wide = near_dup.folded(near_dup.registers(pair)), near_dup.folded(near_dup.registers(pair, near_dup.WIDE))
        keys = near_dup.band_keys(near_dup.densified(near_dup.registers(pair)))
        assert (keys[0] == keys[1]).any()
        assert near_dup.plausible(narrow[:1], narrow[1:], *n, 0.7).all()
        assert len(near_dup.close(wide[:1], wide[1:], *n, np.ones((1, 1), bool), 0.7)[0]) == 1


def test_register_estimate_is_close():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 6000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    rng.shuffle(pool)
    err = []
    for j in (0.0, 0.3, 0.7, 0.9):
        common = int(round(2 * 1500 * j / (1 + j)))
        a = np.sort(pool[:1500])
        b = np.sort(np.concatenate([pool[:common], pool[1500 : 1500 + 1500 - common]]))
        reg = near_dup.registers([a, b])
        e, _, _ = near_dup.estimate(reg[:1], reg[1:], np.array([1500]), np.array([1500]))
        err.append(abs(float(e[0]) - j))
    assert max(err) < 0.15


def base_plain(text):
    """The stated patterns with the plain engine."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii(docs):
    rows = {}
    for r in pii.find(docs).collect():
        rows.setdefault((r.doc_id, r.base_sha256), []).append(r)
    for d, t in texts(docs):
        base = base_plain((t or "")[:2000] if t and len(t) >= 50_000 and t[:100] == t[0] * 100 else t or "")
        if t and len(t) >= 50_000 and t[:100] == t[0] * 100:
            base = pii.base_spans(t)
        r = rows[d, hashlib.sha256(pii.written(base).encode()).hexdigest()].pop()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(",")) | {""}
        assert len(spans) == len(base) + r.n_added


def test_base_patterns_on_random_strings():
    rng = np.random.default_rng(4)
    for alphabet in ("ab@.-1 ", "0123.. ", "45- 1", "+1() .-2x"):
        for _ in range(1500):
            t = "".join(rng.choice(list(alphabet), 40))
            assert pii.base_spans(t) == base_plain(t), t


def test_numbers_of_many_zeros_and_shapes_of_long_words(spark):
    zeros = "0" * 5000
    text = f"host {zeros}.1.1.1 and 0.{zeros}256.1.1 and {zeros}255.0.00.1 end"
    want = [(5, 1, 5 + 5006), (text.index("255."), 1, text.index(" end"))]
    want[1] = (want[1][0] - 5000, *want[1][1:])
    assert [s for s in pii.base_spans(text) if s[1] == 1] == want
    assert pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_ip == 2
    for short in ("q(at)b(dot)cc", "q[at]b.cc", "q@b"):
        assert pii.shape("w" * 70 + short) == pii.shape(short)
    spans = lambda t: [(k, b - a) for a, k, b in pii.all_spans([t], pii.default_field())[0][1]]
    for host in ("mail.host.com", "w" * 70 + ".host.com"):
        assert spans(f"write to jane12 (at) {host} now") == [(0, 12 + len(host))]


def test_chain_decoding_is_exact():
    model = pii.default_field()
    rng = np.random.default_rng(1)
    chains = [np.where((c := rng.integers(0, len(model.own), int(rng.integers(0, 9)))) == model.EDGE, 0, c).astype(np.int32) for _ in range(300)]
    for chain, y in zip(chains, model.decode_all(chains)):
        if not len(chain):
            continue
        e = model.emissions(chain)
        score, back = e[0], []
        for t in range(1, len(chain)):
            through = score[:, None] + model.move
            back.append(through.argmax(0))
            score = through.max(0) + e[t]
        value = lambda ys: sum(e[t, v] for t, v in enumerate(ys)) + sum(model.move[a, b] for a, b in zip(ys, ys[1:]))
        assert abs(value(list(y)) - score.max()) < 1e-9


def test_field_on_held_out_rows():
    model = pii.default_field()
    good = total = wrong = 0
    for row in pii.labelled_rows(seed=99, rows=300):
        y = model.decode(model.code([w for w, _ in row]))
        gold = np.array([k for _, k in row])
        good, total, wrong = good + int(((y == gold) & (gold > 0)).sum()), total + int((gold > 0).sum()), wrong + int(((y > 0) & (gold == 0)).sum())
    assert good / total > 0.93 and wrong / total < 0.04


def test_redaction():
    text = "write to jane@a.example.com, or call (456) 555-2186 now"
    (base, more), = pii.all_spans([text], pii.default_field())
    assert pii.redacted(text, base + more) == "write to <EMAIL>, or call <PHONE> now"


def test_toxicity(spark, odd):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows, labels = [], []
    for k in range(900):
        w = [word() for _ in range(40)]
        y = k % 6 == 0
        if y:
            w[3], w[20] = "scumbag", "women" if k % 12 == 0 else "idiot"
            w[30] = "idiot"
        elif k % 7 == 0:
            w[5] = "men"
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, r in got.items() if r.held_out} == held
    truth = {k: y for k, _, y in labels}
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    # labels are learnt from the rest alone: turning those held out changes nothing
    turned = spark.createDataFrame([*((k, q, 1 - y if k in held else y) for k, q, y in labels), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, turned).weights == model.weights
    assert toxicity.classify(odd, model).count() == len(ODD)
    assert toxicity.classify(odd, toxicity.train(odd, marks.limit(0))).agg(F.max("predicted")).first()[0] == 0


def test_counterfactual_term_shrinks_the_gap():
    rng = np.random.default_rng(8)
    texts_, y = [], []
    for k in range(400):
        toxic = k % 4 == 0
        t = {f"n{n}".encode() for n in rng.integers(0, 50, 6)} | ({b"vile"} if toxic else set())
        if rng.random() < (0.5 if toxic else 0.05):
            t.add(b"women")
        texts_.append(t)
        y.append(int(toxic))
    gap = {}
    for c in (0.0, 20.0):
        m = toxicity.fit(texts_, np.array(y), np.ones(len(y)), counterfactual=c)
        gap[c] = abs(m.score(b"women n1") - m.score(b"men n1"))
    assert gap[20.0] < 0.5 * gap[0.0]


def test_swapped_sentences_score_alike(spark):
    """Terms of 5 and more bytes have beginnings as features, which the swaps must move too."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(2000):
        toxic = k % 4 == 0
        w = [f"n{n}" for n in rng.integers(0, 50, 6)] + (["vile"] if toxic and rng.random() < 0.7 else [])
        w += (["muslim"] if rng.random() < (0.4 if toxic else 0.05) else []) + (["christian"] if rng.random() < 0.05 else [])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odds = lambda t: math.log(model.score(t) / (1 - model.score(t)))
    for other in ("christian", "jewish", "sikh"):
        assert abs(odds("n1 n2 muslim n3") - odds(f"n1 n2 {other} n3")) < 0.5
    assert model.score("n1 vile n2") > 0.5


def test_urls(spark, sf_dir):
    odd_urls = [None, "", "no scheme", "http://COM/en/1", "ftp://a.b.example.com/en/77?q=1#f", "x://example.net/de/8", "x://notexample.net/de/8", "https://host", "://", "a://b?c/d", "http://net/de/", "http://x.org/es", "http://x.org/es/ü\nz", "http://İ.COM/en/", "u" * 5000 + "://h/p"]
    pages = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(10**6 + k, u) for k, u in enumerate(odd_urls)], "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for p in pages.collect():
        host = path = ""
        if p.url is not None and "://" in p.url:
            rest = p.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(rule), rule, v) for v, rule in url_filter.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/") :])]
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None), p.url
        assert r.verdict == max(fit)[2] if fit else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_trees_on_held_out_labels(spark):
    """Labels that no rule gives: trees fitted to one part of a labelled table judge the other."""
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), n))

    def url():
        if bad := rng.random() < 0.4:
            return f"http://{word(4)}{rng.integers(100, 9999)}.{rng.choice(['top', 'info', 'com'])}/{word(9)}?{'&'.join(f'{word(2)}={rng.integers(10**6)}' for _ in range(int(rng.integers(2, 6))))}", bad
        return f"https://{rng.choice(['www', 'en', 'news'])}.{word(8)}.{rng.choice(['edu', 'info', 'com'])}/{word(5)}/{word(7)}.html", bad

    rows = [(k, *url()) for k in range(1600)]
    labelled = spark.createDataFrame([(u, int(b), "x") for k, u, b in rows if k % 4], "url string, blocked int, host string").unionByName(spark.createDataFrame([(None, 1, "x"), ("http://a.b/", None, "x")], "url string, blocked int, host string"))
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u, _ in rows if k % 4 == 0] + [(None, rows[0][1], "h", "v"), (0, rows[0][1], "h", "v")], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(pages, rules=(), labelled=labelled).collect()
    assert len(got) == 402 and {r.verdict for r in got if r.page_id in (None, 0)} == {"block" if rows[0][2] else "allow"}
    assert all(r.rule is None for r in got)
    assert np.mean([(r.verdict == "block") == rows[r.page_id][2] for r in got if r.page_id is not None]) > 0.93


def test_boosted_trees_learn():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = url_filter.boost(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95


def test_shards(docs):
    rows = hilbert.shard(docs).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts(docs)), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots[k]) for k in range(8)]
    assert max(n) - min(n) <= 1
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_string_cuts(spark):
    """Cuts are the values at the quantiles, of whole strings however alike they begin."""
    rng = np.random.default_rng(3)
    names = [f"https://crawl.example.org/segment-{k:04d}" for k in range(300)] + ["", "é", "Z"]
    values = [names[int(k)] for k in rng.integers(0, len(names), 4000)] + [names[7]] * 2000
    df = spark.createDataFrame([(v,) for v in [*values, None]], "value string").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ordered = sorted(values, key=str.encode)
    held = Counter(ordered[-(-k * len(ordered) // 16) - 1] for k in range(1, 17))
    want, below = [], 0
    for v in sorted(held, key=str.encode):
        want.append((v, below, held[v]))
        below += held[v]
    assert hilbert.string_cuts(df, 16) == want
    cells = {r.v: r.cell for r in spark.createDataFrame([(v,) for v in [*names, None]], "v string").select("v", hilbert.string_cell(F.col("v"), want, 16).alias("cell")).collect()}
    assert cells.pop(None) == 0
    inner = {v: (below, own) for v, below, own in want}
    for v, cell in cells.items():
        below, own = inner.get(v, (sum(n for c, n in held.items() if c.encode() < v.encode()), 0))
        assert cell == min(below + own // 2, 15)
    assert hilbert.string_cuts(df.limit(0), 16) == [] and hilbert.string_cuts(df.where("value is null"), 16) == []


def test_shards_prune(spark):
    """By the least and greatest values of its rows, a filter on one or two dimensions opens few of the shards."""
    rng = np.random.default_rng(4)
    rows = [(k, "x" * int(rng.integers(1, 4000)), f"lang-of-the-world-{rng.integers(4)}", f"https://source.example/{rng.integers(8)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    at = {r.doc_id: r.shard for r in hilbert.shard(docs).collect()}
    held = defaultdict(list)
    for k, text, lang, source in rows:
        held[at[k]].append((lang, source, len(text)))
    ranges = [[(min(x), max(x)) for x in zip(*v)] for v in held.values()]
    opened = lambda d, lo, hi: [r[d][0] <= hi and lo <= r[d][1] for r in ranges]
    both = [sum(a and b for a, b in zip(opened(0, lang, lang), opened(1, source, source))) for lang in {r[2] for r in rows} for source in {r[3] for r in rows}]
    assert np.mean(both) <= 4 and np.mean([sum(opened(2, n, n + 100)) for n in range(0, 4000, 200)]) <= 6


def test_hilbert_curve_visits_neighbours():
    side, bits = 8, 3
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(side**3))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def nearest(rows, every, k):
    out = {}
    for i, v in rows:
        if i % every == 0:
            other = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in other]
    return out


def test_nearest_neighbours(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in emb.collect()]
    want = nearest(rows, 20, 20)
    for shard_rows in (10_000, 120):
        got = defaultdict(list)
        for r in ann.search(emb, shard_rows=shard_rows, query_block=7).orderBy("query_id", "rank").collect():
            assert r.rank == len(got[r.query_id]) + 1
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
        assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) >= 0.9
        exact = dict(rows)
        assert all(abs(s - float(exact[i] @ exact[j])) < 1e-12 for i, x in got.items() for j, s in x)


@pytest.mark.parametrize("kind", ["unit", "normal", "log-normal", "clustered"])
def test_recall_on_lengths_of_all_sorts(kind):
    """Bands with graphs of their own against brute force; the band of most vectors is walked, not compared as a whole."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32))
    if kind == "clustered":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, len(x))] + 0.3 * x
    if kind in ("unit", "log-normal"):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "log-normal":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    x = x[np.argsort(-(x**2).sum(1))]
    bands = ann.Bands(x, 21, 1.15, 40, 72, 64)
    assert kind == "log-normal" or any(bands.graphs)
    for held in (bands, ann.Bands.opened(bands.arrays())):
        scores = x[::30] @ x.T
        edge = np.partition(scores, -21, axis=1)[:, -21]
        assert np.mean([(s[f] >= e).sum() / 21 for s, f, e in zip(scores, held.search(x[::30], 21), edge)]) >= 0.9


def test_nearest_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)) * np.exp(rng.normal(size=(1500, 1)))
    emb = spark.createDataFrame([(k, v.tolist(), -1, 0.5) for k, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, score double")
    want = nearest(list(enumerate(x)), 20, 20)
    got = defaultdict(set)
    for r in ann.search(emb, shard_rows=600, beam=64).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[i] & {j for j, _ in want[i]}) / 20 for i in want]) >= 0.9


def test_nearest_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(1, 30)]
    rows += [(20 * k, [1.0, 2.0, 3.0, 4.0]) for k in range(2, 60)]  # copies
    bad = [(None, [1.0] * 4), (3001, None), (3020, [0.0] * 4), (3040, [1.0, None, 1.0, 1.0]), (3060, [1.0, float("nan"), 1.0, 1.0]), (3080, [float("inf"), 0.0, 0.0, 0.0]), (3100, [1.0, 2.0]), (3120, [])]
    emb = spark.createDataFrame([*rows, *rows[:5], *bad], "vec_id long, embedding array<double>")
    want = nearest([(i, np.array(v)) for i, v in rows], 20, 20)
    got = defaultdict(list)
    for r in ann.search(emb).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(few).collect()] == [(0, 1, 1, 2.0)]
    assert ann.search(emb.limit(0)).count() == 0


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (packing.pack(none, BPE), tokenfile.round_trip(none, BPE), trie_count.count(none, public_tokenizers.path("piece_bpe_32k.model")), decontaminate.find(none, bench), near_dup.components(none), pii.find(none), hilbert.shard(none)):
        assert df.count() == 0


def test_pipeline(spark, sf_dir, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = texts(docs)
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "near_dup":
            assert sorted(kept) == sorted(d for d, _, _, keep in groups(before) if keep)
        if name == "decontaminate":
            bench = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            assert sorted(kept) == sorted(r[0] for r in leaks(before, bench) if not r[-1])
        if name == "pii":
            assert len(kept) == len(before) and not any(base_plain(t) for t in kept.values())
        docs = after
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in rows) == sum(len(encode(t, 0)) for _, t in texts(docs))
    d = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf_dir)
    assert d.count() > 0


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
