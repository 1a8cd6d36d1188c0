"""Jaccard join, repeated bytes, exact search and archives against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeflux.llm import bitmaps, jaccard, suffixes, topk, warc
from codeflux.llm.common import components


def shingles(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(texts, ids, k, pct):
    sets = [shingles(t, k) for t in texts]
    link = {i: i for i in ids}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if a and b and 100 * len(a & b) >= pct * len(a | b):
            x, y = sorted((root(i), root(j)))
            link[y] = x
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


@pytest.mark.parametrize(("k", "pct", "frequent", "per_group"), [(4, 85, 24, 4), (4, 85, 3, 2), (5, 80, 3, 4), (2, 60, 2, 3), (5, 80, 1, 1)])
def test_groups_match_brute_force(docs, monkeypatch, k, pct, frequent, per_group):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "PER_GROUP", per_group)
    rng = random.Random(k * pct + frequent)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=40)
    texts = []
    for _ in range(6):
        root = rng.choices(words, k=rng.choice([12, 60, 150]))
        for _ in range(12):
            copy = list(root)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=60) + shared + rng.choices(words, k=40)) for _ in range(20)]
    texts += ["", None, "one", "ONE", "two words", "  two\twords ", "  ", texts[0], texts[0].upper()]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs(texts, ids=ids), k, pct).collect()}
    assert got == classes(texts, ids, k, pct)


def altered(rng, words, at):
    copy = list(words)
    for i in at:
        copy[i] = f"q{rng.randrange(10**9)}"
    return copy


def hot_families(rng):
    """Two families of 60 around texts that overlap just below the threshold; most members are too far from each other."""
    root = [f"w{i}" for i in range(120)]
    other = altered(rng, root, range(0, 24, 3))
    out = []
    for base in (root, other):
        for _ in range(60):
            out.append(" ".join(altered(rng, base, [rng.randrange(120) for _ in range(rng.choice([1, 2, 3, 4]))])))
    return out


@pytest.mark.parametrize("bits", [27, 8])
def test_hot_families_below_the_threshold(docs, monkeypatch, bits):
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)  # 8: a map in which all tokens seem frequent
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    texts = hot_families(random.Random(11))
    ids = list(range(len(texts)))
    frame = docs(texts, ids=ids)
    want = classes(texts, ids, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame).collect()} == want
    sets = [shingles(t, 5) for t in texts]
    links = jaccard.spanning_links(frame).collect()
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b]) for r in links)
    root = {i: i for i in ids}
    for r in links:
        old, new = root[r.b], root[r.a]
        root = {i: new if c == old else c for i, c in root.items()}
    assert all((root[i] == root[j]) == (want[i][1] == want[j][1]) for i in ids for j in ids)


def test_very_long_texts_are_joined_whole(docs):
    rng = random.Random(12)
    long = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    texts = [" ".join(x) for x in (long, altered(rng, long, range(0, 20_000, 60)), altered(rng, long, range(0, 20_000, 20)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs(texts, ids=[9, 8, 7])).collect()}
    assert got == classes(texts, [9, 8, 7], 5, 80) and got[9][1] == 8 and got[7][1] == 7


def test_groups_of_awkward_rows(docs):
    got = jaccard.similar_groups(docs(["a b c d e f", "a b c d e f", "", None], ids=[None, 3, 4, None])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("3", 2, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 2, "None")]
    assert jaccard.similar_groups(docs(["a"]).limit(0)).count() == 0
    kept = jaccard.keep_one(docs(["a b c d e f", "a b c d e  f", "z", None, "z"], ids=[2, 1, 5, 6, 5]))
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [(1, "a b c d e  f"), (5, "z"), (6, "None")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_bitmaps_never_miss():
    rng = np.random.default_rng(1)
    seen = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    packer = bitmaps.Packer(4)
    packed = [b for x in (seen, seen[:100]) for b in [*packer.add(x), *packer.flush()]]
    cells = [bitmaps._unpack(i, d, 4) for b in packed for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    keys = np.sort(np.concatenate([np.repeat(k, n) for k, n in cells]))
    assert (keys == np.sort(np.concatenate([seen, seen[:100]]) >> np.uint64(24))).all()


def test_repeats_are_summed_before_the_shuffle():
    packer = bitmaps.Packer(4)
    (batch,) = [*packer.add(np.full(1000, 7 << 60, np.uint64)), *packer.flush()]
    keys, times = bitmaps._unpack(batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), 4)
    assert len(keys) == 1 and times.tolist() == [1000]


def removed(texts, n):
    raws, count = [(t or "").encode() for t in texts], {}
    for b in raws:
        for s in range(len(b) - n + 1):
            count[b[s : s + n]] = count.get(b[s : s + n], 0) + 1
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if count[b[s : s + n]] > 1:
                gone[s : s + n] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("windows", "segment", "bits"), [(1 << 21, 1 << 20, 27), (40, 2000, 27), (5, 1 << 20, 8)])
def test_repeats_match_brute_force(docs, prose, monkeypatch, windows, segment, bits):
    monkeypatch.setattr(suffixes, "WINDOWS", windows)  # 5: every window is dealt by place and first bytes
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    monkeypatch.setattr(bitmaps, "MOST_BITS", bits)
    a, b = prose(60, 1), prose(50, 2)
    near = [a[:i] + "é" + a[i + 1 :] for i in range(5, 300, 37)]
    texts = [prose(80), f"{prose(30)} {a} {prose(20)}", f"{a}{b}", f"{prose(9)}{b}{b}", *near, a, a, "x" * 450, "ab" * 150, None, "", "y" * 199, f"{prose(5)}{a[50:260]}{prose(5)}", prose(3000)]
    got = suffixes.repeated_spans(docs(texts, ids=[*range(len(texts) - 1), None])).collect()
    want = sorted(zip(map(str, [*range(len(texts) - 1), None]), removed(texts, 200)))
    assert sorted((str(r.doc_id), (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in got) == want
    assert suffixes.repeated_spans(docs(["a"]).limit(0)).count() == 0


def test_long_texts_are_cut_into_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    text = "".join(random.Random(3).choices("abcdef", k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["node", "text"])
    starts = [o + s for _, data, at, o in suffixes._pieces([batch], 200) for x, y in zip(*suffixes.anchors(data, at)[2:]) for s in range(x, y + 1)]
    assert sorted(starts) == list(range(len(text) - 199))


def test_deep_shallow_sorting():
    rng = random.Random(4)
    data = "".join(rng.choices("ab", k=400)).encode() * 2 + b"a" * 300 + bytes(rng.choices(range(256), k=300))
    starts = np.arange(len(data) - 64 + 1)
    group = starts % 3
    order, same = suffixes.sort_windows(data, starts, group, length=64, shallow=16)
    texts = [data[s : s + 64] for s in starts]
    keys = [(group[i], texts[i]) for i in order]
    assert keys == sorted(keys) and same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]
    got = suffixes.repeated(data, starts, np.zeros(len(starts), np.int64), length=64, shallow=16)
    assert got.tolist() == [texts.count(t) > 1 for t in texts]
    assert suffixes.repeated(b"", starts[:0], group[:0]).tolist() == []


@pytest.mark.parametrize(("block", "chunk"), [(1024, 512), (7, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "FEWEST", chunk)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, rng.choice([0.1, 1])) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)] + [(900, [1.0, 2.0]), (920, [3.0, -1.0])]
    rows += [(None, rows[0][1]), (500, None), (501, []), (502, [math.nan] * 6), (503, [None] * 6), (504, [math.inf] * 6), rows[3]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % 20 == 0, k=20, n_pivots=5).collect()
    ok = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(topk.integer_vectors(frame.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_norms_and_one_crowded_cell(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) * 1e6 for _ in range(4)]) for i in range(120)] + [(1000 + i, [5e6, 5e6, 0.0, 1.0]) for i in range(2500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % 20 == 0, k=5).collect()
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q in (0, 20, 1000, 3480):
        want = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("few", [True, False])
def test_archives_round_trip(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FRAME_RECORDS", 3)
    monkeypatch.setattr(warc, "small", lambda df: few)
    long = "<p>é " * 50
    rows = [(5, "u5", long), (2, "u2", long), (9, "u\r\n%0A", long + "!"), (1, None, None), (3, "u3", ""), (4, "u4", "short"), (6, "u6", "short"), (2, "u2", long), (None, "n", long), (7, "u7", "x\r\n\r\ny" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = warc.write_archives(pages)
    got = sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(bundles).collect())
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        visit = h == long and i != 2
        want.append((str(i), str(u), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visit else "response", 2 if visit else None))
    assert got == sorted(want)
    found = warc.lookup(bundles, spark.createDataFrame([(9,), (7,)], "page_id long")).collect()
    assert {(r.page_id, r.payload.decode()) for r in found} == {(9, long + "!"), (7, "x\r\n\r\ny" * 30)}
    warc.export(bundles, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert files and all(sum(n for _, n, _ in warc.frames(f.read_bytes())) < f.stat().st_size for f in files)
    again = warc.read_archives(warc.load(spark, str(tmp_path))).drop("payload").collect()
    assert sorted(map(str, again)) == sorted(map(str, warc.read_archives(bundles).drop("payload").collect()))
    big = spark.createDataFrame([(i, "u", "y" * 3_000_000) for i in range(2)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_archives(warc.write_archives(big)).collect()) == [(0, 3_000_000, "response"), (1, 3_000_000, "revisit")]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_sets_of_a_batch_take_little_memory():
    """The batch of a Python worker is 4 MB; what is held beside it follows the run of rows, not the batch."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{i}x{j}" for j in range(600)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], ["node", "text"])
    tracemalloc.start()
    try:
        rows = sum(len(sets) for _, sets in jaccard._sets([batch], 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1000 and batch.nbytes > 4 << 20 and peak < 24 << 20
