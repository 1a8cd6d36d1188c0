"""Decontamination, mixing and personal data against brute force, on awkward rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeflux.llm import decontaminate, mixing, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected_hits(text, items, n=8):
    w, hit, met = WORD.findall(low(text)), set(), set()
    for item, t in items:
        v = WORD.findall(low(t))
        k = min(n, len(v))
        for s in range(len(v) - k + 1) if v else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[s : s + k]:
                    hit |= set(range(i, i + k))
                    met.add(str(item))
    return len(w), len(hit), sorted(met)


@pytest.mark.parametrize("most", [10**6, 0])
def test_scan_matches_brute_force(spark, docs, prose, most):
    items = [(1, prose(12, 1)), (2, prose(9, 2)), (10, prose(3, 3)), (3, None), (None, prose(10, 4)), (4, "..."), (1, prose(12, 1))]
    passage = items[0][1].upper()
    texts = [prose(30), f"{prose(5)}, {passage}! {prose(4)}", f"{passage} {items[1][1]}", None, "", "...", items[2][1], f"{passage}{passage}", prose(4000) + " " + items[1][1], f"{passage} {items[1][1]}"]
    ids = [0, 1, 2, 3, 4, 5, 6, None, 8, 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs(texts, ids=ids), bench, broadcast_rows=most).collect()
    want = sorted((str(i), *map(str, expected_hits(t, [x for x in items if x[0] is not None]))) for i, t in zip(ids, texts))
    assert sorted((str(r.doc_id), str(r.n_words), str(len(r.hits)), str(r["items"])) for r in got) == want


@pytest.mark.parametrize("most", [10**6, 0])
def test_scan_of_very_long_texts(spark, docs, prose, most):
    item = prose(12, 21)
    text = f"{prose(9000)} {item} {prose(9000)} {item} {prose(2000)}"
    bench = spark.createDataFrame([(1, item), (2, prose(400, 22))], "item_id long, text string")
    got = decontaminate.scan(docs([text]), bench, broadcast_rows=most).first()
    assert (got.n_words, len(got.hits), got["items"]) == expected_hits(text, [(1, item), (2, prose(400, 22))])


def test_scan_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hits, r["items"]) for r in decontaminate.scan(docs(["a b"]), none).collect()] == [(2, [], [])]
    assert decontaminate.scan(docs(["a"]).limit(0), none).count() == 0


def test_decontaminate_cuts_and_drops(spark, docs, prose):
    a, b = prose(10, 11), prose(10, 12)
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    frame = docs([f"one. {a}; two", f"{a} {b}", "clean text, here", None])
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench).collect()}
    assert set(got) == {0, 2, 3} and got[0].text == "one. two" and got[0].n_chars == 8 and got[2].text == "clean text, here" and got[3].text is None
    assert got[2].asDict().keys() == dict.fromkeys(frame.columns).keys()


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in left) or 1)
        more = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def test_mix_meets_its_targets(docs, prose):
    texts = [prose(1 + i % 17) for i in range(900)] + [None, "", prose(3), prose(3)]
    sources = [(["a"] * 6 + ["b", "é", "z", None])[i % 10] for i in range(len(texts))]
    ids = [*range(902), 5, None]
    frame = docs(texts, ids=ids, sources=sources)
    got = mixing.mix(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.size == 0 or r.taken % r.size == 0 and 0 <= r.taken <= 2 * r.size
    want = targets(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 17
    assert len(got) == len(texts)
    kept = mixing.apply_mix(frame).collect()
    assert sum(r.mix_words_ for r in kept) == sum(taken.values()) and {"hash", "size", "c"} <= set(kept[0].asDict())


def test_mix_of_nothing(docs):
    assert mixing.mix(docs(["a"]).limit(0)).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs([None, " "])).collect()] == [(0, 0.0, 0)] * 2


SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base(text):
    out = []
    for j, (kind, shape) in enumerate(SHAPES.items()):
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), j, m.end()))
    return sorted(out)


AWKWARD = [
    None, "", "a@b.c_d@e.f", "a@b@c.d x@y", "x..y@z-1.co.uk.", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.2.3 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567, +123, ++49 30 1234567",
    "é😀 a@b.cd 😀 10.0.0.1", "1" * 3000, "a" * 5000 + "@", "1.1." * 2000, "0 " * 4000 + "1", "x@" + "a." * 3000 + "a", " ".join(["m@n.op +1 (555) 123-4567"] * 300), "99999999999999999999999.1.1.1",
]


def test_base_spans_match_brute_force(docs):
    got = pii.find(docs(AWKWARD, ids=[*range(len(AWKWARD) - 1), None])).collect()
    want = sorted((str(i), base(t)) for i, t in zip([*range(len(AWKWARD) - 1), None], AWKWARD))
    assert sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.base]) for r in got) == want
    assert all({(s.start, s.kind) for s in r.base} <= {(s.start, s.kind) for s in r.spans} for r in got)


def test_contexts_find_what_shapes_miss(docs, prose):
    texts = [f"{prose(6)} write to user{i}@mail.example.org {prose(5)}" for i in range(12)] + [f"{prose(4)} write to bob@localhost, please", f"{prose(4)} in the year 1999 {prose(3)}", "write to nobody"] * 2
    got = {(r.doc_id): [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.find(docs(texts)).collect()}
    assert got[12] == got[15] == ["bob@localhost"] and got[13] == [] and got[14] == []
    masked = {r.doc_id: r.text for r in pii.mask(docs(texts)).collect()}
    assert masked[12].endswith("write to <email>, please") and masked[13] == texts[13]


def test_digest_of_nothing(docs):
    got = pii.find(docs(["", None])).select(F.sha2(pii.digest(F.col("spans")), 256).alias("d")).collect()
    assert {r.d for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(docs(["a"]).limit(0)).count() == 0


def _spans(docs, texts):
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.find(docs(texts)).collect()}


def test_spans_take_in_groups_of_digits(docs, prose):
    texts = [f"{prose(5)} call me at +4930123456{i} {prose(4)}" for i in range(10, 30)]
    texts += ["please call me at 030 1234 5678, 12 of us wait", "call me at DE44 5001 0517 5407 3249 31 today", "call me at 030. 12 wait"]
    got = _spans(docs, texts)
    assert got[20] == ["030 1234 5678"] and got[21] == ["DE44 5001 0517 5407 3249 31"] and got[22] == ["030"]


def test_contexts_hold_other_tokens(docs, prose):
    texts = [f"Room 12, fax +4930123456{i} {prose(4)}" for i in range(10, 30)] + ["Room 12, fax 5551234 or so"]
    assert "5551234" in _spans(docs, texts)[20]


def test_found_instances_bring_up_other_contexts(docs, prose):
    texts = [f"{prose(5)} write to user{i}@mail.example.org {prose(4)}" for i in range(20)]
    handles = [f"box{i}@localhost" for i in range(10)]
    texts += [f"{prose(5)} write to {h} {prose(4)}" for h in handles] + [f"{prose(5)} signed by {h} {prose(4)}" for h in handles]
    texts += [f"{prose(5)} signed by guest7@localhost"]
    assert _spans(docs, texts)[len(texts) - 1] == ["guest7@localhost"]
