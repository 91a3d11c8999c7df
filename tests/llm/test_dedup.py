import random

import numpy as np
import pytest

import quarry.llm.near_dedup as near
import quarry.llm.suffix_dedup as suffix
from helpers import awkward, components, covered, shingles, table
from quarry.llm.common import connected_components
from quarry.llm.line_dedup import line_dedup
from quarry.llm.near_dedup import exact_groups, near_groups
from quarry.llm.shingles import Shingler
from quarry.llm.suffix_dedup import matching_marks, remove_repeats


# ------------------------------------------------------------------ lines
def test_line_ratio(spark):
    site = [(k, f"own {k}\nmenu\n\nrare") for k in range(10)] + [(k, f"own {k}\nmenu") for k in range(10, 40)]
    out = {r["doc_id"]: r for r in line_dedup(table(spark, site, "s"), ratio=0.5).collect()}
    assert out[3]["text"] == "own 3\n\nrare" and (out[3]["n_lines"], out[3]["n_dropped"]) == (4, 1)
    assert out[20]["text"] == "own 20"
    small = {r["doc_id"]: r["n_dropped"] for r in line_dedup(table(spark, site[:3], "s"), ratio=0.5).collect()}
    assert set(small.values()) == {0}                                # below min_pages
    other = table(spark, site, "s").unionByName(table(spark, [(100, "menu")], "t"))
    assert {r["doc_id"]: r["text"] for r in line_dedup(other, ratio=0.5).collect()}[100] == "menu"


def test_copies_above_the_ratio_lose_their_text(spark):
    site = [(k, "one text\n\nof a page") for k in range(4)] + [(k, f"own {k}") for k in range(4, 39)]
    out = {r["doc_id"]: r["text"] for r in line_dedup(table(spark, site, "s")).collect()}          # 4 of 39 pages
    assert {out[k] for k in range(4)} == {""} and all(out[k] == f"own {k}" for k in range(4, 39))
    out = {r["doc_id"]: r["text"] for r in line_dedup(table(spark, site + [(39, "own 39")], "s")).collect()}   # 4 of 40
    assert out[0] == "one text\n\nof a page"


def test_line_cases(spark):
    docs = awkward(spark)
    out = line_dedup(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got == {(r["doc_id"], r["text"], 0 if r["text"] is None else r["text"].count("\n") + 1, 0) for r in docs.collect()}
    assert line_dedup(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ near copies
def variants(seed, n, base_words=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(base_words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


def check_groups(spark, docs, rows):
    sets = {}
    for k, t in rows:
        if k is not None:
            sets[k] = sets.get(k, set()) | shingles(t)
    want = components(sets)
    for r in near_groups(docs).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (
            want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_near_groups_equal_brute_force(spark):
    texts = [t for s in range(12) for t in variants(s, 9)]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts + [texts[0], texts[0].upper(), None, "", "a b", "A  B", " \n"]))
    check_groups(spark, table(spark, rows), rows)


def test_crowded_group_in_blocks(spark, monkeypatch):
    texts = variants(5, 150, 80)
    rows = list(enumerate(texts))
    sets = {k: shingles(t) for k, t in rows}
    want = components(sets)
    for name, value in (("MEMBERS", 40), ("REGION", 16), ("BUFFER", 60)):
        monkeypatch.setattr(near, name, value)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(table(spark, rows)).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert all(got[k] >= want[k] for k in want) and len(wrong) <= 2    # blocks far below the sizes in use


def test_crowded_star_equals_brute_force(spark, monkeypatch):
    # copies that are linked only through the text they were made from, .82 to it and .74 at most to each other
    base = [f"b{k}" for k in range(104)]
    places = [(a, b) for a in range(4, 104, 5) for b in range(4, a, 5)]
    texts = []
    for n, changed in enumerate(places):
        w = list(base)
        for k in changed:
            w[k] = f"x{n}at{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:80] + [f"y{n}end{k}" for k in range(24)]) for n in range(20)]      # linked to nothing
    rows = list(enumerate([*texts, " ".join(base)]))
    want = components({k: shingles(t) for k, t in rows})
    assert sorted(want.values()).count(0) == len(places) + 1 and len(set(want.values())) == 21
    for name, value in (("MEMBERS", 40), ("REGION", 16), ("BUFFER", 60)):
        monkeypatch.setattr(near, name, value)
    assert {r["doc_id"]: r["component_id"] for r in near_groups(table(spark, rows)).collect()} == want


def test_near_cases(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_groups(spark, docs, rows)
    assert near_groups(docs.limit(0)).count() == 0


def test_exact_groups_at_the_border():
    a = np.arange(100, dtype=np.uint64)
    b, c = np.arange(14, 100, dtype=np.uint64), np.arange(26, 100, dtype=np.uint64)
    d = np.arange(25, 100, dtype=np.uint64)
    assert exact_groups([a, d]).tolist() == [0, 0]                    # 75 of 100
    assert exact_groups([a, c]).tolist() == [0, 1]                    # 74 of 100
    assert exact_groups([a, b, c]).tolist() == [0, 0, 0]              # through b
    assert exact_groups([a[:0], a[:0], a]).tolist()[2] not in exact_groups([a[:0], a[:0], a]).tolist()[:2]


def test_shingles_words():
    s = Shingler()
    assert len(s.shingles("a b c")) == 1 and len(s.shingles(" \t\n")) == 0 and len(s.shingles(None)) == 0
    assert (s.shingles("A b\x0bC\x0cd e f") == s.shingles("a  b c d\re f ")).all()
    assert len(s.shingles("a b c d e f")) == 2 and len(np.intersect1d(s.shingles("é b c d e"), s.shingles("É b c d e"))) == 0


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, 105), (105, 101), (7, 7)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 105: 100}


# ------------------------------------------------------------------ repeats
def test_marks_equal_brute_force():
    r = random.Random(4)
    for _ in range(80):
        width = r.choice([6, 12, 30])
        base = bytes(r.choice(b"ab\x00c") for _ in range(150))
        parts = []
        for _ in range(r.randint(1, 10)):
            a = r.randint(0, 120)
            p = base[a:a + r.randint(1, 90)]
            parts.append(bytes(r.choice(b"ab") for _ in range(8)) + p if r.random() < 0.5 else p if r.random() < 0.7 else b"a" * r.randint(1, 60))
        got = [[False] * len(p) for p in parts]
        for k, a, b in matching_marks(parts, width):
            got[k][a:b] = [True] * (b - a)
        assert got == covered(parts, width)


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [text(90), text(60), text(200)]
    texts = [text(r.randint(0, 150)) + r.choice(shared)[r.randint(0, 30):] + text(r.randint(0, 150)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "z" * 300, "ab" * 100, "short", shared[0]]
    docs = table(spark, list(enumerate(texts)))
    raw = [(t or "").encode() for t in texts]
    marks = covered(raw, 50)
    for row in remove_repeats(docs, length=50).collect():
        mark, data = marks[row["doc_id"]], raw[row["doc_id"]]
        assert bytes(row["kept"]) == bytes(b for b, m in zip(data, mark) if not m)
        assert row["n_bytes"] == len(data)
        own = [False] * len(data)
        for s in row["spans"]:
            assert not own[s["start"]] and (s["start"] == 0 or not mark[s["start"] - 1])
            own[s["start"]:s["end"]] = [True] * (s["end"] - s["start"])
        assert own == mark


def test_repeat_cases(spark):
    docs = awkward(spark)
    out = remove_repeats(docs).collect()
    assert len(out) == docs.count() and remove_repeats(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_bytes"] for r in out}[1] == 0


def test_streamed_groups_keep_their_rows(monkeypatch):
    monkeypatch.setattr(suffix, "HELD", 3)
    rows = np.array(sorted([(5, 1)] * 9 + [(5, 2)] + [(5, 3)] * 2 + [(6, 1)] + [(7, 4)] * 2 + [(8, 1), (8, 2)]), np.int64)
    groups, out = suffix._Groups(), []
    for k in range(0, len(rows), 2):
        part = rows[k:k + 2]
        at = np.arange(k, k + len(part))
        if (x := groups.add([part[:, 0], part[:, 1], at, at, at])) is not None:
            out.append(x)
    if (x := groups.end()) is not None:
        out.append(x)
    kind, many, h, d, t1 = (np.concatenate([x[c] for x in out]) for c in range(5))
    told = sorted(t1[kind == 0].tolist())
    assert told == [k for k, r in enumerate(rows.tolist()) if rows.tolist().count(r) > 1]
    copies = sorted(zip(h[kind == 1].tolist(), d[kind == 1].tolist(), many[kind == 1].tolist()))
    assert copies == [(5, 1, True), (5, 2, False), (5, 3, True), (8, 1, False), (8, 2, False)]
