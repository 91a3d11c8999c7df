import random
import zlib

import numpy as np
import pytest

from quarry.llm.queries import op11_toxicity
from quarry.llm.toxicity import (ADDRESSED, MARK, PLAIN, QUOTED, REPORTED, WORD, HitFinder, LexiconAutomaton, choose_entries,
                                 edits_allowed, fit, held_out, score_toxicity, train)
from testdata import SF_MID

ENTRIES = [w + MARK for w in ("idiot", "scum", "worthless", "disgusting", "moron")] + ["lowe", "réeuxva", "trashier"]


def distance_rows(a, b):
    rows = [list(range(len(b) + 1))]
    for i, ch in enumerate(a, 1):
        row = [i]
        for j, c in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (ch != c)))
        rows.append(row)
    return rows


def nearest(word):
    """Brute force: least distance to an entry, a stem to any beginning of the word."""
    best = None
    for e in ENTRIES:
        rows = distance_rows(e.rstrip(MARK), word)
        d = rows[-1][-1] if e.endswith(MARK) else min(rows[-1])
        if d <= edits_allowed(e) and (best is None or d < best):
            best = d
    return best


def test_automaton_equals_brute_force():
    r = random.Random(5)
    words = {"idiot", "lower", "lowe", "low", "é", "moronmoron", "x" * 5000, "idiots" + "z" * 300, "réeuxvable"}
    for e in ENTRIES:
        for _ in range(300):
            w = list(e.rstrip(MARK))
            for _ in range(r.randint(0, 3)):
                k = r.randint(0, len(w))
                w[k:k + r.choice((0, 1))] = r.choice(("", "a", "t", "é", "0"))
            words.add("".join(w) + r.choice(("", "", "s", "ly")))
    words = sorted(w for w in words if w)
    entry, edits, same = LexiconAutomaton(ENTRIES).match(words)
    for w, e, d, s in zip(words, entry, edits, same):
        assert (None if e < 0 else d) == nearest(w), w
        assert e < 0 or s == (w[0] == ENTRIES[e][0])


def kinds(text):
    (hits, n_words), = HitFinder(LexiconAutomaton(ENTRIES)).find([text])
    assert n_words == len(WORD.findall((text or "").lower()))
    return sorted((ENTRIES[x[0]].rstrip(MARK), x[1], x[3]) for x, n in hits.items() for _ in range(n))


def test_context_of_hits():
    assert kinds("What a moron") == [("moron", 0, PLAIN)]
    assert kinds("You are an IDIOT, a m0ron and worthles sc*m") == [
        ("idiot", 0, ADDRESSED), ("moron", 1, PLAIN), ("scum", 1, PLAIN), ("worthless", 1, PLAIN)]
    assert kinds('Paper: "the idiot left" he noted') == [("idiot", 0, QUOTED)]
    assert kinds("> some idiot\nno") == [("idiot", 0, QUOTED)]
    assert kinds("they called him idiot") == [("idiot", 0, REPORTED)]
    assert kinds("5\" wide moron") == [("moron", 0, PLAIN)]
    assert kinds("an idiooooot, moron$$$") == [("idiot", 0, PLAIN), ("moron", 0, PLAIN)]
    assert kinds(None) == kinds("") == kinds("nothing here") == []


def test_quotation_scores_below_abuse():
    finder = HitFinder(LexiconAutomaton(ENTRIES))
    toxic, clean = finder.find(["some idiot and a moron here"] * 30), finder.find(["plain words in a row"] * 90)
    model = fit(toxic + clean, np.array([True] * 30 + [False] * 90), ENTRIES)
    abuse, quoted, misspelled, empty = model.scores(finder.find(
        ["this idiot is a moron", 'the word "idiot" is quoted', "this idiott is a morn", ""]))
    assert abuse > 0.9 > 0.5 > quoted >= empty
    assert misspelled > quoted


def test_entries_by_evidence():
    rows = [("idiot" + MARK, 80, 0), ("idi", 80, 0), ("the" + MARK, 500, 4000), ("lowe", 120, 1), ("lower" + MARK, 30, 0), ("low", 125, 90)]
    assert choose_entries(rows, 10_000, 80_000, evidence=60, ratio=8, limit=10) == ["lowe", "idiot" + MARK]


def brute_split(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_query_finds_held_out_toxic_rows(spark):
    rows = {r["doc_id"]: r for r in op11_toxicity(spark, SF_MID.replace("0.01", "0.1")).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(SF_MID.replace("0.01", "0.1") + "/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(r["held_out"] == brute_split(k) and 0 <= r["score"] <= 1 for k, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(labels[k], rows[k]["predicted"]) for k in labels if brute_split(k) and k in rows]
    caught = [p for t, p in held if t]
    left = [1 - p for t, p in held if not t]
    assert np.mean(caught) >= 0.9 and np.mean(left) >= 0.99


@pytest.fixture
def small(spark):
    docs = [(k, f"no{k} moron and so{k} idiot sat there" if k % 4 == 0 else f"so{k} words no{k} number to{k} of x{k} text", 1, "x") for k in range(1, 400)]
    docs += [(None, "an idiot", 1, "x"), (7, "an idiot", 1, "x"), (1000, None, 1, "x"), (1001, "", 1, "x"), (1002, "idiot " * 50_000, 1, "x")]
    labels = [(k, int(k % 4 == 0), 9) for k in range(1, 400)] + [(None, 1, 9), (5, None, 9), (8, 0, 9), (5000, 1, 9)]
    return (spark.createDataFrame(docs, "doc_id int, text string, hits int, toxic string"),
            spark.createDataFrame(labels, "doc_id int, toxic int, text int"))


def test_cases(spark, small):
    docs, labels = small
    model = train(docs, labels, evidence=10.0)
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == docs.count()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(of[7]) == 2 and of[1000][0]["score"] == of[1001][0]["score"] < 0.5
    assert of[1002][0]["n_hits"] == 50_000 and of[1002][0]["score"] > 0.5
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert all(h == brute_split(k) for k, h in flags.items())


def test_no_labels_and_no_rows(spark, small):
    docs, labels = small
    model = train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in score_toxicity(docs, model).collect()} == {round(1 / (1 + np.exp(2.0)), 6)}
    assert score_toxicity(docs.limit(0), train(docs.limit(0), labels)).count() == 0
