import math
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.llm.hard_negatives import NOTHING, Negatives, Positives, cluster_centres, exact_products, hard_negatives, walk
from quarry.llm.queries import op13_hard_negatives
from testdata import SF_MID

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank string, row int"


def brute(rows, shift=True):
    """(anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    kept = []
    for i, x, label in rows:
        if None in (i, x, label) or any(v is None or not math.isfinite(v) or abs(v) >= 2**23 / 256 for v in x):
            continue
        kept.append((i, (label + 1) % 10 if shift and i % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    width = max((len(v) for _, _, v in kept), default=0)
    ids, labels = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
    m = np.array([v + [0] * (width - len(v)) for _, _, v in kept], np.int64)
    out = []
    for a in np.flatnonzero(ids % 100 == 0):
        s = m @ m[a]
        order = np.lexsort((ids, -s))
        for p in [k for k in order if labels[k] == labels[a] and k != a][:5]:
            far = [k for k in order if labels[k] != labels[a] and 80 * s[p] <= 100 * s[k] <= 100 * s[p]][:5]
            out += [(ids[a], ids[p], r + 1, ids[k], s[p], s[k]) for r, k in enumerate(far)]
    return sorted(tuple(map(int, x)) for x in out)


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF_MID}/embeddings.parquet").to_pylist()]
    assert sorted(map(tuple, op13_hard_negatives(spark, SF_MID).collect())) == brute(rows)


def test_cases_equal_brute_force(spark):
    r = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(k, [f32(r.gauss(0, 1)) for _ in range(6)], r.randint(0, 3)) for k in range(900)]
    rows += [(k, [0.5] * 6, k % 3) for k in range(1000, 1600)]                               # one vector, many times
    rows += [(200, [0.5] * 6, 1), (200, [0.5] * 6, 1), (None, [1.0] * 6, 1), (3, None, 1), (4, [1.0] * 6, None),
             (300, [1.0, None, 1.0], 1), (5, [math.nan] * 6, 1), (6, [math.inf, 0.0], 1), (7, [1e30] * 6, 1),
             (8, [], 1), (400, [], 1), (9, [2.0, 1.0], 1), (500, [3.0] * 9, 2), (600, [0.0] * 6, 7)]
    table = spark.createDataFrame([(*x, 0.5, "x", 1) for x in rows], SCHEMA).repartition(5)
    done = hard_negatives(table, F.col("id") % 100 == 0)
    assert sorted(map(tuple, done.collect())) == brute(rows, shift=False)
    assert hard_negatives(table.where("vec_id = 1"), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives(table.limit(0), F.col("id") % 100 == 0).count() == 0


def test_walk_is_certified_and_stops_early():
    """Clustered vectors: the walk skips most of the list and misses nothing."""
    r = np.random.default_rng(1)
    middles = r.normal(size=(8, 32)) * 3
    v = np.floor(256 * (middles[r.integers(0, 8, 4000)] + r.normal(size=(4000, 32)) * 0.2))
    label = r.integers(0, 3, 4000)
    block = {"v": v, "id": r.permutation(4000), "label": label, "row": np.arange(4000)}
    at = np.arange(0, 4000, 40)
    centres = cluster_centres(v[at], 8)
    own = ((v[at] / np.linalg.norm(v[at], axis=1, keepdims=True)) @ centres.T).argmax(axis=1)
    work = 0
    for k in np.unique(own):
        mine = at[own == k]
        anchors = {c: x[mine] for c, x in block.items()}
        found = Positives(anchors, block, 5)
        work += walk(anchors["v"], centres[k], found.floors(), found.take, v, 64)
        got = found.columns()
        products = exact_products(anchors["v"], v)
        anchors["positives"] = np.full((len(mine), 5), NOTHING)
        for j, a in enumerate(mine):
            fits = np.flatnonzero((label == label[a]) & (np.arange(4000) != a))
            expect = fits[np.lexsort((block["id"][fits], -products[j, fits]))][:5]
            assert sorted(got["id"][got["row"] == a]) == sorted(block["id"][expect])
            anchors["positives"][j] = products[j, expect]
        mined = Negatives(anchors, block, 5, 80, 100)
        work += walk(anchors["v"], centres[k], mined.floors(), mined.take, v, 64)
        got = mined.columns()
        for j, a in enumerate(mine):
            for p, s in enumerate(anchors["positives"][j]):
                fits = np.flatnonzero((label != label[a]) & (100 * products[j] >= 80 * s) & (100 * products[j] <= 100 * s))
                expect = fits[np.lexsort((block["id"][fits], -products[j, fits]))][:5]
                assert sorted(got["id"][(got["row"] == a) & (got["place"] == p)]) == sorted(block["id"][expect])
    assert work < 2 * len(at) * 4000 / 4
    big = np.array([[2.0**22, 3.0], [5.0, 2.0**22]])
    assert exact_products(big, big).tolist() == [[2**44 + 9, 5 * 2**22 + 3 * 2**22], [8 * 2**22, 2**44 + 25]]
