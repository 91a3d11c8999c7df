"""Hard negatives by exact inner product, over lists shared by anchor clusters.

Vectors are quantized to integers. Anchors are clustered by angle (centres fitted
on a bounded sample of anchors); candidates are dealt into blocks. Where a block
meets a cluster, its candidates are sorted once by an upper bound on their inner
product with any member: |v| cos(max(0, angle to the centre - widest angle of the
cluster)). All members walk that list, and one leaves it as soon as the bound of
what follows, times its own length, is below what it still could take: the walk is
certified and nothing is missed. A first walk finds positives, a second one the
negatives whose score lies in the window that each positive sets.

Blocks (about ``BLOCK`` candidates) meet bundles (about ``BUNDLE`` anchors) as
keyed groups, so a task holds one of each; the best of all blocks are ranked after
a limit per task. Neither candidates nor anchors pass the driver or a broadcast.

Cases: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do those with a component of ``LARGEST`` or more after
quantization (a score must fit in a long); vectors of unlike length are compared
as if the shorter one ended in zeros; rows that share an id are rows of their own;
an anchor without positives, and a positive without negatives in its window, give
no row; without anchors or on an empty table the result is empty; other columns
are ignored, so names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 16_384
BUNDLE = 16_384
LARGEST = 2**23
SAMPLE = 4_096                  # anchors that the cluster centres are fitted on, at most about
CENTRES = 16


def quantized(rows: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(row, id, label, v array<int>) of the rows that take part."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    good = F.forall("wide", lambda x: F.coalesce((x > F.lit(-float(LARGEST))) & (x < F.lit(float(LARGEST))), F.lit(False)))
    return (rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), wide.alias("wide"))
            .where("id IS NOT NULL AND label IS NOT NULL AND wide IS NOT NULL").where(good)
            .select(F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("label").alias("label"),
                    F.transform("wide", lambda x: F.floor(x).cast("int")).alias("v")))


def cluster_centres(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by k-means on the sphere, from evenly spaced starting points."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = vectors[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    if not len(x):
        return np.zeros((1, vectors.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


class Members:
    """A cluster's anchors of one bundle while they walk."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray):
        self.vectors = vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        cos = np.divide(vectors @ centre, self.norms, out=np.zeros(len(vectors)), where=self.norms > 0)
        self.centre, self.widest = centre, float(np.arccos(np.clip(cos, -1, 1)).max(initial=0))

    def bounds(self, candidates: np.ndarray) -> np.ndarray:
        """Upper bound of each candidate's product with a member of length 1."""
        norms = np.linalg.norm(candidates, axis=1)
        cos = np.divide(candidates @ self.centre, norms, out=np.ones(len(candidates)), where=norms > 0)
        angle = np.arccos(np.clip(cos, -1, 1))
        if not self.centre.any():
            angle = np.zeros(len(candidates))
        return norms * (np.cos(np.maximum(0.0, angle - self.widest)) + 1e-6)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products by the fastest type that holds every partial sum."""
    size = np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0)
    if size < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if size < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(places: list[np.ndarray], score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first k of their place: score falling, then id."""
    order = np.lexsort((ident, -score, *places[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in places], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def walk(vectors: np.ndarray, centre: np.ndarray, floors: np.ndarray, take, candidates: np.ndarray, first_step: int = 256) -> int:
    """Members walk the list of candidates. ``take(members, places, scores)`` takes
    a stretch of the list and returns new floors: the least score a member could
    still use. Returns how many products were formed."""
    members = Members(vectors, centre)
    bound = members.bounds(candidates)
    order = np.argsort(-bound, kind="stable")
    live, at, step, work = np.arange(len(vectors)), 0, first_step, 0
    while at < len(order):
        live = live[members.norms[live] * bound[order[at]] + 1e-3 >= floors[live]]
        if not len(live):
            break
        places = order[at:at + step]
        floors[live] = take(live, places, exact_products(vectors[live], candidates[places]))
        work += len(live) * len(places)
        at, step = at + step, min(2 * step, 4_096)
    return work


NOTHING = np.iinfo(np.int64).min


class Positives:
    """The first k of an anchor's own label."""

    def __init__(self, anchors: dict, block: dict, k: int):
        self.anchors, self.block, self.k = anchors, block, k
        self.found = [np.empty(0, np.int64)] * 3               # anchor, candidate, score
        self.floor = np.full(len(anchors["id"]), NOTHING)

    def floors(self) -> np.ndarray:
        return self.floor.copy()

    def take(self, live: np.ndarray, places: np.ndarray, scores: np.ndarray) -> np.ndarray:
        a, b = self.anchors, self.block
        fits = (a["label"][live][:, None] == b["label"][places]) & (a["row"][live][:, None] != b["row"][places])
        r, c = np.nonzero(fits & (scores >= self.floor[live][:, None]))
        joined = [np.concatenate(x) for x in zip(self.found, (live[r], places[c], scores[r, c]))]
        keep = best([joined[0]], joined[2], b["id"][joined[1]], self.k)
        self.found = [x[keep] for x in joined]
        anchor, _, score = self.found
        full = np.flatnonzero(np.bincount(anchor, minlength=len(self.floor))[anchor] == self.k)
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, anchor[full], score[full])
        self.floor = np.where(worst < np.iinfo(np.int64).max, worst, NOTHING)
        return self.floor[live]

    def columns(self) -> dict[str, np.ndarray]:
        anchor, place, score = self.found
        return {"row": self.anchors["row"][anchor], "id": self.block["id"][place], "score": score}


class Negatives:
    """Of each positive the first k of other labels inside its window of scores."""

    def __init__(self, anchors: dict, block: dict, k: int, low: int, high: int):
        self.anchors, self.block, self.k, self.low, self.high = anchors, block, k, low, high
        self.found = [np.empty(0, np.int64)] * 4               # anchor, number of the positive, candidate, score
        scores = anchors["positives"]                          # anchors x positives, NOTHING where there are fewer
        self.least = np.where(scores == NOTHING, np.iinfo(np.int64).max, -((-low * np.where(scores == NOTHING, 0, scores)) // 100))
        self.most = np.where(scores == NOTHING, NOTHING, (high * np.where(scores == NOTHING, 0, scores)) // 100)
        self.least = np.where(self.least > self.most, np.iinfo(np.int64).max, self.least)

    def floors(self) -> np.ndarray:
        return self.least.min(axis=1)

    def take(self, live: np.ndarray, places: np.ndarray, scores: np.ndarray) -> np.ndarray:
        a, b = self.anchors, self.block
        fits = a["label"][live][:, None] != b["label"][places]
        least, most = self.least[live], self.most[live]
        r, c = np.nonzero(fits & (scores >= least.min(axis=1)[:, None]) & (scores <= most.max(axis=1)[:, None]))
        s = scores[r, c]
        parts = [self.found]
        for j in range(least.shape[1]):
            ok = (s >= least[r, j]) & (s <= most[r, j])
            parts.append([live[r[ok]], np.full(ok.sum(), j), places[c[ok]], s[ok]])
        joined = [np.concatenate(x).astype(np.int64) for x in zip(*parts)]
        keep = best(joined[:2], joined[3], b["id"][joined[2]], self.k)
        self.found = [x[keep] for x in joined]
        anchor, j, _, score = self.found
        width = self.least.shape[1]
        place = anchor * width + j
        full = np.flatnonzero(np.bincount(place, minlength=self.least.size)[place] == self.k)
        worst = np.full(self.least.size, np.iinfo(np.int64).max)
        np.minimum.at(worst, place[full], score[full])
        known = worst.reshape(self.least.shape) < np.iinfo(np.int64).max
        self.least = np.where(known, worst.reshape(self.least.shape), self.least)
        return self.least[live].min(axis=1)

    def columns(self) -> dict[str, np.ndarray]:
        anchor, j, place, score = self.found
        return {"row": self.anchors["row"][anchor], "place": j, "id": self.block["id"][place], "score": score}


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _group(rows: pa.Table, width: int) -> dict:
    out = {c: rows.column(c).to_numpy() for c in rows.column_names if c in ("row", "id", "label", "centre")}
    out["v"] = _matrix(rows.column("v"), width)
    if "positives" in rows.column_names:
        lists = rows.column("positives").to_pylist()
        most = max(map(len, lists), default=1)
        out["positives"] = np.array([x + [NOTHING] * (most - len(x)) for x in lists], np.int64).reshape(len(lists), most)
    return out


def meet(candidates: DataFrame, anchors: DataFrame, centres, width: int, n_blocks: int, n_bundles: int, make, schema: str) -> DataFrame:
    """Blocks of candidates meet bundles of anchors; ``make(anchors, block)`` is
    what a cluster's members collect on their walk."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        if left.num_rows and right.num_rows:
            block, bundle = _group(left, width), _group(right, width)
            for k in np.unique(bundle["centre"]):
                own = bundle["centre"] == k
                part = {c: x[own] for c, x in bundle.items()}
                collected = make(part, block)
                walk(part["v"], centres.value[k], collected.floors(), collected.take, block["v"])
                out.append(collected.columns())
        return pa.table({n: np.concatenate([x[n] for x in out]) if out else np.empty(0, np.int64) for n in names}).cast(
            pa.schema([(n, pa.int64()) for n in names]))

    left = (candidates.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
            .withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1)))))
    right = (anchors.withColumn("bundle", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_bundles)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    return left.groupBy("block", "bundle").cogroup(right.groupBy("block", "bundle")).applyInArrow(run, schema)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor``: condition on the column ``id``. ``positives``: an anchor's first
    rows of its label; ``negatives``: of each positive the first rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    all_rows = written(quantized(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale), "vectors")
    n, n_anchors, width = all_rows.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks, n_bundles, width = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_anchors / BUNDLE)), max(1, width)
    anchors = all_rows.where(is_anchor)
    share = min(1.0, SAMPLE / max(1, n_anchors))
    sample = anchors.where(F.xxhash64("row", F.lit(2)) / 2.0**64 + 0.5 <= share).select("row", "v").collect()   # about SAMPLE rows
    fitted = np.zeros((len(sample), width))
    for k, r in enumerate(sorted(sample)):
        fitted[k, :len(r["v"])] = r["v"]
    centres = spark.sparkContext.broadcast(cluster_centres(fitted, CENTRES) if len(fitted) else np.zeros((1, width)))

    def assign(batches):
        for batch in batches:
            cos = _matrix(pa.chunked_array([batch.column(batch.schema.get_field_index("v"))]), width) @ centres.value.T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cos.argmax(axis=1), pa.int64())], names=[*batch.schema.names, "centre"])

    anchors = written(anchors.mapInArrow(assign, "row bigint, id bigint, label bigint, v array<int>, centre bigint"), "anchors")
    near = meet(all_rows, anchors, centres, width, n_blocks, n_bundles,
                lambda part, block: Positives(part, block, positives), "row bigint, id bigint, score bigint")
    chosen = written(_first(near, ["row"], positives), "positives")
    windows = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(
        "row", F.col("p.score").alias("positives"))                # at most ``positives`` a row
    far = meet(all_rows, anchors.join(windows, "row"), centres, width, n_blocks, n_bundles,
               lambda part, block: Negatives(part, block, negatives, low, high), "row bigint, place bigint, id bigint, score bigint")
    mined = _first(far, ["row", "place"], negatives).select("row", (F.col("place") + 1).alias("of"), "rank", F.col("id").alias("negative_id"),
                                                            F.col("score").alias("negative_score"))
    return (mined.join(chosen.select("row", F.col("rank").alias("of"), F.col("id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), ["row", "of"])
            .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
