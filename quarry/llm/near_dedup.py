"""Near-duplicate groups with an LSH forest over MinHash signatures.

1. Every text becomes its set of 5-word shingles; equal sets are one class (a
   class digest, aggregated before anything else, so copies never meet).
2. Forest: each class enters ``TREES`` sorted orders, one per tree, keyed by
   ``DEPTH`` MinHash values. In a sorted order the rows with a common prefix
   are a region; the prefix is taken as deep as a region needs to have at most
   ``REGION`` rows (one value where the corpus is sparse, more where it is
   crowded). A region of equal full keys is cut into runs of neighbours.
   Within a region, signatures decide candidates (a spanning forest, so edges
   grow with rows, not with pairs).
3. Candidates' connected components bring the texts together once. A component
   up to ``LOAD`` shingles is decided by one task on the full sets. A larger one
   is first thinned: dealt out by ``ORDERS_BIG`` of the sorted orders into
   overlapping blocks, whose exact links make groups. What is outside its
   largest group then meets all the others of the component: both are cut into
   blocks, and each pair of blocks with such rows is one task. So every two
   members of a component are in one group already or compared on full sets.

Two texts at similarity 0.75 share no first key in any of 12 trees with
probability 0.25^12; two levels deep it is below 5e-5.

Cases: null and empty texts, and texts of white space, have an empty set and
link to nothing; rows with equal ids are one document; a row without id links
to nothing, its component is null and it is kept; texts may be of any length;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_filter, id_slot, written
from .shingles import Shingler

TREES, DEPTH = 12, 6
WIDTH = 4 * DEPTH                    # bytes of a tree's key
REGION = 256                         # rows that a region may have before it is split deeper
BUFFER = 50_000                      # rows of one crowded key that a task holds at a time
ESTIMATE = 0.5                       # least share of equal signature bytes of a candidate
LOAD = 2_000_000                     # shingles (16 MB) that one verification holds
MEMBERS = 2_000                      # and texts
ORDERS_BIG = 4


class Signer:
    """MinHash: multiply-add on mixed 64-bit hashes, upper 32 bits."""

    def __init__(self, seed: int = 20260101):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(TREES * DEPTH, np.uint64(2**64 - 1))
        for k in range(0, len(hashes), 2048):
            least = np.minimum(least, (hashes[k:k + 2048, None] * self.a + self.b).min(axis=0))
        return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest, keys (all trees' keys), sketch (a byte a value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for batch in batches:
            n, digest, keys, sketch = [], [], [], []
            for text in batch.column(1):
                h = shingler.shingles(text.as_py())
                n.append(len(h))
                if not len(h):
                    digest.append(None), keys.append(None), sketch.append(None)
                    continue
                s = signer.sign(h)
                digest.append(blake2b(h.tobytes(), digest_size=16).digest())
                keys.append(s.astype(">u4").tobytes())
                sketch.append((s & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, keys, sketch))],
                names=["doc_id", "n_shingles", "digest", "keys", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, keys binary, sketch binary")


def _regions(keys: np.ndarray, tree: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges of the regions (two rows at least) of sorted rows."""
    n = len(tree)
    same = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
    common = np.concatenate([np.logical_and.accumulate(same, axis=1).sum(axis=1), [0]])     # with the next row
    out, todo = [], [(0, n, 1)]
    while todo:
        a, b, depth = todo.pop()
        ends = np.flatnonzero(common[a:b - 1] < depth) + a + 1
        starts, stops = np.concatenate([[a], ends]), np.concatenate([ends, [b]])
        many = stops - starts > 1
        for s, e in zip(starts[many].tolist(), stops[many].tolist()):
            if e - s <= REGION:
                out.append((s, e))
            elif depth < DEPTH:
                todo.append((s, e, depth + 1))
            else:                                             # neighbours of equal keys, overlapping by one row
                out += [(k, min(e, k + REGION)) for k in range(s, e - 1, REGION - 1)]
        # rows that were split off a crowded region keep their nearest neighbour
        if depth > 1:
            out += [(k, k + 2) for k in (ends - 1).tolist() if a <= k and k + 2 <= b]
    return out


def _candidates(sketch: np.ndarray, region: tuple[int, int], least: int) -> list[tuple[int, int]]:
    """Spanning forest of a region's rows whose signatures agree enough."""
    left = np.arange(*region)
    edges, queue = [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        p = queue.pop()
        if not len(left):
            break
        near = np.count_nonzero(sketch[left] == sketch[p], axis=1) >= least
        found = left[near].tolist()
        edges += [(p, x) for x in found]
        queue += found
        left = left[~near]
    return edges


def forest_edges(classes: DataFrame) -> DataFrame:
    """Candidate links (a, b) of ``classes`` (node, keys, sketch)."""
    least = int(np.ceil(ESTIMATE * TREES * DEPTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            tree = rows["tree"].to_numpy()
            node = rows["node"].to_numpy()
            keys = np.frombuffer(b"".join(rows["key"].to_pylist()), ">u4").reshape(-1, DEPTH)
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)
            regions = _regions(keys, tree)
            pairs = np.array([r for r in regions if r[1] - r[0] == 2], np.int64).reshape(-1, 2)
            ok = np.count_nonzero(sketch[pairs[:, 0]] == sketch[pairs[:, 0] + 1], axis=1) >= least
            found = [(a, a + 1) for a in pairs[ok, 0].tolist()]
            for r in regions:
                if r[1] - r[0] > 2:
                    found += _candidates(sketch, r, least)
            at = np.array(found, np.int64).reshape(-1, 2)
            at = node[at]
            at = np.unique(np.sort(at, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            # the last first-key run may go on in the next batch
            last = (rows["tree"][-1].as_py(), rows["key"][-1].as_py()[:4])
            cut = rows.num_rows
            for k in range(len(held) - 1, -1, -1):
                t, keys = held[k].column("tree").to_numpy(), held[k].column("key").to_pylist()
                own = sum(1 for _ in _while_last(t, keys, last))
                cut -= own
                if own < held[k].num_rows:
                    break
            if rows.num_rows - cut > BUFFER:                       # crowded: go on with an overlap of neighbours
                yield links(rows)
                held = rows.slice(rows.num_rows - REGION).to_batches()
                continue
            if cut:
                yield links(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    rows = classes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "keys")
    rows = rows.select("tree", F.expr(f"substring(keys, tree * {WIDTH} + 1, {WIDTH})").alias("key"), "node", "sketch")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(n, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
            .mapInArrow(run, "a bigint, b bigint"))


def _while_last(tree: np.ndarray, keys: list[bytes], last: tuple) -> Iterator[None]:
    for k in range(len(keys) - 1, -1, -1):
        if (tree[k], keys[k][:4]) != last:
            return
        yield


def exact_groups(sets: list[np.ndarray], percent: int = 75, known: np.ndarray | None = None) -> np.ndarray:
    """Group number of every set: linked if 100 |A and B| >= percent |A or B|.
    Each set is compared with the sets that no group has reached yet; sets of an
    equal ``known`` number are linked beforehand."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, ids, counts = np.unique(np.concatenate(sets) if n else np.empty(0), return_inverse=True, return_counts=True)
    group = np.full(n, -1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [ids[bounds[k]:bounds[k + 1]] for k in range(n)]
    shared = [x[counts[x] > 1] for x in own]                       # what only one set has meets nothing
    mark = np.zeros(len(values) + 1, np.int32)                     # the last one ends the last set
    left = np.arange(n)
    next_group, queue = 0, []
    flat = starts = None
    while len(left) or queue:
        if not queue:
            group[left[0]] = next_group
            next_group += 1
            queue, left, flat = [left[0]], left[1:], None
            if known is not None:
                mates = known[left] == known[queue[0]]
                group[left[mates]] = group[queue[0]]
                queue, left = queue + left[mates].tolist(), left[~mates]
        p = queue.pop()
        if not len(left):
            queue.clear()
            break
        if flat is None:
            parts = [shared[k] for k in left]
            flat = np.concatenate([*parts, [len(values)]]).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
            lengths = np.array([len(x) for x in parts])
        mark[shared[p]] = 1
        both = np.add.reduceat(mark[flat], starts)
        both[lengths == 0] = 0
        mark[shared[p]] = 0
        linked = 100 * both >= percent * (sizes[p] + sizes[left] - both)
        if linked.any():
            if known is not None:
                linked = np.isin(known[left], known[left[linked]])
            found = left[linked]
            group[found] = group[p]
            queue += found.tolist()
            left, flat = left[~linked], None
    return group


def _roots(nodes: list[int], sets: list[np.ndarray], known: list[int]) -> tuple[list[int], list[int]]:
    group = exact_groups(sets, known=np.array(known) if known else None)
    root: dict[int, int] = {}
    for g, node in zip(group.tolist(), nodes):
        root[g] = min(node, root.get(g, node))
    pairs = {(node, root[g]) for g, node in zip(group.tolist(), nodes) if node != root[g]}
    return [p[0] for p in pairs], [p[1] for p in pairs]


def _verify(blocks: bool):
    """Exact links (a, b) of rows (comp, turn, node, text) that arrive with a
    component's rows together; ``blocks``: in overlapping blocks of MEMBERS rows.
    Rows of an equal ``root``, if there is that column, are linked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        key, nodes, sets, known, load = None, [], [], [], 0

        def out() -> pa.RecordBatch:
            a, b = _roots(nodes, sets, known)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            roots = batch.column("root").to_pylist() if "root" in batch.schema.names else [None] * batch.num_rows
            for comp, turn, node, text, root in zip(*(batch.column(c).to_pylist() for c in ("comp", "turn", "node", "text")), roots):
                if key != (comp, turn):
                    if len(nodes) > 1:
                        yield out()
                    key, nodes, sets, known, load = (comp, turn), [], [], [], 0
                elif blocks and (len(nodes) >= MEMBERS or load >= LOAD):
                    yield out()
                    half = len(nodes) // 2                      # the next block sees these neighbours again
                    nodes, sets = nodes[half:], sets[half:]
                    load = sum(map(len, sets))
                nodes.append(node)
                if root is not None:
                    known.append(root)
                sets.append(shingler.shingles(text))
                load += len(sets[-1])
        if len(nodes) > 1:
            yield out()

    return run


def _rest_pairs(crowd: DataFrame) -> DataFrame:
    """(comp, turn, node, root) of ``crowd`` (comp, node, n, root): every two rows
    of a component whose roots differ share a turn. Rows of its largest root meet
    the others only; a turn has about MEMBERS texts and LOAD shingles at most."""
    groups = crowd.groupBy("comp", "root").agg(F.count("*").alias("size"), F.sum("n").alias("load"))
    blocks = lambda load, size: F.greatest(F.ceil(2 * load / LOAD), F.ceil(2 * size / MEMBERS), F.lit(1)).cast("bigint")
    most = groups.groupBy("comp").agg(
        F.max(F.struct("size", "root", "load")).alias("most"), F.sum("size").alias("size"), F.sum("load").alias("load"))
    most = most.where(F.col("size") > F.col("most.size")).select(
        "comp", F.col("most.root").alias("main"), blocks(F.col("most.load"), F.col("most.size")).alias("n_main"),
        blocks(F.col("load") - F.col("most.load"), F.col("size") - F.col("most.size")).alias("n_rest"))
    rows = crowd.join(F.broadcast(most), "comp")                # a row per large component that is not one group
    rest, all_blocks = F.col("root") != F.col("main"), F.col("n_rest") + F.col("n_main")
    slot = F.xxhash64("node")
    rows = rows.withColumn("block", F.when(rest, F.pmod(slot, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(slot, F.col("n_main"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(rest, all_blocks).otherwise(F.col("n_rest")) - 1)))
    return rows.where("other <> block").select(
        "comp", (F.least("block", "other") * all_blocks + F.greatest("block", "other")).alias("turn"), "node", "root")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = written(signatures(docs, id_col, text_col), "signed")
    classes = written(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"),
             F.first("sketch").alias("sketch")), "classes")
    edges = written(forest_edges(classes.select("node", "keys", "sketch")).distinct(), "candidates")
    members = connected_components(edges)
    members = written(members.join(classes.select("node", "n", "keys"), "node"), "members")
    sizes = members.groupBy("comp").agg(F.sum("n").alias("load"), F.count("*").alias("size"))
    big = (F.col("load") > LOAD) | (F.col("size") > MEMBERS)
    members = members.join(sizes.select("comp", big.alias("big")), "comp")

    held = spark.sparkContext.broadcast(id_filter(members.select("node"), "node"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = held.value[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))],
                                             names=["node", "text"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).alias("text"))
    texts = rows.withColumn("slot", id_slot(F.col("node"))).mapInArrow(thin, "node bigint, text string")
    near = (members.where("NOT big").select("comp", F.lit(0).alias("turn"), "node").join(texts, "node")
            .repartition(parts, "comp").sortWithinPartitions("comp", "node").mapInArrow(_verify(False), "a bigint, b bigint"))
    links = near
    if members.where("big").limit(1).count():
        turns = members.where("big").select(
            "comp", "node", "keys", F.explode(F.sequence(F.lit(0), F.lit(ORDERS_BIG - 1))).alias("turn"))
        dealt = (turns.select("comp", "turn", "node", F.expr(f"substring(keys, turn * {WIDTH} + 1, {WIDTH})").alias("key"))
                 .join(texts, "node").repartitionByRange(parts, "comp", "turn", "key", "node")
                 .sortWithinPartitions("comp", "turn", "key", "node"))
        blocks = written(dealt.select("comp", "turn", "node", "text").mapInArrow(_verify(True), "a bigint, b bigint"), "blocks")
        roots = connected_components(blocks).select("node", F.col("comp").alias("root"))
        crowd = written(members.where("big").select("comp", "node", "n").join(roots, "node", "left")
                        .withColumn("root", F.coalesce("root", "node")), "crowd")
        rest = written(_rest_pairs(crowd).join(texts, "node").repartition(parts, "comp", "turn")
                       .sortWithinPartitions("comp", "turn", "node").select("comp", "turn", "node", "text", "root")
                       .mapInArrow(_verify(False), "a bigint, b bigint"), "rest")
        links = near.unionByName(connected_components(blocks.unionByName(rest)).where("node <> comp").select(
            F.col("node").alias("a"), F.col("comp").alias("b")))
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    named = classes.select("digest", "node").join(roots, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    # rows that share an id are one document
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
