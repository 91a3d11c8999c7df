"""Prefix trie of conversations over vertical bitmaps.

The conversations are ranged by id into shards of bounded size. A shard keeps,
for every (position, turn), the bitset of its conversations that have this turn
there; a depth-first walk intersects a node's bitset with the posting of one
member's next turn, which is a child, until no member is left. Popcounts are
member counts, and the members that end at a node are listed per shard. Nodes of
all shards meet by the digest of their path.

Sums over subtrees need no walk down the whole trie. The smallest member owns a
node; along a conversation ownership, once reached, lasts to its end, so one depth
(from which it owns) and one flag (its end is a leaf) per conversation say what it
adds to each of its nodes. A second walk of the shards adds that up: words at
depths that a member does not own are those that sharing saves.

A turn is its role and text, compared by a 128-bit digest; texts are not moved.
A task holds the digests of one shard, and at least those of one conversation.

Cases: turns are ordered by number (null first), then role, then digest; repeated
rows are turns of their own; a null role or text is empty; rows with a null
conversation id are left out; conversations named in ``members`` without rows
belong to the root only; an empty table has no nodes, not even a root; other
columns are ignored, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORDS = r"[^\x20\x09-\x0D]+"
ROOT = b"\0" * 16
SHARD_MEMBERS = 2_048           # conversations of a shard
SHARD_TURNS = 200_000           # its turns (one conversation may have more)
DIGEST = 16


class Trie(NamedTuple):
    nodes: DataFrame            # node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    ends: DataFrame             # node, first_id, ids: ascending runs of the members that end there


def turn_keys(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, key, words) of every turn with a conversation."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "utf-8"))).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).alias("words"))


def numbered(keys: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, key, words)."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "key")
    return keys.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "key", "words")


# ------------------------------------------------------------------ one shard
class Shard:
    """Members in the order of their bits, with turn keys and word counts."""

    def __init__(self, members: list[tuple[int, list[bytes], list[int]]]):
        self.ids = [m[0] for m in members]
        self.keys, self.words = [m[1] for m in members], [m[2] for m in members]
        longest = max(map(len, self.keys), default=0)
        self.postings: list[dict[bytes, int]] = [{} for _ in range(longest)]
        self.ending = [0] * (longest + 1)
        for i, keys in enumerate(self.keys):
            bit = 1 << i
            for posting, key in zip(self.postings, keys):
                posting[key] = posting.get(key, 0) | bit
            self.ending[len(keys)] |= bit

    def walk(self) -> Iterator[tuple[bytes, bytes, int, int, int, int]]:
        """Depth first: (node, parent, number of the parent in this walk, depth,
        members as bits, the smallest member's bit number)."""
        stack = [(ROOT, b"", -1, 0, (1 << len(self.ids)) - 1)]
        number = 0
        while stack:
            node, parent, above, depth, bits = stack.pop()
            first = (bits & -bits).bit_length() - 1
            yield node, parent, above, depth, bits, first
            rest = bits & ~self.ending[depth]
            while rest:
                key = self.keys[(rest & -rest).bit_length() - 1][depth]
                child = rest & self.postings[depth][key]
                rest ^= child
                stack.append((md5(node + key).digest(), node, number, depth + 1, child))
            number += 1

    def ids_of(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out

    def partial_nodes(self) -> Iterator[tuple]:
        for node, parent, _, depth, bits, first in self.walk():
            ending = bits & self.ending[depth]
            yield node, parent, depth, self.ids[first], bits.bit_count(), self.ids_of(ending) if ending else None

    def partial_sums(self, owns_from: list[int | None], leaf: list[bool]) -> list[tuple[bytes, int, int]]:
        """(node, leaves below, words saved below) as far as these members add."""
        leaves = sum(1 << i for i, x in enumerate(leaf) if x)
        borrowed = [0] * len(self.ending)                    # members that do not own their node of that depth
        for i, start in enumerate(owns_from):
            for d in range(len(self.keys[i]) + 1 if start is None else min(start, len(self.keys[i]) + 1)):
                borrowed[d] |= 1 << i
        nodes, saved, above = [], [], []
        for node, _, up, depth, bits, first in self.walk():
            nodes.append((node, (bits & leaves).bit_count()))
            saved.append(self.words[first][depth - 1] * (bits & borrowed[depth]).bit_count() if depth else 0)
            above.append(up)
        for k in range(len(nodes) - 1, 0, -1):               # children come after their parent
            saved[above[k]] += saved[k]
        return [(node, n, s) for (node, n), s in zip(nodes, saved)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows (conversations) in runs of one ``part`` that make a shard."""
    run: list[dict] = []
    turns = 0
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["words"])
            if run and (row["part"] != run[0]["part"] or len(run) == SHARD_MEMBERS or turns + n > SHARD_TURNS):
                yield run
                run, turns = [], 0
            run.append(row)
            turns += n
    if run:
        yield run


def _member(row: dict) -> tuple[int, list[bytes], list[int]]:
    raw = row["keys"]
    return row["conv_id"], [raw[k:k + DIGEST] for k in range(0, len(raw), DIGEST)], row["words"]


# ------------------------------------------------------------------ all shards
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows that are ordered by (conv_id, pos)."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    conv, keys, words = None, [], []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        c, k, w = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(c), pa.int32()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(w, pa.list_(pa.int32()))],
            names=["part", "conv_id", "keys", "words"])

    for batch in batches:
        done = []
        for c, pos, key, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if c != conv:
                if conv is not None:
                    done.append((conv, b"".join(keys), words))
                conv, keys, words = c, [], []
            if pos is not None:                              # a member without turns has one row without any
                keys.append(key)
                words.append(n)
        if done:
            yield batch_of(done)
    if conv is not None:
        yield batch_of([(conv, b"".join(keys), words)])


def _first_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _shards(batches):
        shard = Shard([_member(r) for r in rows])
        node, parent, depth, first, n, ends = zip(*shard.partial_nodes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(node, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int32()), pa.array(first, pa.int64()),
             pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
            names=["node", "parent", "depth", "conv_id", "n_convs", "ids"])


def _second_walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _shards(batches):
        shard = Shard([_member(r) for r in rows])
        node, leaves, saved = zip(*shard.partial_sums([r["owns_from"] for r in rows], [bool(r["leaf"]) for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())],
                                         names=["node", "n_leaves", "saved_tokens"])


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> Trie:
    """The trie of conversations given as (conv_id, pos, key, words) rows;
    ``members`` (conv_id) may name conversations without rows."""
    rows = turns.select("conv_id", "pos", "key", "words")
    if members is not None:
        bare = members.select("conv_id").distinct().join(rows.select("conv_id").distinct(), "conv_id", "left_anti")
        rows = rows.unionByName(bare.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("key"),
                                            F.lit(None).cast("int").alias("words")))
    rows = written(rows, "trie-turns")
    ranged = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    packed = written(ranged.mapInArrow(_packed, "part int, conv_id bigint, keys binary, words array<int>"), "trie-members")

    partial = written(packed.mapInArrow(
        _first_walk, "node binary, parent binary, depth int, conv_id bigint, n_convs bigint, ids array<bigint>"), "trie-partial")
    merged = written(partial.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"),
                                                 F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "trie-merged")
    children = merged.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max(F.col("n_children") == 0).alias("leaf"))
    sums = (packed.join(owners, "conv_id", "left")
            .select(F.lit(0).alias("part"), "conv_id", "keys", "words", "owns_from", "leaf")
            .mapInArrow(_second_walk, "node binary, n_leaves bigint, saved_tokens bigint")
            .groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    # an owner's nodes hang on one another; only its first node has another's as parent
    tops = nodes.alias("n").join(owners.select("conv_id", "owns_from"), "conv_id").where("depth = owns_from AND depth > 0")
    parents = tops.select("node", "parent").join(
        nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").select("node", "parent_conv_id")
    done = (nodes.join(sums, "node").join(parents, "node", "left")
            .withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))))
    return Trie(done.select("node", "parent", F.col("depth").cast("bigint").alias("depth"), "conv_id", "parent_conv_id", "n_convs",
                            "n_children", "n_leaves", "saved_tokens"),
                partial.where("ids IS NOT NULL").select("node", F.element_at("ids", 1).alias("first_id"), "ids"))


def conversation_trie(conversations: DataFrame, **columns: str) -> Trie:
    return prefix_trie(numbered(turn_keys(conversations, **columns)))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ending members' decimal ids, ascending
    and comma-joined. The runs of a node are streamed in order through one hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def one(node: bytes, digest) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = ",".join(map(str, ids)).encode()
                if key != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = key, sha256(text)
                else:
                    digest.update(b"," + text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])],
                                                 names=["node", "ends_sha256"])
        if node is not None:
            yield one(node, digest)

    return ends.repartition("node").sortWithinPartitions("node", "first_id").mapInArrow(run, "node binary, ends_sha256 string")


def shared_heads(turns: DataFrame, *, group: int = 20) -> DataFrame:
    """Conversations rebuilt for the query: the first h turns of conversation
    c - c % group, then c's own after its first h; h = crc32(decimal c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    rows = turns.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    heads = rows.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < 3)).select("base", "pos", "key", "words")
    taken = (rows.where("pos = 0 AND h > 0").select("conv_id", "h", "base").join(heads, "base").where("pos < h")
             .select("conv_id", "pos", "key", "words"))
    return rows.where("pos >= h").select("conv_id", "pos", "key", "words").unionByName(taken)
