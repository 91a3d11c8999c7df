import collections
import hashlib
import re
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.llm.prefix_trie import Shard, conversation_trie, ends_digest, numbered, prefix_trie, shared_heads, turn_keys
from quarry.llm.queries import op12_prefix_trie
from testdata import SF_MID


def sequences(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}


def rebuilt(seq):
    out = {}
    for c, turns in seq.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))          # the remainder of SQL
        out[c] = seq.get(base, [])[:h] + turns[h:]
    return out


def brute(seq):
    members, children = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in seq.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * words
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, ())), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seq[c]) == len(k)))).encode()).hexdigest())
                   for k, m in members.items()), key=str)


def result(trie):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = trie.nodes.join(ends_digest(trie.ends), "node", "left").collect()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                    r["ends_sha256"] or nothing) for r in rows), key=str)


def awkward():
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of kind {c % 3 if t > 1 else 0}") for c in range(0, 130) for t in range(c % 6)]
    rows += [(c, t, "user", ["same", "words", "again"][t]) for c in range(200, 260) for t in range(3)]       # exact copies
    rows += [(300, None, None, None), (300, 1, "a", ""), (300, 1, "a", ""), (300, 1, "", "a"), (None, 0, "user", "nobody")]
    rows += [(-5, 0, "user", "below zero"), (-5, 4, "user", "x  y\tz"), (-25, 0, "user", "below zero")]
    rows += [(400, t, "user", "long " * 2_000 if t == 3 else "go on") for t in range(300)] + [(401, t, "user", "go on") for t in range(290)]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_trie_equals_brute_force(spark):
    rows = awkward()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("words", F.lit(2))
    assert result(conversation_trie(table.repartition(7))) == brute(sequences(rows))


def test_rebuilt_trie_equals_brute_force(spark):
    rows = awkward()
    turns = numbered(turn_keys(spark.createDataFrame(rows, SCHEMA)))
    assert result(prefix_trie(shared_heads(turns), turns)) == brute(rebuilt(sequences(rows)))


def test_query_equals_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF_MID}/conversations.parquet").to_pylist()]
    assert sorted(map(tuple, op12_prefix_trie(spark, SF_MID).collect()), key=str) == brute(rebuilt(sequences(rows)))


def test_empty_table(spark):
    assert result(conversation_trie(spark.createDataFrame([], SCHEMA))) == []


def test_shards_add_up():
    """Partial nodes of small shards, put together, are those of one shard."""
    seq = sorted(rebuilt(sequences(awkward())).items())
    members = [(c, [hashlib.md5(repr(t).encode()).digest() for t in turns], [1] * len(turns)) for c, turns in seq]
    whole = {n[0]: n for n in Shard(members).partial_nodes()}
    counts, ends = collections.Counter(), collections.defaultdict(list)
    for k in range(0, len(members), 7):
        for node, _, _, _, n, ids in Shard(members[k:k + 7]).partial_nodes():
            counts[node] += n
            ends[node] += ids or []
    assert {k: (n[4], n[5] or []) for k, n in whole.items()} == {k: (n, ends[k]) for k, n in counts.items()}
