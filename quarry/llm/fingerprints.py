"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; a section is a run of paragraphs that ends at an empty
line or after a paragraph whose digest falls in a fixed class (so an edit moves
section borders only near itself). Paragraph, section and root digests are
SHA-256 over their children; a paragraph also lists short checksums of its
pieces (content-cut stretches of some words) so that likeness sees edits inside
a paragraph. The fingerprint string holds the whole tree:

    root '|' section '/' section ...      section = digest ':' paragraph '.' ...

Equal roots mean equal texts. ``differing`` and ``likeness`` take two such strings
and descend only into branches whose digests differ: a section whose digest both
have is common as a whole, so is a paragraph of the rest, and only paragraphs that
differ are compared piece by piece. ``differing`` names the edited paragraphs;
``likeness`` is the Dice share of common pieces (1 for equal roots). Two
fingerprints take about a fifth of a text's size each.

Cases: null and empty texts are one empty paragraph; texts may be of any
length; rows without an id have no place in the order: they follow nobody and
nothing follows them (the replacement is empty, ``near_next`` 0); repeated ids
follow each other by text; one document follows itself; an empty table gives an
empty result; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import re
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A piece has at least 24 bytes (8 in a short paragraph) and ends after a word
# whose last byte is odd, so the cuts find each other again after an edit.
_ODD = b"[" + b"".join(re.escape(bytes([b])) for b in range(0x21, 0x100, 2)) + b"]"
PIECE, SHORT_PIECE = (re.compile(rb"[^\n]{%d,}?%s |[^\n]+" % (least, _ODD), re.DOTALL) for least in (24, 8))
SHORT = 96             # bytes below which a paragraph is short
SECTION_CLASS = 8      # on average a section has so many paragraphs
DIGEST = 6             # bytes of a paragraph digest that the string shows


class Tree:
    """Digests of one text; ``text`` is the fingerprint string."""

    __slots__ = ("root", "text")

    def __init__(self, text: str):
        shown, digests = [], []
        held, words = [], []
        for paragraph in text.encode().split(b"\n"):
            digest = sha256(b"p" + paragraph).digest()
            sums = list(map(crc32, (PIECE if len(paragraph) >= SHORT else SHORT_PIECE).findall(paragraph)))
            held.append(digest)
            words.append(urlsafe_b64encode(digest[:DIGEST] + np.array(sums, ">u4").tobytes()).decode().rstrip("="))
            if not paragraph or digest[-1] % SECTION_CLASS == 0:
                digests.append(self._close(held, words, shown))
                held, words = [], []
        if held:
            digests.append(self._close(held, words, shown))
        self.root = sha256(b"r" + b"".join(digests)).hexdigest()
        self.text = f"{self.root}|{'/'.join(shown)}"

    @staticmethod
    def _close(held: list[bytes], words: list[str], shown: list[str]) -> bytes:
        digest = sha256(b"s" + b"".join(held)).digest()
        shown.append(f"{urlsafe_b64encode(digest[:DIGEST]).decode()}:{'.'.join(words)}")
        return digest


def fingerprint(text: str | None) -> str:
    return Tree(text or "").text


def _sections(tree: str) -> Counter:
    """Sections of a fingerprint's tree part, each with its digest, and how often they occur."""
    return Counter(tree.split("/"))


def _paragraphs(sections: Counter) -> Counter:
    out = Counter()
    for section, times in sections.items():
        for paragraph in section.split(":", 1)[1].split("."):
            out[paragraph] += times
    return out


def _n_pieces(paragraph: str) -> int:
    """Pieces of a paragraph, by the length of its base64 text alone."""
    return (len(paragraph) * 3 // 4 - DIGEST) // 4


def _pieces(paragraphs: Counter) -> Counter:
    out = Counter()
    for paragraph, times in paragraphs.items():
        raw = urlsafe_b64decode(paragraph + "=" * (-len(paragraph) % 4))[DIGEST:]
        for k in range(0, len(raw), 4):
            out[raw[k:k + 4]] += times
    return out


def _size(paragraphs: Counter) -> int:
    return sum(times * _n_pieces(p) for p, times in paragraphs.items())


def likeness(a: str, b: str) -> float:
    """Dice share of the pieces of two fingerprint strings, by descent: what is
    common on a level leaves both sides and is counted by its size."""
    (root_a, tree_a), (root_b, tree_b) = (x.split("|", 1) for x in (a, b))
    if root_a == root_b:
        return 1.0
    x, y = _sections(tree_a), _sections(tree_b)
    same = x & y
    common = _size(_paragraphs(same))
    x, y = _paragraphs(x - same), _paragraphs(y - same)
    total = 2 * common + _size(x) + _size(y)
    same = x & y
    common += _size(same)
    common += (_pieces(x - same) & _pieces(y - same)).total()
    return 2.0 * common / total if total else 0.0


def differing(a: str, b: str) -> list[int]:
    """Paragraph numbers of fingerprint ``b`` that ``a`` does not have, by
    descending from the roots into differing sections only."""
    (root_a, tree_a), (root_b, tree_b) = (x.split("|", 1) for x in (a, b))
    if root_a == root_b:
        return []
    had = {}
    for section in tree_a.split("/"):
        digest, paragraphs = section.split(":", 1)
        had[digest] = paragraphs.split(".")
    known = set(chain.from_iterable(had.values()))
    out, at = [], 0
    for section in tree_b.split("/"):
        digest, paragraphs = section.split(":", 1)
        paragraphs = paragraphs.split(".")
        if digest not in had:
            out += [at + k for k, p in enumerate(paragraphs) if p not in known]
        at += len(paragraphs)
    return out


def _bucket(col: Column, splits: list, low: int, high: int) -> Column:
    """Number of ``splits`` (descending) that are not below ``col``, as a
    balanced tree of comparisons."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(col > F.lit(splits[mid]), _bucket(col, splits, low, mid)).otherwise(_bucket(col, splits, mid + 1, high))


def with_next(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """Rows (bucket, helper, id, text), one bucket a partition, sorted so that each
    document is followed by the next one in descending id order.

    The texts move once. Buckets are id ranges cut at quantiles; the top row of
    a bucket goes to the bucket before it too, as a helper (after the last
    bucket comes the first). The driver sees one id per bucket.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    splits = sorted({int(c) for c in cuts}, reverse=True)
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("id"), splits, 0, len(splits))))
    tops = sorted((r["bucket"], r["id"]) for r in rows.where("bucket >= 0").groupBy("bucket").agg(F.max("id").alias("id")).collect())
    before = [(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)]
    marked = spark.createDataFrame(before, "id bigint, helps int")
    rows = rows.join(F.broadcast(marked), "id", "left")     # one row per bucket
    spread = rows.select("id", "text", F.explode(F.filter(F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("helper")),
        F.struct(F.col("helps").alias("bucket"), F.lit(True).alias("helper"))), lambda s: s["bucket"].isNotNull())).alias("to"))
    # rows without id need no neighbour and can lie anywhere
    lane = F.when(F.col("to.bucket") < 0, -1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(F.col("to.bucket"))
    place = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return (spread.select(lane.alias("bucket"), F.col("to.helper").alias("helper"), "id", "text")
            .repartitionById(n, place).sortWithinPartitions("bucket", "helper", F.col("id").desc(), "text"))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited`` (its text with the last
    half replaced by the beginning of the next document in descending id
    order), the fingerprints of both, ``near_edited`` and ``near_next``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None                              # (bucket, id, text, tree)
        for batch in batches:
            out: list[tuple] = []
            for bucket, helper, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    out.append(_row(doc, text, Tree(text), "", None))
                    continue
                tree = None
                if waiting and waiting[0] == bucket:
                    tree = Tree(text)
                    out.append(_row(*waiting[1:], text, tree))
                waiting = None if helper else (bucket, doc, text, tree or Tree(text))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    if kind != "bigint":
        docs = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias(text_col))
    return with_next(docs, id_col, text_col).mapInArrow(
        run, f"`{id_col}` bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def _row(doc, text: str, tree: Tree, next_text: str, next_tree: Tree | None) -> tuple:
    n = len(text)
    edited = text[:n - n // 2] + next_text[:n // 2]
    edited_tree = Tree(edited)
    return (doc, n, edited, tree.text, edited_tree.text, likeness(tree.text, edited_tree.text),
            likeness(tree.text, next_tree.text) if next_tree else 0.0)
