"""Benchmark decontamination, in DataFrame functions only.

1. Anchors: a window can hold ``SIMILARITY`` of an item's shingle weight only if
   it holds one of the item's anchor shingles (its heaviest ones, just over
   ``1 - SIMILARITY`` of the weight). Texts without an anchor stop there. This
   loses nothing that step 4 would accept.
2. Windows: every anchor places an item-sized window of words; its fingerprint
   is a 64-bit SimHash of its words, as is the item's.
3. Pairs: a multi-index returns every item of the window's size whose
   fingerprint is within ``RADIUS``. A fingerprint is cut into ``BLOCKS`` blocks;
   within the radius one block at least differs in ``PROBE`` bits or fewer, so the
   items are listed under all such values of each block and an equi-join on
   (size, block, bits) finds them. Only these pairs go on.
4. Verification: the window must hold ``SIMILARITY`` of the item's 5-word
   shingle weight (a shingle weighs 1 / number of items that have it).

The radius is what a quarter of the words replaced can take (README has the
measured miss rate). Fingerprints count words alike, weights do not: a window
that holds three quarters of the weight in a small part of the words can lie
outside the radius.

Words: runs of letters, digits and non-ASCII characters, lower-cased.

Cases: null and empty texts match nothing; items without words match nothing;
an item with fewer than five words is one shingle; repeated items and rows are
reported each for itself; a document without id is reported with a null id;
texts may be of any length; empty tables give an empty result; other columns
are ignored. For a benchmark of any size the texts are read twice: once for the
anchors, once (those with an anchor) for the windows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .license_scan import words_text

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS = 8
PROBE = 2
RADIUS = BLOCKS * (PROBE + 1) - 1      # 23: more would need PROBE + 1 bits in every block
ANCHORS_SENT = 8_000_000               # anchor places (24 bytes each) sent to every executor; beyond, the planner's join


def words_of(text: Column) -> Column:
    plain = F.lower(words_text(F.coalesce(text, F.lit(""))))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + k) for k in range(size)])


def _positions(words: str, size: int) -> Column:
    n = F.size(words)
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def shingles(words: str, sizes: tuple[int, ...] = (SHINGLE,)) -> Column:
    """Array of (pos, h) of the shingles of each size."""
    def of(size: int) -> Column:
        return F.transform(_positions(words, size), lambda i: F.struct(i.alias("pos"), _shingle(words, i, size).alias("h")))

    return of(sizes[0]) if len(sizes) == 1 else F.concat(*map(of, sizes))


def simhash(words: str) -> Column:
    """Each word votes on each of 64 bits."""
    hashes = F.transform(F.col(words), lambda w: F.xxhash64(w))
    votes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(
        hashes, F.lit(0), lambda a, h: a + F.when(F.getbit(h, b) == 1, F.lit(1)).otherwise(F.lit(-1))))
    powers = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)])
    return F.aggregate(F.zip_with(votes, powers, lambda v, p: F.when(v > 0, p).otherwise(F.lit(0).cast("long"))),
                       F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _block(fingerprint: Column, k: Column) -> Column:
    width = 64 // BLOCKS
    return F.call_function("shiftrightunsigned", fingerprint, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def blocks(fingerprint: str) -> Column:
    """(block number, bits); the blocks cover the 64 bits once."""
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
                       lambda k: F.struct(k.alias("block"), _block(F.col(fingerprint), k).alias("bits")))


def probes(fingerprint: str) -> Column:
    """(block number, bits) of all values that differ from a block in ``PROBE`` bits at most."""
    width = 64 // BLOCKS
    masks = [sum(1 << b for b in some) for n in range(PROBE + 1) for some in combinations(range(width), n)]
    return F.flatten(F.transform(blocks(fingerprint), lambda b: F.transform(
        F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(b["block"].alias("block"), b["bits"].bitwiseXOR(m).alias("bits")))))


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(k, id, start, span, item_key, distance): every window with every item of
    its size whose fingerprint is within ``RADIUS``, each pair once."""
    keyed = windows.select("k", "id", "start", "span", F.col("fingerprint").alias("fw"), F.explode(blocks("fingerprint")).alias("b")).select(
        "k", "id", "start", "span", "fw", "b.block", "b.bits")
    listed = items.select("item_key", F.col("n_words").alias("span"), F.col("fingerprint").alias("fi"),
                          F.explode(probes("fingerprint")).alias("b")).select("item_key", "span", "fi", "b.block", "b.bits")
    apart = F.col("fw").bitwiseXOR(F.col("fi"))
    near = F.transform(blocks("apart"), lambda b: F.bit_count(b["bits"]) <= PROBE)
    return (keyed.join(listed, ["span", "block", "bits"]).withColumn("apart", apart)
            .withColumn("distance", F.bit_count("apart")).where(F.col("distance") <= RADIUS)
            .where(F.array_position(near, F.lit(True)) == F.col("block") + 1)       # at the first block that finds it
            .select("k", "id", "start", "span", "item_key", "distance"))


def prepared_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per item: item, item_key (row number), n_words, fingerprint,
    weighted (array of h, w), total, anchors (array of offset, h)."""
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = written(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    size = F.least(F.size("words"), F.lit(SHINGLE))
    cut = reduce(lambda a, k: F.when(size == k, shingles("words", (k,))).otherwise(a), range(1, SHINGLE), shingles("words"))
    rows = items.select("item_key", F.explode(cut).alias("s")).select("item_key", "s.pos", "s.h")
    distinct = rows.groupBy("item_key", "h").agg(F.min("pos").alias("pos"))
    weights = distinct.groupBy("h").agg((F.lit(1.0) / F.count("*")).alias("w"))
    # heaviest first; an anchor set ends once it weighs more than 1 - SIMILARITY
    packed = distinct.join(weights, "h").groupBy("item_key").agg(F.sort_array(F.collect_list(F.struct("w", "h")), asc=False).alias("weighted"))
    total = F.aggregate("weighted", F.lit(0.0), lambda a, x: a + x["w"])
    packed = packed.withColumn("total", total)
    # counted from the heaviest: the shingles before the sum passes the bound, and one more
    packed = packed.withColumn("n_anchors", F.aggregate(
        "weighted", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, x: F.when(a["sum"] > (1 - SIMILARITY) * F.col("total") + 1e-9, a).otherwise(
            F.struct((a["sum"] + x["w"]).alias("sum"), (a["n"] + 1).alias("n"))), lambda a: a["n"]))
    packed = packed.withColumn("anchor_hashes", F.transform(F.slice("weighted", F.lit(1), F.col("n_anchors")), lambda x: x["h"]))
    places = rows.groupBy("item_key").agg(F.collect_list(F.struct("pos", "h")).alias("places"))
    return written(items.join(packed, "item_key").join(places, "item_key").select(
        "item", "item_key", F.size("words").alias("n_words"), simhash("words").alias("fingerprint"), "weighted", "total",
        F.filter("places", lambda p: F.array_contains("anchor_hashes", p["h"])).alias("anchors")), "prepared")


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) pairs with ``start_word`` (of the best window),
    ``distance`` (Hamming) and ``similarity`` (share of the item's weight)."""
    items = prepared_items(benchmark, item_id, item_text)
    anchors = written(items.select(F.col("n_words").alias("span"), F.explode("anchors").alias("a"))
                      .select("span", F.col("a.pos").alias("offset"), "a.h").distinct(), "anchors")
    if anchors.count() <= ANCHORS_SENT:
        anchors = F.broadcast(anchors)
    sizes = tuple(sorted(r[0] for r in items.select(F.least("n_words", F.lit(SHINGLE))).distinct().collect())) or (SHINGLE,)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("id", "text").alias("k"))           # rows of one (k, id) are copies
    # outer: an inner explode would have its shingles computed once more as a filter
    held = rows.select("k", words_of(F.col("text")).alias("words")).select("k", shingles("words", sizes).alias("s"))
    held = held.select("k", F.explode_outer("s").alias("s")).select("k", "s.pos", "s.h")
    places = written(held.join(anchors, "h").select("k", "span", (F.col("pos") - F.col("offset")).alias("start")).distinct(), "places")
    texts = rows.join(places.select("k").distinct(), "k", "left_semi").groupBy("k", "id").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    start = F.greatest(F.col("start"), F.lit(0))
    windows = texts.select("k", "id", "copies", words_of(F.col("text")).alias("words")).join(places, "k").select(
        "k", "id", "copies", "start", "span",
        F.slice("words", start + 1, F.least(F.col("start") + F.col("span"), F.size("words")) - start).alias("window"))
    windows = written(windows.withColumn("fingerprint", simhash("window")), "windows")
    pairs = within_radius(windows, items)
    full = pairs.join(windows.withColumnRenamed("id", "own_id"), ["k", "start", "span"]).where(F.col("id").eqNullSafe(F.col("own_id"))).join(
        items.select("item", "item_key", "weighted", "total"), "item_key")
    own = F.transform(shingles("window", sizes), lambda s: s["h"])
    full = full.withColumn("own", own)
    held = F.aggregate("weighted", F.lit(0.0), lambda a, x: a + F.when(F.array_contains("own", x["h"]), x["w"]).otherwise(F.lit(0.0)))
    full = full.withColumn("similarity", held / F.col("total")).where(F.col("similarity") >= SIMILARITY - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("near"), (-F.col("start")).alias("first")))
    out = full.groupBy("k", "id", "item_key", "item").agg(best.alias("best"), F.max("copies").alias("copies"))
    out = out.select("id", "item", "best", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), (-F.col("best.first")).alias("start_word"),
                      (-F.col("best.near")).alias("distance"), F.col("best.similarity").alias("similarity"))
