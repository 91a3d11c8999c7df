"""Exact repeated-substring removal with run-length suffix indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else in the corpus (same document included).

1. Equal texts are one text (aggregated first); a text that occurs twice and is
   long enough is covered as a whole.
2. Every window of ``length`` bytes has one anchor: the least hash of its
   32-byte grams, leftmost on ties. Windows with the same anchor occurrence
   are a segment. Equal windows have equal anchors, so segments only have to
   be compared within their anchor's group, and every window is in one group.
3. Segments of a group that are equal as a whole cover each other. Groups with
   different segments bring one copy of each (its bytes) together.
4. Groups are packed into blocks of bounded size. A block's suffixes are sorted,
   the Burrows-Wheeler transform is cut into runs, and the suffix array is kept
   at run ends only. Longest common extensions are taken at run borders; all
   other matching statistics follow by streaming the text (one less per byte),
   and matches of ``length`` or more are marked.
5. A group with more than ``GROUP`` different segments would not fit a block;
   its windows are counted by 128-bit hash instead (partial aggregation).

Cases: null and empty texts, and texts shorter than ``length``, lose nothing;
texts may be of any length; rows are told apart by content, so null and
repeated ids are kept, each row for itself (a repeated row is another place);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, id_slot, written
from .shingles import SpanHash

GRAM = 32
GROUP = 4096                        # segments of one anchor that a block may hold
BLOCK = 1 << 20                     # bytes from which a block is closed
HELD = 1_000_000                    # rows of one anchor that a task holds at a time


class Anchors:
    """Segments of a text: (start, windows, anchor hash, content hash)."""

    def __init__(self, length: int):
        self.length, self.hash = length, SpanHash()

    def segments(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        data = np.frombuffer(raw, np.uint8)
        n = len(data) - self.length + 1
        if n <= 0:
            return None
        prefix = self.hash.prefix(data)
        at = np.arange(len(data) - GRAM + 1)
        gram = self.hash.spans(prefix, at, at + GRAM)
        # upper half of the hash, then the position: the least key is leftmost
        key = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width, done = self.length - GRAM + 1, 1
        while 2 * done <= width:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if done < width:
            key = np.minimum(key[:len(key) - (width - done)], key[width - done:])
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        windows = np.diff(np.concatenate([start, [n]]))
        content = self.hash.spans(prefix, start, start + windows + (self.length - 1))
        return start, windows, gram[place[start]], content


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (symbols 1-256, 0 at each position in ``ends``);
    a segment's end sorts before every byte, earlier segments first. Seven
    symbols at once, then doubling over the suffixes that are still tied."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(6, text.dtype)]).astype(np.int64)
    key, open_ = np.zeros(n, np.int64), np.ones(n, np.bool_)
    for k in range(7):                                    # nothing after a segment's end counts
        key = (key << 9) | np.where(open_, padded[k:k + n], 0)
        open_ &= padded[k:k + n] != 0
    order = np.argsort(key, kind="stable")
    new = np.ones(n, np.bool_)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | ~open_[order[1:]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first                                   # a class is named by its first place
    step = 7
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffixes = order[places]
        pair = rank[suffixes] * np.int64(n + 1) + rank[np.minimum(suffixes + step, n - 1)]
        by = np.argsort(pair, kind="stable")
        suffixes, pair = suffixes[by], pair[by]
        order[places] = suffixes
        border = np.ones(len(places), np.bool_)
        border[1:] = pair[1:] != pair[:-1]
        new[places] = border
        rank[suffixes] = places[np.maximum.accumulate(np.where(border, np.arange(len(places)), 0))]
        step *= 2


def common_length(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Longest common extension of positions ``a`` and ``b``, up to a segment's
    end; 0 where it is below ``least``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    step = 8
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        cols = np.arange(step)
        last = len(text) - 1
        s, t = text[np.minimum(x[:, None] + cols, last)], text[np.minimum(y[:, None] + cols, last)]
        stop = (s != t) | (s == 0) | (x[:, None] + cols > last) | (y[:, None] + cols > last)
        whole = ~stop.any(axis=1)
        out[live] += np.where(whole, step, stop.argmax(axis=1))
        live = live[whole]
        step = min(2 * step, 64)
    out[out < least] = 0
    return out


def matching_marks(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the maximal stretches covered by strings of
    ``length`` bytes that occur at two places in ``segments``."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint16)
    inside = np.ones(len(text), np.bool_)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, ends)
    before = text[order - 1]                              # the transform; 0 at a segment's first byte
    border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    # samples at run ends: the last suffix of a run and the first of the next
    left, right = order[border - 1], order[border]
    match = common_length(text, left, right, length)
    found = match > 0
    reach = np.zeros(len(text), np.int64)
    for side in (left, right):
        np.maximum.at(reach, side[found], side[found] + match[found])
    # streaming: matching statistics fall by one a byte between the samples
    statistics = np.maximum.accumulate(reach) - np.arange(len(text))
    starts = statistics >= length
    covered = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + statistics[at], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8), [0]])))
    begin, stop = edge[::2], edge[1::2]
    own = np.searchsorted(ends, begin)
    base = ends[own] - sizes[own]
    return list(zip(own.tolist(), (begin - base).tolist(), (stop - base).tolist()))


def distinct_texts(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, text) with every text once, and the ids (t1, t2, n_bytes) of
    those that occur more than once. Only texts whose hash may be repeated are
    shuffled, and copies meet as partial aggregates."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("t2"), F.col(text_col).alias("text"))
    copies = written(rows.select("t1", "t2", F.octet_length("text").alias("n_bytes")).groupBy("t1", "t2", "n_bytes")
                     .agg(F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    may = docs.sparkSession.sparkContext.broadcast(id_filter(copies, "t1"))
    slotted = rows.withColumn("slot", id_slot(F.col("t1")))
    once = _sift(slotted, may, False, "t1 bigint, t2 bigint, text string")
    more = _sift(slotted, may, True, "t1 bigint, t2 bigint, text string")
    return once.unionByName(more.groupBy("t1", "t2").agg(F.first("text").alias("text"))), copies


def _sift(rows: DataFrame, may, inside: bool, schema: str) -> DataFrame:
    """Rows whose last column, a filter slot, is (not) set; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = may.value[batch.column(batch.num_columns - 1).to_numpy()]
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(ok if inside else ~ok))

    return rows.mapInArrow(run, schema)


def segments(texts: DataFrame, length: int) -> DataFrame:
    """(h, d, t1, t2, place): anchor and content hash, text, start * 4096 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for t1, t2, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                found = anchors.segments(text.as_py().encode())
                if found is None:
                    continue
                start, windows, h, d = found
                out.append((h, d, np.full(len(h), t1), np.full(len(h), t2), start * 4096 + windows))
                size += len(h)
                if size > 200_000:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)],
                                          names=["h", "d", "t1", "t2", "place"])

    return texts.mapInArrow(run, "h bigint, d bigint, t1 bigint, t2 bigint, place bigint")


class _Groups:
    """Streams rows sorted by (h, d): equal segments (``many``) cover each
    other; one copy of each segment of a group with different ones goes on."""

    def __init__(self):
        self.cols = [np.empty(0, np.int64)] * 5
        self.told = False           # the first held row is covered and was returned
        self.open_anchor = None     # an anchor of which a part has been returned

    def add(self, cols: list[np.ndarray]) -> list[np.ndarray] | None:
        self.cols = [np.concatenate(x) for x in zip(self.cols, cols)]
        h, d = self.cols[0], self.cols[1]
        last = np.searchsorted(h, h[-1])                 # sorted: first row of the last group
        if last == 0:
            if len(h) <= HELD:
                return None
            self.open_anchor = h[-1]
            last = np.searchsorted(d, d[-1])
            if last == 0:                                # a single segment, again and again
                out = self._rows(np.arange(int(self.told), len(h)), 0)
                self.cols, self.told = [c[-1:] for c in self.cols], True
                return out
        return self._take(int(last))

    def end(self) -> list[np.ndarray] | None:
        return self._take(len(self.cols[0])) if len(self.cols[0]) else None

    def _rows(self, at: np.ndarray, kind: int, many: np.ndarray | None = None) -> list[np.ndarray]:
        return [np.full(len(at), kind, np.int32), np.zeros(len(at), np.bool_) if many is None else many, *[c[at] for c in self.cols]]

    def _take(self, n: int) -> list[np.ndarray]:
        h, d = self.cols[0][:n], self.cols[1][:n]
        start = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (d[1:] != d[:-1])) + 1])
        count = np.diff(np.concatenate([start, [n]]))
        many = count > 1
        many[0] |= self.told
        covered = np.repeat(many, count)
        if self.told:
            covered[0] = False
        _, group, runs = np.unique(h[start], return_inverse=True, return_counts=True)
        mixed = runs[group] > 1
        if self.open_anchor is not None:
            mixed |= h[start] == self.open_anchor
        out = [np.concatenate(x) for x in zip(self._rows(np.flatnonzero(covered), 0), self._rows(start[mixed], 1, many[mixed]))]
        self.cols, self.told = [c[n:] for c in self.cols], False
        return out


def grouped(found: DataFrame) -> DataFrame:
    """kind 0: covered segments; kind 1: one copy of each segment of a mixed group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups()

        def pack(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "many", "h", "d", "t1", "t2", "place"])

        for batch in batches:
            if batch.num_rows and (out := groups.add([c.to_numpy() for c in batch.columns])) is not None:
                yield pack(out)
        if (out := groups.end()) is not None:
            yield pack(out)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "h").sortWithinPartitions("h", "d").mapInArrow(
        run, "kind int, many boolean, h bigint, d bigint, t1 bigint, t2 bigint, place bigint")


def indexed(pieces: DataFrame, length: int) -> DataFrame:
    """Covered spans (t1, t2, start, end) of (h, many, t1, t2, start, bytes) by
    run-length indexes over blocks of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def marks() -> pa.RecordBatch:
            found = [(held[k], a, b) for k, a, b in matching_marks([x[4] for x in held], length) if not held[k][0]]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[1] for x, _, _ in found], pa.int64()), pa.array([x[2] for x, _, _ in found], pa.int64()),
                 pa.array([x[3] + a for x, a, _ in found], pa.int64()), pa.array([x[3] + b for x, _, b in found], pa.int64())],
                names=["t1", "t2", "start", "end"])

        for batch in batches:
            for h, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last and size >= BLOCK:
                    yield marks()
                    held, size = [], 0
                last = h
                held.append(tuple(rest))
                size += len(rest[4])
        if held:
            yield marks()

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.select("h", "many", "t1", "t2", "start", "bytes").repartition(n, "h").sortWithinPartitions("h")
            .mapInArrow(run, "t1 bigint, t2 bigint, start bigint, end bigint"))


def counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for the segments of crowded groups, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = SpanHash()
        for batch in batches:
            for many, t1, t2, start, raw in zip(*(batch.column(c).to_pylist() for c in ("many", "t1", "t2", "start", "bytes"))):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                first = spans.spans(spans.prefix(data), at, at + length)
                second = spans.spans(spans.prefix(data ^ np.uint8(0x5A)), at, at + length)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(n, 2 if many else 1, np.int64)),
                     pa.array(np.full(n, t1)), pa.array(np.full(n, t2)), pa.array(start + at)],
                    names=["w1", "w2", "places", "t1", "t2", "start"])

    windows = pieces.mapInArrow(run, "w1 bigint, w2 bigint, places bigint, t1 bigint, t2 bigint, start bigint")
    again = windows.groupBy("w1", "w2").agg(F.sum("places").alias("n")).where("n > 1").select("w1", "w2")
    return windows.join(again, ["w1", "w2"]).select("t1", "t2", "start", (F.col("start") + length).alias("end"))


def repeated_spans(texts: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, end): covered spans of every distinct text (overlapping)."""
    spark = texts.sparkSession
    rows = written(grouped(segments(texts, length)), "segments")
    start, windows = F.shiftright("place", 12), F.col("place").bitwiseAND(F.lit(4095))
    covered = rows.where("kind = 0").select("t1", "t2", start.alias("start"), (start + windows + (length - 1)).alias("end"))
    mixed = rows.where("kind = 1").select("h", "many", "t1", "t2", start.alias("start"), (windows + (length - 1)).cast("int").alias("size"))
    crowded = mixed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("crowded"))
    may = spark.sparkContext.broadcast(id_filter(mixed, "t1"))
    near = _sift(texts.withColumn("slot", id_slot(F.col("t1"))), may, True, "t1 bigint, t2 bigint, text string")
    pieces = mixed.join(near, ["t1", "t2"]).select("h", "many", "t1", "t2", "start", F.substring(
        F.encode("text", "utf-8"), (F.col("start") + 1).cast("int"), F.col("size")).alias("bytes"))
    pieces = written(pieces.join(crowded, "h", "left"), "pieces")
    spans = covered.unionByName(indexed(pieces.where("crowded IS NULL"), length))
    if pieces.where("crowded").limit(1).count():
        spans = spans.unionByName(counted(pieces.where("crowded"), length))
    whole = copies.where(F.col("n_bytes") >= length).select(
        "t1", "t2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end"))
    return spans.unionByName(whole)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``spans`` (array of start, end of
    the removed runs, in bytes) and ``kept`` (the other bytes, binary)."""
    if length < GRAM or length - GRAM + 1 > 4095:
        raise ValueError(f"length has to be between {GRAM} and {GRAM + 4094}")
    texts, copies = distinct_texts(docs, text_col)
    spans = written(repeated_spans(texts, copies, length).groupBy("t1", "t2").agg(
        F.collect_list(F.struct("start", "end")).alias("found")), "spans")
    may = docs.sparkSession.sparkContext.broadcast(id_filter(spans, "t1"))
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"),
                       F.xxhash64(F.lit(1), text).alias("t2"))
    rows = rows.withColumn("slot", id_slot(F.col("t1")))
    schema = f"id {kind}, text string, t1 bigint, t2 bigint"
    array = "array<struct<start: bigint, end: bigint>>"
    free = _sift(rows, may, False, schema).select("id", F.encode("text", "utf-8").alias("raw"), F.lit(None).cast(array).alias("found"))
    hit = _sift(rows, may, True, schema).join(spans, ["t1", "t2"], "left").select("id", F.encode("text", "utf-8").alias("raw"), "found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept = [], []
            for raw, found in zip(batch.column(1), batch.column(2)):
                raw, out = raw.as_py(), []
                if found.is_valid:
                    v = found.values
                    a, b = v.field(0).to_numpy(), v.field(1).to_numpy()
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    first = np.concatenate([[True], a[1:] > b[:-1]])
                    at = np.flatnonzero(first)
                    out = list(zip(a[at].tolist(), b[np.concatenate([at[1:], [len(a)]]) - 1].tolist()))
                merged.append([{"start": s, "end": e} for s, e in out])
                edges = [0, *(x for s in out for x in s), len(raw)]
                kept.append(b"".join(raw[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=[id_col, "spans", "kept"])

    cut_rows = hit.mapInArrow(cut, f"`{id_col}` {kind}, spans {array}, kept binary")
    whole = free.select(F.col("id").alias(id_col), F.array().cast(array).alias("spans"), F.col("raw").alias("kept"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return whole.unionByName(cut_rows).select(id_col, (F.octet_length("kept") + removed).alias("n_bytes"), "spans", "kept")
