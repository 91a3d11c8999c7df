"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut into units no piece can cross (before a run of blanks, and
around a line feed; both are checked against the vocabulary). Every unit runs
an agenda of its adjacent symbol pairs ordered by piece score, leftmost first
on ties (``pair_merge``), and what stays outside the vocabulary falls back to
byte pieces. The units that are new to a worker are checked, one Arrow batch at a
time, against the sentencepiece library: on a difference the library's ids are
taken and counted in ``n_differs``. Ids, and the bytes that they decode to, are
kept per unit; a document's are the runs of its units put together.

The model is read on the driver and broadcast (bounded by its file size).

Cases: a null or empty text has no ids and decodes to the empty text; texts may
be of any length (long units take a heap); U+2581 counts as a blank, as in the
library; repeated rows and null ids are returned as they are; an empty table
gives an empty result; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, text_runs
from .pair_merge import PairTable, merge_units, spread

BLANK = "▁"                 # fixed value: the library's visible blank
UNITS = re.compile(r" +[^ \n]+|\n|[^ \n]+| +")
LONG_UNIT = 64                   # longer units are forgotten first
CHECKED = 8_000                # characters of units in one call of the library
BEYOND = 0x110000


class UnitStore:
    """Ids and decoded bytes of units, as runs of two flat arrays. Beyond ``cap``
    units (or eight ids a unit) the store keeps the more used half."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 decode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], cap: int):
        self.compute, self.decode, self.cap = compute, decode, cap
        self.index: dict[str, int] = {}
        self.used = np.empty(0, np.int64)
        self.ids, self.n_ids = np.empty(0, np.int32), np.empty(0, np.int64)
        self.raw, self.n_raw = np.empty(0, np.uint8), np.empty(0, np.int64)
        self._place()

    def _place(self) -> None:
        self.at_ids, self.at_raw = np.cumsum(self.n_ids) - self.n_ids, np.cumsum(self.n_raw) - self.n_raw

    def _shrink(self) -> None:
        units = list(self.index)
        short = np.fromiter(map(len, units), np.int64, len(units)) <= LONG_UNIT
        keep = np.argsort(np.where(short, self.used, -1), kind="stable")[len(units) - self.cap // 2:] \
            if len(units) > self.cap // 2 else np.arange(len(units))
        keep = np.sort(keep[short[keep]])
        self.ids, self.raw = spread(self.ids, self.at_ids[keep], self.n_ids[keep]), spread(self.raw, self.at_raw[keep], self.n_raw[keep])
        self.n_ids, self.n_raw, self.used = self.n_ids[keep], self.n_raw[keep], self.used[keep] // 2
        self.index = {units[k]: i for i, k in enumerate(keep.tolist())}
        self._place()

    def codes(self, units: list[str]) -> np.ndarray:
        """The place of each unit in the store, which holds all of them now."""
        distinct = set(units)
        new = distinct.difference(self.index)
        if new and (len(self.index) + len(new) > self.cap or len(self.ids) > 8 * self.cap):
            self._shrink()
            new = distinct.difference(self.index)
        if new:
            fresh = list(new)
            ids, n_ids = self.compute(fresh)
            raw, n_raw = self.decode(ids, n_ids)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.ids, self.n_ids = np.concatenate([self.ids, ids]), np.concatenate([self.n_ids, n_ids])
            self.raw, self.n_raw = np.concatenate([self.raw, raw]), np.concatenate([self.n_raw, n_raw])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
            self._place()
        codes = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        self.used += np.bincount(codes, minlength=len(self.used))
        return codes


class PieceCodec:
    """Agenda encoder and decoder over one model."""

    def __init__(self, model: bytes, cap: int = 360_000):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = len(sp)
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self._check(normal)
        of = {self.pieces[i]: i for i in normal}
        # single characters that occur only inside pieces are symbols as well
        extra = sorted(set("".join(of)) - of.keys())
        self.base = n + len(extra)
        symbol = of | {ch: n + k for k, ch in enumerate(extra)}
        self.symbol_of = np.arange(BEYOND, dtype=np.int32) + self.base
        for ch, i in symbol.items():
            if len(ch) == 1:
                self.symbol_of[ord(ch)] = i
        self.outside = {n + k: ch for k, ch in enumerate(extra)}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        rows = [(symbol[p[:k]], symbol[p[k:]], order[sp.get_score(i)], i)
                for p, i in of.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, priority, merged = (np.array(c, np.int64) for c in zip(*rows))
        self.table = PairTable(left, right, priority.astype(np.int32), merged.astype(np.int32))
        # decoding
        self.id_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
                         else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(BLANK, " ").encode()
                         for i, p in enumerate(self.pieces)]
        self.blank_first = {i for i in normal if self.pieces[i].startswith(BLANK)}
        self.piece_raw = np.frombuffer(b"".join(self.id_bytes), np.uint8)
        self.n_piece_raw = np.fromiter(map(len, self.id_bytes), np.int64, n)
        self.at_piece_raw = np.cumsum(self.n_piece_raw) - self.n_piece_raw
        self.starts_blank = np.array([p.startswith(BLANK) for p in self.pieces]) & np.isin(np.arange(n), normal)
        self.feed = self.sp.encode("\n")               # the prefix blank and the line feed
        self.differs = 0
        self.store = UnitStore(self.encode_units, self._raw_of, cap)

    def _check(self, normal: list[int]) -> None:
        # the first blank stands for the added prefix and no normalization happens
        if self.sp.encode("") or self.sp.encode("  a", out_type=str) != self.sp.encode(f"{BLANK} a", out_type=str) \
                or self.sp.decode(self.sp.encode("ﬁ  ａ\t")) != "ﬁ  ａ\t":
            raise ValueError("expected a model with identity normalization that keeps white space")
        for i in normal:
            p = self.pieces[i]
            if BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1):
                raise ValueError(f"piece {p!r} would cross a unit border")

    def units(self, text: str) -> list[str]:
        return UNITS.findall(" " + text.replace(BLANK, " ")) if text else []

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Agenda per unit, then the check against the library: all ids, one
        unit after another, and how many each unit has."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.symbol_of[np.where(points == 32, ord(BLANK), points)]
        ids, n_ids = self._final(*merge_units(self.table, symbols, lengths))
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // CHECKED, prepend=0)).tolist()
        ends = np.cumsum(n_ids)
        good = True
        for a, b in zip([0, *cuts], [*cuts, len(units)]):
            if a < b and good:
                good = self._agrees(units[a:b], ids[ends[a] - n_ids[a]:ends[b - 1]], n_ids[a:b])
        return (ids, n_ids) if good else self._of_library(units, ids, n_ids)

    def _agrees(self, units: list[str], ids: np.ndarray, n_ids: np.ndarray) -> bool:
        """Whether the library finds these ids; a line feed sets units apart."""
        if len(self.feed) != 2:
            return False
        theirs = np.array(self.sp.encode("\n" + "\n".join(units), num_threads=1), np.int32)
        at = np.cumsum(n_ids) - n_ids
        return np.array_equal(theirs, np.concatenate([self.feed[:1], np.insert(ids, at, self.feed[1])]))

    def _of_library(self, units: list[str], ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a line feed before the unit takes the library's prefix blank
        theirs = [x[len(self.feed):] for x in self.sp.encode(["\n" + u for u in units], num_threads=1)]
        ends = np.cumsum(n_ids).tolist()
        own = ids.tolist()
        self.differs += sum(own[e - n:e] != t for e, n, t in zip(ends, n_ids.tolist(), theirs))
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        return np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum())), sizes

    def _final(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary as byte pieces (else as unknown)."""
        n = len(self.pieces)
        places = np.flatnonzero(ids >= n)
        if not len(places):
            return ids, sizes
        distinct, which = np.unique(ids[places], return_inverse=True)
        chars = [chr(i - self.base) if i >= self.base else self.outside[i] for i in distinct.tolist()]
        runs = [[self.byte_id[b] for b in ch.encode()] if self.byte_id else [self.unknown] for ch in chars]
        length = np.array([len(r) for r in runs])
        flat = np.array(list(chain.from_iterable(runs)), np.int32)
        times = np.ones(len(ids), np.int64)
        times[places] = length[which]
        out = np.repeat(ids, times)
        out[np.repeat(ids >= n, times)] = spread(flat, (np.cumsum(length) - length)[which], length[which])
        ends = np.concatenate([[0], np.cumsum(times)])
        stop = np.cumsum(sizes)
        return out, ends[stop] - ends[stop - sizes]

    def _raw_of(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that each unit's ids decode to."""
        size = self.n_piece_raw[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(n_ids)
        return spread(self.piece_raw, self.at_piece_raw[ids], size), ends[stop] - ends[stop - n_ids]

    def encode_decode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and decoded bytes of all texts, one after another, each with the
        borders of the texts (one more than there are texts)."""
        cut = [self.units(t) if t else [] for t in texts]
        border = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        store, codes = self.store, self.store.codes(list(chain.from_iterable(cut)))
        n_ids, n_raw = store.n_ids[codes], store.n_raw[codes]
        ids, raw = spread(store.ids, store.at_ids[codes], n_ids), spread(store.raw, store.at_raw[codes], n_raw)
        id_ends, raw_ends = (np.concatenate([[0], np.cumsum(x)])[border] for x in (n_ids, n_raw))
        some = np.flatnonzero(np.diff(id_ends))
        blank = some[self.starts_blank[ids[id_ends[some]]]]          # texts that lose the prefix blank
        raw = np.delete(raw, raw_ends[blank])
        raw_ends = raw_ends - np.searchsorted(blank, np.arange(len(border)))
        return ids, id_ends, raw, raw_ends

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, ends, _, _ = self.encode_decode(texts)
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = b"".join(map(self.id_bytes.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text[1:] if ids[0] in self.blank_first else text

    def _decode_broken(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8: U+FFFD for each byte that fits nowhere."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.sp.is_byte(i):
                run += self.id_bytes[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.id_bytes[i].decode())
        return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                  cache: int = 360_000) -> DataFrame:
    """One row per document: id, ``ids`` (array of int), ``decoded`` (string)
    and ``n_differs``: units that the worker first met with this document's run
    of texts whose agenda and library ids differ (0 unless the agenda is wrong;
    else it depends on what the worker met before, as a diagnostic may).

    ``cache``: units that a worker's store holds (bounds its memory).
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker("pieces", (sha256(model.value).digest(), cache), lambda: PieceCodec(model.value, cache))
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1)):
                before = codec.differs
                ids, id_ends, raw, raw_ends = codec.encode_decode(texts)
                id_lists = pa.ListArray.from_arrays(id_ends.astype(np.int32), ids)
                decoded = pa.StringArray.from_buffers(len(texts), pa.py_buffer(raw_ends.astype(np.int32)), pa.py_buffer(raw))
                try:
                    decoded.validate(full=True)
                except pa.ArrowInvalid:                    # byte pieces that are no UTF-8
                    decoded = pa.array([codec.decode(x) for x in id_lists.to_pylist()], pa.string())
                differs = [codec.differs - before] + [0] * (len(texts) - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), id_lists, decoded, pa.array(differs, pa.int64())],
                    names=[id_col, "ids", "decoded", "n_differs"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>, decoded string, n_differs bigint")
