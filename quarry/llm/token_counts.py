"""Token counts of a byte-level BPE vocabulary with the whole-token shortcut.

Before the job, every vocabulary string is pushed through the merge rules; the
strings that end as one token are *proved* whole. Inside the job a pre-token
found in that set counts as one without any merging, and only the rest is
merged. The proved set and the merge ranks are bounded by the vocabulary file,
read on the driver and broadcast, so executors need no tokenizer file.

Cases: a null or empty text has 0 bytes and 0 tokens; the vocabulary's special
strings inside a text count one token each; a text may be of any length (long
pre-tokens are merged with a heap); repeated rows and null ids are returned as
they are; an empty table gives an empty result; columns other than id and text
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs
from .pair_merge import LONG, Memo, PairTable, merge_one, merge_rows

# The white space the pre-tokenizer knows (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
# A chunk never cuts a pre-token: white space joins a chunk only as the one
# blank before it, as in the pre-tokenizer's own rule.
CHUNK = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# Up to here the character classes below are complete and do not depend on a
# Unicode version; other chunks are cut by the library's own pre-tokenizer.
LATIN_END = 0x250


def _latin_pattern() -> re.Pattern:
    import unicodedata
    kinds = {k: "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+"
                      f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """Byte → the printable character that stands for it in the vocabulary
    (printable Latin-1 bytes are themselves, the others follow from U+0100)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Merge rules of a byte-level BPE, applied to batches of pieces."""

    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int]):
        self.letters = byte_letters()
        self.of_byte = np.array([ids[self.letters[b]] for b in range(256)], np.int32)
        left, right, joined = ([ids[x] for x in side] for side in zip(*((a, b, a + b) for a, b in merges)))
        self.table = PairTable(np.array(left), np.array(right), np.arange(len(merges), dtype=np.int32), np.array(joined))

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of tokens of each piece after all merges."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out = np.zeros(len(raw), np.int64)
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= LONG]
        for a in range(0, len(short), 8192):
            part = short[a:a + 8192]
            flat = self.of_byte[np.frombuffer(b"".join([raw[k] for k in part]), np.uint8)]
            out[part] = merge_rows(self.table, flat, lengths[part])[1]
        for k in order[lengths[order] > LONG]:
            out[k] = len(merge_one(self.table, self.of_byte[np.frombuffer(raw[k], np.uint8)].tolist()))
        return out.tolist()

    def prove_whole(self, vocabulary: list[str]) -> set[str]:
        """Vocabulary entries, as text, whose merge ends in a single token."""
        back = {ch: b for b, ch in self.letters.items()}
        texts = []
        for token in vocabulary:
            try:
                texts.append(bytes(back[ch] for ch in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue                      # never a pre-token of valid text
        return {t for t, n in zip(texts, self.counts(texts)) if n == 1}


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizers JSON file that counting needs."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    d = json.loads(raw)
    pre = d["pre_tokenizer"]
    if d["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] \
            or d["model"].get("ignore_merges"):
        raise ValueError("expected a byte-level BPE without normalizer, prefix space or ignore_merges")
    added = d["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens with strip or single-word flags are not supported")
    return {"merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]],
            "ids": d["model"]["vocab"],
            "added": [t["content"] for t in added],
            "pre_tokenizer": json.dumps(d | {"model": d["model"] | {"vocab": {}, "merges": []}, "added_tokens": []})}


class TokenCounter:
    """Counts whole texts; one per task."""

    def __init__(self, parts: dict, whole: set[str], cap: int):
        self.bpe, self.whole = ByteBpe(parts["merges"], parts["ids"]), whole
        self.added = sorted(parts["added"], key=len, reverse=True)
        self.splitter = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.pre_json, self._pre = parts["pre_tokenizer"], None
        self.latin, self.chunk = _latin_pattern(), re.compile(CHUNK)
        self.beyond = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")
        self.pieces = Memo(self.bpe.counts, cap)
        self.chunks = Memo(self._new_chunks, cap)

    def pre_tokens(self, chunk: str) -> list[str]:
        if not self.beyond.search(chunk):
            return self.latin.findall(chunk)
        if self._pre is None:
            from tokenizers import Tokenizer
            self._pre = Tokenizer.from_str(self.pre_json).pre_tokenizer
        return [chunk[a:b] for _, (a, b) in self._pre.pre_tokenize_str(chunk)]

    def _new_chunks(self, chunks: list[str]) -> list[int]:
        cut = [self.pre_tokens(c) for c in chunks]
        rest = [[p for p in pieces if p not in self.whole] for pieces in cut]
        merged = self.pieces.look_up(set(chain.from_iterable(rest)))
        return [len(c) - len(r) + sum(map(merged.__getitem__, r)) for c, r in zip(cut, rest)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; ``texts`` should be some megabytes at most."""
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.splitter is not None and any(a in text for a in self.added):
                parts = self.splitter.split(text)
                out[k] += len(parts) - 1
                cut += [(k, self.chunk.findall(x)) for x in parts]
            else:
                cut.append((k, self.chunk.findall(text)))
        known = self.chunks.look_up(set(chain.from_iterable(c for _, c in cut)))
        for k, c in cut:
            out[k] += sum(map(known.__getitem__, c))
        return out


def count_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, cache: int = 150_000) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``limit``: the context budget that ``over_limit`` compares with.
    ``cache``: entries per generation of a task's memo (bounds its memory).
    """
    parts = read_vocabulary(vocabulary_path)
    whole = ByteBpe(parts["merges"], parts["ids"]).prove_whole(list(parts["ids"]))
    shared = docs.sparkSession.sparkContext.broadcast((parts, whole))
    kind = docs.schema[id_col].dataType.simpleString()

    sized = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def counted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value, cache)
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            counts = pa.array(chain.from_iterable(counter.counts(t) for t in text_runs(text)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, counts], names=[id_col, "n_bytes", "n_tokens"])

    counted = sized.mapInArrow(counted_batches, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
