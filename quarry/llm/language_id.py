"""Language identification with string kernels.

Kernel: blended spectrum with presence bits. A text's set holds its character
1- to 3-grams (lower-cased letters, everything else one blank), hashed into
2^16 buckets; k(x, y) = |x and y| / sqrt(|x| |y|).

Model: Nystroem features over landmark texts, then one-versus-rest kernel ridge
regression, both fitted on the driver from a sample of at most
``sample_per_language`` labelled texts per language (packed bit sets of 8 KB
each, so the driver's data are bounded however long the texts are).

Scoring: as the kernel is linear in x's bits, landmarks times weights is one
matrix of buckets x languages; each Arrow batch is scored by matrix products
of (texts x buckets) with it.

Learned or not: the best score is at least 1 / languages whatever the text says,
so it cannot reject. A text in none of the learned languages, or no language at
all, has few grams that any landmark has; the model keeps what share the
labelled sample has at least (a landmark counts by the other landmarks).

Cases: a null text or one without a letter is ``und`` with score 0; texts are
read whole, whatever their length; null labels are not learned from; without
any labelled text every prediction is ``und``; ties go to the first language in
alphabetical order; repeated rows and null ids are returned as they are; only
id and text are read when predicting, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SLACK = 0.1                  # share of known grams that a text may have less than the sample
UND = "und"


def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() if not 0xD800 <= c < 0xE000 else 0 for c in range(0x110000)), np.bool_)


class Grams:
    """Presence bits of a text's n-grams."""

    _MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))

    def __init__(self):
        self.letter = _letters()

    def bits(self, text: str | None) -> np.ndarray | None:
        """Boolean vector over the buckets, None without any letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        letter = self.letter[points]
        if not letter.any():
            return None
        points = np.where(letter, points, np.uint32(32))
        points = points[letter | np.concatenate([[True], letter[:-1]])]     # one blank for a run
        bits = np.zeros(BUCKETS, np.bool_)
        mixed = [points * m for m in self._MIX]
        for n in ORDERS:
            if len(points) < n:
                break
            code = mixed[0][:len(points) - n + 1].copy()
            for k in range(1, n):
                code ^= mixed[k][k:len(points) - n + 1 + k]
            code += np.uint32(n)
            code *= np.uint32(0x27D4EB2F)
            bits[code >> np.uint32(16)] = True
        return bits


@dataclass
class Model:
    languages: list[str]
    buckets: np.ndarray          # buckets that any landmark has
    weights: np.ndarray          # float32, buckets x languages
    bias: np.ndarray
    known: float                 # share of known grams that 99 % of the labelled sample reach

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """(texts x languages) from boolean (texts x BUCKETS)."""
        sizes = np.sqrt(np.count_nonzero(bits, axis=1).astype(np.float32))
        return bits[:, self.buckets].astype(np.float32) @ self.weights / sizes[:, None] + self.bias
    def learned(self, bits: np.ndarray) -> np.ndarray:
        """Whether texts have the grams of a learned language; a text of few
        grams may miss by chance (two standard deviations)."""
        least, sizes = max(0.0, self.known - SLACK), np.count_nonzero(bits, axis=1)
        return np.count_nonzero(bits[:, self.buckets], axis=1) >= least * sizes - 2 * np.sqrt(least * (1 - least) * sizes)


def fit(bits: np.ndarray, labels: list[str], landmarks_per_language: int, ridge: float) -> Model | None:
    """Nystroem features over the first landmarks of each language, then ridge
    regression to +1 / -1 per language. ``bits``: boolean, samples x BUCKETS."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    marks = np.concatenate([np.flatnonzero(y == k)[:landmarks_per_language] for k in range(len(languages))])
    buckets = np.flatnonzero(bits[marks].any(axis=0))
    seen = np.count_nonzero(bits[marks], axis=0)
    others = np.ones(len(bits), np.int64)
    others[marks] = 2                                                  # a landmark itself and another one
    known = float(np.quantile([np.count_nonzero(seen[b] >= least) / np.count_nonzero(b) for b, least in zip(bits, others)], 0.01))
    x = bits[:, buckets].astype(np.float32)
    scaled = x[marks] / np.sqrt(bits[marks].sum(axis=1, dtype=np.float32))[:, None]
    kernel = (x / np.sqrt(bits.sum(axis=1, dtype=np.float32))[:, None]) @ scaled.T
    values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    feature = kernel @ whiten
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]          # every language weighs the same
    mean_f, mean_t = np.average(feature, 0, share), np.average(target, 0, share)
    centred = (feature - mean_f) * np.sqrt(share)[:, None]
    gram = centred.T @ centred + ridge * np.eye(centred.shape[1])
    beta = np.linalg.solve(gram, centred.T @ ((target - mean_t) * np.sqrt(share)[:, None]))
    return Model(languages, buckets, (scaled.T @ (whiten @ beta)).astype(np.float32), (mean_t - mean_f @ beta).astype(np.float32), known)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_per_language: int = 300, landmarks_per_language: int = 60, ridge: float = 1e-3) -> Model | None:
    """Fit on rows that are not held out. ``sample_per_language`` bounds the
    sample: the rows of least id hash of each language."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # a row per language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, (1.5 * sample_per_language + 30) / n))])
    thinned = rows.where((F.col("h") / 2.0**64 + 0.5) <= share[F.col("lang")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [(lang, h, b) for lang, h, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                                       batch.column(1).to_pylist()) if (b := grams.bits(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()),
                 pa.array([np.packbits(x[2]).tobytes() for x in found], pa.binary())], names=["lang", "h", "bits"])

    packed = thinned.mapInArrow(pack, "lang string, h bigint, bits binary").collect()
    chosen: dict[str, list[bytes]] = {}
    for r in sorted(packed, key=lambda r: (r["lang"], r["h"], bytes(r["bits"]))):
        own = chosen.setdefault(r["lang"], [])
        if len(own) < sample_per_language:
            own.append(bytes(r["bits"]))
    labels = [k for k, own in chosen.items() for _ in own]
    if not labels:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(b for own in chosen.values() for b in own), np.uint8)
                         .reshape(len(labels), -1), axis=1).astype(np.bool_)
    return fit(bits, labels, landmarks_per_language, ridge)


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = (), keep_text: bool = False, batch: int = 64,
             judge: bool = False) -> DataFrame:
    """Id, ``lang_pred``, ``score`` (0 to 1), the ``carry`` columns, with
    ``keep_text`` the text and with ``judge`` the column ``learned``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = (id_col, *carry, *((text_col,) if keep_text else ()))
    names = [*held, "lang_pred", "score", *(("learned",) if judge else ())]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, grams = shared.value, Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(part.num_columns - 1).to_pylist()
                sets = [grams.bits(t) if m else None for t in texts]
                known = [k for k, b in enumerate(sets) if b is not None]
                lang, score = [UND] * len(texts), [0.0] * len(texts)
                learned = [False] * len(texts)
                if known:
                    stacked = np.stack([sets[k] for k in known])
                    s = m.scores(stacked)
                    for k, ok in zip(known, m.learned(stacked).tolist() if judge else ()):
                        learned[k] = ok
                    for k, best, value in zip(known, s.argmax(axis=1), s.max(axis=1)):
                        lang[k], score[k] = m.languages[best], float(min(1.0, max(0.0, (value + 1) / 2)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(held)], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                                  *((pa.array(learned, pa.bool_()),) if judge else ())],
                                                 names=names)

    rows = docs.select(id_col, *carry, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double" + (", learned boolean" if judge else ""))
