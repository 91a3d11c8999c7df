"""Toxicity scores from a learned lexicon, misspellings included.

1. *Lexicon*. From a bounded sample of labelled rows: every word and every word
   beginning is counted by its distinct left neighbours in toxic and in clean
   texts (a passage that is copied counts once), and those that stand out in
   toxic texts become entries, whole words or stems that any ending may follow.
2. *Automaton*. The entries form a trie; the Levenshtein automaton of each entry
   (0, 1 or 2 edits by its length) is run over the trie as one automaton, made
   deterministic state by state as words call for it. All distinct words of an
   Arrow batch walk it side by side.
3. *Context*. Each hit is read in its window of words: inside quotation marks or
   a quoted line, after a word of reporting, next to a word of address, among
   other hits. Quoted and reported hits count apart from abuse.
4. *Score*. A class of hits (entry, edits, same first letter) weighs what the
   sample says, drawn to a prior; five features of a text (its worst hits, their
   sum and their share of the words) go into a logistic regression drawn to
   prior weights.

The sample is thinned by a hash of the id: about ``sample`` rows a label, four
times that of clean ones. The driver sees the leading word beginnings (at most
``candidates``), and one row of hits per sampled text.

Cases: a null or empty text has no hits and gets the score of such a text; runs
of three or more equal letters count as one letter; a character that stands for
a letter (``@ $ * !`` or a digit inside a word) is one edit; labels that differ
for one id count as toxic, null labels and labels of no document are ignored; a
null id is never learned from nor held out; without toxic training rows or
without a word that stands out every text gets the base rate; repeated rows are
scored alike; other columns are ignored, so names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_runs, written

WORD = re.compile(r"[@$0-9]?[^\W\d_](?:[^\W_]|[@$*!](?=[^\W\d_]))*")
RUNS = re.compile(r"(.)\1\1+")
Hit = tuple[int, int, bool, int, int]        # entry, edits, same first letter, kind, other hits near (3: or more)
Found = tuple[dict[Hit, int], int]           # how often each hit occurs, and the words of the text
QUOTES = re.compile("\"[^\"\n]{1,600}\"|“[^”\n]{1,600}”|„[^“”\n]{1,600}[“”]|«[^»\n]{1,600}»|‹[^›\n]{1,600}›|^[ \t]*>[^\n]*",
                    re.MULTILINE)

# Words that introduce what somebody else said, and words that
# address the reader, in the languages of the documents.
REPORTING = frozenset("""said says saying called calls calling wrote writes quoted quote quoting word term slur
    sagte sagt nannte nennt schrieb schreibt wort zitat
    dit disait appelé appelle écrit mot terme citation
    dijo dice llamó llama escribió palabra término cita""".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu toi te vous votre usted ustedes eres tú vos".split())

PLAIN, ADDRESSED, QUOTED, REPORTED = range(4)
MARK = "\0"                     # ends the whole-word entries of the lexicon
LONGEST_STEM = 8
PRIOR = np.array([-2.0, 1.0, 0.5, 0.3, 0.2, 0.5])
# chance that a word is abuse by (edits, same first letter), before the sample speaks
CHANCE = {(0, True): 0.95, (1, True): 0.85, (1, False): 0.6, (2, True): 0.75, (2, False): 0.5}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def edits_allowed(entry: str) -> int:
    """Edits within which a word still counts as the entry (its mark included)."""
    n = len(entry.rstrip(MARK)) - (0 if entry.endswith(MARK) else 2)      # a stem needs more letters
    return 0 if n < 4 else 1 if n < 9 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all entries over their trie, determinized on
    demand. A state is a set of (trie node, edits so far)."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        letters = sorted(set("".join(entries)) - {MARK})
        self.class_of = {ch: k + 1 for k, ch in enumerate(letters)}           # 0: any other character
        self.children: list[dict[int, int]] = [{}]
        self.allowed = [0]                                                     # most edits of an entry below
        self.final: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.budget = [edits_allowed(e) for e in entries]
        for k, e in enumerate(entries):
            node = 0
            self.allowed[0] = max(self.allowed[0], self.budget[k])
            for ch in e.rstrip(MARK):
                nxt = self.children[node].setdefault(self.class_of[ch], len(self.children))
                if nxt == len(self.children):
                    self.children.append({})
                    self.allowed.append(0)
                    self.final.append(-1)
                    self.stem.append(-1)
                node = nxt
                self.allowed[node] = max(self.allowed[node], self.budget[k])
            (self.final if e.endswith(MARK) else self.stem)[node] = k
        self.none = 3 * max(1, len(entries))                                   # code of no match
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next = np.empty((0, len(letters) + 1), np.int32)
        self.at_end, self.on_way = np.empty(0, np.int32), np.empty(0, np.int32)
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))
        self.first = np.array([ord(e[0]) for e in entries], np.int64)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With letters of entries left out: a child costs one more edit."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.allowed[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            if len(self.sets) > len(self.next):
                more = max(64, len(self.next))
                self.next = np.concatenate([self.next, np.full((more, self.next.shape[1]), -1, np.int32)])
                self.at_end, self.on_way = (np.concatenate([x, np.full(more, self.none, np.int32)]) for x in (self.at_end, self.on_way))
            n = len(self.entries)
            for out, accepts in ((self.at_end, self.final), (self.on_way, self.stem)):
                codes = [e * n + accepts[node] for node, e in key if accepts[node] >= 0 and e <= self.budget[accepts[node]]]
                out[self.number[key]] = min(codes, default=self.none)
        return self.number[key]

    def _step(self, state: int, cls: int) -> int:
        out: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)                                                 # a letter too many
            for c, child in self.children[node].items():
                reach(child, e if c == cls else e + 1)
        return self._state(self._closed(out))

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word the nearest entry (-1: none), its edits, and whether the
        first letters agree."""
        n = max(1, len(self.entries))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        seen, which = np.unique(points, return_inverse=True)
        classes = np.array([self.class_of.get(chr(c), 0) for c in seen.tolist()], np.int32)[which] if len(seen) else which
        at = np.cumsum(lengths) - lengths
        best = np.full(len(words), self.none, np.int32)
        live = np.flatnonzero(lengths > 0)
        state = np.full(len(live), self.start, np.int32)
        k = 0
        while len(live):
            cls = classes[at[live] + k]
            to = self.next[state, cls]
            unknown = to < 0
            if unknown.any():
                for pair in np.unique(state[unknown].astype(np.int64) * self.next.shape[1] + cls[unknown]).tolist():
                    s, c = divmod(pair, self.next.shape[1])
                    target = self._step(s, c)                                  # may make the table longer
                    self.next[s, c] = target
                to = self.next[state, cls]
            k += 1
            best[live] = np.minimum(best[live], self.on_way[to])
            ended = lengths[live] == k
            best[live[ended]] = np.minimum(best[live[ended]], self.at_end[to[ended]])
            going = ~ended & (to != self.dead)
            live, state = live[going], to[going]
        entry = np.where(best < self.none, best % n, -1)
        same = np.zeros(len(words), bool)
        hit = np.flatnonzero(entry >= 0)
        same[hit] = points[at[hit]] == self.first[entry[hit]]
        return entry, best // n, same


def fold(text: str) -> str:
    return RUNS.sub(r"\1", text) if RUNS.search(text) else text


class HitFinder:
    """Hits of texts with their context."""

    def __init__(self, automaton: LexiconAutomaton):
        self.automaton = automaton

    def find(self, texts: list[str | None]) -> list[Found]:
        lowered = [t.lower() if t else "" for t in texts]
        found = [WORD.findall(t) for t in lowered]
        word_sets = [set(w) for w in found]
        words = list(set(chain.from_iterable(word_sets)))
        entry, edits, same = self.automaton.match([fold(w) for w in words])
        hits = {words[k]: (int(entry[k]), int(edits[k]), bool(same[k])) for k in np.flatnonzero(entry >= 0).tolist()}
        return [(self._in_text(t, hits) if not hits.keys().isdisjoint(s) else {}, len(w))
                for t, s, w in zip(lowered, word_sets, found)]

    @staticmethod
    def _in_text(text: str, hits: dict) -> dict[Hit, int]:
        words, starts = zip(*((m.group(), m.start()) for m in WORD.finditer(text)))
        at = [k for k, w in enumerate(words) if w in hits]
        spans = [m.span() for m in QUOTES.finditer(text)]
        places = np.array(at)
        near = np.searchsorted(places, places + 8, side="right") - np.searchsorted(places, places - 8) - 1
        span_start = np.array([s for s, _ in spans])
        out: Counter = Counter()
        for k, n in zip(at, near.tolist()):
            i = int(np.searchsorted(span_start, starts[k], side="right")) - 1
            if i >= 0 and starts[k] < spans[i][1]:
                kind = QUOTED
            elif not REPORTING.isdisjoint(words[max(0, k - 4):k]):
                kind = REPORTED
            else:
                kind = PLAIN if ADDRESS.isdisjoint(words[max(0, k - 4):k + 5]) else ADDRESSED
            out[(*hits[words[k]], kind, min(n, 3))] += 1
        return out


class Model:
    def __init__(self, entries: list[str], weights: dict[tuple[int, int, bool], float], beta: np.ndarray):
        self.entries, self.weights, self.beta = entries, weights, beta

    def scores(self, texts: list[Found]) -> np.ndarray:
        x = np.array([features(f, self.weights) for f in texts]).reshape(len(texts), len(PRIOR))
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def default_weight(edits: int, same: bool) -> float:
    p = CHANCE.get((edits, same), 0.5)
    return float(np.log(p / (1 - p)))


def features(found: Found, weights: dict[tuple[int, int, bool], float]) -> list[float]:
    """[1, worst abuse, log of all abuse, worst addressed abuse, worst quotation,
    log of abuse per 100 words]."""
    hits, n_words = found
    worst = addressed = quoted = total = 0.0
    for (entry, edits, same, kind, near), times in hits.items():
        w = weights.get((entry, edits, same))
        w = max(0.0, default_weight(edits, same) if w is None else w)
        if kind in (QUOTED, REPORTED):
            quoted = max(quoted, w)
            continue
        total += w * times
        worst = max(worst, w * (1 + 0.1 * near))
        if kind == ADDRESSED:
            addressed = max(addressed, w)
    return [1.0, worst, float(np.log1p(total)), addressed, quoted, float(np.log1p(100 * total / max(n_words, 1)))]


def choose_entries(rows: list[tuple[str, int, int]], all_toxic: int, all_clean: int, *, evidence: float, ratio: float,
                   limit: int) -> list[str]:
    """From (word beginning, toxic, clean) counts the entries, strongest evidence
    first; of beginnings of one another only the one with more evidence (the
    longer one on a tie) stays."""
    p = all_toxic / (all_toxic + all_clean)
    scored = []
    for text, t, c in rows:
        rate = (t + 0.5) / all_toxic / ((c + 0.5) / all_clean)
        g = 2 * (t * np.log(max(t, 1e-9) / ((t + c) * p)) + (c * np.log(c / ((t + c) * (1 - p))) if c else 0.0))
        if rate >= ratio and g >= evidence:
            scored.append((-g, -len(text), text))
    chosen: list[str] = []
    taken: set[str] = set()
    inner: set[str] = set()
    for _, _, text in sorted(scored):
        if len(chosen) == limit:
            break
        if text in inner or any(text[:k] in taken for k in range(1, len(text) + 1)):
            continue
        chosen.append(text)
        taken.add(text)
        inner.update(text[:k] for k in range(1, len(text) + 1))
    return chosen


def fit(found: list[Found], toxic: np.ndarray, entries: list[str],
        ridge: float = 1.0, strength: float = 4.0) -> Model:
    """Weights of the hit classes, then the logistic regression (Newton steps)."""
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    counts = (Counter(chain.from_iterable({x[:3] for x in h} for (h, _), t in zip(found, toxic) if t == side)) for side in (True, False))
    in_toxic, in_clean = counts
    weights = {}
    for key in in_toxic.keys() | in_clean.keys():
        t, c = in_toxic[key] * n_clean / n_toxic, in_clean[key]
        p0 = CHANCE.get(key[1:], 0.5)
        p = (t + strength * p0) / (t + c + strength)
        weights[key] = float(np.log(p / (1 - p)))
    beta = PRIOR.copy()
    if len(found):
        x, y = np.array([features(f, weights) for f in found]), toxic.astype(float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (y - p) - ridge * (beta - PRIOR)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), gradient)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return Model(entries, weights, beta)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of the thinned training rows; the ids are at most about five
    times ``sample``, so they may be broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).alias("_k")).agg((F.max(label_col) > 0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic"), min(1.0, sample / max(1, sizes.get(True, 0)))).otherwise(
        min(1.0, 4 * sample / max(1, sizes.get(False, 0))))
    ids = known.where(F.xxhash64(F.col("_k").cast("string")) / 2.0**64 + 0.5 <= share)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_k"), F.col(text_col).alias("text"))
    return written(rows.join(F.broadcast(ids), "_k").select("text", "toxic"), "toxicity-sample")


def _beginnings(rows: DataFrame, candidates: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """Word beginnings and whole words with their counts of distinct left
    neighbours in toxic and in clean texts, and the sums over all words."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str, bool]] = set()
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [fold(w) for w in WORD.findall(t.lower())]
                found.update(zip(words, ["", *words], [toxic] * len(words)))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                              pa.array(columns[2], pa.bool_())], names=["word", "prev", "toxic"])

    words = (rows.mapInArrow(pairs, "word string, prev string, toxic boolean")
             .select("word", F.xxhash64("prev").alias("prev"), "toxic").distinct()
             .groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")))
    words = written(words, "toxicity-words")
    total = words.agg(F.sum("t"), F.sum("c")).first()
    whole = words.select(F.concat("word", F.lit(MARK)).alias("b"), "t", "c").where(F.char_length("word") >= 3)
    stems = words.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(LONGEST_STEM)), lambda k: F.when(
        F.char_length("word") > k, F.substring("word", F.lit(1), k)))).alias("b"), "t", "c").where("b IS NOT NULL")
    all_t, all_c = (total[0] or 0), (total[1] or 0)
    standing = (whole.unionByName(stems).groupBy("b").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
                .where((F.col("t") >= 5) & (F.col("t") * max(1, all_c) > 5 * F.col("c") * max(1, all_t)))
                .orderBy(F.desc("t"), "b").limit(candidates))
    return [tuple(r) for r in standing.collect()], all_t, all_c


def _encoded(hit: Hit) -> int:
    entry, edits, same, kind, near = hit
    return (((entry * 3 + edits) * 2 + same) * 4 + kind) * 4 + near


def _decoded(code: int) -> Hit:
    return code // 96, code // 32 % 3, bool(code // 16 % 2), code // 4 % 4, code % 4


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = 2_500, candidates: int = 20_000, entries: int = 400, evidence: float = 60.0,
          ratio: float = 8.0) -> Model:
    """Lexicon and weights from the labelled rows that are not held out.

    ``sample``: toxic rows that are read at most, about (four times as many clean
    ones). ``evidence``: least G-statistic of an entry, ``ratio``: least quotient
    of its rates in toxic and clean texts.
    """
    rows = _sample(docs, labels, id_col, text_col, label_col, sample)
    found, all_t, all_c = _beginnings(rows, candidates)
    lexicon = choose_entries(found, all_t, all_c, evidence=evidence, ratio=ratio, limit=entries) if all_t and all_c else []
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = HitFinder(LexiconAutomaton(shared.value))
        for batch in batches:
            found = [f for t in text_runs(batch.column(0)) for f in finder.find(t)]
            codes = [{_encoded(x): n for x, n in sorted(h.items())} for h, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(c) for c in codes], pa.list_(pa.int32())), pa.array([list(c.values()) for c in codes], pa.list_(pa.int32())),
                 pa.array([n for _, n in found], pa.int32()), batch.column(1)], names=["hits", "times", "n_words", "toxic"])

    seen = rows.mapInArrow(hits_of, "hits array<int>, times array<int>, n_words int, toxic boolean").collect()   # bounded by the sample
    seen = sorted((tuple(r["hits"]), tuple(r["times"]), r["n_words"], r["toxic"]) for r in seen)
    return fit([(dict(zip(map(_decoded, h), t)), n) for h, t, n, _ in seen], np.array([x[3] for x in seen], bool), lexicon)


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1), ``n_hits`` (abuse) and ``n_quoted`` (quoted or
    reported) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        finder = HitFinder(LexiconAutomaton(m.entries))
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1)):
                found = finder.find(texts)
                quoted = [sum(n for x, n in h.items() if x[3] in (QUOTED, REPORTED)) for h, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(m.scores(found), pa.float64()),
                     pa.array([sum(h.values()) - q for (h, _), q in zip(found, quoted)], pa.int64()), pa.array(quoted, pa.int64())],
                    names=[id_col, "score", "n_hits", "n_quoted"])
                at += len(texts)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, n_hits bigint, n_quoted bigint")
