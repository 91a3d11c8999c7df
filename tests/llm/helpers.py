"""Small fixtures: the table with every awkward row, and brute-force versions."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, t1 bigint, words string, id int, plain string, slot int"


def table(spark, texts, source="a", lang="en"):
    """documents with extra columns whose names the operators use inside."""
    rows = [(k, t, lang, source, None if t is None else len(t), 7, "x", k, "y", 3) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    return table(spark, [(1, None), (2, ""), (3, "x"), (None, "no id at all here, six words"), (4, "same words here again and again"),
                         (4, "same words here again and again"), (5, "é" * 3000 + " " + "word " * 3000), (6, " \n\t ")])


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def components(sets: dict, percent=75) -> dict:
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def covered(texts: list[bytes], width: int) -> list[list[bool]]:
    from collections import Counter
    seen = Counter(t[k:k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        for k in range(len(t) - width + 1):
            if seen[t[k:k + width]] > 1:
                mark[k:k + width] = [True] * width
        out.append(mark)
    return out
