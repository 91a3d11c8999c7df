"""License scan with ordered signature rules, in DataFrame functions only.

A text becomes its words (A-Z lower-cased, ``WORD`` runs) with single blanks
between. Texts without any gate keyword stop there. For the others the rules
whose own keyword occurs are matched as regular expressions; every match is an
interval of word numbers with the rule's priority. A match that lies inside an
earlier, larger or equal interval of the same or a higher priority is
suppressed (one window per text, no joins of matches). The three base phrases
are rules of the highest priority that nothing suppresses.

Cases: a null or empty text has no words and no matches; texts may be of any
length (matches are rows, not growing arrays); null and repeated ids are kept,
each row for itself; an empty table gives an empty result; other columns are
ignored, so names cannot clash.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Everything else separates words (upper case counts as lower case).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TOP = 6                            # priority of the base phrases

# label | keyword that must occur at a word's start | the license's name as an expression over words
FAMILIES = """
mit | mit | mit
mit | expat | expat
x11 | x11 | x11
isc | isc | isc
zlib | zlib | zlib(?: libpng)?
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
0bsd | 0bsd | 0bsd
0bsd | zero clause | (?:zero clause bsd|bsd zero clause)
bsd-2 | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)
bsd-2 | freebsd | freebsd
bsd-3 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)
bsd-4 | bsd | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)
bsd | bsd | bsd(?: style)?
apache-1 | apache | apache (?:software )?(?:v|version )?1(?: [01])?
apache-2 | apache | apache (?:software )?(?:v|version )?2(?: 0)?
apache-2 | asl | asl (?:software )?(?:v|version )?2(?: 0)?
apache-2 | al 2 | al 2(?: 0)?
apache-2 | al v2 | al v2(?: 0)?
apache-2 | al version 2 | al version 2(?: 0)?
apache-2 | al software | al software (?:v|version )?2(?: 0)?
gpl-1 | gpl | (?:gnu )?gpl ?(?:v|version )?1(?: 0)?
gpl-2 | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only| or later)?
gpl-3 | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
lgpl-2 | lgpl | (?:gnu )?lgpl ?(?:v|version )?2(?: [01])?(?: only| or later)?
lgpl-3 | lgpl | (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
agpl-3 | agpl | (?:gnu )?agpl ?(?:v|version )?3(?: 0)?(?: only| or later)?
gpl | general public | (?:gnu )?general public
lgpl | lesser | (?:gnu )?lesser general public
lgpl | library general | (?:gnu )?library general public
agpl | affero | (?:gnu )?affero general public
gfdl | gfdl | (?:gnu )?gfdl(?: (?:v|version )?1(?: [123])?)?
gfdl | free documentation | (?:gnu )?free documentation
mpl-1 | mpl | mpl ?(?:v|version )?1(?: [01])?
mpl-2 | mpl | mpl ?(?:v|version )?2(?: 0)?
mpl | mozilla | mozilla public
epl-1 | epl | epl ?(?:v|version )?1(?: 0)?
epl-2 | epl | epl ?(?:v|version )?2(?: 0)?
epl | eclipse | eclipse (?:public|distribution)
cddl | cddl | cddl(?: (?:v|version )?1(?: [01])?)?
cddl | common development | common development and distribution
cpl | common public | common public
ipl | ibm public | ibm public
apsl | apple public | apple public source
artistic-1 | artistic | artistic (?:v|version )?1(?: 0)?
artistic-2 | artistic | artistic (?:v|version )?2(?: 0)?
artistic | artistic | (?:perl )?artistic
boost | boost | boost(?: software)?(?: (?:v|version )?1(?: 0)?)?
bsl | bsl | bsl(?: (?:v|version )?1(?: [01])?)?
bsl | business source | business source
sspl | sspl | sspl(?: (?:v|version )?1)?
sspl | server side public | server side public
elastic | elastic | elastic(?: (?:v|version )?2(?: 0)?)?
cc-by | cc by | cc by(?: (?:[1-4])(?: [05])?)?
cc-by-sa | cc by sa | cc by sa(?: (?:[1-4])(?: [05])?)?
cc-by-nd | cc by nd | cc by nd(?: (?:[1-4])(?: [05])?)?
cc-by-nc | cc by nc | cc by nc(?: (?:[1-4])(?: [05])?)?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: (?:[1-4])(?: [05])?)?
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: (?:[1-4])(?: [05])?)?
cc-by | creative commons | creative commons attribution(?: (?:[1-4])(?: [05])?)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: (?:[1-4])(?: [05])?)?
cc-by-nd | creative commons | creative commons attribution no ?derivatives(?: (?:[1-4])(?: [05])?)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: (?:[1-4])(?: [05])?)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: (?:[1-4])(?: [05])?)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?derivatives(?: (?:[1-4])(?: [05])?)?
cc0 | cc0 | cc0(?: 1(?: 0)?)?
ofl | ofl | (?:sil )?ofl(?: 1(?: [01])?)?
ofl | open font | (?:sil )?open font
odbl | odbl | odbl(?: (?:v|version )?1(?: 0)?)?
odbl | open database | (?:odc )?open database
eupl | eupl | eupl(?: (?:v|version )?1(?: [0-2])?)?
eupl | european union public | european union public
ms-pl | ms pl | ms pl
ms-rl | ms rl | ms rl
psf | python software | python software foundation
postgresql | postgresql | postgresql
php | php | php(?: (?:v|version )?3(?: 01?)?)?
openssl | openssl | openssl
ncsa | ncsa | (?:university of illinois )?ncsa
afl | academic free | academic free
osl | open software | open software
zpl | zope | zope public
w3c | w3c | w3c(?: software)?
lppl | latex project | latex project public
cecill | cecill | cecill(?: [bc])?(?: (?:v|version )?2(?: [01])?)?
mulan | mulan | mulan (?:psl|permissive software)(?: (?:v|version )?2)?
ecl | educational community | educational community
vim | vim | vim
json | json | json
"""

# priority | confidence | expression around a license's name ({n})
TEMPLATES = """
5 | 0.99 | spdx license identifier {n}
4 | 0.95 | (?:re ?)?(?:released|licensed|distributed|published|provided|available|offered|covered|redistributable|dual licensed) (?:by |only )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}(?: licen[sc]e)?
3 | 0.9 | under (?:the )?(?:terms of (?:the )?)?{n} licen[sc]e
2 | 0.7 | {n} licen[sc]e(?: (?:agreement|terms|text|file))?
2 | 0.6 | licen[sc]e(?:d)?(?: is| as| type)? {n}
"""

# label | keyword | priority | confidence | expression: rules that are no family's
SINGLE = """
apache-2 | apache | 4 | 0.95 | apache licen[sc]e (?:v|version )?2(?: 0)?
apache-2 | apache org | 4 | 0.9 | www apache org licenses licen[sc]e 2(?: 0)?
gpl-2 | general public | 4 | 0.95 | (?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?2
gpl-3 | general public | 4 | 0.95 | (?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:v|version )?3
lgpl-2 | general public | 5 | 0.95 | (?:gnu )?(?:lesser|library) general public licen[sc]e (?:v|version )?2(?: [01])?
lgpl-3 | general public | 5 | 0.95 | (?:gnu )?(?:lesser|library) general public licen[sc]e (?:v|version )?3
agpl-3 | affero | 5 | 0.95 | (?:gnu )?affero general public licen[sc]e (?:v|version )?3
gpl | gnu org | 3 | 0.8 | www gnu org licen[sc]es gpl
mpl-2 | mozilla | 4 | 0.95 | mozilla public licen[sc]e (?:v|version )?2(?: 0)?
epl-2 | eclipse | 4 | 0.95 | eclipse public licen[sc]e (?:v|version )?2(?: 0)?
mit | permission is hereby granted | 4 | 0.9 | permission is hereby granted free of charge to any person obtaining a copy
isc | permission to use | 4 | 0.85 | permission to use copy modify and or distribute this software for any purpose
bsd | redistribution and use | 4 | 0.85 | redistribution and use in source and binary forms
zlib | implied warranty | 3 | 0.8 | this software is provided as is without any express or implied warranty
unlicense | public domain | 4 | 0.85 | this is free and unencumbered software released into the public domain
public-domain | public domain | 3 | 0.7 | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | public domain | 1 | 0.4 | public domain
cc | creativecommons | 3 | 0.8 | creativecommons org licen[sc]es
cc | creative commons | 1 | 0.5 | creative commons(?: licen[sc]e)?
proprietary | rights reserved | 2 | 0.6 | all rights reserved
proprietary | proprietary | 2 | 0.7 | proprietary (?:and confidential|licen[sc]e)
proprietary | permission | 2 | 0.6 | (?:no part|may not be reproduced) .{0,60}without (?:the )?(?:prior )?(?:written )?permission
copyright | copyright | 1 | 0.3 | copyright(?: c)? (?:19|20)[0-9]{2}
license | licen | 1 | 0.2 | licen[sc]ed? under
"""

def _lines(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[dict]:
    """All rules, most important first: label, kw, prio, weight, rx, base."""
    out = [(label, "licen" if label != "cc-by-nc" else "cc by nc", TOP, 1.0, text, True) for label, text in BASE]
    out += [(label, kw, int(p), float(w), rx, False) for label, kw, p, w, rx in _lines(SINGLE)]
    out += [(label, kw, int(p), float(w), t.format(n=name), False)
            for p, w, t in _lines(TEMPLATES) for label, kw, name in _lines(FAMILIES)]
    out = sorted(out, key=lambda r: -r[2])
    return [{"id": k, "label": label, "kw": kw, "prio": p, "weight": w, "rx": f"(?<![^ ])(?:{rx})(?![^ ])", "base": base}
            for k, (label, kw, p, w, rx, base) in enumerate(out)]


def _needs(rule: dict) -> tuple[str, ...]:
    """Substrings that every match of the rule holds: its keyword's words, and
    "licen" or "under" where they stand outside every group."""
    rest = re.sub(r"^\(\?<!\[\^ \]\)\(\?:(.*)\)\(\?!\[\^ \]\)$", r"\1", rule["rx"])
    while (shorter := re.sub(r"\(\?:[^()]*\)\??", "#", rest)) != rest:
        rest = shorter
    if "licen" in rest:
        return ("licen",)
    return (*(["under"] if "under" in rest else []), *rule["kw"].split(" "))


def gate(lowered: Column) -> Column:
    """True for every text with a match (and some others): a text passes if it
    holds all that some rule needs."""
    groups: dict[tuple[str, ...], set] = {}
    for need in {_needs(r) for r in rules()}:
        groups.setdefault(need[:1], set()).add(need[1:])
    holds = lambda words: reduce(Column.__and__, [F.contains(lowered, F.lit(w)) for w in words])
    out = []
    for first, rest in sorted(groups.items()):
        more = [holds(w) for w in sorted(rest) if w]
        out.append(holds(first) if () in rest else holds(first) & reduce(Column.__or__, more))
    return reduce(Column.__or__, out)


def words_text(text: Column) -> Column:
    """The words of ``text`` (case kept) with single blanks between."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _n_words(plain: Column) -> Column:
    return F.when(plain == "", F.lit(0)).otherwise(_blanks(plain) + 1).cast("long")


def detections(gated: DataFrame, key: str, plain: str) -> DataFrame:
    """Matches of the rules: ``key``, label, prio, weight, base, start, end
    (word numbers, end inclusive) and ``kept`` (not suppressed). Rows of
    ``gated`` without a match come once, with null fields."""
    by_keyword: dict[str, list[dict]] = {}
    for r in rules():
        by_keyword.setdefault(r["kw"], []).append(r)
    schema = "array<struct<kw string, rules array<struct<id int, label string, prio int, weight double, rx string, base boolean>>>>"
    table = F.from_json(F.lit(json.dumps([{"kw": f" {k}", "rules": v} for k, v in by_keyword.items()])), schema)
    # a keyword is looked up once, however many rules it has
    padded = F.concat(F.lit(" "), F.col(plain))
    own = gated.withColumn("__rules", F.flatten(F.transform(F.filter(table, lambda g: F.contains(padded, g["kw"])), lambda g: g["rules"])))
    own = own.withColumn("__rules", F.filter("__rules", lambda r: F.rlike(F.col(plain), r["rx"])))
    rows = own.select(key, plain, F.explode_outer("__rules").alias("r"))
    matches = F.regexp_extract_all(F.col(plain), F.col("r.rx"), F.lit(0))
    pieces = F.slice(F.split(F.col(plain), F.col("r.rx"), -1), 1, F.size(matches))
    sizes = F.arrays_zip(F.transform(pieces, _blanks).alias("before"), F.transform(matches, _blanks).alias("inside"))
    rows = rows.select(key, F.col("r.id").alias("rule"), F.col("r.label").alias("label"), F.col("r.prio").alias("prio"),
                       F.col("r.weight").alias("weight"), F.col("r.base").alias("base"), F.posexplode_outer(sizes).alias("nth", "m"))
    so_far = Window.partitionBy(key, "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(F.col("m")["before"] + F.col("m")["inside"]).over(so_far) - F.col("m")["inside"])
    rows = rows.withColumn("end", F.col("start") + F.col("m")["inside"])
    earlier = (Window.partitionBy(key).orderBy("start", F.col("end").desc(), F.col("prio").desc(), "rule")
               .rowsBetween(Window.unboundedPreceding, -1))
    reach = F.coalesce(*[F.when(F.col("prio") == p, F.max(F.when(F.col("prio") >= p, F.col("end"))).over(earlier))
                         for p in range(1, TOP + 1)])
    return (rows.withColumn("reach", reach)
            .withColumn("kept", F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
            .drop("m", "nth", "reach"))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (confidence of the best detection), n_found."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # lower() also changes other letters, but never loses a keyword of a-z
    rows = rows.withColumn("gated", gate(F.lower("text")))
    free = rows.where(~F.col("gated")).select(
        "id", _n_words(words_text(F.col("text"))).alias("n_words"), F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_found"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gated = rows.where("gated").select("id", F.monotonically_increasing_id().alias("row"),
                                       F.translate(words_text(F.col("text")), upper, upper.lower()).alias("plain"))
    gated = gated.withColumn("head", F.struct("row", "id", _n_words(F.col("plain")).alias("n_words")))
    found = detections(gated, "head", "plain")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    base = F.coalesce(F.col("base"), F.lit(False))
    kept = F.coalesce(F.col("kept"), F.lit(False))
    scanned = found.groupBy("head").agg(
        F.count(F.when(base, F.lit(1))).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), labels(base).alias("base_labels"),
        labels(kept).alias("labels"), F.coalesce(F.max(F.when(kept, F.col("weight"))), F.lit(0.0)).alias("score"),
        F.count(F.when(kept, F.lit(1))).alias("n_found"))
    out = scanned.select(F.col("head.id").alias("id"), F.col("head.n_words").alias("n_words"), *free.columns[2:])
    return free.unionByName(out).withColumnRenamed("id", id_col)
