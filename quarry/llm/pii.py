"""Personal data: detection and keyed surrogates.

Detected entities (e-mail addresses, phone numbers, IP addresses, payment
cards, bank accounts, social security numbers, secrets, names) are replaced by
surrogates of the same type and form: digits for digits, letters for letters of
the same case and script, a valid check digit where the original has one, a
name of the same gender and script. A surrogate is a keyed hash (HMAC-SHA-256)
of type, normalized value and attempt, so the same value gets the same
surrogate everywhere (coreference), also across mentions such as "John Smith"
and "Mr Smith": names are replaced part by part.

Distinctness: all distinct values of the corpus form one table; two values with
the same surrogate, or a surrogate that is itself a value of the corpus, are
drawn again with the next attempt until none is left. From attempt
``WIDEN`` on a drawn value may differ from its original in length, so the
space cannot run out.

Cases: null and empty texts and texts without an entity are not returned (they
need no change); rows with null or repeated ids are handled each for itself;
texts may be of any length; an empty table gives an empty result; other columns
are ignored, so names cannot clash.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDEN = 6

# Titles and given names by gender, for detection only.
TITLES = {"m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don Господин", "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа",
          "n": "Dr Prof Professor Доктор"}
GIVEN = {"m": "James John Robert Michael William David Richard Thomas Daniel Peter Paul Hans Karl Jürgen Wolfgang Pierre Jean Jacques Luc "
              "Carlos José Juan Miguel Pedro Иван Пётр Сергей Алексей Дмитрий",
         "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Ursula Ingrid Sabine Marie Claire Hélène Camille "
              "María Carmen Lucía Elena Анна Мария Ольга Елена Наталья"}

_NAME = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+(?:[-’'][^\W\d_]+)*"
_title = {w: g for g, ws in TITLES.items() for w in ws.split()}
_given = {w: g for g, ws in GIVEN.items() for w in ws.split()}
_words = lambda ws: "|".join(sorted(map(re.escape, ws), key=len, reverse=True))

_PLUS_ONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
_CARD = r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9-])"

# In this order where two start at the same place.
PATTERNS = (
    ("email", r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("secret", r"\b(?:ghp_|gho_|xox[abp]-|sk-)[A-Za-z0-9-]{16,}"),
    ("assigned", r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\b\"?\s*[=:]\s*[\"']?)(?P<value>[^\s\"']{6,})"),
    ("hex", r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    # fixed layouts first, so that a number that follows is not taken in
    ("phone", rf"(?<![0-9]){_PLUS_ONE}|" r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
              r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", rf"{_CARD}|" r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"),
    ("person", rf"\b(?P<title>{_words(_title)})\.? (?P<named>{_NAME}(?: {_NAME}){{0,2}})|\b(?P<first>{_words(_given)}) (?P<rest>{_NAME}(?: {_NAME})?)"),
)
ONE = {kind: re.compile(rx) for kind, rx in PATTERNS}
CARD = re.compile(_CARD)
LONG_CARD = re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}(?![0-9-])")
ANY = re.compile("|".join(f"(?P<{kind}>{rx})" for kind, rx in PATTERNS))
GATE = re.compile(rf"[0-9@]|(?i:token|secret|key|passw|pwd)|\b(?:{_words(_title)}|{_words(_given)})\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def script_of(word: str) -> str:
    return unicodedata.name(word[0], "LATIN").split(" ")[0]


def _kind(m: re.Match) -> str:
    return next(k for k, _ in PATTERNS if m.group(k) is not None)


def _own(text: str, kind: str, m: re.Match) -> re.Match | None:
    """The match of ``kind`` without the start of an entity that follows it;
    None if there is no account number in it."""
    start, end = m.span()
    if kind == "card" and (longer := LONG_CARD.match(text, start)) and luhn(re.sub("[ -]", "", longer.group())):
        return longer
    if kind == "iban":
        ends = [end, *(start + x.start() for x in reversed(list(re.finditer(" ", m.group()))))]
        return next((x for e in ends if (x := ONE[kind].fullmatch(text, start, e)) and iban_ok(x.group())), None)
    if kind not in ("phone", "card", "person") or re.fullmatch(_PLUS_ONE, m.group()):
        return m
    words = list(re.finditer(r"[^ ]+", m.group()))
    pairs = list(zip(words, words[1:]))
    for before, word in pairs if kind == "person" else reversed(pairs):      # a number keeps as much as it can
        at = start + word.start()
        if inner := ANY.match(text, at):
            found = _kind(inner)
            if found == "person":
                follows = kind == "person" and (inner.group("title") or before.group() not in _given)
            else:
                follows = inner.end() > end and (found != "iban" or _own(text, found, inner)) \
                    and (found != "card" or CARD.match(text, at))
            if follows and (x := ONE[kind].fullmatch(text, start, at - 1)):
                return x
    return m


def detect(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities; a name is one entity per part, its
    kind naming gender (m, f, n for unknown, s for a surname) and script. A known
    given name has its own gender, whatever the title. A name found once is an
    entity wherever its word stands in the text."""
    if not text or not GATE.search(text):
        return []
    out: list[tuple[str, int, int]] = []
    at = 0
    while m := ANY.search(text, at):
        kind = _kind(m)
        own = _own(text, kind, m)
        if own is None:
            at = m.start() + 1
            continue
        m, at = own, own.end()
        if kind == "assigned":
            out.append(("secret", m.start("value"), m.end("value")))
        elif kind == "person":
            whole, gender = ("named", _title[m.group("title")]) if m.group("title") else ("first", _given[m.group("first")])
            base = m.start(whole)
            parts = [(base + x.start(), base + x.end()) for x in re.finditer(r"\S+", text[base:m.end()])]
            for k, (a, b) in enumerate(parts):
                # the last part is the surname unless the given name stands alone
                role = "s" if k == len(parts) - 1 and (len(parts) > 1 or whole == "named") else _given.get(text[a:b], gender)
                out.append((f"name_{role}_{script_of(text[a:b])}", a, b))
        else:
            out.append((kind, m.start(), m.end()))
    return _everywhere(text, out)


def _everywhere(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """With the other places where the words of the found names stand."""
    kinds: dict[str, str] = {}
    for kind, a, b in found:
        if kind.startswith("name_"):
            kinds.setdefault(text[a:b], kind)
    if not kinds:
        return found
    out, k = [], 0
    for m in re.finditer(r"(?<![\w'’-])(?:" + "|".join(map(re.escape, sorted(kinds, key=len, reverse=True))) + r")(?![\w-])", text):
        while k < len(found) and found[k][2] <= m.start():
            out.append(found[k])
            k += 1
        if k == len(found) or m.end() <= found[k][1]:
            out.append((kinds[m.group()], *m.span()))
    return out + found[k:]


def one_kind_per_name(mentions: DataFrame) -> DataFrame:
    """Mentions (kind, value, ...) with one kind per name: the one it has most
    often in the corpus, so that a name has one surrogate whatever its titles."""
    names = mentions.where(F.startswith("kind", F.lit("name_"))).groupBy("value", "kind").agg(F.count("*").alias("n"))
    usual = names.groupBy("value").agg(F.max_by("kind", F.struct(~F.col("kind").contains("_n_"), "n", "kind")).alias("usual"))
    key = F.when(F.startswith("kind", F.lit("name_")), F.col("value"))
    joined = mentions.withColumn("name", key).join(usual.withColumnRenamed("value", "name"), "name", "left")
    return joined.withColumn("kind", F.coalesce("usual", "kind")).drop("usual", "name")


def normalized(kind: str, text: str) -> str:
    """Mentions with the same normalized value are the same entity."""
    if kind.startswith("name") or kind in ("email", "ipv6"):
        return text.lower()
    if kind in ("phone", "card", "iban"):
        return re.sub(r"[ .()-]", "", text)
    return text


class Drawer:
    """Keyed surrogates of normalized values."""

    _CONSONANTS = {"LATIN": "b d f g k l m n p r s t v br dr kl st tr".split(), "CYRILLIC": "б в г д к л м н п р с т ст др".split(),
                   "GREEK": "β γ δ κ λ μ ν π ρ σ τ φ".split()}
    _VOWELS = {"LATIN": list("aeiou"), "CYRILLIC": list("аеиоу"), "GREEK": list("αειου")}
    _END = {"m": {"LATIN": "n", "CYRILLIC": "н", "GREEK": "ν"}, "f": {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"},
            "s": {"LATIN": "k", "CYRILLIC": "в", "GREEK": "κ"}, "n": {"LATIN": "l", "CYRILLIC": "л", "GREEK": "λ"}}

    def __init__(self, key: bytes):
        self.key = key

    def stream(self, *parts: str) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.new(self.key, "\x1f".join((*parts, str(block))).encode(), sha256).digest()
            block += 1

    def draw(self, kind: str, value: str, attempt: int) -> str:
        bits = self.stream(kind, value, str(attempt))
        pick = lambda seq: seq[((next(bits) << 16) | (next(bits) << 8) | next(bits)) % len(seq)]
        digit = lambda: pick("0123456789")
        if kind.startswith("name_"):
            _, role, script = kind.split("_")
            script = script if script in self._VOWELS else "LATIN"
            n = 2 + (attempt >= 2) + attempt // WIDEN
            word = "".join(pick(self._CONSONANTS[script]) + pick(self._VOWELS[script]) for _ in range(n))
            return word + pick(self._CONSONANTS[script][:6]) + self._END["f"][script] if role == "f" else word + self._END[role][script]
        if kind == "ipv4":
            lengths = [len(x) if attempt < WIDEN else 3 for x in value.split(".")]
            low, high = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 254}
            return ".".join(str(pick(range(low[n], high[n] + 1))) for n in lengths)
        if kind == "ipv6":
            return ":".join("".join(pick("0123456789abcdef") for _ in range(max(len(x), 4 * (attempt >= WIDEN)))) for x in value.split(":"))
        if kind == "card":
            body = value[0] + "".join(digit() for _ in value[1:-1])
            valid = luhn(value)
            return next(body + d for d in "0123456789" if luhn(body + d) == valid) if valid else \
                body + pick([d for d in "0123456789" if not luhn(body + d)])
        if kind == "iban":
            body = "".join(digit() if c.isdigit() else pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in value[4:])
            rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
            return f"{value[:2]}{98 - rest:02d}{body}"
        if kind == "email":
            local, _, domain = value.partition("@")
            labels = domain.split(".")
            host = self.stream("domain", domain, "0")          # one domain, one surrogate domain
            near = lambda c: "bcdfghjklmnpqrstvwxz"[next(host) % 20] if c.isalpha() else str(next(host) % 10) if c.isdigit() else c
            hosts = ["".join(map(near, x)) for x in labels[:-1]] + labels[-1:]
            more = "".join(digit() for _ in range(attempt // WIDEN))
            return "".join(self._like(c, pick) for c in local) + more + "@" + ".".join(hosts)
        keep = 4 if kind == "aws_key" else (2 if value.startswith("+1") else 1) if kind == "phone" and value.startswith("+") else 0
        hexed = kind == "hex" or (kind == "secret" and re.fullmatch(r"[0-9a-f]+", value))
        body = [pick("0123456789abcdef") if hexed else self._like(c, pick) for c in value[keep:]]
        return value[:keep] + "".join(body) + "".join(digit() for _ in range(attempt // WIDEN))

    @staticmethod
    def _like(c: str, pick) -> str:
        if c.isdigit():
            return pick("0123456789")
        if not c.isalpha():
            return c
        return pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else pick("abcdefghijklmnopqrstuvwxyz")


def in_form(kind: str, text: str, surrogate: str) -> str:
    """The surrogate with the mention's separators and case."""
    if kind in ("phone", "card", "iban"):
        digits = iter(surrogate)
        out = [next(digits, "") if c.isalnum() or c == "+" else c for c in text]
        return "".join(out) + "".join(digits)
    if kind.startswith("name"):
        return surrogate.upper() if text.isupper() and len(text) > 1 else surrogate.capitalize()
    return surrogate


def _draw(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) with ``surrogate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawer = Drawer(key)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([drawer.draw(k, v, a) for k, v, a in rows], pa.string())],
                                             names=["kind", "value", "attempt", "surrogate"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def surrogate_table(values: DataFrame, key: bytes) -> DataFrame:
    """One surrogate per distinct (kind, value), no two alike, and none equal to a
    value of any kind. Values that lose a collision draw again; the least value of
    a collision keeps its draw. Draws grow longer with the attempts where the form
    allows it, and addresses, cards and accounts have billions of forms, so the
    rounds end by themselves."""
    values = written(values.select("kind", "value").distinct(), "values")
    real = values.select(F.col("value").alias("surrogate"), F.lit(True).alias("real")).distinct()
    table = written(_draw(values.withColumn("attempt", F.lit(0)), key), "drawn")
    while True:
        # attempts are only ever raised for losers, so settled draws stay
        first = table.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n"))
        taken = first.join(real, "surrogate", "left").where((F.col("n") > 1) | F.col("real")).select(
            "surrogate", "real", F.struct("first.kind", "first.value").alias("winner"))
        judged = table.join(taken, "surrogate", "left")
        loses = F.col("winner").isNotNull() & (F.coalesce(F.col("real"), F.lit(False)) | (F.col("winner") != F.struct("kind", "value")))
        judged = written(judged.select("kind", "value", "attempt", "surrogate", loses.alias("loses")), "judged")
        if not judged.where("loses").limit(1).count():
            return table.select("kind", "value", "surrogate")
        again = _draw(judged.where("loses").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key)
        table = written(judged.where("NOT loses").drop("loses").unionByName(again), "drawn")


def replace_entities(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with at least one entity: id, ``n_entities``, ``kinds``,
    ``text`` (with surrogates) and ``spans`` (kind, start and end in the
    original text in characters, surrogate)."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = "array<struct<kind: string, start: int, end: int, value: string>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if spans := detect(text):
                    keep.append(k)
                    out.append([{"kind": c, "start": a, "end": b, "value": normalized(c, text[a:b])} for c, a, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(out, arrow)], names=["id", "text", "found"])

    hits = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, text string, found {found}")
    hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    mentions = one_kind_per_name(hits.select("row", F.posexplode("found").alias("nth", "e")).select("row", "nth", "e.kind", "e.value"))
    table = surrogate_table(mentions, key)
    chosen = mentions.join(table, ["kind", "value"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "surrogate"))).alias("chosen"))
    joined = hits.join(chosen, "row").select("id", "text", "found", F.col("chosen.surrogate").alias("surrogates"))
    spans = "array<struct<kind: string, start: int, end: int, surrogate: string>>"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, told = [], []
            for text, ents, drawn in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                out, at, said = [], 0, []
                for e, s in zip(ents, drawn):
                    new = in_form(e["kind"], text[e["start"]:e["end"]], s)
                    out += [text[at:e["start"]], new]
                    at = e["end"]
                    said.append({"kind": e["kind"], "start": e["start"], "end": e["end"], "surrogate": new})
                texts.append("".join(out) + text[at:])
                told.append(said)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()),
                 pa.array(told, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])))],
                names=[id_col, "text", "spans"])

    done = joined.mapInArrow(rewrite, f"`{id_col}` {kind}, text string, spans {spans}")
    return done.select(id_col, F.size("spans").cast("long").alias("n_entities"),
                       F.array_join(F.array_sort(F.array_distinct(F.col("spans.kind"))), ",").alias("kinds"), "text", "spans")
