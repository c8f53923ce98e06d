"""Personal data: surrogates for detected entities (operator 9).

Detected, in the digits of any script: e-mail addresses, IPv4 addresses, card
and account numbers, phone numbers (an area code set apart, + and 8 to 15
digits, pairs behind a trunk 0 or 00, ten digits in a row), social security
numbers, keys and tokens with a label, and names
behind a title.  Every entity gets a surrogate of its own type, drawn with a
secret key: the same value has the same surrogate in all documents and
notations (coreference), and the layout is kept (separators, country code,
digits per group, letter case, Luhn checksum of a card that has one).  Names
keep gender (from the title), script and parts: a surname alone gets what it
has in a full name.

Collision checks over all documents keep surrogates distinct: if two values
draw one surrogate, or a surrogate is itself a value that occurs, all but the
smallest value draw again with the next attempt number, until none is left.
Texts are scanned twice and never shuffled; only distinct values and the few
values with a later attempt move (these are broadcast while there are at most
``BROADCAST_VALUES``, counted, and joined per document beyond that).

Defined cases: null texts stay null, empty ones empty; texts without an
entity are left as they are.  Rows are handled one by one, so repeated rows
and null ids are kept; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import Scratch, texts, tidy

BROADCAST_VALUES = 200_000
MANY_ATTEMPTS = 12

EMAIL, IPV4, CARD, ACCOUNT, PHONE, SSN, SECRET, NAME = "email", "ipv4", "card", "account", "phone", "ssn", "secret", "name"

#: The digit zero in all scripts.
ZEROS = "".join(c for c in map(chr, range(0x20000)) if unicodedata.decimal(c, None) == 0)
PATTERNS = regex.compile(
    r"(?P<email>(?<![\w.+-])[\p{L}\p{N}_][\p{L}\p{N}_.+-]{0,63}@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62})\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}]))"
    r"|(?P<secret>(?<=(?i:api_key|apikey|access_key|secret|token|password|passwd|pwd)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-/+]{12,128}(?![A-Za-z0-9_\-/+]))"
    r"|(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.,-])\d(?:[ -]?\d){12,18}(?![\d]|[.,-]\d))"
    # with an area code set apart; behind + (digits in any groups); pairs of digits behind a trunk 0; ten digits in a row
    r"|(?P<phone>(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\d]|[.,-]\d)"
    r"|(?<![\p{L}\d+])\+\d(?:[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d){7,14}(?![ ]?\d|[.,-]\d)"
    rf"|(?<![\p{{L}}\d]|\d[.,-])(?:[{ZEROS}]{{2}}\d{{1,3}}[ .-]?\d|[{ZEROS}]\d)(?:[ .-]\d\d){{4}}(?![\d]|[.,-]\d)"
    r"|(?<![\p{L}\d]|\d[.,-])\d{10}(?![\p{L}\d]|[.,-]\d))"
    r"|(?P<name>(?<!\p{L})(?P<title>Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Г-н|Г-жа|Господин|Госпожа)"
    r"\.?[ ](?P<who>\p{Lu}[\p{L}\p{M}'’-]+(?:[ ]\p{Lu}[\p{L}\p{M}'’-]+){0,2}))")
TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Г-", "Господин", "Госпожа")
LABELS = ("api_key", "apikey", "access_key", "secret", "token", "passw", "pwd")
DIGIT = re.compile(r"[@\d]")       # the digits that PATTERNS knows


def may_hold(text: str) -> bool:
    """What every entity needs; most texts have none of it."""
    if DIGIT.search(text) or any(x in text for x in TITLES):
        return True
    low = text.lower()
    return any(x in low for x in LABELS)


FEMALE_TITLES = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа", "Госпожа"}
MALE_TITLES = {"Mr", "Herr", "Monsieur", "Señor", "Г-н", "Господин"}
#: Stems and endings that names are built from, by script and gender.
PARTS = {
    "LATIN": {"f": (["Al", "Be", "Ca", "Da", "El", "Fi", "Ga", "He", "Is", "Jo", "Ka", "Li", "Ma", "No", "Ro", "Sa", "Te", "Vi"],
                    ["lina", "ria", "nna", "tha", "risa", "vina", "lena", "mara"]),
              "m": (["Al", "Ber", "Con", "Da", "Ed", "Fer", "Ge", "Har", "Ju", "Kon", "Le", "Mar", "Nor", "Os", "Pe", "Ro", "Ste", "Vic"],
                    ["vin", "nard", "rad", "mund", "ton", "bert", "rick", "man"]),
              "s": (["Ack", "Bram", "Cold", "Dorn", "East", "Fair", "Grey", "Hol", "Kirk", "Lang", "Mer", "North", "Old", "Pen",
                     "Rams", "Stan", "Thorn", "Wal"], ["ley", "ton", "field", "berg", "worth", "man", "son", "brook"])},
    "CYRILLIC": {"f": (["Ал", "Вал", "Гал", "Елен", "Ир", "Лар", "Мар", "Над", "Ол", "Свет"], ["ина", "ия", "анна", "ена"]),
                 "m": (["Ал", "Бор", "Вад", "Григ", "Дмит", "Ег", "Ив", "Конст", "Мих", "Ник"], ["ан", "ий", "им", "ор"]),
                 "s": (["Ков", "Лаз", "Мороз", "Нов", "Орл", "Петр", "Сид", "Тар", "Фёд", "Чер"], ["ов", "ин", "енко", "ский"])},
}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    value: str      #: canonical: the same in all notations
    gender: str = ""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in s if c.isdecimal())


def find(text: str) -> list[Entity]:
    """Entities in order, not overlapping.  Each part of a name is an entity
    (kind ``name``), so that a surname alone finds its own."""
    out: list[Entity] = []
    if not may_hold(text):
        return out
    surnames: dict[str, str] = {}
    for m in PATTERNS.finditer(text):
        kind = next(k for k in (EMAIL, SECRET, IPV4, SSN, CARD, PHONE, NAME) if m.group(k) is not None)
        a, b = m.span(kind)
        s = m.group(kind)
        if kind == NAME:
            gender = "f" if m.group("title") in FEMALE_TITLES else "m" if m.group("title") in MALE_TITLES else ""
            words = [(w.start() + m.start("who"), w.group()) for w in regex.finditer(r"[^ ]+", m.group("who"))]
            for i, (at, w) in enumerate(words):
                last = i == len(words) - 1
                out.append(Entity(at, at + len(w), NAME, w.casefold(), "s" if last else gender or "m"))
                if last:
                    surnames[w] = w.casefold()
            continue
        if kind == EMAIL:
            value = s.casefold()
        elif kind in (SECRET, IPV4):
            value = s if kind == SECRET else ".".join(str(int(x)) for x in s.split("."))
        else:
            value = digits_of(s)
            if kind == CARD and not luhn(value):
                kind = ACCOUNT
            elif kind == PHONE:
                if not 7 <= len(value) <= 15:
                    continue
                value = value[-10:]     # without the country code
        out.append(Entity(a, b, kind, value))
    if surnames:
        taken = [(e.start, e.end) for e in out]
        for m in regex.finditer(r"(?<!\p{L})(?:" + "|".join(map(regex.escape, surnames)) + r")(?![\p{L}\p{M}])", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                out.append(Entity(m.start(), m.end(), NAME, surnames[m.group()], "s"))
        out.sort(key=lambda e: e.start)
    return out


class Draw:
    """Numbers below a bound, drawn with the key for one value and attempt."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.block, self.pool = key, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.what + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


def surrogate(key: bytes, kind: str, gender: str, value: str, attempt: int) -> str:
    """The canonical surrogate of a canonical value."""
    draw = Draw(key, kind, gender, value, str(attempt))
    if kind == IPV4:
        return ".".join(str(1 + draw.below(223) if i == 0 else draw.below(256)) for i in range(4))
    if kind in (CARD, ACCOUNT, PHONE, SSN):
        out = value[0] if kind == CARD else str(1 + draw.below(9))
        out += "".join(str(draw.below(10)) for _ in value[1:])
        if kind == PHONE:
            out = str(2 + draw.below(8)) + out[1:]
        if kind in (CARD, ACCOUNT):
            luhn_digit = next(d for d in "0123456789" if luhn(out[:-1] + d))
            out = out[:-1] + (luhn_digit if kind == CARD else str((int(luhn_digit) + 1 + draw.below(9)) % 10))
        return out
    if kind == NAME:
        script = "CYRILLIC" if "CYRILLIC" in unicodedata.name(value[0], "") else "LATIN"
        stems, ends = PARTS[script][gender if gender in "fms" and gender else "m"]
        mid = "".join(f"{'bcdfglmnrstv'[draw.below(12)]}{'aeiou'[draw.below(5)]}" for _ in range(attempt)) if script == "LATIN" else \
            "".join(f"{'бвгдклмнрст'[draw.below(11)]}{'аеиоу'[draw.below(5)]}" for _ in range(attempt))
        return (stems[draw.below(len(stems))] + mid + ends[draw.below(len(ends))]).casefold()
    if kind == EMAIL:
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        grown = "".join(chr(97 + draw.below(26)) for _ in range(attempt))
        return f"{_alike(draw, local)}{grown}@{_alike(draw, host)}.{top}"
    grown = "" if attempt <= MANY_ATTEMPTS else str(attempt)
    return _alike(draw, value) + grown


HEX = set("0123456789abcdef")


def _alike(draw: Draw, s: str) -> str:
    """Letters for letters and digits for digits, in the same script and case."""
    if len(s) >= 16 and set(s) <= HEX:
        return "".join("0123456789abcdef"[draw.below(16)] for _ in s)
    out = []
    for c in s:
        if "a" <= c <= "z" or "A" <= c <= "Z":
            out.append(chr((97 if c.islower() else 65) + draw.below(26)))
        elif c.isdecimal():
            out.append(str(draw.below(10)))
        elif "Ѐ" <= c <= "ӿ":
            x = chr(0x430 + draw.below(32))
            out.append(x if c.islower() else x.upper())
        elif c.isalpha():
            x = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöúùûü"[draw.below(45)]
            out.append(x if not c.isupper() else x.upper())
        else:
            out.append(c)
    return "".join(out)


def render(entity: Entity, original: str, new: str) -> str:
    """The surrogate in the notation of the original."""
    if entity.kind in (CARD, ACCOUNT, PHONE, SSN):
        digits = iter(digits_of(original)[:-len(new)] + new)
        return "".join(next(digits) if c.isdecimal() else c for c in original)
    if entity.kind == NAME:
        return new.upper() if original.isupper() and len(original) > 1 else new[:1].upper() + new[1:]
    if entity.kind == EMAIL and original.isupper():
        return new.upper()
    return new


def entity_values(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, gender, value): the distinct entities of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(e.kind, e.gender, e.value) for t in texts(batch.column(0)) if t for e in find(t)}
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "gender", "value"])

    return docs.select(text_col).mapInArrow(tidy(run), "kind string, gender string, value string").distinct()


def assign(values: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, gender, value, attempt, new): distinct surrogates.  A value
    draws again while its surrogate is taken by a smaller value, or occurs
    as a value."""
    secret = key.encode()
    schema = "kind string, gender string, value string, attempt int, new string"

    def drawn(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*[c.to_pylist() for c in batch.columns])
                new = [surrogate(secret, k, g, v, a) for k, g, v, a in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())],
                                                 names=["kind", "gender", "value", "attempt", "new"])
        return df.select("kind", "gender", "value", "attempt").mapInArrow(tidy(run), schema)

    occurring = scratch.table(values.select("kind", F.col("value").alias("new")).distinct(), "values")
    state = scratch.table(drawn(values.withColumn("attempt", F.lit(0))), "drawn")
    while True:
        # names are compared over all genders, so two people never share one; settled values keep theirs
        first = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value", "gender")).alias("first"), F.count("*").alias("n"))
        clash = (first.join(occurring.withColumn("real", F.lit(True)), ["kind", "new"], "left")
                 .where("n > 1 or real").withColumn("real", F.coalesce("real", F.lit(False))))
        marked = state.join(clash, ["kind", "new"], "left").withColumn(
            "again", F.coalesce(F.col("real") | (F.struct("attempt", "value", "gender") != F.col("first")), F.lit(False)))
        marked = scratch.table(marked.select("kind", "gender", "value", "attempt", "new", "again"), "marked")
        if not marked.where("again").limit(1).count():
            return state
        state = scratch.table(
            marked.where("not again").drop("again").unionByName(
                drawn(marked.where("again").withColumn("attempt", F.col("attempt") + 1))), "drawn")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", keep_entities: bool = False) -> DataFrame:
    """The input with entities in ``text_col`` replaced; with ``keep_entities``
    a column ``entities`` (array of start, end in the old text, kind,
    surrogate) is added or replaced."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    state = assign(scratch.table(entity_values(docs, text_col), "found"), key, scratch)
    later = state.where("attempt > 0").select("kind", "gender", "value", "attempt")
    if later.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        attempts = spark.sparkContext.broadcast({(r[0], r[1], r[2]): r[3] for r in later.collect()})
    else:
        attempts = None
    secret = key.encode()
    kept = [c for c in docs.columns if not (keep_entities and c == "entities")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    found_type = T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()), T.StructField("surrogate", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, *([T.StructField("entities", found_type)] if keep_entities else [])])
    arrow_found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
    extra = docs.select("*") if attempts else _with_attempts(docs, later, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new_texts, found = [], []
            own = batch.column(batch.num_columns - 1).to_pylist() if attempts is None else None
            for i, text in enumerate(texts(batch.column(at))):
                tries = attempts.value if attempts else {(x["kind"], x["gender"], x["value"]): x["attempt"] for x in own[i] or ()}
                parts, last, mine = [], 0, []
                for e in find(text) if text else ():
                    new = surrogate(secret, e.kind, e.gender, e.value, tries.get((e.kind, e.gender, e.value), 0))
                    new = render(e, text[e.start:e.end], new)
                    parts += [text[last:e.start], new]
                    last = e.end
                    mine.append({"start": e.start, "end": e.end, "kind": e.kind, "surrogate": new})
                new_texts.append("".join([*parts, text[last:]]) if parts else text)
                found.append(mine)
            columns = list(batch.columns)[:len(kept)]
            columns[at] = pa.array(new_texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(found, arrow_found)] if keep_entities else []), names=schema.names)

    return extra.mapInArrow(tidy(run), schema)


def _with_attempts(docs: DataFrame, later: DataFrame, text_col: str) -> DataFrame:
    """Documents with the attempts of those of their values that drew again,
    for when these are too many to broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(n, e.kind, e.gender, e.value) for n, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))) if t for e in find(t)}
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]],
                                             names=["_row", "kind", "gender", "value"])

    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    own = (numbered.select("_row", text_col).mapInArrow(tidy(run), "_row long, kind string, gender string, value string")
           .join(later, ["kind", "gender", "value"])
           .groupBy("_row").agg(F.collect_list(F.struct("kind", "gender", "value", "attempt")).alias("_own")))
    return numbered.join(own, "_row", "left").drop("_row")
