"""Phrase collocation mining by best-first branch and bound (operator 11).

Phrases grow word by word.  A phrase xy of count a that follows a first word
of count f(x) can't lead to a score above a / f(x): a longer phrase is at most
as frequent as its beginning, and its first word stays.  The same holds from
the other end.  So:

1. Words are counted, then pairs of words that are frequent enough.
2. Frontier: pairs in order of their bound.  A wave takes, for each language,
   all pairs whose bound reaches a threshold (at first the score of the
   ``top``-th best pair), and counts the triples that begin and end with such
   a pair, and those that hold a pair whose own score reaches it (they decide
   whether that pair survives).
3. Every phrase whose score reaches the threshold, ties included, is then
   known, and whether it survives.  Languages with ``top`` survivors (or with
   nothing left below) are settled; for the others the threshold goes down to
   a deeper place of the frontier, and the next wave follows.

Counting is a scan: a task makes words of blocks of text with numpy, adds up
equal phrases of a block by two 64-bit hashes, and sends the phrases
themselves, so the sums are exact.  What a scan may leave out is told by a bit
array of fixed size (``BITS``): it has false positives, which only send some
needless rows, but no false negatives.

Defined cases: a null or empty text has no words; a null language is ``und``.
Repeated rows count each time.  Equal scores stand by count, then by the
phrase's bytes.  Other columns are not read; empty tables and languages
without a candidate give no rows.  Long texts are read in blocks; one single
word is held whole.  Counts may go up to 10^16 (scores are exact decimals).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch

UNDETERMINED = "und"
LEAST_COUNT = 10
TOP = 2000
COVERED = 50
BITS = 26
BLOCK = 1 << 20
BROADCAST_LANGS = 100_000
BUCKETS = 64

_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(_BLANK)], _KIND[list(_BREAK)] = 1, 2
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_GAP = re.compile(rb"[ \t]+")
_END = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each 64-bit number."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hash terms of a byte at a place of its word, for the first 64 places.
_TERMS = [mixed(np.arange(64 * 256, dtype=np.uint64), salt) for salt in (1, 2)]


class Words:
    """The words of a block of text: where they begin and end, the piece they
    stand in, and two hashes of each.  Neighbours in a piece are one blank
    apart."""

    def __init__(self, block: bytes):
        if b"\t" in block or b"  " in block:
            block = _GAP.sub(b" ", block)
        self.bytes = np.frombuffer(block, dtype=np.uint8)
        kind = _KIND[self.bytes]
        word = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        size = self.ends - self.starts
        at = np.flatnonzero(kind == 0)
        place = at - np.repeat(self.starts, size)
        key = (place << 8) | self.bytes[at]
        far = np.flatnonzero(place >= 64)
        first = np.cumsum(size) - size
        self.hashes = []
        for salt, terms in enumerate(_TERMS, 1):
            values = terms[np.where(place < 64, key, 0)] if len(far) else terms[key]
            if len(far):
                values[far] = mixed(key[far].astype(np.uint64), salt)
            self.hashes.append(mixed(np.add.reduceat(values, first), salt + 2) if len(size) else values)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and the two hashes of each phrase of ``k`` words."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        i = np.flatnonzero(self.piece[:n] == self.piece[k - 1:k - 1 + n])
        return i, *(phrase_hash(h, i, k) for h in self.hashes)

    def texts(self, i: np.ndarray, k: int) -> pa.Array:
        """The phrases that begin with these words."""
        a, b = self.starts[i], self.ends[i + k - 1]
        ends = np.cumsum(b - a)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - (b - a)), b - a)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[at])])


def phrase_hash(words: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    h = words[i]
    for j in range(1, k):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[i + j], 9)
    return h


def blocks(data: bytes, k: int) -> Iterator[Words]:
    """Blocks of a text in which each phrase of ``k`` words stands once."""
    begin = end = 0
    while end < len(data):
        found = _END.search(data, max(end, begin) + BLOCK)
        end = found.start() if found else len(data)
        part = data[begin:end]
        words = Words(part)
        yield words
        if k == 1 or end == len(data):
            begin = end
        else:       # the last k - 1 words begin the next block
            begin += tail(part, k - 1)


def tail(part: bytes, n: int) -> int:
    """Where the last ``n`` words of a block begin."""
    at = len(part)
    for _ in range(n):
        while at and _KIND[part[at - 1]]:
            at -= 1
        while at and not _KIND[part[at - 1]]:
            at -= 1
    return at


def lang_hash(lang: str) -> np.uint64:
    return Words(lang.encode().hex().encode() or b"-").hashes[0][0]


class Bits:
    """A set of (role, language, phrase) as a bit array; may say yes falsely."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), dtype=np.uint64) if words is None else words

    def _places(self, keys: np.ndarray, lang: np.uint64, role: int) -> list[np.ndarray]:
        h = mixed(keys ^ lang, 20 + role)
        mask = np.uint64((1 << self.bits) - 1)
        return [h & mask, (h >> np.uint64(self.bits)) & mask]

    def add(self, keys: np.ndarray, lang: np.uint64, role: int) -> None:
        for p in self._places(keys, lang, role):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def has(self, keys: np.ndarray, lang: np.uint64, role: int) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in self._places(keys, lang, role):
            out &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


FREQUENT, FORWARD, BACKWARD, SCORED = range(4)


def bit_set(phrases: DataFrame, k: int, bits: int = BITS) -> Bits:
    """The set of rows (role, lang, phrase) of ``k`` words each; the driver
    gets the 2^(bits - 6) numbers of the array at most."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bits(bits)
        for batch in batches:
            groups: dict[tuple, list[bytes]] = {}
            for role, lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                groups.setdefault((role, lang), []).append(phrase)
            for (role, lang), own in groups.items():
                i, h, _ = Words(b"\n".join(own)).phrases(k)
                out.add(h, lang_hash(lang), role)
        at = np.flatnonzero(out.words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out.words[at].view(np.int64), pa.int64())], names=["i", "m"])

    got = (phrases.select("role", "lang", "phrase").mapInArrow(fill, "i long, m long")
           .groupBy("i").agg(F.bit_or("m").alias("m")).toArrow())
    out = Bits(bits)
    out.words[got.column("i").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return out


def wanted(words: Words, k: int, lang: np.uint64, bits: Bits | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of ``k`` words to count: pairs of frequent words; triples
    of two frontier pairs, or of a scored and a frequent one."""
    i, h, g = words.phrases(k)
    if bits is None or not len(i):
        return i, h, g
    parts = [phrase_hash(words.hashes[0], i + j, k - 1) for j in (0, 1)]
    if k == 2:
        keep = bits.has(parts[0], lang, FREQUENT)
        keep[keep] = bits.has(parts[1][keep], lang, FREQUENT)
    else:
        a, b = parts
        keep = bits.has(a, lang, FREQUENT)
        keep[keep] = bits.has(b[keep], lang, FREQUENT)
        a, b, at = a[keep], b[keep], np.flatnonzero(keep)
        keep[at] = ((bits.has(a, lang, FORWARD) & bits.has(b, lang, BACKWARD))
                    | bits.has(a, lang, SCORED) | bits.has(b, lang, SCORED))
    return i[keep], h[keep], g[keep]


def counts(docs: DataFrame, k: int, bits: Bits | None = None, langs: set[str] | None = None) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``k`` words that ``bits`` lets
    through; with k = 1 also an empty phrase with the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast((bits, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, langs = shared.value
        held: dict[str, list[bytes]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                key = lang_hash(lang)
                for words in blocks(b"\n".join(parts).translate(_LOWER), k):
                    i, h, g = wanted(words, k, key, bits)
                    if not len(i):
                        continue
                    order = np.argsort(h)
                    h, g = h[order], g[order]
                    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
                    n = np.diff(np.append(first, len(h)))
                    phrases = words.texts(i[order[first]], k)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
                    if k == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(i)], pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                lang, text = lang.as_py(), text.as_py()
                if text and (langs is None or lang in langs):
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                if size >= 2 * BLOCK:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    return (docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
            .groupBy("lang", "phrase").agg(F.sum("n").alias("n")))


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), exactly."""
    return F.expr(f"(CAST({a} AS DECIMAL(38,0)) * {a} * 1000000) div (CAST({left} AS DECIMAL(38,0)) * {right})")


def bound(a: str, of: str) -> Column:
    """No phrase that grows from one of count ``a`` beyond an edge word of
    count ``of`` scores above floor(1000000 a / of)."""
    return F.expr(f"(CAST({a} AS DECIMAL(38,0)) * 1000000) div {of}")


def thresholds(pairs: DataFrame, want: DataFrame) -> DataFrame:
    """(lang, want, theta): the score of the want-th best pair (0 if there are
    fewer), from counts by score (at most a million and one a language)."""
    by_score = pairs.join(want, "lang").groupBy("lang", "want", "score").count()
    deep = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = (by_score.withColumn("above", F.sum("count").over(deep))
               .groupBy("lang", "want").agg(F.coalesce(F.max(F.when(F.col("above") >= F.col("want"), F.col("score"))), F.lit(0)).alias("theta")))
    return reached


def small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the number of languages."""
    return F.broadcast(df) if df.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else df


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP,
         covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, words: the ``top`` best phrases
    of two and three words of each language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).alias("text"))

    words = scratch.table(counts(rows, 1).where((F.col("phrase") == "") | (F.col("n") >= least)), "words")
    sizes = words.where("phrase = ''").select("lang", F.col("n").alias("all"))
    words = words.where("phrase <> ''")
    frequent = bit_set(words.select(F.lit(FREQUENT).alias("role"), "lang", "phrase"), 1, bits)

    pairs = counts(rows, 2, frequent).where(F.col("n") >= least)
    edge = lambda name, f: words.select("lang", F.col("phrase").alias(name), F.col("n").alias(f))
    pairs = (pairs.select("lang", F.col("phrase").alias("pair"), F.col("n").alias("a"),
                          F.substring_index("phrase", " ", 1).alias("x"), F.substring_index("phrase", " ", -1).alias("y"))
             .join(edge("x", "fx"), ["lang", "x"]).join(edge("y", "fy"), ["lang", "y"])
             .select("lang", "pair", "a", "fx", "fy", score("a", "fx", "fy").alias("score"),
                     bound("a", "fx").alias("forward"), bound("a", "fy").alias("backward")))
    pairs = scratch.table(pairs, "pairs")

    want = scratch.table(pairs.select("lang").distinct().withColumn("want", F.lit(top).cast("long")), "want")
    settled = None
    while not want.isEmpty():
        theta = scratch.table(thresholds(pairs, want), "theta")
        near = pairs.join(small(theta), "lang")
        roles = F.array(F.lit(FREQUENT), F.when(F.col("forward") >= F.col("theta"), F.lit(FORWARD)),
                        F.when(F.col("backward") >= F.col("theta"), F.lit(BACKWARD)), F.when(F.col("score") >= F.col("theta"), F.lit(SCORED)))
        frontier = near.select(F.explode(F.array_compact(roles)).alias("role"), "lang", F.col("pair").alias("phrase"))
        open_langs = [r[0] for r in theta.select("lang").limit(BROADCAST_LANGS + 1).collect()]
        triples = counts(rows, 3, bit_set(frontier, 2, bits), set(open_langs) if len(open_langs) <= BROADCAST_LANGS else None)
        triples = (triples.where(F.col("n") >= least)
                   .select("lang", "phrase", F.col("n").alias("a"), F.substring_index("phrase", " ", 2).alias("begin"),
                           F.substring_index("phrase", " ", -2).alias("end")))
        side = lambda name, f: near.select("lang", F.col("pair").alias(name), F.col("a").alias(f"f_{name}"), F.col(f).alias(f"{name}_word"))
        triples = (triples.join(side("begin", "fx"), ["lang", "begin"]).join(side("end", "fy"), ["lang", "end"])
                   .withColumn("s1", score("a", "begin_word", "f_end")).withColumn("s2", score("a", "f_begin", "end_word")))
        triples = scratch.table(triples, "triples")

        # a candidate goes if a longer one holds it and has at least a share of its count
        covers = [triples.where(F.col("a") * 100 >= F.col(f"f_{s}") * covered).select("lang", F.col(s).alias("pair")) for s in ("begin", "end")]
        two = (near.where(F.col("score") >= F.col("theta")).join(covers[0].unionByName(covers[1]).distinct(), ["lang", "pair"], "left_anti")
               .select("lang", F.col("pair").alias("phrase"), "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score", F.lit(2).alias("words")))
        first = F.col("s1") <= F.col("s2")
        three = (triples.join(small(theta), "lang").where(F.least("s1", "s2") >= F.col("theta"))
                 .select("lang", "phrase", "a", F.when(first, F.col("begin_word")).otherwise(F.col("f_begin")).alias("l"),
                         F.when(first, F.col("f_end")).otherwise(F.col("end_word")).alias("r"),
                         F.least("s1", "s2").alias("score"), F.lit(3).alias("words")))
        found = scratch.table(two.unionByName(three), "found")
        state = theta.join(found.groupBy("lang").count(), "lang", "left").fillna(0, ["count"])
        state = scratch.table(state.withColumn("done", (F.col("count") >= top) | (F.col("theta") == 0)), "state")
        ready = found.join(small(state.where("done").select("lang")), "lang", "left_semi")
        settled = ready if settled is None else settled.unionByName(ready)
        # deeper by as much as the survivors' share tells, twice as deep at least
        deeper = F.greatest(F.col("want") * 2, F.ceil(F.col("want") * top * 1.25 / F.greatest("count", F.lit(1))))
        want = scratch.table(state.where("NOT done").select("lang", deeper.cast("long").alias("want")), "want")
        scratch.drop(triples)

    if settled is None:
        settled = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long, words int")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).orderBy(*best)
    some = settled.withColumn("k", F.row_number().over(within)).where(F.col("k") <= top).drop("k")
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
            .join(small(sizes), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score",
                    F.col("words").cast("long").alias("words")))
