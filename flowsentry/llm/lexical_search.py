"""Ranked lexical search by an Aho-Corasick scan of the documents (operator 12).

The terms of all items form one automaton, each guarded by a blank on both
sides.  Documents are read as they are: letters A-Z in lower case, whatever
can't stand in a term as a blank; one run of the automaton over such a text
gives every item term with its frequency.  No index of the documents is made.

1. Scan: per document its length and its item terms with frequencies, written
   as a table (texts are not).
2. Document frequencies of the item terms, one small aggregate over it.
3. Scores: each task adds up the weights of its documents' terms over the
   items that hold them, and keeps the best ``k`` documents of each item, so
   it hands on k rows an item at most; these are ranked by item.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms and ``BLOCK_PAIRS``
(item, term) pairs (one item with more is a block of its own), so what tasks
receive is bounded; each block is one scan of all documents.

A term is a maximal run of characters that are neither ASCII punctuation,
space nor control characters.  N documents have terms, L is the number of all
their terms; a term in df documents weighs w = floor(1000 ln((2N+2)/(2df+1)));
a document of n terms has m = 10 + (90 n N) div L, and its score for an item
sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct terms.

Defined cases: a null or empty text has no terms; items without terms have no
rows.  Repeated item rows are items of their own, repeated document rows are
ranked each.  Equal scores stand by ascending id, null ids last.  Ids of
documents are whole numbers.  Other columns are not read; empty tables give an
empty result.  A task holds one batch of texts and an item's best documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch

K = 10
BLOCK_TERMS = 100_000
BLOCK_PAIRS = 1_000_000
CELLS = 2_000_000
NULL_ID = (1 << 63) - 1

_TERM = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of terms in lower case, all others as a blank (UTF-8 has no ASCII byte inside other characters).
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM else 0x20 for b in range(256))
_SHAPE = bytes(0x20 if b == 0x20 else 0x61 for b in range(256))


def plain(text: bytes) -> bytes:
    return text.translate(_PLAIN)


def n_terms(plain_text: bytes) -> int:
    return (b" " + plain_text.translate(_SHAPE)).count(b" a")


def terms_of(text: str | None) -> list[str]:
    return [t.decode() for t in plain((text or "").encode()).split()]


def automaton(terms: list[str]):
    """Finds `` term `` with its number; texts and terms are read byte by byte."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        found.add_word(" " + t.encode().decode("latin-1") + " ", i)
    if terms:
        found.make_automaton()
    return found


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, n, terms, tfs) of the documents with terms; docs has id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = "id long, n long, terms array<int>, tfs array<long>"
    names = ["id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, second = automaton(shared.value), itemgetter(1)
        for batch in batches:
            rows, sizes, ends, ids, times = [], [], [0], [], []
            for r, text in enumerate(batch.column(1).cast(pa.binary())):
                p = plain(text.as_py() or b"")
                n = n_terms(p)
                if not n:
                    continue
                tf = Counter(map(second, found.iter(f" {p.decode('latin-1')} "))) if shared.value else {}
                rows.append(r)
                sizes.append(n)
                ids.extend(tf)
                times.extend(tf.values())
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=names)

    return docs.mapInArrow(run, schema)


class Best:
    """The best ``k`` (score, id) of each item, of all that were added."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.item, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items; those below an item's k-th best go."""
        d, i = np.nonzero(scores >= self.least)
        item = np.concatenate([self.item, i])
        score = np.concatenate([self.score, scores[d, i]])
        ident = np.concatenate([self.id, ids[d]])
        order = np.lexsort((ident, -score, item))
        item, score, ident = item[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        keep = place < self.k
        self.item, self.score, self.id = item[keep], score[keep], ident[keep]
        last = place[keep] == self.k - 1
        self.least[self.item[last]] = self.score[last]


def best_of(scanned: DataFrame, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int,
            n_docs: int, n_all: int, k: int) -> DataFrame:
    """(item, id, score): each task's best ``k`` of each item.  The items of
    term t are items[starts[t]:starts[t + 1]]."""
    shared = scanned.sparkSession.sparkContext.broadcast((weights, starts, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, begin, of = shared.value
        held, best = begin[1:] - begin[:-1], Best(n_items, k)
        step = max(1, CELLS // n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                m = np.array([10 + 90 * n * n_docs // n_all for n in part.column("n").to_pylist()], dtype=np.int64)
                terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), np.diff(part.column("terms").offsets.to_numpy()))
                value = w[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                scores = np.zeros(part.num_rows * n_items, dtype=np.int64)
                pairs = np.cumsum(held[terms])
                cut = 0
                while cut < len(terms):         # some (document, term, item) triples at a time
                    done = pairs[cut - 1] if cut else 0
                    end = max(cut + 1, int(np.searchsorted(pairs, done + CELLS, side="right")))
                    t, each = terms[cut:end], held[terms[cut:end]]
                    own = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    item = of[np.repeat(begin[t], each) + own]
                    np.add.at(scores, np.repeat(doc[cut:end], each) * n_items + item, np.repeat(value[cut:end], each))
                    cut = end
                best.add(scores.reshape(part.num_rows, n_items), ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.id, mask=best.id == NULL_ID), pa.array(best.score)], names=["item", "id", "score"])

    return scanned.mapInArrow(run, "item long, id long, score long")


def blocks(items: DataFrame, block_terms: int, block_pairs: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (item_row, distinct terms); the driver holds one at a time."""
    held, seen, pairs = [], set(), 0
    for row, text in items.select("item_row", "text").toLocalIterator():
        own = sorted(set(terms_of(text)))
        if held and (len(seen) + len(own) > block_terms or pairs + len(own) > block_pairs):
            yield held
            held, seen, pairs = [], set(), 0
        if own:
            held.append((row, own))
            seen.update(own)
            pairs += len(own)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, block_terms: int = BLOCK_TERMS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``k`` documents of the highest score above 0 for each item:
    item id, rank (from 1), id, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    queries = scratch.table(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item"),
                                         F.col(item_text_col).alias("text")), "items")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    best = None
    for block in blocks(queries, block_terms, block_pairs):
        terms = sorted({t for _, own in block for t in own})
        number = {t: i for i, t in enumerate(terms)}
        scanned = scratch.table(scan(rows, terms), "terms")
        size = scanned.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not size["docs"]:
            break
        df = np.zeros(len(terms), dtype=np.int64)
        for t, n in scanned.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[t] = n
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
        of = sorted((number[t], i) for i, (_, own) in enumerate(block) for t in own)
        starts = np.searchsorted(np.array([t for t, _ in of]), np.arange(len(terms) + 1))
        part = best_of(scanned, weights, starts, np.array([i for _, i in of], dtype=np.int64), len(block),
                       size["docs"], size["terms"], k)
        item_rows = spark.createDataFrame([(i, row) for i, (row, _) in enumerate(block)], "item long, item_row long")
        part = scratch.table(part.join(F.broadcast(item_rows), "item").drop("item"), "best")
        scratch.drop(scanned)
        best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], "id long, score long, item_row long")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(queries.select("item_row", "item"), "item_row")
            .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
