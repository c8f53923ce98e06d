"""Substring dedup by line hashing (operator 1).

Texts are cut into units: lines, and sentences inside a line.  Units are
normalised (lower case; marks and white space between words as one space) and
named by a 128-bit digest.  Over the whole corpus the earliest occurrence of
a digest, ranked by (document id, row, offset), is kept.  A run of later
occurrences that stand together and have ``min_words`` words in all is
removed; the offsets of what goes, and so of what stays, are those of the
original text.  A run of fewer words (a short boilerplate line) stays.

One aggregate by digest (added up before the shuffle, so a line that stands
in a third of all documents is a few rows) and one join of the units with the
repeated digests, which Spark splits where a digest is frequent.

Defined cases: null and empty texts have no units.  Repeated rows are
documents of their own: the first row keeps the text.  Documents without an
id rank last.  Columns other than id and text are not read.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import Scratch, fresh, row_numbering, texts

MIN_WORDS = 25
SENTENCE_END = regex.compile(r"(?<=[.!?])\s+|\n+")
NOT_WORDS = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def units(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normalised, words) of the units that hold a word."""
    start = 0
    cuts = [m.span() for m in SENTENCE_END.finditer(text)]
    for end, after in [*cuts, (len(text), len(text))]:
        if end > start:
            norm = NOT_WORDS.sub(" ", text[start:end].lower()).strip()
            if norm:
                yield start, end, norm, norm.count(" ") + 1
        start = after


def unit_table(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """One row per unit: row (``row_col``, or the place in the scan), id, no,
    start, end, words, d1, d2."""
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
        *[T.StructField(c, T.IntegerType()) for c in ("no", "start", "end", "words")],
        T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbering()
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                of, rows, plain, digests = [], [], [], []
                given = batch.column(2).to_pylist() if row_col else None
                for i, text in enumerate(texts(batch.column(1))):
                    row = given[i] if given else next(numbers)
                    for no, (start, end, norm, n) in enumerate(units(text) if text else ()):
                        of.append(i)
                        rows.append(row)
                        plain.append((no, start, end, n))
                        digests.append(xxhash.xxh128_digest(norm.encode()))
                both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                four = np.array(plain, dtype=np.int32).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), batch.column(0).take(pa.array(of, pa.int64())),
                     *[pa.array(four[:, k]) for k in range(4)],
                     pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=schema.names)

    return docs.select(id_col, text_col, *([row_col] if row_col else [])).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, row_col: str | None = None) -> DataFrame:
    """One row per removed passage: row, id, start, end (characters of the
    original text), n_words, n_units, kept_in (sorted ids of the documents
    that keep its units)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    all_units = scratch.table(unit_table(docs, id_col, text_col, row_col), "units")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "no")
    first = (all_units.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
             .where("n > 1").select("d1", "d2", "first"))
    later = (all_units.join(first, ["d1", "d2"])
             .where((F.col("row") != F.col("first.row")) | (F.col("no") != F.col("first.no")))
             .select("row", "id", F.struct("no", "start", "end", "words", F.col("first.id").alias("keeper")).alias("u")))
    # units of one document, in order: runs of consecutive numbers
    per_doc = later.groupBy("row", "id").agg(F.sort_array(F.collect_list("u")).alias("us"), F.sum("u.words").alias("words")).where(
        F.col("words") >= min_words)
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()), T.StructField("n_units", T.IntegerType()),
        T.StructField("kept_in", T.ArrayType(docs.schema[id_col].dataType))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, us in enumerate(texts(batch.column("us"))):
                run: list[dict] = []
                for u in [*us, None]:
                    if run and (u is None or u["no"] != run[-1]["no"] + 1):
                        n = sum(x["words"] for x in run)
                        if n >= min_words:
                            of.append(i)
                            keepers = {x["keeper"] for x in run}
                            out.append((run[0]["start"], run[-1]["end"], n, len(run),
                                        sorted(k for k in keepers if k is not None) + [None] * (None in keepers)))
                        run = []
                    if u is not None:
                        run.append(u)
            cols = list(zip(*out)) or [()] * 5
            at = pa.array(of, pa.int64())
            kept_type = pa.list_(batch.schema.field("id").type)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("id").take(at),
                 *[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], kept_type)], names=schema.names)

    return per_doc.mapInArrow(runs, schema)


def remove_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """What is left of a text without these passages."""
    out, last = [], 0
    for a, b in sorted(spans):
        out.append(text[last:a])
        last = max(last, b)
    return "".join([*out, text[last:]])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input with repeated passages cut out of ``text_col``.  Rows are
    numbered in a written copy: another scan may deal them in another way."""
    number, span = fresh(docs, "_row_number"), fresh(docs, "_spans")
    rows = Scratch(docs.sparkSession, "line-dedup").table(docs.withColumn(number, F.monotonically_increasing_id()), "documents")
    passages = repeated_passages(rows, id_col, text_col, min_words, number)
    spans = passages.groupBy(F.col("row").alias(number)).agg(F.collect_list(F.struct("start", "end")).alias(span))
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for batch in batches:
            new = [t if t is None or not s else remove_passages(t, [(x["start"], x["end"]) for x in s])
                   for t, s in zip(texts(batch.column(at)), texts(batch.column(len(columns))))]
            arrays = list(batch.columns[:len(columns)])
            arrays[at] = pa.array(new, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    joined = rows.join(spans, number, "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], span).mapInArrow(cut, docs.schema)
