"""Token counts (operator 4).

Pieces are counted once per distinct pre-token; documents only carry
pre-token frequencies, and ids are never made.

1. One pass sums pre-token frequencies over the corpus (each task adds up
   before the shuffle) and counts every distinct pre-token's pieces once.
2. The frequent head of that table (at most ``head_size`` pre-tokens of at
   most ``HEAD_BYTES`` bytes, so its size is bounded) goes to all tasks; a
   second pass multiplies it with each document's frequencies.
3. Pre-tokens outside the head, which are all rare or very long, are joined
   on the pre-token and summed by document.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows
and null ids are counted row by row; columns of the input other than id and
text are not read, so their names can't clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import Scratch, row_numbering, texts

HEAD_SIZE = 1 << 17
HEAD_BYTES = 256
FLUSH = 200_000


class PreTokens:
    """Pre-tokens and pieces of one ``tokenizers`` file, split into the parts
    that a task needs.  The library does the work; texts of Latin-1 alone take
    a plain regular expression that gives the same pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.loads(open(path, encoding="utf-8").read())
        self.full = Tokenizer.from_file(path)
        marks = spec.get("added_tokens") or []
        if any(m["lstrip"] or m["rstrip"] or m["single_word"] or m["normalized"] for m in marks):
            raise ValueError("added tokens with strip, word or normalisation flags are not supported")
        found = sorted((re.escape(m["content"]) for m in marks), key=len, reverse=True)
        self.marks = re.compile("|".join(found)) if found else None
        self.latin = self._latin_pattern(spec)
        bare = dict(spec, normalizer=None, added_tokens=[], post_processor=None, truncation=None, padding=None,
                    pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                   "use_regex": False})
        self.model = Tokenizer.from_str(json.dumps(bare))

    @staticmethod
    def _latin_pattern(spec: dict) -> re.Pattern | None:
        """The file's split pattern over Latin-1, if the file normalises as
        lower case with white space dropped; else the library splits."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps[0].get("type") != "Split" or not steps[0].get("invert") or norm != ["NFC", "Replace", "Lowercase"]:
            return None
        pattern = steps[0]["pattern"]["Regex"]
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        for name, chars in ((r"\p{L}", of("L")), (r"\p{N}", of("N")), (r"\s", space)):
            pattern = pattern.replace(name, chars)
        return re.compile(pattern)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a whole text, and how many special strings it holds."""
        if self.marks is None:
            return self._plain(text), 0
        parts = self.marks.split(text)
        if len(parts) == 1:
            return self._plain(text), 0
        return [w for p in parts for w in self._plain(p)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text.lower())
            except UnicodeEncodeError:
                pass
        if self.full.normalizer is not None:
            text = self.full.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(words, add_special_tokens=False)]


_LOADED: dict[str, PreTokens] = {}


def _pre_tokens(path: str) -> PreTokens:
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


def piece_table(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(pre_token, freq, pieces): every distinct pre-token of the corpus, how
    often it occurs, and its number of pieces, counted once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _pre_tokens(tokenizer).split, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pre_token": pa.array(list(seen), pa.string()),
                                               "n": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for text in texts(batch.column(0)):
                if text:
                    seen.update(split(text)[0])
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _pre_tokens(tokenizer).pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())],
                                             names=["pre_token", "freq", "pieces"])

    return (docs.select(F.col(text_col).alias("text"))
            .mapInArrow(count, "pre_token string, n long")
            .groupBy("pre_token").agg(F.sum("n").alias("freq"))
            .mapInArrow(pieces, "pre_token string, freq long, pieces long"))


def frequent_head(table: DataFrame, head_size: int) -> dict[str, int]:
    """Pieces of the pre-tokens with freq >= 2^k, for the least k that leaves
    at most ``head_size`` of them; only 64 counts are looked at to find k."""
    short = table.where(F.octet_length("pre_token") <= HEAD_BYTES)
    sizes = {r["k"]: r["n"] for r in short.groupBy(F.floor(F.log2("freq")).alias("k")).agg(F.count("*").alias("n")).collect()}
    total, cut = 0, 64
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > head_size:
            break
        total, cut = total + sizes[k], k
    if cut == 64:
        return {}
    return {r[0]: r[1] for r in short.where(F.col("freq") >= F.lit(1 << cut)).select("pre_token", "pieces").toLocalIterator()}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 head_size: int = HEAD_SIZE) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    table = scratch.table(piece_table(docs, tokenizer, text_col), "pieces")
    head = spark.sparkContext.broadcast(frequent_head(table, head_size))

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", id_type),
        T.StructField("n_bytes", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, numbers = _pre_tokens(tokenizer).split, head.value, row_numbering()
        for batch in batches:
            rows, size, known, rare, times = [], [], [], [], []
            for text in texts(batch.column(1)):
                rows.append(next(numbers))
                words, n = split(text) if text else ((), 0)
                r, t = [], []
                for w, k in Counter(words).items():
                    p = pieces.get(w)
                    if p is None:
                        r.append(w)
                        t.append(k)
                    else:
                        n += k * p
                size.append(len(text.encode()) if text else 0)
                known.append(n)
                rare.append(r)
                times.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), pa.array(size, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                names=schema.names)

    seen = scratch.table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                         .mapInArrow(measure, schema), "frequencies")
    rare = (seen.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("pre_token"), F.col("x.times").alias("k"))
            .join(table.select("pre_token", "pieces"), "pre_token")
            .groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("rest")))
    return (seen.select("row", "id", "n_bytes", "known").join(rare, "row", "left")
            .select(F.col("id").alias(id_col), "n_bytes",
                    (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens")))
