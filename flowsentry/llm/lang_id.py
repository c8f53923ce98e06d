"""Language identification by word-first backoff (operator 5).

A known word is scored by its log frequency in each language.  A word that
was not learned falls back to its character n-grams (word edges marked): the
longest length at which any n-gram is known decides, else the next shorter
one, down to single letters.  The text goes to the language with the largest
sum; the score is that language's share of the likelihoods.

A run of more than ``LONGEST_WORD`` letters (texts without spaces) is never a
known word: all its n-grams are counted and judged.

Learning counts words over every labelled row (each task adds up before the
shuffle) and derives n-gram counts from the word counts.  The model keeps the
``n_words`` most frequent words and the ``n_grams`` most frequent n-grams, so
the broadcast is bounded by these parameters; rarer ones use the backoff.

Defined cases: a null text or one without a letter gives ``und`` with score
0; so does every text if no row can be learned from.  Ties go to the first
language in name order.  Null ids are kept; columns of the input other than
the named ones are not read.  Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch, release, texts, tidy

UNDETERMINED = "und"
N_WORDS = 300_000
N_GRAMS = 100_000
LONGEST = 4
LONGEST_WORD = 64
FLUSH = 200_000
MEMO = 50_000
SLICE = 500
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of the word with its edges marked; single letters
    have no edges."""
    if n == 1:
        return list(word)
    w = f"<{word}>"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language (columns in name order)."""

    langs: list[str]
    words: dict[str, int]
    word_logp: np.ndarray
    grams: dict[str, int]
    gram_logp: np.ndarray | list[list[float]]

    def backoff(self, word: str) -> list[float] | None:
        """Mean log frequency of the longest n-grams of which any is known."""
        for n in range(LONGEST, 0, -1):
            found = [g for g in (self.grams.get(x) for x in grams_of(word, n)) if g is not None]
            if found:
                rows = np.asarray(self.gram_logp)[found].tolist()
                return [sum(x) / len(rows) for x in zip(*rows)]
        return None

    def predict(self, text: str | None, memo: dict) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        known, times, rest = [], [], [0.0] * len(self.langs)
        for w, k in Counter(words).items():
            i = self.words.get(w)
            if i is not None:
                known.append(i)
                times.append(k)
                continue
            if len(w) > LONGEST_WORD:
                found = self.backoff(w)
            elif w in memo:
                found = memo[w]
            else:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[w] = self.backoff(w)
            if found is not None:
                rest = [a + k * b for a, b in zip(rest, found)]
        total = np.array(rest)
        if known:
            total += np.asarray(times, dtype=np.float64) @ self.word_logp[known]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, lang, n) over all rows of (text, lang)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array([w for c in seen.values() for w in c], pa.string()),
                                               "lang": pa.array([x for x, c in seen.items() for _ in c], pa.string()),
                                               "n": pa.array([n for c in seen.values() for n in c.values()], pa.int64())})
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), texts(batch.column(1))):
                seen.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, seen.values())) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return (rows.mapInArrow(tidy(count), "word string, lang string, n long")
            .groupBy("word", "lang").agg(F.sum("n").alias("n")))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, lang, n) from the word counts."""
    def cut(n: int):
        return lambda i: F.concat(*[F.get("chars", i + k) for k in range(n)])

    def chars(text) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    size = F.size("chars")
    of = [F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), cut(n))).otherwise(F.array().cast("array<string>"))
          for n in range(2, LONGEST + 1)]
    return (words.withColumn("letters", chars(F.col("word"))).withColumn("chars", chars(F.concat(F.lit("<"), "word", F.lit(">"))))
            # explode_outer: for explode, the optimiser infers a filter that would make the n-grams again
            .select(F.explode_outer(F.concat("letters", *of)).alias("gram"), "lang", "n")
            .groupBy("gram", "lang").agg(F.sum("n").alias("n")))


def _most_frequent(counts: DataFrame, key: str, langs: list[str], keep: int) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies of at most ``keep`` keys: all with a count of 2^k or
    more, for the least such k."""
    wide = counts.groupBy(key).agg(
        F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}")
                                     for i, x in enumerate(langs)])
    scratch = Scratch(counts.sparkSession, "lang-id")
    wide = scratch.table(wide, key)
    sizes = {r["k"]: r["n"] for r in wide.groupBy(F.floor(F.log2("total")).alias("k")).agg(F.count("*").alias("n")).collect()}
    size, cut = 0, 64
    for k in sorted(sizes, reverse=True):
        if size + sizes[k] > keep:
            break
        size, cut = size + sizes[k], k
    rows = wide.where(F.col("total") >= F.lit(1 << cut)).collect() if cut < 64 else []
    totals = wide.agg(*[F.sum(f"n{i}") for i in range(len(langs))]).first()
    scratch.drop(wide)
    names = {r[key]: i for i, r in enumerate(rows)}
    n = np.array([[r[f"n{i}"] for i in range(len(langs))] for r in rows], dtype=np.float64).reshape(len(rows), len(langs))
    size_all = np.array([t or 0 for t in totals], dtype=np.float64)
    return names, np.log((n + 0.5) / (size_all + 0.5 * max(1, len(rows)) + 1))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang",
        n_words: int = N_WORDS, n_grams: int = N_GRAMS) -> Model:
    """Learn from all rows whose text and language are not null."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    scratch = Scratch(rows.sparkSession, "lang-id")
    words = scratch.table(word_counts(rows), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not langs:
        scratch.drop(words)
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    w, w_logp = _most_frequent(words.where(F.length("word") <= LONGEST_WORD), "word", langs, n_words)
    g, g_logp = _most_frequent(gram_counts(words), "gram", langs, n_grams)
    scratch.drop(words)
    return Model(langs, w, w_logp, g, g_logp)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """The input with the language and the score added (columns of these
    names are replaced)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (lang_out, score_out)]
    at = keep.index(text_col)
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = docs.limit(0).withColumn(lang_out, F.lit("")).withColumn(score_out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m, memo = shared.value, {}
        for whole in batches:
            for batch in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                got = [m.predict(t, memo) for t in texts(batch.column(at))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())],
                    names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by a checksum of its id; a null id is not held
    out and not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def may_learn(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 != 0
