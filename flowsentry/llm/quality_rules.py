"""Quality rules (operator 13, native).

A document is judged by plain counts (words, repeated lines, words in
repeated windows) and by a likelihood ratio: hashed word unigrams and bigrams
are drawn from one multinomial for the trusted target and from another for
the raw corpus, and a document's score is its mean log ratio per n-gram.  It
is kept if the counts pass and the score reaches a fixed threshold: the same
document and corpus always get the same verdict.

1. One scan hashes the n-grams of all documents into ``BUCKETS`` buckets and
   adds up two counts a bucket: raw corpus and trusted target.  Each task adds
   up before the shuffle, so a task sends ``BUCKETS`` rows a group at most.
2. A bucket seen c times in the target, where the raw corpus lets expect e,
   weighs ln((c + PRIOR) / (e + PRIOR)), in millionths (whole numbers, so sums
   don't hang on their order).  The prior keeps buckets neutral about which
   the target tells little.  With a ``group_col`` (the language) the raw corpus
   is taken in the target's mix of groups, so a document does not lose for a
   group that happens to have few labels; a group without any is neutral.
3. A second scan counts and scores each document in place, without a shuffle:
   the weights (``BUCKETS`` numbers, whatever the corpus) are a scalar
   subquery.

Only DataFrame functions; no Python runs on the executors.

Defined cases: a null or empty text has no words, so it fails by the least
number of words; its score is null.  Trusted are documents all of whose label
rows have quality 1 and toxic 0 or null; label rows with a null id say
nothing.  Without any trusted document the score is 0 for all.  Repeated
document rows are judged row by row, null ids are kept.  Other columns are
not read; empty tables give an empty result.  Windows of a document count as
equal if their 64-bit hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch

SYMBOLS = r"[^#*$%&|<>]++"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
BUCKETS = 1 << 16
PRIOR = 5.0
UNIT = 1_000_000
#: Least mean log ratio (in nats) of a document that is kept.
THRESHOLD = -0.1
#: Trusted ids up to this number are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def words(text: Column) -> Column:
    """Array of the words; blanks are made one kind, since splitting at a
    literal is much cheaper than at a pattern."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.filter(F.split(one, " "), lambda w: w != "")


def _neighbours(xs: str, n: int, f) -> Column:
    """``f`` of each element of the array column ``xs`` and the one ``n``
    places behind it."""
    size = F.size(xs)
    return F.when(size > n, F.zip_with(F.slice(xs, 1, size - n), F.slice(xs, F.lit(n + 1), size - n), f))


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _words and _hash (64 bits for each word)."""
    return (docs.withColumn("_words", words(F.col(text_col)))
            .withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))))


def with_buckets(df: DataFrame) -> DataFrame:
    """Adds _ngrams: the buckets of all words and word pairs, in order."""
    df = df.withColumn("_uni", F.transform("_hash", lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")))
    pairs = _neighbours("_uni", 1, lambda a, b: (a * 31 + b) % BUCKETS)
    return df.withColumn("_ngrams", F.concat("_uni", F.coalesce(pairs, F.array().cast("array<int>")))).drop("_uni")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents in the trusted target."""
    return (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_trusted"))
            .agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
            .where("q = 1 AND t = 0").select("_trusted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        group_col: str | None = None) -> DataFrame:
    """(bucket, target, expected, weight) for every bucket, from all
    documents; a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    ids = scratch.table(trusted_ids(labels, id_col), "trusted")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    group = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), group.alias("_group"))
    rows = rows.join(ids, F.col("_id") == F.col("_trusted"), "left")
    counts = (with_buckets(hashed(rows, "_text"))
              # explode_outer: for explode, the optimiser infers a filter that would hash everything again
              .select(F.explode_outer("_ngrams").alias("bucket"), "_group", F.col("_trusted").isNotNull().cast("long").alias("t"))
              .where(F.col("bucket").isNotNull())
              .groupBy("bucket", "_group").agg(F.count("*").alias("raw"), F.sum("t").alias("target")))
    counts = scratch.table(counts, "counts")
    shares = counts.groupBy("_group").agg((F.sum("target") / F.sum("raw")).alias("share"))
    seen = (counts.join(shares, "_group").groupBy("bucket")
            .agg(F.sum("target").alias("target"), F.sum(F.col("raw") * F.col("share")).alias("expected")))
    full = (spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left")
            .fillna(0, ["target", "expected"]))
    ratio = (F.col("target") + PRIOR) / (F.col("expected") + PRIOR)
    return scratch.table(full.withColumn("weight", F.round(F.log(ratio) * UNIT).cast("int")), "weights")


def repeated_words(hashes: str, window: int = WINDOW) -> tuple[list[tuple[str, Column]], Column]:
    """Helper columns, and the number of words in windows of ``window`` (a
    power of two) words that occur twice or more, from an array of hashes."""
    steps, name, width = [], hashes, 1
    while width < window:
        steps.append((f"_w{2 * width}", _neighbours(name, width, lambda a, b: F.xxhash64(a, b))))
        name, width = steps[-1][0], 2 * width
    # each hash with its place, sorted; neighbours with equal hashes are repeats
    steps.append(("_sorted", F.when(F.size(F.array_distinct(name)) < F.size(name),
                                    F.sort_array(F.transform(name, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    n = F.size("_sorted")
    twice = F.zip_with(F.slice("_sorted", 1, n - 1), F.slice("_sorted", F.lit(2), n - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.concat(
                           F.sequence(a["i"], a["i"] + window - 1), F.sequence(b["i"], b["i"] + window - 1))))
    places = F.size(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    return steps, F.when(F.col("_sorted").isNotNull(), places).otherwise(0).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed, beside the helper columns of ``hashed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    steps, repeats = repeated_words("_hash")
    df = (hashed(docs, text_col)
          .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    for name, column in steps:
        df = df.withColumn(name, column)
    df = (df.withColumn("n_words", F.size("_words").cast("long"))
          .withColumn("word_chars", F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)))
          .withColumn("n_symbols", F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("n_repeat_words", repeats).drop("_lines", *[x for x, _ in steps]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def judge(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score (mean log ratio; null without words),
    kept."""
    table = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w")).scalar()
    df = with_buckets(measure(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text"))
    df = (df.withColumn("_weights", table)
          .withColumn("_sum", F.aggregate("_ngrams", F.lit(0).cast("long"), lambda s, b: s + F.get("_weights", b))))
    n = F.size("_ngrams").cast("long")
    passes = F.coalesce(F.col("_sum") >= F.lit(round(threshold * UNIT)) * n, F.lit(False))
    return df.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     F.when(n > 0, F.col("_sum") / (n * F.lit(float(UNIT)))).alias("score"),
                     (~F.col("base_failed") & passes).alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            group_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``judge`` with weights learned from the documents and their labels.  A
    written table: a filter on it must not be pushed into the measures."""
    out = judge(docs, fit(docs, labels, id_col, text_col, group_col), id_col, text_col, threshold)
    return Scratch(docs.sparkSession, "quality").table(out, "judged")
