"""Benchmark decontamination by template canonicalisation (operator 2, native).

Words of documents and benchmark items become template words: numbers, units
behind numbers, and names (capitalised words inside a sentence) are replaced
by typed placeholders, all else is put in lower case, and marks go.  The words
and the template words of a text are made and hashed once; a window of
``width`` words is a hash put together from these, in all its forms: as typed,
with its first word literal (whether that one is a name or unit hangs on what
stands before the window), and all literal (copies in other letter case, or
with other sentence ends, type other words).  A typed window of placeholders
alone says nothing and is left out: such windows can stand only when equal,
which the literal form finds.  The windows of all sizes come out of one scan
and are joined by hash.

Matched windows on one diagonal (document place minus item place) form an
alignment; each run of consecutive windows of it stands if its slot values are
consistent: each value of the item goes with one value of the document and
the other way round.  If they clash, only the windows with a changed value
that clashes go, and a run of what is left stands if it is equal word by word,
or has as many words outside slots as a window is long.  Equal values are an
exact leak, others a re-parameterised question.

Only DataFrame functions.  Document windows are never shuffled while the
benchmark has at most ``BROADCAST_WINDOWS`` windows (counted, then broadcast);
beyond that the join is left to Spark's shuffle joins.  A window that an item
holds several times is matched in its first place there, so texts of one
repeated word match once for each of their words, not for each pair.

Defined cases: null and empty texts have no windows.  An item of fewer than
``width`` but at least ``LEAST`` words is one window of its own length; a
shorter one is never matched.  An alignment of which fewer than half of the
words are literal stands only with equal values.  Repeated document rows are
matched row by row and give one result per (id, item); ``decontaminate``
removes by row.  Repeated items are items of their own.  Null ids are kept.  Other columns are not read; empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import Scratch, fresh, run_hash, run_hashes

WIDTH = 8
LEAST = 3
BROADCAST_WINDOWS = 500_000

#: Units that may follow a number.
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "cl", "l", "s", "sec", "second", "seconds", "min", "minute",
         "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "inch",
         "inches", "feet", "foot", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
         "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre",
         "litres", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees"]

#: Words as the template counts them: numbers (with decimals) and runs of letters.
WORD = r"\p{N}+(?:\.\p{N}+)*|[\p{L}\p{M}]+"


def spaced(text: Column) -> Column:
    """Words and sentence ends of a text, all else as one space."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}.!?]++", " ")


def template(spaced: Column) -> Column:
    """The template words of a ``spaced`` column (an expression would be run
    again in each place), joined by one space: one for each WORD.

    A name is a capitalised word behind a letter or number with nothing but
    white space or marks other than sentence ends between."""
    numbered = F.when(spaced.rlike(r"\p{N}"), F.regexp_replace(
        F.regexp_replace(spaced, r" ?\p{N}+(?:\.\p{N}+)* ?", " #num "),
        r"(?i)(?<=#num )(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}])", "#unit")).otherwise(spaced)
    named = F.regexp_replace(numbered, r"\p{Lu}(?<=[\p{L}\p{M}] .)\p{M}*+\p{Ll}[\p{L}\p{M}]*+", "#name")
    return F.lower(F.trim(F.regexp_replace(named, r"[ .!?]++", " ")))


def values(text: Column) -> Column:
    """Array of the words themselves, in lower case, one for each template word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words_of(df: DataFrame) -> DataFrame:
    """Adds to rows with text: values and template (arrays of equal length)."""
    return (df.withColumn("_spaced", spaced(F.col("text")))
            .withColumn("_template", F.coalesce(template(F.col("_spaced")), F.lit("")))
            .withColumn("values", values(F.col("text")))
            .withColumn("template", F.when(F.size("values") > 0, F.split("_template", " ")).otherwise(F.array().cast("array<string>")))
            .drop("_spaced", "_template"))


def window_hashes(df: DataFrame, sizes: list[int], item: bool = False) -> DataFrame:
    """Adds to rows with values and template: windows, an array of (size, at)
    where at holds for each place the hashes of the window that begins there:
    all literal; typed; and with a literal first word.

    A window's first word may be typed on one side alone.  So a document has
    the third form, which is hashed another way, where that word is a
    placeholder, and an ``item`` has it everywhere, hashed both ways."""
    df = (df.withColumn("_t", F.transform("template", lambda w: F.xxhash64(w)))
          .withColumn("_v", F.transform("values", lambda w: F.xxhash64(w))))
    for col in ("_t", "_v"):
        df = run_hashes(df, col, sizes)
    parts = []
    for n in sizes:
        if item:
            both = F.zip_with(f"_v_{n}", f"_t_{n}", lambda v, t: F.array(v, t))
        else:
            both = F.zip_with(f"_v_{n}", f"_t_{n}", lambda v, t: F.when(v == t, F.array(v)).otherwise(F.array(v, t)))
        third = F.transform(F.sequence(F.lit(0), F.size("_v") - n), _third(n, item))
        at = F.zip_with(both, third, lambda x, f: F.when(f.isNull(), x).otherwise(F.concat(x, f)))
        parts.append(F.struct(F.lit(n).alias("size"), F.when(F.size("_v") >= n, at).alias("at")))
    return df.withColumn("windows", F.array(*parts)).drop(*[c for c in df.columns if c.startswith(("_t", "_v"))])


def _third(n: int, item: bool):
    """Of a place: the hashes of its window with a literal first word."""
    def of(p: Column) -> Column:
        words = [F.get("_v", p), *[F.get("_t", p + k) for k in range(1, n)]]
        own = F.xxhash64(F.lit(n), *words)
        return F.array(own, run_hash(words)) if item else F.when(F.get("_t", p) != F.get("_v", p), F.array(own))
    return of


def digest(text: Column) -> Column:
    """Names a text; equal texts match the same items."""
    return F.sha2(text, 256)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per (document, item) that match: id, item id, n_windows,
    matched_words (item words covered), item_words, kind (exact or template),
    n_rows (document rows of that id that match)."""
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, item {benchmark.schema[item_col].dataType.simpleString()}, "
              "n_windows long, matched_words long, item_words long, kind string, n_rows long")
    names = {"id": id_col, "item": item_col}
    got = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, width)
    if got is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed(names)
    found, items = got
    found = (found.groupBy("id", "item_row")
             .agg(F.max("n_windows").alias("n_windows"), F.max("matched_words").alias("matched_words"),
                  F.max(F.col("item_words").cast("long")).alias("item_words"),
                  F.when(F.max("exact"), "exact").otherwise("template").alias("kind"), F.count("*").alias("n_rows")))
    return (found.join(items.select("item_row", "item"), "item_row")
            .select("id", "item", "n_windows", "matched_words", "item_words", "kind", "n_rows").withColumnsRenamed(names))


def _runs(df: DataFrame) -> DataFrame:
    """One row for each run of consecutive numbers in the sorted ``places``."""
    runs = F.array_distinct(F.transform("places", lambda p, i: p - i))
    return (df.withColumn("run", F.explode(runs))
            .withColumn("places", F.filter("places", lambda p, i: p - i == F.col("run"))).drop("run"))


def _pair(p: Column) -> Column:
    """Type and values, in item and document, of the slot at item place ``p``."""
    return F.struct(F.get("item_template", p).alias("t"), F.get("item_values", p).alias("b"),
                    F.get("values", p + F.col("diagonal")).alias("d"))


def _judged(df: DataFrame) -> DataFrame:
    """covered (item places from 0 of the run), slots among them, changed
    (places with another word), pairs of slot values, exact (no other word),
    consistent (pairs are one to one)."""
    n = F.size("pairs")
    return (df.withColumn("covered", F.sequence(F.array_min("places"), F.array_max("places") + F.col("size") - 1))
            .withColumn("slots", F.filter("covered", lambda p: F.get("item_template", p).startswith("#")))
            .withColumn("changed", F.filter("covered", lambda p: F.get("item_values", p) != F.get("values", p + F.col("diagonal"))))
            .withColumn("pairs", F.array_distinct(F.transform("slots", _pair)))
            .withColumn("exact", F.size("changed") == 0)
            .withColumn("consistent",
                        (F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["t"], p["b"])))) == n)
                        & (F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["t"], p["d"])))) == n)))


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
             width: int) -> tuple[DataFrame, DataFrame] | None:
    """(row, id, digest of the text, item_row, item_words, n_windows,
    matched_words, exact) of the document rows that match an item, and the
    items; None if no item can match."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.table(
        words_of(benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item"),
                                  F.col(item_text_col).alias("text")))
        .select("item_row", "item", F.col("values").alias("item_values"), F.col("template").alias("item_template"))
        .withColumn("item_words", F.size("item_values")).where(F.col("item_words") >= LEAST)
        .withColumn("size", F.least("item_words", F.lit(width))), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    if not sizes:
        return None

    own = items.select("item_row", "size", F.col("item_values").alias("values"), F.col("item_template").alias("template"))
    probe = (window_hashes(own, sizes, item=True)
             .select("item_row", "size", "template", F.explode("windows").alias("w")).where("w.size = size")
             .select("item_row", "size", "template", F.posexplode("w.at").alias("item_pos", "hs"))
             .select("item_row", "size", "template", "item_pos", F.posexplode("hs").alias("form", "h")))
    bare = F.forall(F.slice("template", F.col("item_pos") + 1, F.col("size")), lambda w: w.startswith("#"))
    probe = (probe.where(~(bare & (F.col("form") == 1)))
             .groupBy("item_row", "size", "h").agg(F.min("item_pos").alias("item_pos")))
    probe = scratch.table(probe, "windows")
    small = probe.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not small:       # these rows are read twice
        rows = scratch.table(rows, "rows")
    # explode_outer: for explode, the optimiser infers filters that would make the windows again
    grams = (window_hashes(words_of(rows), sizes)
             .select("row", "id", "text", F.explode_outer("windows").alias("w"))
             .select("row", "id", "text", F.posexplode_outer("w.at").alias("pos", "hs"))
             .select("row", "id", "text", "pos", F.explode_outer("hs").alias("h")))
    if small:
        hits = grams.join(F.broadcast(probe), "h")
    else:
        hits = grams.drop("text").join(probe, "h").join(rows.select("row", "text"), "row")
    hits = (hits.groupBy("row", "id", "item_row", "size", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
            .agg(F.collect_set("item_pos").alias("places"), F.first("text").alias("text")))
    # written: what follows uses these arrays many times, and the optimiser would make them again in each place
    aligned = scratch.table(words_of(hits).join(items.select("item_row", "item_words", "item_values", "item_template"), "item_row")
                            .withColumn("digest", digest(F.col("text"))).drop("text"), "aligned")
    # equal hashes are confirmed: each word is the same, or of the same type
    same = lambda p: ((F.get("item_values", p) == F.get("values", p + F.col("diagonal")))
                      | (F.get("item_template", p) == F.get("template", p + F.col("diagonal"))))
    aligned = scratch.table(aligned.withColumn("places", F.sort_array(F.filter("places", lambda w: F.forall(
        F.sequence(w, w + F.col("size") - 1), same)))).where(F.size("places") > 0).drop("template"), "confirmed")
    whole = scratch.table(_judged(_runs(aligned)), "whole")
    good = F.col("consistent") & (F.col("exact") | (F.size("slots") * 2 <= F.size("covered")))
    # of a run that does not stand: the windows without a clash, and those that are equal word by word
    clashing = F.filter("pairs", lambda p: (p["b"] != p["d"]) & F.exists("pairs", lambda q: (q["t"] == p["t"]) & (
        (q["b"] == p["b"]) != (q["d"] == p["d"]))))
    bad = F.filter("slots", lambda p: F.array_contains("clashing", _pair(p)))
    whole = scratch.table(whole.withColumn("whole", good).withColumn("clashing", F.when(~F.col("whole"), clashing)), "clashing")
    parts = (scratch.table(whole.withColumn("bad", bad), "bad")
             .withColumn("parts", F.when(F.col("whole"), F.array("places")).otherwise(F.array(
                 F.filter("places", lambda w: ~F.exists("bad", lambda p: (p >= w) & (p < w + F.col("size")))),
                 F.filter("places", lambda w: ~F.exists("changed", lambda p: (p >= w) & (p < w + F.col("size")))))))
             .select("row", "id", "digest", "item_row", "item_words", "size", "diagonal", "item_values", "item_template", "values", "whole",
                     F.explode("parts").alias("places")))
    stands = (scratch.table(_judged(_runs(scratch.table(parts, "parts"))), "judged")
              .where(good & (F.col("whole") | F.col("exact") | (F.size("covered") - F.size("slots") >= F.col("size")))))
    found = (stands.groupBy("row", "id", "digest", "item_row", "item_words")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
                  F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).cast("long").alias("matched_words"),
                  F.max("exact").alias("exact")))
    return found, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows that match no item, each judged by its own text: rows of one
    id, or without an id, don't take each other along."""
    got = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, width)
    if got is None:
        return docs
    leaked = fresh(docs, "_leaked")
    found = Scratch(docs.sparkSession, "decontaminate").table(got[0].select(F.col("digest").alias(leaked)).distinct(), "leaked")
    if found.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        found = F.broadcast(found)
    return docs.join(found, digest(docs[text_col]) == found[leaked], "left_anti")
