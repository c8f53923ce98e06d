"""MinHash near-dedup by a chosen-path set similarity join (operator 8).

Documents are sets of distinct word shingles; two are linked when
``intersection >= similarity * union`` on the full sets.

1. One scan makes each document's set digest, ``T`` minwise tokens and a
   sketch (one byte of each token).  Documents with equal sets form a class;
   only one of each class goes on.
2. ``trees`` independent trees: a node splits its documents by their minwise
   tokens at positions chosen for that node (each with probability
   1 / (similarity * T)), so similar documents share a chosen path with a
   probability that grows with their similarity.  Nodes of at most ``leaf``
   documents stop; nodes of one document, or of nothing but documents known
   to be connected, are dropped.  A node still larger after ``depth`` levels is
   dealt into leaves at random, together with a few pivots of the whole node,
   which connects the bulk of a group of near copies cheaply.
3. Leaves are compared exhaustively, first by sketches; documents with a
   promising partner get their full sets (their texts are read again once),
   and the exact test within the leaf gives one link per document and group.
   After a first round of ``first_trees`` trees, what is connected already is
   not compared again in the other trees.
4. A node that was dealt, and holds documents not connected by now, is compared
   whole: it is cut into blocks, and every pair of blocks is a leaf, but for
   two blocks of one component.  So no node loses a link by its size; the work
   on documents of a node that are alike, but not near duplicates, grows with
   their square, a pair of blocks a task at a time.
5. Connected components of the links.

A pair at the threshold shares a leaf of one tree with a probability of about
0.63 for one level, 0.47 for two, 0.37 for three; 16 trees give a recall of
0.999 or more per pair with three levels.  Links between members of a large
group need not all be found: one path of links is enough for a component.

Defined cases: null texts and texts without a word have an empty set and no
link; texts with fewer words than a shingle are one shingle.  Repeated rows
are documents of their own with equal sets; equal ids share a
component id, and ``dedup`` keeps one row.  Null ids never represent a
component that holds another id.  Columns other than id and text are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import Scratch, by_group, components, fresh, grouped, local_roots, texts, tidy

WORDS = 5
SIMILARITY = Fraction(75, 100)
TOKENS = 128
TREES = 16
FIRST_TREES = 3
LEAF = 192
DEPTH = 4
PIVOTS = 4
#: Blocks of a dealt node: about so many documents, and so many shingles of them together.
BLOCK = 512
BLOCK_SHINGLES = 500_000
#: A pair is dropped by its sketch if its estimate is so many standard deviations too low.
SKETCH_SIGMA = 4.0

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.Generator(np.random.PCG64(20240817))
_MULT = _RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    found = WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    digest, known = xxhash.xxh3_64_intdigest, {}
    codes = np.empty(len(found), dtype=np.uint64)
    for i, w in enumerate(found):
        c = known.get(w)
        if c is None:
            c = known[w] = digest(w.encode("utf-8", "surrogatepass"))
        codes[i] = c
    if len(codes) <= words:
        h = _mixed(np.concatenate([codes, np.full(words - len(codes), len(codes), dtype=np.uint64)])[None, :])
    else:
        h = _mixed(np.lib.stride_tricks.sliding_window_view(codes, words))
    return np.unique(h)


def _mixed(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of codes, by their order."""
    h = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(rows.shape[1]):
        h ^= rows[:, k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


def minwise(h: np.ndarray, block: int = 2048) -> np.ndarray:
    """``TOKENS`` minwise tokens of a set, 32 bits each."""
    low = np.full(TOKENS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(h), block):
        part = h[None, i:i + block] * _MULT[:, None]
        part += _ADD[:, None]
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=1).astype(np.uint32), out=low)
    return low


def signatures(docs: DataFrame, id_col: str, text_col: str, row_col: str, words: int) -> DataFrame:
    """row, id, n, d1, d2 (digest of the set), tokens (binary)."""
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, tokens = [], [], []
            for text in texts(batch.column(1)):
                h = shingles(text, words)
                n.append(len(h))
                digests.append(xxhash.xxh128_digest(h.tobytes()))
                tokens.append(minwise(h).tobytes() if len(h) else None)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(both[:, 0])),
                 pa.array(np.ascontiguousarray(both[:, 1])), pa.array(tokens, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col, row_col).mapInArrow(tidy(run), schema)


def _seed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


_POSITIONS: dict[int, np.ndarray] = {}


def chosen(path: int, share: int) -> np.ndarray:
    """Positions at which the node ``path`` branches: each one with
    probability 1 / share."""
    got = _POSITIONS.get(path)
    if got is None:
        if len(_POSITIONS) > 20_000:
            _POSITIONS.clear()
        at = np.arange(TOKENS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_seed(path & 0xFFFFFFFFFFFFFFFF))
        at ^= at >> np.uint64(32)
        at *= np.uint64(0xD6E8FEB86659FD93)
        at ^= at >> np.uint64(32)
        got = _POSITIONS[path] = np.flatnonzero(at % np.uint64(share) == 0)
    return got


def branches(df: DataFrame, share: int) -> DataFrame:
    """(tree, path, row) of the children of (tree, path, row, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, paths, rows = (batch.column(c).to_numpy() for c in ("tree", "path", "row"))
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            out_tree, out_path, out_row = [], [], []
            uniq, inverse = np.unique(paths, return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.searchsorted(inverse[order], np.arange(len(uniq) + 1))
            for k, p in enumerate(uniq):
                at = order[ends[k]:ends[k + 1]]
                for i in chosen(int(p), share):
                    child = _mixed(np.stack([np.full(len(at), p, dtype=np.int64).view(np.uint64), np.full(len(at), i, dtype=np.uint64),
                                             tokens[at, i].astype(np.uint64)], axis=1))
                    out_path.append(child.view(np.int64))
                    out_row.append(rows[at])
                    out_tree.append(trees[at])
            join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(join(out_tree, np.int32)), pa.array(join(out_path, np.int64)), pa.array(join(out_row, np.int64))],
                                             names=["tree", "path", "row"])

    return df.select("tree", "path", "row", "tokens").mapInArrow(tidy(run), "tree int, path long, row long")


def leaves(reps: DataFrame, scratch: Scratch, trees: int, share: int, leaf: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """(tree, path, row) of all leaves of two documents or more, and (path, row)
    of the nodes that were dealt into such, None if there are none."""
    roots = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(_seed(t + 1) >> 1).cast("long").alias("path")) for t in range(trees)]))
    level = branches(reps.select("row", "tokens", roots.alias("r")).select("r.tree", "r.path", "row", "tokens"), share)
    out = None
    for k in range(depth):
        level = scratch.table(level.distinct() if k else level, f"level{k}")
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        members = scratch.table(level.join(sizes, "path"), f"nodes{k}")
        scratch.drop(level)
        small = members.where(F.col("size") <= leaf).select("tree", "path", "row")
        out = small if out is None else out.unionByName(small)
        large = members.where(F.col("size") > leaf)
        if not large.limit(1).count():
            return out, None
        if k < depth - 1:
            level = branches(large.join(reps.select("row", "tokens"), "row"), share)
    # what is still large: random leaves, each with the node's pivots
    pivots = large.groupBy("tree", "path", "size").agg(F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("row", "path", F.lit(j)).alias("h"), "row"))["row"] for j in range(PIVOTS)])).alias("pivots"))
    parts = F.ceil(F.col("size") / leaf).cast("int")
    dealt = large.select("tree", F.xxhash64("path", F.pmod(F.xxhash64("row", "path"), parts)).alias("path"), "row")
    spread = pivots.select("tree", "path", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "pivots").select(
        "tree", F.xxhash64("path", F.col("part").cast("long")).alias("path"), F.explode("pivots").alias("row"))
    return out.unionByName(dealt.unionByName(spread).distinct()), large.select("path", "row")


def block_pairs(large: DataFrame, reps: DataFrame, roots: DataFrame, scratch: Scratch, block: int) -> DataFrame | None:
    """(tree, path, row, sketch, root) of all pairs of blocks of the nodes whose
    documents are not one component; a path is one pair.  Documents of a
    component of more than ``block`` in a node make blocks of their own, which
    are not paired with each other."""
    nodes = (large.join(reps.select("row", "n"), "row").join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
             .withColumn("root", F.coalesce("root", "row")))
    groups = scratch.table(nodes.groupBy("path", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), "groups")
    apart = groups.groupBy("path").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("path")
    groups = groups.join(apart, "path", "left_semi").withColumn("own", F.when(F.col("size") > block, F.col("root")))
    count = F.greatest(F.ceil(F.sum("size") / block), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int")
    cuts = scratch.table(groups.groupBy("path", "own").agg(count.alias("parts")), "cuts")
    if not cuts.limit(1).count():
        return None
    at = cuts.select("path", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    at = at.withColumn("block", F.xxhash64("path", F.coalesce("own", F.lit(-1).cast("long")), "part"))
    other = at.select("path", F.col("own").alias("own2"), F.col("block").alias("block2"))
    pairs = (at.join(other, "path").where("block <= block2 and (own is null or own2 is null or own <> own2)")
             .select(F.xxhash64("block", "block2").alias("pair"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block")))
    placed = (nodes.join(groups.select("path", "root", "own"), ["path", "root"])
              .join(cuts.withColumnRenamed("own", "own2"), "path").where("own <=> own2")
              .withColumn("part", F.pmod(F.xxhash64("row", "path"), "parts").cast("int"))
              .select(F.xxhash64("path", F.coalesce("own", F.lit(-1).cast("long")), "part").alias("block"), "row", "root"))
    return (placed.join(pairs, "block").join(reps.select("row", "sketch"), "row")
            .select(F.lit(-1).alias("tree"), F.col("pair").alias("path"), "row", "sketch", "root"))


def promising(members: DataFrame, parts: int, least: int) -> DataFrame:
    """(tree, path, row) of the documents of a leaf that have, by sketch, a
    partner in it that they are not connected with (columns sketch, root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "path"):
            roots = group.column("root").to_numpy()
            if (roots == roots[0]).all():
                continue
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            live = np.zeros(len(roots), dtype=bool)
            for i in range(len(roots) - 1):
                near = ((sketch[i + 1:] == sketch[i]).sum(axis=1) >= least) & (roots[i + 1:] != roots[i])
                if near.any():
                    live[i] = True
                    live[i + 1:] |= near
            if live.any():
                yield from group.select(["tree", "path", "row"]).filter(pa.array(live)).to_batches()

    return (by_group(members.select("tree", "path", "row", "sketch", "root"), "path", parts, "row")
            .mapInArrow(tidy(run), "tree int, path long, row long"))


def verified(members: DataFrame, parts: int, similarity: Fraction) -> DataFrame:
    """(a, b): links of the full sets (column set), one per document and
    connected group of a leaf."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "path"):
            rows = group.column("row").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("set").to_pylist()]
            size = np.array([len(s) for s in sets])
            common = shared_counts(sets)
            union = size[:, None] + size[None, :] - common
            near = common * den >= union * num
            np.fill_diagonal(near, False)
            a, b = np.nonzero(near)
            root = local_roots(len(rows), a, b)
            at = np.flatnonzero(root != np.arange(len(rows)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(rows[root[at]])], names=["a", "b"])

    return by_group(members.select("path", "row", "set"), "path", parts, "row").mapInArrow(tidy(run), "a long, b long")


def shared_counts(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of a leaf's sets."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[code]
    of, column = of[keep], number[code[keep]]
    common = np.zeros((n, n), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for c in range(0, int(often.sum()), block):
        a, b = np.searchsorted(column, [c, c + block])
        m = np.zeros((n, block), dtype=np.float32)
        m[of[a:b], column[a:b] - c] = 1
        common += (m @ m.T).astype(np.int64)
    return common


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    similarity: Fraction = SIMILARITY, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH,
                    first_trees: int = FIRST_TREES, row_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per input row: row, id, n_shingles, component_id (the smallest
    id reachable), component (a number of it), first (the row that stays).
    With ``row_col``, ``docs`` is a written table with a number of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chosen-path")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, round(float(similarity) * TOKENS))
    s = float(similarity)
    match = s + (1 - s) / 256
    least = int(TOKENS * match - SKETCH_SIGMA * (TOKENS * match * (1 - match)) ** 0.5)

    stored = docs
    if row_col is None:
        row_col = "_row" if id_col != "_row" != text_col else "__row"
        stored = scratch.table(_numbered(docs, [id_col, text_col], row_col), "numbered")
    signed = scratch.table(signatures(stored, id_col, text_col, row_col, words), "signatures")
    classes = scratch.table(signed.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep")), "classes")
    tokens = scratch.table(signed.where("n > 0").select("row", "n", "tokens").join(classes.select(F.col("rep").alias("row")), "row", "left_semi"),
                           "tokens")
    sigs = scratch.table(signed.drop("tokens"), "digests")
    scratch.drop(signed)
    reps = scratch.table(tokens.select("row", "n", _sketch(F.col("tokens")).alias("sketch")), "sketches")
    found, large = leaves(tokens, scratch, trees, share, leaf, depth)
    scratch.drop(tokens)
    members = found.join(reps.select("row", "sketch"), "row")
    live = scratch.table(promising(members.withColumn("root", F.col("row")), parts, least), "live")

    def full_sets(of: DataFrame) -> DataFrame:
        need = of.select("row").distinct()
        return scratch.table(stored.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).join(need, "row", "left_semi")
                             .mapInArrow(tidy(_as_sets(words)), "row long, set binary"), "sets")

    sets = full_sets(live)
    links = scratch.table(verified(live.where(F.col("tree") < first_trees).join(sets, "row"), parts, similarity), "links")
    if trees > first_trees:
        roots = components(scratch, links)
        rest = (live.where(F.col("tree") >= first_trees).join(reps.select("row", "sketch"), "row")
                .join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
                .withColumn("root", F.coalesce("root", "row")))
        rest = scratch.table(promising(rest, parts, least), "rest")
        more = scratch.table(verified(rest.join(sets, "row"), parts, similarity), "more")
        links = links.unionByName(more)
        scratch.drop(rest)
    scratch.drop(live, sets)
    roots = components(scratch, links)
    apart = block_pairs(large, reps, roots, scratch, block) if large is not None else None
    if apart is not None:
        rest = scratch.table(promising(apart, parts, least), "apart")
        last = scratch.table(verified(rest.join(full_sets(rest), "row"), parts, similarity), "last")
        roots = components(scratch, links.unionByName(last))
    if stored is not docs:
        scratch.drop(stored)
    labelled = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "d1", "d2", F.coalesce("root", "rep").alias("component"))
    rows = (sigs.where("n > 0").select("row", "id", "n", "d1", "d2").join(labelled, ["d1", "d2"]).drop("d1", "d2")
            .unionByName(sigs.where("n = 0").select("row", "id", "n", (-1 - F.col("row")).alias("component"))))
    rows = scratch.table(rows, "rows")
    first = rows.groupBy("component").agg(F.min("id").alias("component_id"),
                                          F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))["row"].alias("first_row"))
    return rows.join(first, "component").select(
        "row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "component",
        (F.col("row") == F.col("first_row")).alias("first"))


def _sketch(tokens: Column) -> Column:
    """One byte of each 32-bit token."""
    hexes = F.hex(tokens)
    return F.unhex(F.regexp_replace(hexes, "(..)......", "$1"))


def _numbered(docs: DataFrame, columns: list[str], number: str) -> DataFrame:
    """The columns and a number of each row.  To be written once and read back:
    another scan may deal the rows in another way."""
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias(number))


def _as_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], names=["row", "set"])
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with one row of each group of near duplicates: that of the
    smallest id.  Rows are numbered in a written copy."""
    number = fresh(docs, "_row_number")
    stored = Scratch(docs.sparkSession, "chosen-path").table(_numbered(docs, docs.columns, number), "documents")
    stay = near_duplicates(stored, id_col, text_col, row_col=number, **options).where("first").select(F.col("row").alias(number))
    return stored.join(stay, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
