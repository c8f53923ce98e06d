"""Embedding near-dedup by spherical k-means cells (operator 3).

Vectors of one label (and one length) are compared; two are linked when their
cosine, in double precision, is at least ``threshold``.

1. Equal vectors of a label become one vector with a weight.
2. Labels with many vectors are cut into cells by spherical k-means, fitted on
   at most ``SAMPLE`` vectors; every vector goes to its nearest centre, and a
   cell is cut into blocks of about ``BLOCK`` vectors.
3. Cosine products compare a block with itself, with the later blocks of
   its cell, and with visitors from other cells.  A vector visits another
   cell only if it is near the plane between the two centres: with
   cos >= t two vectors are at most sqrt(2 - 2t) apart, so one that is
   farther from the plane has no partner behind it.  The cells thus lose no
   link, whatever the fit.
4. Tasks give back sums of linked weights and one link per vector and block
   (to the block's own group), never pairs; a component's smallest id
   represents it.

Memory in a task is one block and one batch of visitors.

Defined cases: null labels, and vectors that are null, empty, zero or hold
null or non-finite components, link with nothing.  Repeated rows are vectors
of their own.  Null ids: a component's id is its smallest id that is not
null; a row is kept if its id equals it (null-safe).  Columns other than the
named ones are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import Scratch, by_group, components, local_roots

THRESHOLD = 0.98
BLOCK = 1024
SAMPLE = 50_000
MAX_CELLS = 64
ROUNDS = 8
SLACK = 1e-9


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column (all of one length) scaled to length 1."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres; starts from evenly spaced rows, so the same for the same
    rows in the same order."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.argmax(x @ centres.T, axis=1)
        for c in range(k):
            s = x[cell == c].sum(axis=0)
            n = np.sqrt((s * s).sum())
            if n > 0:
                centres[c] = s / n
    return centres


def _prepared(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    good = (F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.xxhash64(F.col(label_col).cast("string"), F.size(vec_col)).alias("group"),
                       v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))


def link_counts(distinct: DataFrame, scratch: Scratch, threshold: float, block: int = BLOCK,
                sample: int = SAMPLE, max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame]:
    """For (node, group, v, weight): sums of linked weights (node, links) and
    links (a, b) that connect what is linked."""
    spark = distinct.sparkSession
    # labels with more than one block, and their centres; a label beyond the sample's reach is one cell of many blocks
    big = distinct.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > block)
    total = big.agg(F.sum("n")).first()[0] or 0
    centres: dict[int, np.ndarray] = {}
    if total:
        share = min(1.0, sample / total)
        drawn = (distinct.join(big, "group").where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
                 .select("group", "n", "v").orderBy(F.xxhash64("v")).limit(sample))
        by: dict[int, list] = {}
        sizes: dict[int, int] = {}
        for g, n, v in drawn.collect():
            by.setdefault(g, []).append(v)
            sizes[g] = n
        for g, vs in by.items():
            k = min(max_cells, max(1, len(vs) // 8), math.ceil(sizes[g] / block))
            if k > 1:
                centres[g] = spherical_kmeans(unit_vectors(pa.array(vs, pa.list_(pa.float64()))), k)
    shared = spark.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            groups = batch.column("group").to_numpy()
            for g in np.unique(groups):
                c = shared.value.get(int(g))
                if c is not None:
                    at = np.flatnonzero(groups == g)
                    cell[at] = np.argmax(unit_vectors(batch.column("v").take(pa.array(at))) @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    homes = scratch.table(distinct.mapInArrow(cells, T.StructType([*distinct.schema.fields, T.StructField("cell", T.IntegerType())])), "cells")
    counts = homes.groupBy("group", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # blocks per cell, as one small array for each label
    plan = counts.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("cell", "blocks"))).alias("plan"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    placed = homes.join(plan, "group")
    out_schema = "unit long, visitor boolean, node long, weight long, v array<double>"

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for its own block and for every block that it visits."""
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                nodes, groups, cell = (batch.column(c).to_numpy() for c in ("node", "group", "cell"))
                plans = [dict(p) for p in batch.column("plan").to_pylist()]
                units, visitor, of = [], [], []
                far: dict[int, np.ndarray] = {}
                for g in np.unique(groups):
                    c = shared.value.get(int(g))
                    if c is not None:
                        at = np.flatnonzero(groups == g)
                        x = unit_vectors(batch.column("v").take(pa.array(at)))
                        for i, row in zip(at, x):
                            gap = c[cell[i]] - c
                            norm = np.sqrt((gap * gap).sum(axis=1))
                            far[i] = np.divide(gap @ row, norm, out=np.zeros(len(c)), where=norm > 0)
                for i in range(batch.num_rows):
                    plan_i, home, group = plans[i], int(cell[i]), int(groups[i])
                    mine = _mix(int(nodes[i])) % plan_i[home]
                    units.append(_unit(group, home, mine))
                    visitor.append(False)
                    of.append(i)
                    for other, blocks in plan_i.items():
                        if other < home or (other > home and far[i][other] > reach):
                            continue
                        for b in range(mine + 1 if other == home else 0, blocks):
                            units.append(_unit(group, other, b))
                            visitor.append(True)
                            of.append(i)
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units, pa.int64()), pa.array(visitor, pa.bool_()), *[batch.column(c).take(at) for c in ("node", "weight", "v")]],
                    names=["unit", "visitor", "node", "weight", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, home, home_nodes, home_weight, home_sum = None, None, None, None, None

        def result(nodes: np.ndarray, links: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
            keep = (links > 0) | (roots != nodes)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (nodes, links, roots)], names=["node", "links", "root"])

        for table in _blocks(batches):
            nodes, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
            x = unit_vectors(table.column("v").combine_chunks())
            u, is_visitor = table.column("unit")[0].as_py(), table.column("visitor")[0].as_py()
            if not is_visitor:
                unit, home, home_nodes, home_weight = u, x, nodes, weight
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                a, b = np.nonzero(near)
                roots = local_roots(len(nodes), a, b)
                yield result(nodes, near @ weight, nodes[roots])
                continue
            if u != unit:
                continue        # a block that nobody has its home in
            near = home @ x.T >= threshold
            a, b = np.nonzero(near)
            if not len(a):
                continue
            n = len(home_nodes)
            roots = local_roots(n + len(nodes), a, b + n)
            both = np.concatenate([home_nodes, nodes])
            yield result(both, np.concatenate([near @ weight, near.T @ home_weight]), both[roots])

    moved = by_group(placed.mapInArrow(visits, out_schema), "unit", int(spark.conf.get("spark.sql.shuffle.partitions")), "visitor")
    found = scratch.table(moved.mapInArrow(compare, "node long, links long, root long"), "found")
    return (found.groupBy("node").agg(F.sum("links").alias("links")),
            found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def _mix(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 >> 20 & 0xFFFFFFFF


def _unit(group: int, cell: int, block: int) -> int:
    return xxhash.xxh64_intdigest(f"{group}/{cell}/{block}") - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Home rows of a unit as one table, then its visitors in pieces of at
    most one block."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        units, visitor = batch.column("unit").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (visitor[1:] != visitor[:-1])) + 1).tolist(), len(units)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            now = (int(units[a]), bool(visitor[a]))
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            for i in range(a, b, BLOCK):
                piece = batch.slice(i, min(BLOCK, b - i))
                held.append(piece)
                if key[1] and sum(h.num_rows for h in held) >= BLOCK:
                    yield pa.Table.from_batches(held)
                    held = []
    if held:
        yield pa.Table.from_batches(held)


def dedup_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                     threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    scratch = Scratch(rows.sparkSession, "embedding-dedup")
    rows = scratch.table(_prepared(rows, id_col, vec_col, label_col), "rows")
    keyed = rows.where("good").withColumn("key", F.xxhash64("v")).withColumn("key2", F.xxhash64(F.lit(3), "v"))
    classes = scratch.table(keyed.groupBy("group", "key", "key2").agg(
        F.min("row").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("weight")), "classes")
    distinct = scratch.table(rows.select(F.col("row").alias("node"), "v").join(classes, "node").select("node", "group", "weight", "v"), "distinct")
    counts, links = link_counts(distinct, scratch, threshold)
    roots = components(scratch, links)
    known = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "group", "key", "key2", "least_id", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    known = scratch.table(known, "known")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(least, "root").select(
        "group", "key", "key2", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = keyed.select("row", "id", "group", "key", "key2").join(known, ["group", "key", "key2"]).select("row", "id", "n_links", "component_id")
    alone = rows.where("not good").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.col("component_id").cast(rows.schema["id"].dataType).alias("component_id"),
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
