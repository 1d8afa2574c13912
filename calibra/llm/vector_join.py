"""Embedding near-duplicates by an epsilon grid order join (operator 8).

For unit vectors a cosine of at least s is a distance of at most
eps = sqrt(2 - 2 s). Vectors are projected on their leading principal
dimensions (a projection never lengthens a distance), cut into a grid of cells
of side eps and sorted by label and cells: the epsilon grid order. The sorted
sequence is cut into intervals of ``LEAF`` vectors, ``FANOUT`` of them form an
interval of the next level, and so on. The join starts with the top intervals
and goes down by pairs of intervals; a pair whose labels do not meet or whose
boxes are more than eps apart is skipped with all below it. At the bottom each
remaining pair of leaves is compared by a matrix product in double precision.

A pair of leaves yields one row per vector with links: how many, and the
smallest vector it hangs together with inside the pair. So a group of m alike
vectors costs m rows a leaf pair and not m * m; sums give ``n_links`` and
components give the groups. Bit-equal vectors of a label are one node with a
multiplicity.

The principal dimensions come from sums over all vectors (the square of the
dimension in numbers, whatever the rows). Vectors that are null, empty, zero, or
hold a null or non-finite component, and vectors with a null label, link with
nothing; so do vectors of unequal lengths. A null id is never linked (component
null, kept). Rows that share an id are one node, each counted as a vector.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import components, cut, on_workers, spread_ids, table

LEAF = 512
FANOUT = 8
DIMENSIONS = 6      # leading principal dimensions of the grid
LEAVES = ("part int, chunk int, label long, dim int, ids binary, weights binary, vecs binary, lo array<double>, hi array<double>")


def unit_rows(col) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of a list column as float64 arrays, and which of them are comparable."""
    out, good = [], np.zeros(len(col), bool)
    for i, value in enumerate(col):
        v = None
        if value.is_valid and value.values is not None and not value.values.null_count:
            v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            good[i] = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
            if good[i]:
                most = float(np.abs(v).max())
                if not 1e-100 < most < 1e100:      # its square would be out of range; a power of two keeps the direction
                    v = np.ldexp(v, -math.frexp(most)[1])
        out.append(v)
    return out, good


def _read_vectors(batches):
    import xxhash

    for batch in batches:
        rows, good = unit_rows(batch.column(2))
        raw = [v.tobytes() if g else None for v, g in zip(rows, good)]
        sig = [xxhash.xxh3_128_digest(x) if x is not None else None for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.binary()), pa.array(raw, pa.binary())],
                                         ["id", "label", "sig", "vec"])


def _moments(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by: dict[int, list] = {}
        for x in batch.column(0):
            v = np.frombuffer(x.as_buffer(), np.float64)
            by.setdefault(len(v), []).append(v / np.sqrt(v @ v))
        for d, rows in by.items():
            m = np.column_stack([np.ones(len(rows)), np.array(rows)])
            sums[d] = sums.get(d, 0) + m.T @ m
    for d, m in sums.items():
        at = np.arange(m.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(at.astype(np.int32)), pa.array(m.ravel())],
                                         ["dim", "cell", "x"])


def principal(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """For each vector length the leading principal directions, from sums over all vectors."""
    sums = (vectors.select("vec").mapInArrow(_moments, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
            .toArrow().to_pandas())
    out = {}
    for d, part in sums.groupby("dim"):
        m = np.zeros((d + 1) ** 2)
        m[part["cell"].to_numpy()] = part["x"].to_numpy()
        m = m.reshape(d + 1, d + 1)
        mean = m[0, 1:] / m[0, 0]
        _, directions = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[int(d)] = directions[:, ::-1][:, :count].copy()
    return out


def _cells(shared, eps: float, count: int):
    def run(batches):
        bases = shared.value
        for batch in batches:
            at = np.zeros((batch.num_rows, count))
            dims = np.zeros(batch.num_rows, np.int32)
            for i, x in enumerate(batch.column(3)):
                v = np.frombuffer(x.as_buffer(), np.float64)
                p = (v / np.sqrt(v @ v)) @ bases[len(v)]
                at[i, :len(p)] = p
                dims[i] = len(v)
            grid = np.floor(at / eps).astype(np.int32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(grid.ravel()), count).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), flat], ["id", "label", "weight", "vec", "dim", "cells"])
    return run


def _leaves(shared, size: int, count: int):
    """Cuts each sorted partition into intervals of one label and vector length."""
    def run(batches):
        from pyspark import TaskContext

        bases, part, chunk = shared.value, TaskContext.get().partitionId(), 0
        kind, ids, weights, vecs = None, [], [], []

        def leaf():
            m = np.array([np.frombuffer(x, np.float64) for x in vecs])
            p = np.zeros((len(m), count))
            base = bases[m.shape[1]]
            p[:, :base.shape[1]] = (m / np.sqrt((m * m).sum(1))[:, None]) @ base
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "label": pa.array([kind[0]], pa.int64()),
                 "dim": pa.array([kind[1]], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 "weights": pa.array([np.array(weights, np.int64).tobytes()], pa.binary()), "vecs": pa.array([b"".join(vecs)], pa.binary()),
                 "lo": pa.array([p.min(0).tolist()], pa.list_(pa.float64())), "hi": pa.array([p.max(0).tolist()], pa.list_(pa.float64()))})

        for batch in batches:
            for i, label, weight, vec, dim in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if ids and ((label, dim) != kind or len(ids) == size):
                    yield leaf()
                    chunk += 1
                    ids, weights, vecs = [], [], []
                kind = (label, dim)
                ids.append(i)
                weights.append(weight)
                vecs.append(vec)
        if ids:
            yield leaf()
    return run


def _compare(limit: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[f"vecs{s}"], np.float64).reshape(-1, row["dim"]) for s in "ij")
                ix, iy = (np.frombuffer(row[f"ids{s}"], np.int64) for s in "ij")
                wx, wy = (np.frombuffer(row[f"weights{s}"], np.int64) for s in "ij")
                own = row["i"] == row["j"]
                linked = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None, :] >= limit
                if own:
                    np.fill_diagonal(linked, False)
                rx, ry = linked.any(1), linked.any(0)
                if not rx.any():
                    continue
                part = linked[rx][:, ry]
                ca, cb = spread_ids(part, ix[rx], iy[ry])
                ids, links, comps = ix[rx], part @ wy[ry], ca
                if not own:
                    ids, links, comps = (np.concatenate(z) for z in ((ids, iy[ry]), (links, wx[rx] @ part), (comps, cb)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(comps)], ["id", "links", "comp"])
    return run


def interval_pairs(leaves: DataFrame, eps: float) -> DataFrame:
    """(i, j) of the leaves that may hold vectors within ``eps``: descends the levels of the sequence by pairs."""
    box = lambda f, agg: F.array(*[agg(F.col(f)[d]) for d in range(DIMENSIONS)]).alias(f)
    levels = [leaves.select("node", F.struct("label", "dim").alias("first"), F.struct("label", "dim").alias("last"), "lo", "hi")]
    nodes = leaves.count()
    while nodes > 1:
        below = levels[-1]
        levels.append(below.groupBy((F.floor(F.col("node") / FANOUT)).alias("node")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), box("lo", F.min), box("hi", F.max)))
        nodes = -(-nodes // FANOUT)
    gap = sum((F.pow(F.greatest(F.col("loj")[d] - F.col("hii")[d], F.col("loi")[d] - F.col("hij")[d], F.lit(0.0)), F.lit(2.0))
               for d in range(DIMENSIONS)), F.lit(0.0))
    near = (F.col("firsti") <= F.col("lastj")) & (F.col("firstj") <= F.col("lasti")) & (F.sqrt(gap) <= F.lit(eps))
    pairs = levels[-1].select(F.col("node").alias("i"), F.col("node").alias("j"))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.col("node").alias(f"c{s}"), F.floor(F.col("node") / FANOUT).alias(s),
                                      *[F.col(c).alias(f"{c}{s}") for c in ("first", "last", "lo", "hi")])
        pairs = pairs.join(side("i"), "i").join(side("j"), "j").where((F.col("ci") <= F.col("cj")) & near)
        pairs = cut(pairs.select(F.col("ci").alias("i"), F.col("cj").alias("j")), "intervals")
    return pairs


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 similarity: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    spark = vectors.sparkSession
    on_workers(spark)
    eps = math.sqrt(2 - 2 * similarity) + 1e-6
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("vec"))
    rows = cut(given.mapInArrow(_read_vectors, "id long, label long, sig binary, vec binary"), "vectors")
    able = rows.where("sig is not null and label is not null and id is not null")
    classes = able.groupBy("label", "sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    mine = classes.select(F.col("label").alias("clabel"), F.col("sig").alias("csig"), "rep", "weight")
    reps = able.dropDuplicates(["id", "label", "sig"]).join(
        mine, (F.col("id") == F.col("rep")) & (F.col("label") == F.col("clabel")) & (F.col("sig") == F.col("csig")))
    reps = cut(reps.select("id", "label", "weight", "vec"), "reps")
    bases = spark.sparkContext.broadcast(principal(reps, DIMENSIONS))
    placed = cut(reps.mapInArrow(_cells(bases, eps, DIMENSIONS), "id long, label long, weight long, vec binary, dim int, cells array<int>"), "cells")
    order = ["label", "dim", "cells", "id"]
    leaves = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("cells")
                 .mapInArrow(_leaves(bases, LEAF, DIMENSIONS), LEAVES), "leaves")
    per_part = {r["part"]: r["n"] for r in leaves.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}    # a row per task
    base, start = {}, 0
    for p in sorted(per_part):
        base[p], start = start, start + per_part[p]
    bases_of = spark.createDataFrame([(p, b) for p, b in base.items()], "of_part int, base long")
    leaves = cut(leaves.join(bases_of, F.col("part") == F.col("of_part")).withColumn("node", F.col("base") + F.col("chunk"))
                 .drop("of_part", "base", "part", "chunk"), "sequence")
    pairs = interval_pairs(leaves, eps)
    side = lambda s: leaves.select(F.col("node").alias(s), *([F.col("dim")] if s == "i" else []),
                                   *[F.col(c).alias(f"{c}{s}") for c in ("ids", "weights", "vecs")])
    found = cut(pairs.join(side("i"), "i").join(side("j"), "j").mapInArrow(_compare(similarity), "id long, links long, comp long"), "links")
    groups = components(found.select(F.col("id").alias("a"), F.col("comp").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = (classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
               .select(F.col("label").alias("clabel"), F.col("sig").alias("csig"),
                       (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("comp", "rep").alias("root")))
    out = rows.select("id", "label", "sig").join(
        classes, (F.col("label") == F.col("clabel")) & (F.col("sig") == F.col("csig")) & F.col("id").isNotNull(), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                      F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def op8_vector_join(spark, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
