"""Vector code compression by Lloyd rounds over partition-local cover trees (operator 11).

Components become integers, vectors are cut into ``PARTS`` equal parts, and each
part position has a codebook that starts as that part of the first vectors. A
round assigns every part to its nearest entry and moves entries to the rounded
means. All of it is integer arithmetic, so results do not depend on the order of
rows or tasks.

Each task cuts its vectors into chunks and builds, once, a cover tree for each
part position of a chunk: a node is a ball around one of its points; its
children are balls of half the radius around points more than that apart, the
first around the node's own point. Points are kept in the order of the tree, so
a subtree is a range, and its sum is a difference of cumulative sums. The trees
are a written table that all rounds read. A round goes down the trees with the
entries that may be nearest to some point of a node: an entry goes when it is
farther from the centre than the nearest one by more than twice the radius. With
one entry left the whole subtree is assigned; only ambiguous nodes go on to their
children, and at the bottom points are compared with what entries remain. Balls
of radius zero (copies) are compared once.

The driver sees sums by part, entry and component: one number for each component
of the codebooks.

Rows whose vector is null or holds null or non-finite components are dropped.
Null ids come last in the order of the first vectors; rows that share an id are
ordered by their vector. With fewer vectors than ``ENTRIES`` the codebook has that
many entries. Vectors of another length have codebooks of their own, and a length
that is not a multiple of ``PARTS`` is filled up with zeros. Components beyond
what 64-bit distances hold (about 2**19 at 64 components) are held at that bound.
No rows: no result.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import cut, on_workers, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 4096         # vectors of one set of trees
LEAF = 16            # points that a node keeps without children
SALTS = 16
ROWS = "id long, label string, dim int, x binary"
TREES = ("dim int, n int, ids array<long>, labels array<string>, points binary, tree_order binary, node_start binary, node_end binary,"
         " node_reach binary, node_child binary, node_children binary")
SUMS = "dim int, part int, entry int, n long, at int, total long"
CODES = "vec_id long, label string, dim int, code string, error long"


def bound(dim: int) -> int:
    """Largest magnitude with which a squared distance over ``dim`` components stays below 2**62."""
    return min(math.isqrt((1 << 60) // max(dim, 1)), (1 << 31) - 1)


def integers(values: np.ndarray, dim: int, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -bound(dim), bound(dim)).astype(np.int32)


def _read(scale: int):
    """Kept rows as integer vectors, row by row only where a batch holds nulls or several lengths."""
    def run(batches):
        for batch in batches:
            col = batch.column(2)
            flat, sizes = col.flatten(), col.value_lengths()
            good = np.zeros(batch.num_rows, bool)
            length = np.array([x or 0 for x in sizes.to_pylist()], np.int64)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)     # null components read as NaN
            stop = np.concatenate([[0], np.cumsum(length)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[stop[1:]] == bad[stop[:-1]]) & col.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(length[good]).tolist():
                rows = np.flatnonzero(good & (length == dim))
                x = integers(values[stop[rows][:, None] + np.arange(dim)], dim, scale)
                raw = x.astype("<i4").tobytes()
                step = 4 * dim
                keep = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(np.full(len(rows), dim, np.int32)),
                     pa.array([raw[i * step:(i + 1) * step] for i in range(len(rows))], pa.binary())], ["id", "label", "dim", "x"])
    return run


def split_parts(x: np.ndarray) -> np.ndarray:
    """Vectors (n, dim) as points (PARTS, n, width), filled up with zeros."""
    n, dim = x.shape
    width = max(-(-dim // PARTS), 1)
    out = np.zeros((n, PARTS * width), np.int64)
    out[:, :dim] = x
    return np.ascontiguousarray(out.reshape(n, PARTS, width).transpose(1, 0, 2))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k] - y[:, k]
        out += d * d
    return out


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of ranges one after the other."""
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)


def grow(points: np.ndarray) -> dict[str, np.ndarray]:
    """Cover trees of the part positions of a chunk, level by level; nodes are ranges of ``order``."""
    parts, n, width = points.shape
    flat = points.reshape(parts * n, width)
    order = np.arange(parts * n)
    start = np.arange(parts) * n
    end = start + n
    reach = np.maximum.reduceat(squared(flat, np.repeat(flat[start], n, axis=0)), start)
    levels = [[start, end, reach, np.zeros(parts, np.int64), np.zeros(parts, np.int64)]]
    made = parts
    while True:
        start, end, reach, child, children = levels[-1]
        open_ = np.flatnonzero((reach > 0) & (end - start > LEAF))
        if not len(open_):
            break
        size = (end - start)[open_]
        at = runs(start[open_], size)                   # positions in the order
        node = np.repeat(np.arange(len(open_)), size)
        near = reach[open_] // 4                        # squared radius of the children
        of = np.empty(len(at), np.int64)
        far = np.empty(len(at), np.int64)
        todo, made_here = np.arange(len(at)), np.zeros(len(open_), np.int64)
        while len(todo):
            mine = node[todo]
            first = np.ones(len(todo), bool)
            first[1:] = mine[1:] != mine[:-1]
            centre = todo[first][np.cumsum(first) - 1]   # the first point of the node that no child holds yet
            d = squared(flat[order[at[todo]]], flat[order[at[centre]]])
            held = d <= near[mine]
            of[todo[held]] = made_here[mine[held]]
            far[todo[held]] = d[held]
            made_here[mine[first]] += 1
            todo = todo[~held]
        move = np.lexsort((of, node))
        order[at] = order[at[move]]
        key, far = (node * (int(made_here.max()) + 1) + of)[move], far[move]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(key)))
        child[open_] = made + np.cumsum(made_here) - made_here
        children[open_] = made_here
        made += len(begin)
        levels.append([at[begin], at[begin] + size, np.maximum.reduceat(far, begin), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)])
    names = ("node_start", "node_end", "node_reach", "node_child", "node_children")
    return {"tree_order": order, **{k: np.concatenate(c) for k, c in zip(names, zip(*levels))}}


def assign(points: np.ndarray, tree: dict[str, np.ndarray], books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the order that belong to one entry each: start, end, entry (ties to the lower index)."""
    parts, n, width = points.shape
    flat, entries = points.reshape(parts * n, width), books.shape[1]
    order, found = tree["tree_order"], []
    node = np.repeat(np.arange(parts), entries)          # pairs of a node and an entry, sorted by both
    entry = np.tile(np.arange(entries), parts)
    while len(node):
        start = tree["node_start"][node]
        d = squared(flat[order[start]], books[start // n, entry])
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        many = np.diff(np.append(head, len(node)))
        best = np.minimum.reduceat(d, head)
        radius = np.sqrt(tree["node_reach"][node[head]].astype(np.float64))
        limit = (np.sqrt(best.astype(np.float64)) + 2 * radius) * (1 + 1e-12) + 1e-9
        copies = radius == 0
        keep = np.where(np.repeat(copies, many), d == np.repeat(best, many), np.sqrt(d.astype(np.float64)) <= np.repeat(limit, many))
        left = np.add.reduceat(keep.astype(np.int64), head)
        sure = copies | (left == 1)
        first = np.flatnonzero(keep)[np.cumsum(left) - left]     # the lowest entry kept of each node
        own = node[head]
        found.append((tree["node_start"][own[sure]], tree["node_end"][own[sure]], entry[first[sure]]))
        node, entry = node[keep & ~np.repeat(sure, many)], entry[keep & ~np.repeat(sure, many)]
        if not len(node):
            break
        below = tree["node_children"][node]
        leaf = below == 0
        found.append(_leaves(flat, order, n, books, tree, node[leaf], entry[leaf]))
        node, entry, below = node[~leaf], entry[~leaf], below[~leaf]
        child, entry = runs(tree["node_child"][node], below), np.repeat(entry, below)
        sort = np.lexsort((entry, child))
        node, entry = child[sort], entry[sort]
    return tuple(np.concatenate(c) for c in zip(*found))


def _leaves(flat, order, n, books, tree, node, entry):
    """Each point of the ambiguous leaves with the entries that remain there."""
    size = tree["node_end"][node] - tree["node_start"][node]
    at, entry = runs(tree["node_start"][node], size), np.repeat(entry, size)
    sort = np.lexsort((entry, at))
    at, entry = at[sort], entry[sort]
    if not len(at):
        return at, at, entry
    d = squared(flat[order[at]], books[at // n, entry])
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    best = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(at))))
    hit = np.flatnonzero(d == best)
    hit = hit[np.append(True, at[hit][1:] != at[hit][:-1])]
    return at[hit], at[hit] + 1, entry[hit]


def _grow(batches):
    waiting: dict[int, list] = {}
    for batch in batches:
        ids, labels, dims, raw = (batch.column(c).to_pylist() for c in range(4))
        for row in zip(ids, labels, dims, raw):
            held = waiting.setdefault(row[2], [])
            held.append(row)
            if len(held) == CHUNK:
                yield _chunk(waiting.pop(row[2]))
    for held in waiting.values():
        yield _chunk(held)


def _chunk(rows):
    dim = rows[0][2]
    x = np.frombuffer(b"".join(r[3] for r in rows), "<i4").reshape(len(rows), dim)
    tree = grow(split_parts(x))
    small = lambda k: tree[k].astype("<i4").tobytes()
    return pa.RecordBatch.from_pydict(
        {"dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
         "labels": pa.array([[r[1] for r in rows]], pa.list_(pa.string())), "points": pa.array([x.tobytes()], pa.binary()),
         **{k: pa.array([small(k)], pa.binary()) for k in ("tree_order", "node_start", "node_end")},
         "node_reach": pa.array([tree["node_reach"].astype("<i8").tobytes()], pa.binary()),
         **{k: pa.array([small(k)], pa.binary()) for k in ("node_child", "node_children")}})


def _trees(batch):
    for row in batch.to_pylist():
        x = np.frombuffer(row["points"], "<i4").reshape(row["n"], row["dim"])
        tree = {k: np.frombuffer(row[k], "<i8" if k == "node_reach" else "<i4").astype(np.int64)
                for k in ("tree_order", "node_start", "node_end", "node_reach", "node_child", "node_children")}
        yield row, split_parts(x), tree


def _sums(shared):
    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for row, points, tree in _trees(batch):
                books = shared.value[row["dim"]]
                n = points.shape[1]
                start, end, entry = assign(points, tree, books)
                before = np.concatenate([np.zeros((1, points.shape[2]), np.int64), np.cumsum(points.reshape(-1, points.shape[2])[tree["tree_order"]], axis=0)])
                count, total = sums.setdefault(row["dim"], [np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)])
                np.add.at(count, (start // n, entry), end - start)
                np.add.at(total, (start // n, entry), before[end] - before[start])
        for dim, (count, total) in sums.items():
            part, entry, at = (i.ravel() for i in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, dim, np.int32)), *(pa.array(i.astype(np.int32)) for i in (part, entry)),
                 pa.array(np.repeat(count.ravel(), total.shape[2])), pa.array(at.astype(np.int32)), pa.array(total.ravel())],
                ["dim", "part", "entry", "n", "at", "total"])
    return run


def _codes(shared):
    def run(batches):
        for batch in batches:
            for row, points, tree in _trees(batch):
                books, n = shared.value[row["dim"]], points.shape[1]
                start, end, entry = assign(points, tree, books)
                sort = np.argsort(start)
                of = np.empty(PARTS * n, np.int64)
                of[tree["tree_order"]] = np.repeat(entry[sort], (end - start)[sort])
                of = of.reshape(PARTS, n)
                error = sum(squared(points[p], books[p][of[p]]) for p in range(PARTS))
                text = np.ascontiguousarray(of.T.astype(np.uint8)).tobytes().hex()
                ids, labels = pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(np.full(n, row["dim"], np.int32)),
                     pa.array([text[2 * PARTS * i:2 * PARTS * (i + 1)] for i in range(n)]), pa.array(error)], ["vec_id", "label", "dim", "code", "error"])
    return run


def first_books(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """For each vector length the parts of its first vectors (a bounded number each)."""
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "x"))
    books: dict[int, list] = {}
    for r in rows.select("dim", "id", "x").withColumn("nth", nth).where(F.col("nth") <= entries).orderBy("dim", "nth").collect():
        books.setdefault(r["dim"], []).append(np.frombuffer(r["x"], "<i4"))
    return {dim: split_parts(np.array(x).reshape(len(x), dim)) for dim, x in books.items()}


def moved(books: dict[int, np.ndarray], sums: DataFrame) -> dict[int, np.ndarray]:
    """Entries at the rounded-down means of their parts; unused ones stay."""
    out = {dim: b.copy() for dim, b in books.items()}
    total = sums.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for r in total.where("n > 0").collect():
        out[r["dim"]][r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Codes and errors of every kept vector, and the codebooks (part, entry, component) by vector length."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    spark = vectors.sparkSession
    on_workers(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                           F.col(vec_col).cast("array<double>").alias("x"))
    rows = cut(given.mapInArrow(_read(scale), ROWS), "integers")
    books = first_books(rows, entries)
    trees = cut(rows.mapInArrow(_grow, TREES), "trees")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        books = moved(books, trees.drop("ids", "labels").mapInArrow(_sums(shared), SUMS))
        shared.unpersist()
    return trees.mapInArrow(_codes(spark.sparkContext.broadcast(books)), CODES), books


def books_digest(books: np.ndarray, dim: int) -> str:
    """Hash of all components by part, entry and place (without the zeros that fill up a length)."""
    width, numbers = books.shape[2], []
    for part in range(PARTS):
        own = books[part, :, :max(0, min(width, dim - part * width))]
        numbers.extend(map(str, own.ravel().tolist()))
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``label_error``: the sum of errors over equal labels, nulls together (a hot label is dealt to ``SALTS`` tasks)."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))
    sums = codes.groupBy(key.alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
                                              .cast("long").alias("label_error"))
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    return codes.join(sums, (key == F.col("of")) & (salt == F.col("of_salt"))).drop("of", "of_salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    digests = F.lit(None).cast("string")
    for dim, b in books.items():
        digests = F.when(F.col("dim") == dim, F.lit(books_digest(b, dim))).otherwise(digests)
    out = with_label_error(cut(codes, "codes"))
    return out.select("vec_id", "code", "error", "label_error", digests.alias("codebooks_sha256"))
