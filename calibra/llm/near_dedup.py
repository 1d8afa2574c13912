"""MinHash near-duplicates from bottom-k sketches of one hash function (operator 4).

1. Each text becomes its set of word shingles (64-bit hashes) and the ``k``
   smallest of them, its sketch. Texts with equal sets collapse to the
   smallest id.
2. Inverted lists: every retained value lists its texts. Two sets with the
   wanted similarity share at least ``s`` of their ``k`` retained values
   (a binomial tail below 1e-7), so with values ordered from rare to frequent
   each text needs only its ``k - s + t`` rarest ones in the lists, and two
   linked texts meet in ``t`` of them. Frequent shingles drop out of every
   text that also has rare ones, without a cap on the lists.
3. Each list pairs its members with its smallest one only; pairs that meet
   ``t`` times are overlaps. The k smallest values of the union of two sketches
   estimate their similarity, those far below the limit go, the rest are
   confirmed on the full shingle sets. So a group of m copies costs m pairs
   and not m * m.
4. What the stars leave open is settled in two ways. Texts tied together by
   overlaps are a family; a family that the links leave in several pieces is
   dealt into blocks of bounded size, and blocks that hold different pieces are
   compared as wholes (a matrix product counts all intersections, exactly; a
   pair of blocks returns at most a row per text). Lists that meet in several
   families give pairs between families, which pass the estimate and the
   confirmation as before.
5. Components of the confirmed links give the result.

Null or empty texts have no shingles and link with nothing; a null id is never
linked (component null, kept). Rows that share an id are one node. Equal texts
are one group whatever their number. Other columns are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import bounded_batches, components, cut, free_name, id_and_body, on_workers, spread_ids, table

TAIL = 1e-7      # chance that a pair at the limit shares fewer than the required values
SHARED = 3       # values that a pair must share in the lists
BITMAP_BITS = 24  # 2 MB, whatever the number of ids
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 18, 1024     # size of a block of a family


def required_overlap(k: int, similarity: float) -> int:
    """Largest s with P(Binomial(k, similarity) < s) <= TAIL."""
    total, s = 0.0, 0
    while s < k:
        total += math.comb(k, s) * similarity ** s * (1 - similarity) ** (k - s)
        if total > TAIL:
            break
        s += 1
    return max(s, 1)


def shingle_sets(ids, col, width: int):
    """Yields (row index, sorted distinct shingle hashes) for every row of an Arrow text column."""
    b, offs = tb.text_bytes(col)
    for i, j in tb.doc_groups(offs, tb.SEGMENT // 2):
        _, starts, _, h, first = tb.words(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        rolled = h.copy()
        for step in range(1, width):
            rolled = tb.mix(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if len(rolled) > 1 else rolled[:0]
        for r in range(j - i):
            lo, hi = int(first[r]), int(first[r + 1])
            if hi - lo >= width:
                yield i + r, np.unique(rolled[lo:hi - width + 1].view(np.int64))
            elif hi > lo:
                whole = np.array([hi - lo], dtype=np.uint64)
                for x in h[lo:hi]:
                    whole = tb.mix(whole * np.uint64(0x9E3779B97F4A7C15) + x)
                yield i + r, whole.view(np.int64)
            else:
                yield i + r, np.zeros(0, np.int64)


def _sketches(width: int, k: int):
    def run(batches):
        import xxhash

        for batch in batches:
            n, sig, parts = [], [], []
            for _, s in shingle_sets(batch.column(0), batch.column(1), width):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                parts.append(s[:k])
            sizes = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["id", "n", "sig", "sketch"])
    return run


def _positions(batches):
    """(word, bit) of each id's place in the bitmap of :func:`bitmap`."""
    for batch in batches:
        at = _place(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])


def _place(ids: np.ndarray) -> np.ndarray:
    return (tb.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every id of ``ids`` has its bit set."""
    words = (ids.mapInArrow(_positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _listed(shared):
    """Rows whose id has its bit set (all wanted ones, and few others)."""
    def run(batches):
        bits = shared.value
        for batch in batches:
            at = _place(batch.column(0).fill_null(0).to_numpy())
            yield batch.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
    return run


def _confirm(width: int, percent: int):
    def distinct_sets(ids, texts):
        first: dict = {}
        for i, x in enumerate(ids):
            first.setdefault(x, i)
        rows = list(first.values())
        sets = [s for _, s in shingle_sets(None, texts.take(pa.array(rows)), width)]
        return {x: sets[i] for i, x in enumerate(first)}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (list(zip(batch.column(c).to_pylist(), batch.column(c + 2).to_pylist())) for c in (0, 1))
            left, right = distinct_sets(a, batch.column(2)), distinct_sets(b, batch.column(3))
            keep = []
            for p, q in zip(a, b):
                x, y = left[p], right[q]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs whose union sketch does not rule the similarity out."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    p = p.withColumn("hits", F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))))
    lowest = required_overlap(k, similarity) / k - 1e-9
    size = F.size("u").cast("double")
    whole = (F.col("na") <= F.size("sa")) & (F.col("nb") <= F.size("sb")) & (F.size(F.array_union("sa", "sb")) <= k)
    bound = F.when(whole, F.lit(similarity - 1e-9)).otherwise(F.lit(lowest))
    return p.where(F.col("hits") >= bound * size).select("a", "b")


def _confirmed(pairs: DataFrame, body: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose full sets are similar enough. The texts of the pairs are found where they lie with a
    bitmap of the wanted ids, whose size is fixed; the joins then drop what it lets through by chance."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    shared = pairs.sparkSession.sparkContext.broadcast(bitmap(wanted))
    texts = body.mapInArrow(_listed(shared), "id long, body binary")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("body").alias(f"t{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return p.mapInArrow(_confirm(width, round(100 * similarity)), "a long, b long").distinct()


def _blocks_of_sets(width: int):
    """One row per block of a family: ids, set sizes and the sets themselves, as bytes."""
    def run(block: pa.Table) -> pa.Table:
        ids = block.column("id").to_numpy()
        sets = [x for _, x in shingle_sets(None, block.column("body"), width)]
        return pa.table({"grp": block.column("grp").slice(0, 1), "blk": block.column("blk").slice(0, 1),
                         "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                         "sizes": pa.array([np.array([len(x) for x in sets], np.int64).tobytes()], pa.binary()),
                         "members": pa.array([np.concatenate(sets).tobytes()], pa.binary())})
    return run


def intersections(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks (sets one after the other, with their sizes)."""
    shared = np.intersect1d(x, y)
    sides = []
    for values, sizes in ((x, nx), (y, ny)):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        row, col = np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]
        by = np.argsort(col, kind="stable")
        sides.append((row[by], col[by]))
    out = np.zeros((len(nx), len(ny)), np.float32)
    for start in range(0, len(shared), step):
        parts = []
        for (row, col), count in zip(sides, (len(nx), len(ny))):
            lo, hi = np.searchsorted(col, [start, start + step])
            m = np.zeros((count, min(step, len(shared) - start)), np.float32)
            m[row[lo:hi], col[lo:hi] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _compare_blocks(percent: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                (ix, nx, x), (iy, ny, y) = ([np.frombuffer(row[f"{c}{s}"], np.int64) for c in ("ids", "sizes", "members")] for s in "ij")
                both = intersections(x, nx, y, ny)
                linked = (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (ix[:, None] != iy[None, :])
                a, b = linked.any(1), linked.any(0)
                if a.any():
                    ca, cb = spread_ids(linked[a][:, b], ix[a], iy[b])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ix[a], iy[b]])), pa.array(np.concatenate([ca, cb]))], ["a", "b"])
    return run


def _family_links(families: DataFrame, body: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between the pieces (``comp``) of each family (``grp``), from rows (id, n, grp, comp)."""
    pieces = families.groupBy("grp", "comp").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"))
    open_ones = pieces.groupBy("grp").agg(F.count(F.lit(1)).alias("pieces"), F.max_by(F.struct("comp", "w", "m"), "w").alias("main"),
                                          F.sum("w").alias("w"), F.sum("m").alias("m")).where("pieces > 1")
    count = lambda w, m: F.ceil(F.greatest(w / F.lit(BLOCK_SHINGLES), m / F.lit(BLOCK_TEXTS))).cast("long")
    open_ones = cut(open_ones.select("grp", F.col("main.comp").alias("main"), count(F.col("w") - F.col("main.w"), F.col("m") - F.col("main.m")).alias("rest"),
                                     count(F.col("main.w"), F.col("main.m")).alias("mains")), "families")
    dealt = families.join(open_ones, "grp").withColumn("blk", F.when(
        F.col("comp") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("id"), "mains")).otherwise(F.pmod(F.xxhash64("id"), "rest")))
    dealt = cut(dealt.select("id", "grp", "blk"), "dealt")
    shared = body.sparkSession.sparkContext.broadcast(bitmap(dealt.select("id")))
    texts = body.mapInArrow(_listed(shared), "id long, body binary").join(dealt, "id")
    blocks = cut(texts.groupBy("grp", "blk").applyInArrow(_blocks_of_sets(width), "grp long, blk long, ids binary, sizes binary, members binary"), "blocks")
    last = F.col("rest") + F.col("mains") - 1
    pairs = (open_ones.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)))
             .withColumn("j", F.explode(F.sequence(F.col("i"), last))).select("grp", "i", "j"))
    side = lambda s: blocks.select("grp", F.col("blk").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("ids", "sizes", "members")])
    return pairs.join(side("i"), ["grp", "i"]).join(side("j"), ["grp", "j"]).mapInArrow(_compare_blocks(round(100 * similarity)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    similarity: float = 0.8, k: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept (see the module)."""
    on_workers(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    body = id_and_body(docs, id_col, text_col)
    rows = cut(body.mapInArrow(_sketches(shingle_words, k), "id long, n long, sig binary, sketch array<long>"), "sketches")
    classes = cut(rows.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rep")), "classes")
    reps = (rows.where("n > 0").join(classes.select(F.col("sig").alias("class"), "rep"),
                                     (F.col("id") == F.col("rep")) & (F.col("sig") == F.col("class"))).select("id", "n", "sketch"))
    reps = cut(reps, "reps")

    need = required_overlap(k, similarity)
    entries = reps.select("id", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    lists = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("lead")).where("df > 1")
    s = F.when(F.ceil(F.col("n") / F.lit(similarity)) <= k, F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9))).otherwise(
        F.least(F.col("m"), F.lit(need)))
    by_text = Window.partitionBy("id")
    rare = (entries.join(lists, "v").withColumn("s", s).withColumn("t", F.least(F.lit(SHARED), F.col("s")))
            .withColumn("alone", F.col("m") - F.count(F.lit(1)).over(by_text))
            .withColumn("rank", F.row_number().over(by_text.orderBy("df", "v")))
            .where("alone + rank <= m - s + t").withColumn("seen", F.count(F.lit(1)).over(by_text)).where("seen >= t"))
    index = cut(rare.select("id", "n", "t", "v", "lead"), "lists")

    def links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("t")).where("c >= t").select("a", "b"), "overlaps")
        likely = cut(_estimated(met, reps, k, similarity), "pairs")
        return met, cut(_confirmed(likely, body, shingle_words, similarity), "links")

    met, first = links(index.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), "t"))
    groups, family = components(first), components(met)
    of = lambda df, name, out: df.select(F.col("node").alias("id"), F.col(name).alias(out))
    families = cut(of(family, "comp", "grp").join(of(groups, "comp", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
                   .join(reps.select("id", "n"), "id"), "family")
    inside = _family_links(families, body, shingle_words, similarity)

    grouped = (index.join(of(family, "comp", "grp"), "id", "left").withColumn("grp", F.coalesce("grp", "id")).select("v", "grp", "id", "n", "t"))
    mixed = grouped.groupBy("v").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("v")
    grouped = cut(grouped.join(mixed, "v", "left_semi"), "mixed")
    held = grouped.select("v", "grp").distinct()
    across = held.withColumnRenamed("grp", "ga").join(held.withColumnRenamed("grp", "gb"), "v").where("ga < gb")
    side = lambda x: grouped.select("v", F.col("grp").alias(f"g{x}"), F.col("id").alias(x), F.col("n").alias(f"n{x}"),
                                    F.col("t").alias(f"t{x}"))
    alike = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity - 1e-9)
    pairs = across.join(side("a"), ["v", "ga"]).join(side("b"), ["v", "gb"]).where(alike)
    _, outside = links(pairs.select("a", "b", F.least("ta", "tb").alias("t")))

    merged = components(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(inside).union(outside))
    classes = (classes.join(merged, classes.rep == merged.node, "left")
               .select(F.col("sig").alias("class"), F.coalesce("comp", "rep").alias("root")))
    out = rows.join(classes, (F.col("sig") == F.col("class")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"),
                      F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group.

    Rows that share an id are one document: it stays while one of them does, with
    one row for each of its different texts (null is a text of its own). Rows with a
    null id stay. Other columns may have any name.
    """
    name, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    ours = free_name(docs, "kept_id")
    ids = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(ours)).distinct()
    held = docs.where(F.col(name).isNotNull()).join(ids, F.col(name) == F.col(ours), "left_semi").dropDuplicates([name, text])
    return held.unionByName(docs.where(F.col(name).isNull()))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, similarity=0.8)
