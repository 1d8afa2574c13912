"""Token alignment across two tokenizers by interval coalescing (operator 12).

Both tokenizers cut the same bytes. The A and B tokens of many documents are
laid on one axis of byte offsets and sorted by start (one lexsort); where a
start reaches the running maximum of the ends before it (maximum.accumulate),
a group ends, since there an A and a B token end together. Inside groups each
A token meets the B tokens it overlaps, found as a range by binary search, so
the pairs are at most as many as the tokens. Those whose ranges end together are
the links.

``align`` writes one row for each document, with its ids, the A and B tokens of
every group and its links, and one row for each block of about ``BLOCK`` bytes
of text with the block's distinct id pairs and their numbers; a link is an index
into them, in two bytes where they suffice. A document's row also has the hash of
its groups in writing. The corpus counts of pairs are a grouped sum of the block rows, so an
id pair costs one row a block, however frequent it is. Counts go back to blocks
by a join on the pair (salted by block) and to the documents by block; a group of
that join is one block.

A null or empty text, or one whose bytes the ids of A or of B do not give back,
has no tokens: zeros and an empty digest. Null ids and rows that share an id are
aligned like any other. A very long text is a block of its own.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import segments as sg
from calibra.llm import textbytes as tb
from calibra.llm.common import cut, id_and_body, on_workers, table

BLOCK = 2 << 20          # bytes of text whose pairs are counted together
GROUP = 1 << 18          # bytes of text aligned at once
SALTS = 8
ALIGNED = ("block long, at int, doc_id long, n_a long, n_b long, n_groups long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, n_links long,"
           " links binary, groups_sha256 string, pair_a array<int>, pair_b array<int>, pair_n array<long>")
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]
SCORES = "block long, at int, n_best long, count_sum long"


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Group of every token, A's before B's, of two gapless cuts of one axis given by their ends."""
    end = np.concatenate([a_end, b_end])
    start = np.concatenate([[0], a_end[:-1], [0], b_end[:-1]]) if len(a_end) and len(b_end) else np.zeros(0, np.int64)
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of A and B tokens that share bytes."""
    a_start = np.concatenate([[0], a_end[:-1]])[:len(a_end)]
    b_start = np.concatenate([[0], b_end[:-1]])[:len(b_end)]
    low = np.searchsorted(b_end, a_start, side="right")
    many = np.searchsorted(b_start, a_end, side="left") - low
    return np.repeat(np.arange(len(a_end)), many), sg.take_runs(np.arange(len(b_end)), low, many)


def _tokens(coder, slot, stays):
    sizes = coder.sizes[slot] * stays
    return sg.take_runs(coder.flat, coder.begin[slot], sizes), np.concatenate([[0], np.cumsum(sizes)])


def align_rows(a: sg.Coder, b: sg.Coder, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Aligned tokens of some texts: per document how many there are, and everything one after the other."""
    given = offs[1:] > offs[:-1]
    at = offs[:-1][given]
    spaced = np.insert(data, at, 0x20)
    moved = offs + np.concatenate([[0], np.cumsum(given)])
    starts, ends, first = sg.bounds(spaced, moved, a.whole or b.whole)
    hashes = tb.run_hashes(spaced, starts, ends)
    sa, sb = a.find(spaced, starts, ends, hashes), b.find(spaced, starts, ends, hashes)
    wrong = np.concatenate([[0], np.cumsum(~(a.good[sa] & b.good[sb]))])
    whole = wrong[first[1:]] == wrong[first[:-1]]
    stays = np.repeat(whole, np.diff(first)).astype(np.int64)
    a_ids, a_stop = _tokens(a, sa, stays)
    b_ids, b_stop = _tokens(b, sb, stays)
    a_end, b_end = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    group = coalesce(a_end, b_end)
    groups = int(group.max()) + 1 if len(group) else 0
    a_sizes, b_sizes = np.bincount(group[:len(a_ids)], minlength=groups), np.bincount(group[len(a_ids):], minlength=groups)
    left, right = overlaps(a_end, b_end)
    ends_too = a_end[left] == b_end[right]
    left, right = left[ends_too], right[ends_too]
    a_first, b_first = a_stop[first], b_stop[first]
    group_first = np.searchsorted(np.cumsum(a_sizes), a_first, side="right")
    return {"a_ids": a_ids, "b_ids": b_ids, "a_sizes": a_sizes, "b_sizes": b_sizes, "link_a": a_ids[left], "link_b": b_ids[right],
            "a_first": a_first, "b_first": b_first, "group_first": group_first, "link_first": np.searchsorted(left, a_first)}


_TEXTS: dict = {}


def _texts(size: int) -> list[list[bytes]]:
    """Every id below ``size`` as text with what may stand behind it."""
    if _TEXTS.get("size", 0) < size:
        _TEXTS.update(size=size, of=[[b"%d%s" % (i, mark) for i in range(size)] for mark in (b",", b"|", b";")])
    return _TEXTS["of"]


def fingerprints(r: dict[str, np.ndarray]) -> list[str]:
    """SHA-256 of each document's groups in writing: ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    marks = _texts(int(max(r["a_ids"].max(initial=0), r["b_ids"].max(initial=0))) + 1)
    size = r["a_sizes"] + r["b_sizes"]
    ends = np.cumsum(size)
    is_a = np.zeros(len(r["a_ids"]) + len(r["b_ids"]), bool)
    is_a[np.arange(len(r["a_ids"])) + np.repeat(np.cumsum(r["b_sizes"]) - r["b_sizes"], r["a_sizes"])] = True
    ids, mark = np.empty(len(is_a), np.int32), np.zeros(len(is_a), np.int8)
    ids[is_a], ids[~is_a] = r["a_ids"], r["b_ids"]
    mark[ends - r["b_sizes"] - 1], mark[ends - 1] = 1, 2
    first = (r["a_first"] + r["b_first"]).tolist()
    out = []
    for s, e in zip(first[:-1], first[1:]):
        written = b"".join([marks[m][x] for m, x in zip(mark[s:e].tolist(), ids[s:e].tolist())])[:-1]
        out.append(hashlib.sha256(written).hexdigest() if e > s else "")
    return out


def _lists(first: np.ndarray, values: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def _indexes(first: np.ndarray, links: np.ndarray):
    raw, at = links.tobytes(), (first * links.itemsize).tolist()
    return pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:])], pa.binary())


def _align(shared):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        a, b = sg.byte_level(shared.value[0], True), sg.piece_model(shared.value[1])
        block, at, held, keys, numbers = TaskContext.get().partitionId() << 32, 0, 0, [], []
        waiting: list[tuple] = []

        def finish():
            pairs, back = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n, seen = np.bincount(back, minlength=len(pairs)), 0
            back = back.astype("<u2" if len(pairs) < 1 << 16 else "<u4")
            for ids, place, r in waiting:
                links = back[seen:seen + len(r["link_a"])]
                seen += len(links)
                size = len(ids)
                none = pa.nulls(size, pa.list_(pa.int32()))
                many = [pa.array(np.diff(r[c])) for c in ("a_first", "b_first", "group_first")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block)), pa.array(np.arange(place, place + size, dtype=np.int32)), ids, *many,
                     _lists(r["a_first"], r["a_ids"]), _lists(r["b_first"], r["b_ids"]), _lists(r["group_first"], r["a_sizes"]),
                     _lists(r["group_first"], r["b_sizes"]), pa.array(np.diff(r["link_first"])), _indexes(r["link_first"], links), pa.array(r["sha"], pa.string()), none, none, pa.nulls(size, pa.list_(pa.int64()))], NAMES)
            if len(pairs):
                one = np.array([0, len(pairs)])
                none, null = pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([-1], pa.int32()), null, null, null, null, none, none, none, none,
                     null, pa.nulls(1, pa.binary()), pa.nulls(1, pa.string()), _lists(one, pairs >> 32), _lists(one, pairs & 0xFFFFFFFF),
                     pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), pa.array(n.astype(np.int64)))], NAMES)

        for batch in batches:
            data, offs = tb.text_bytes(batch.column(1))
            for i, j in tb.doc_groups(offs, GROUP):
                size = int(offs[j] - offs[i])
                if waiting and held + size > BLOCK:
                    yield from finish()
                    block, at, held, keys, waiting = block + 1, 0, 0, [], []
                r = align_rows(a, b, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                r["sha"] = fingerprints(r)
                keys.append((r["link_a"].astype(np.int64) << 32) | r["link_b"])
                waiting.append((batch.column(0).slice(i, j - i), at, r))
                at, held = at + j - i, held + size
        if waiting:
            yield from finish()
    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written alignment of every document (``at`` >= 0) and the pairs of every block (``at`` -1)."""
    spark = docs.sparkSession
    on_workers(spark)
    with open(a_path, encoding="utf-8") as fa, open(b_path, "rb") as fb:
        shared = spark.sparkContext.broadcast((fa.read(), fb.read()))
    return cut(id_and_body(docs, id_col, text_col).mapInArrow(_align(shared), ALIGNED), "aligned", codec="zstd")


def block_pairs(aligned: DataFrame) -> DataFrame:
    """block, slot, a, b, n: the distinct id pairs of every block."""
    pairs = aligned.where("at < 0").select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("slot", "p"))
    return pairs.select("block", "slot", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count over the corpus, and whether it is the highest of its b."""
    counts = cut(block_pairs(aligned).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy(F.col("b").alias("of_b")).agg(F.max("count").alias("top"))
    return counts.join(highest, F.col("b") == F.col("of_b")).select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _score(left, right):
    """Sums over each document's links of one block."""
    slots, counts, best = (right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("slot", "count", "best"))
    size = int(slots.max()) + 1 if len(slots) else 0
    of, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    of[slots], top[slots] = counts, best
    many, raw = left.column("n_links").combine_chunks().to_numpy(zero_copy_only=False), left.column("links").to_pylist()
    links = np.frombuffer(b"".join(raw), "<u2" if len(raw[0]) == 2 * many[0] else "<u4")
    stop = np.concatenate([[0], np.cumsum(many)])
    sums = [np.concatenate([[0], np.cumsum(x[links])]) for x in (top, of)]
    return pa.table([left.column("block"), left.column("at"), *(pa.array(s[stop[1:]] - s[stop[:-1]]) for s in sums)],
                    names=["block", "at", "n_best", "count_sum"])


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of every document with links, by block and place."""
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = block_pairs(aligned).select("block", "slot", F.col("a").alias("of_a"), F.col("b").alias("of_b"), (F.xxhash64("block") % SALTS).alias("own"))
    found = pairs.join(salted, (F.col("of_a") == F.col("a")) & (F.col("of_b") == F.col("b")) & (F.abs("own") == F.col("salt")))
    docs = aligned.where("at >= 0 and n_links > 0").select("block", "at", "n_links", "links")
    found = found.select(F.col("block").alias("in_block"), "slot", "count", "best")
    return docs.groupBy("block").cogroup(found.groupBy("in_block")).applyInArrow(_score, SCORES)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), *default_tokenizers())
    scores = cut(link_scores(aligned, cut(pair_counts(aligned), "counts")), "scores")
    scores = scores.select(F.col("block").alias("of_block"), F.col("at").alias("of_at"), "n_best", "count_sum")
    docs = aligned.where("at >= 0").select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = docs.join(scores, (F.col("block") == F.col("of_block")) & (F.col("at") == F.col("of_at")), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
