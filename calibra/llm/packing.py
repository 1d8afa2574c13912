"""Packing into sequences of fixed length by shortest-pack-first over the length histogram (operator 13).

Documents are coded once. One of n ids gives n // capacity full sequences of its
own; what is left over is an item of length n % capacity. Only the histogram of
item lengths (fewer numbers than the capacity) reaches the driver. There lengths
are placed longest first, each into the packs with the most room, and what is
counted is patterns: a step puts one or more items of a length into each of k
packs that are filled alike. Where nothing fits, new packs are opened as long as
the ids still to place exceed the room that is open; after that the longest
item is cut at the room of the emptiest pack and its rest becomes an item of a
shorter length. So there are as few packs as the ids allow. What the total has
beyond whole packs goes to packs of its powers of two, which need no padding
either: no sequence is padded.

The steps hold intervals of ranks. A rank of an item is its place among the items
of its length: counted within the writing task, plus a sum over the tasks before.
Each document looks up its rank, its place and, if cut, the rank of its rest. The
steps are broadcast: a step uses up a length or all packs of a pattern, so their
number depends on the capacity and not on the rows (some thousands at 2048).

A null or empty text has only the end id. Null ids and rows that share an id are
packed like any other. No rows: no pieces. A very long text is one row of ids.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm import segments as sg
from calibra.llm import textbytes as tb
from calibra.llm.common import cut, id_and_body, on_workers, table

CAPACITY = 2048
END_ID = 1
GROUP = 1 << 19          # bytes of text coded at once
CODED = "part int, doc_id long, n_tokens long, rest int, chunks long, rank long, chunk_rank long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def id_type(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def _running(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each key among its like, after those in ``seen``, which is brought up to date."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(first)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys)))) + seen[ranked]
    np.add.at(seen, keys, 1)
    return rank


def _code(shared, capacity: int, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), sg.byte_level(shared.value, False)
        seen, chunks_before = np.zeros(capacity, np.int64), 0
        kind = id_type(max(len(coder.bytes) - 1, end_id))
        for batch in batches:
            b, offs = tb.text_bytes(batch.column(1))
            for i, j in tb.doc_groups(offs, GROUP):
                ids, counts = coder.rows(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                n = counts + 1
                stop = np.concatenate([[0], np.cumsum(n)])
                out = np.full(int(stop[-1]), end_id, kind)
                inside = np.ones(len(out), bool)
                inside[stop[1:] - 1] = False
                out[inside] = ids
                chunks, rest = n // capacity, n % capacity
                raw, at = out.tobytes(), (stop * kind.itemsize).tolist()
                before = chunks_before + np.cumsum(chunks) - chunks
                chunks_before += int(chunks.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int32)), batch.column(0).slice(i, j - i), pa.array(n), pa.array(rest.astype(np.int32)),
                     pa.array(chunks), pa.array(_running(rest, seen)), pa.array(before),
                     pa.array([raw[s:e] for s, e in zip(at[:-1], at[1:])], pa.binary())],
                    ["part", "doc_id", "n_tokens", "rest", "chunks", "rank", "chunk_rank", "ids"])
    return run


def plan_packs(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Steps of the packing of items by length: arrays with one entry a step, sorted by length and rank.

    Items of ``length`` with ranks from ``rank`` on go ``copies`` to a pack into
    consecutive sequences from ``sequence`` on, at ``offset``; of each, ``placed``
    ids fit, and the rest is the item of length ``length - placed`` whose ranks
    begin at ``rest_rank``.
    """
    held = [0] * (capacity + 1)
    for length, n in histogram.items():
        held[length] += n
    total = sum(length * n for length, n in enumerate(held))
    rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]     # by room: (first sequence, packs, used)
    sequence = 0
    for bit in range(capacity.bit_length()):
        if (total % capacity) >> bit & 1:
            rooms[1 << bit].append((sequence, 1, 0))
            sequence += 1
    unopened, steps, top = total // capacity, [], capacity
    for length in range(capacity, 0, -1):
        rank = 0
        while rank < held[length]:
            left = held[length] - rank
            while top and not rooms[top]:
                top -= 1
            if top < length and unopened:
                k = min(left, unopened)
                rooms[capacity].append((sequence, k, 0))
                sequence, unopened, top = sequence + k, unopened - k, capacity
            first, packs, used = rooms[top].pop()
            k, room = min(left, packs), top
            copies = min(room // length, left // packs) if room >= length and left >= packs else 1
            if k < packs:
                rooms[room].append((first + k, packs - k, used))
            placed, rest_rank = min(length, room), 0
            if placed < length:
                rest_rank = held[length - placed]
                held[length - placed] += k
            steps.append((length, rank, copies, first, used, placed, rest_rank))
            if room - copies * placed:
                rooms[room - copies * placed].append((first, k, used + copies * placed))
            rank += k * copies
    names = ("length", "rank", "copies", "sequence", "offset", "placed", "rest_rank")
    steps.sort()
    columns = np.array(steps, np.int64).reshape(-1, len(names)).T
    return {**dict(zip(names, columns)), "sequences": np.array([sequence], np.int64)}


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray):
    """Pieces of items given by length and rank: item index, start within the item, length, sequence, offset."""
    item, start, out = np.arange(len(length)), np.zeros(len(length), np.int64), []
    keys = (plan["length"] << 48) + plan["rank"]
    while len(item):
        step = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        nth, copies, placed = rank - plan["rank"][step], plan["copies"][step], plan["placed"][step]
        out.append((item, start, placed, plan["sequence"][step] + nth // copies, plan["offset"][step] + nth % copies * placed))
        more = placed < length
        item, start, rank, length = item[more], (start + placed)[more], (plan["rest_rank"][step] + nth)[more], (length - placed)[more]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _pieces(shared, capacity: int):
    def run(batches):
        plan = shared.value
        full_from = int(plan["sequences"][0])
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            num = lambda c: get(c).to_numpy(zero_copy_only=False).astype(np.int64)
            n, rest, chunks = num("n_tokens"), num("rest"), num("chunks")
            raw, _ = tb.text_bytes(get("ids"))
            ids = raw.view("<u2" if len(raw) == 2 * int(n.sum()) else "<u4")
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            some = np.flatnonzero(rest)
            item, start, length, sequence, offset = place(plan, rest[some], num("rank")[some] + num("base")[some])
            item = some[item]
            start = start + chunks[item] * capacity
            doc = np.repeat(np.arange(len(n)), chunks)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            whole = full_from + (num("chunk_base") + num("chunk_rank"))[doc] + nth
            of, at = np.concatenate([doc, item]), np.concatenate([nth * capacity, start])
            size = np.concatenate([np.full(len(doc), capacity), length])
            part = sg.take_runs(ids, begin[of] + at, size)
            stop = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [get("doc_id").take(pa.array(of)), pa.array(at), pa.array(size), pa.array(n[of]), pa.array(np.concatenate([whole, sequence])),
                 pa.array(np.concatenate([np.zeros(len(doc), np.int64), offset])), pa.ListArray.from_arrays(pa.array(stop), pa.array(part.astype(np.int32)))],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """Every piece with its ids, sequence and place in it."""
    spark = docs.sparkSession
    on_workers(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    coded = cut(id_and_body(docs, id_col, text_col).mapInArrow(_code(tokenizer, capacity, end_id), CODED), "coded", codec="zstd")
    per = cut(coded.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("chunks")), "lengths")
    histogram = {r["rest"]: r["n"] for r in per.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_packs(histogram, capacity))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = per.select("part", F.col("rest").alias("kind"), "n").union(
        per.groupBy("part").agg(F.sum("chunks").alias("n")).select("part", F.lit(capacity).alias("kind"), "n"))
    bases = counts.select(F.col("part").alias("of_part"), "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    full = bases.where(F.col("kind") == capacity).select(F.col("of_part").alias("full_part"), F.col("base").alias("chunk_base"))
    bases = bases.where(F.col("kind") < capacity).join(full, F.col("of_part") == F.col("full_part")).select("of_part", "kind", "base", "chunk_base")
    based = coded.join(bases, (F.col("part") == F.col("of_part")) & (F.col("rest") == F.col("kind")))
    return based.select("doc_id", "n_tokens", "rest", "chunks", "rank", "chunk_rank", "base", "chunk_base", "ids").mapInArrow(
        _pieces(plan, capacity), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Sequences as rows: sequence_id and its ids, pieces in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def _digests(batches):
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        stop = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        crc = [zlib.crc32(values[s:e]) for s, e in zip(stop[:-1].tolist(), stop[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer()).mapInArrow(_digests, PIECES.replace("ids array<int>", "ids_crc32 long"))
