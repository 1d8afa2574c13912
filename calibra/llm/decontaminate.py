"""Benchmark decontamination: CGK embedding and bit-sampling LSH over windows (operator 7).

The edit distance is that of words (A-Z lower-cased): an item of n words is found
in a document if some stretch of it is within ``floor((1 - similarity) * n)`` word
insertions, deletions and replacements.

A CGK walk reads a sequence with a pointer that stays or moves on at each step,
by a random bit drawn from the step number and the word read; two sequences
with few edits between them fall back into step soon after each, so the words
they emit differ in few steps (edit distance becomes Hamming distance). Sampling a
few steps of that output gives a locality-sensitive key.

Windows of the walks start at anchors: words whose hash is smallest among
``ANCHOR`` neighbours (every stretch of that many words has one), the same words in
a document as in an item that it holds. Each anchor's walk has a fixed number of steps (some 14
words). A window is a candidate if one of ``WALKS`` independent walks gives an item
anchor's key for one of ``SAMPLES`` sampled step sets. Walks alone miss short items,
whose rest ends before the walk does, so each item is also cut into one piece more
than the edits allowed: an item within the distance has a piece without any edit,
and the documents' windows of the pieces' lengths (1 to some 5 words) find it for
certain, at every length (``tests/llm`` measures it per length). Candidates are
aligned exactly with a semi-global edit distance around the place they point to,
and only those within the distance are returned.

The keys of the items are broadcast in blocks of at most ``ITEM_BLOCK`` items,
each of a size that the constants bound; more items mean more passes, not a larger
broadcast. Documents are mapped whole, where they lie: no shuffle.

Null or empty texts and items match nothing. Items of any length count, down to
one word, which must stand in the document as it is; ``min_words`` can leave out
shorter ones as no evidence. Repeated rows are each reported;
a null doc_id is reported as null. Equal items are each reported.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import id_and_body, on_workers, table

ANCHOR = 4
WALKS = 3
# Sampled steps of a walk: six of some 27, so that a key holds several words even where the pointer rests.
SAMPLES = ((0, 4, 9, 14, 19, 24), (1, 6, 11, 16, 21, 26), (2, 7, 12, 17, 22, 27), (3, 5, 10, 15, 18, 23))
DISTINCT = 4
MIN_WORDS = 1
ITEM_BLOCK = 20_000
MATCH = "doc_id long, item_id long, distance int, start int, n_words int, item_words int"


def anchors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions whose word hash is the smallest of ``ANCHOR`` consecutive words of one text that hold it."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    order = tb.mix(h + np.uint64(0x51ED270B))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    size = np.diff(first)[text]
    low = np.zeros(n, bool)
    if n >= ANCHOR:
        view = np.lib.stride_tricks.sliding_window_view(order, ANCHOR)
        at = np.argmin(view, axis=1) + np.arange(len(view))
        whole = text[:len(view)] == text[ANCHOR - 1:]
        low[at[whole]] = True
    low |= size < ANCHOR
    return np.flatnonzero(low)


def walk_keys(h: np.ndarray, stops: np.ndarray, starts: np.ndarray):
    """CGK walks from ``starts``; ``stops`` is the end of each start's text.

    Yields a 64-bit key array for every walk and sample set, with a mask of the
    keys that hold at least ``DISTINCT`` different places of the sequence (a
    resting pointer or a finished sequence, which reads as zeros, says little).
    """
    padded = np.append(h, np.uint64(0))
    for walk in range(WALKS):
        bits = tb.mix(padded + np.uint64(0xA0761D6478BD642F + walk))
        pointer = starts.copy()
        keys = [np.full(len(starts), walk * 16 + s + 1, dtype=np.uint64) for s in range(len(SAMPLES))]
        places = [np.zeros(len(starts), np.int8) for _ in SAMPLES]
        last = [np.full(len(starts), -1) for _ in SAMPLES]
        for step in range(max(map(max, SAMPLES)) + 1):
            at = np.where(pointer < stops, pointer, len(h))
            for s, sample in enumerate(SAMPLES):
                if step in sample:
                    keys[s] = tb.mix(keys[s] * np.uint64(0x9E3779B97F4A7C15) + padded[at])
                    places[s] += (pointer != last[s]) & (pointer < stops)
                    last[s] = pointer
            pointer = pointer + ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        for key, count in zip(keys, places):
            yield key, count >= DISTINCT


def pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """Offsets and lengths of ``limit`` + 1 pieces of an item of n words; ``limit`` edits leave one as it is."""
    cuts = [n * i // (limit + 1) for i in range(limit + 2)]
    return [(a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a]


def piece_keys(h: np.ndarray, size: int) -> np.ndarray:
    """Keys of all stretches of ``size`` words (none if there are fewer)."""
    count = max(0, len(h) - size + 1)
    key = np.full(count, size, np.uint64)
    for i in range(size):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + h[i:i + count])
    return key


def semi_global(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to any stretch of ``text`` with the stretch's start and end.

    One pass per item word over the text; insertions along the text are a
    running minimum, so each pass is a few array operations.
    """
    n = len(text)
    cost = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item):
        diagonal = cost[:-1] + (text != word)
        up = cost + 1
        step = up.copy()
        source = origin.copy()
        better = diagonal < up[1:]
        step[1:][better] = diagonal[better]
        source[1:][better] = origin[:-1][better]
        shifted = step - ramp
        low = np.minimum.accumulate(shifted)
        at = np.maximum.accumulate(np.where(shifted == low, ramp, 0))
        cost, origin = low + ramp, source[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


class ItemKeys:
    """LSH keys of a block of items: sorted keys, and for each the item and the anchor's offset in it."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, min_words: int):
        keys, refs, offs, sizes = [], [], [], set()
        self.ids, self.words, self.limits = [], [], []
        for item_id, raw in items:
            b = np.frombuffer(raw, np.uint8)
            _, _, _, h, first = tb.words(b, np.array([0, len(b)]))
            if len(h) < max(1, min_words):
                continue
            starts = anchors(h, first)
            for k, good in walk_keys(h, np.full(len(starts), len(h)), starts):
                keys.append(k[good])
                refs.append(np.full(good.sum(), len(self.ids)))
                offs.append(starts[good])
            limit = math.floor((1 - similarity) * len(h) + 1e-9)
            for off, size in pieces(len(h), limit):
                keys.append(piece_keys(h[off:off + size], size))
                refs.append(np.array([len(self.ids)]))
                offs.append(np.array([off]))
                sizes.add(size)
            self.ids.append(item_id)
            self.words.append(h)
            self.limits.append(limit)
        self.sizes = sorted(sizes)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.refs = (np.concatenate(refs) if refs else np.zeros(0, np.int64))[by]
        self.offs = (np.concatenate(offs) if offs else np.zeros(0, np.int64))[by]
        # a bit per key prefix: most windows end here
        self.present = np.zeros(1 << 20, bool)
        self.present[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def windows(self, h: np.ndarray, first: np.ndarray):
        """Keys, mask of those that count, starts and texts of the walks' windows and of the pieces'."""
        starts = anchors(h, first)
        text = np.searchsorted(first, starts, side="right") - 1
        for k, good in walk_keys(h, first[text + 1], starts):
            yield k, good, starts, text
        starts = np.arange(len(h))
        text = np.searchsorted(first, starts, side="right") - 1
        for size in self.sizes:
            k = piece_keys(h, size)
            at = starts[:len(k)]
            yield k, at + size <= first[text[:len(k)] + 1], at, text[:len(k)]

    def candidates(self, h: np.ndarray, first: np.ndarray):
        """Distinct (text, item, place the item would begin) of all windows that share a key with an item."""
        if not len(h) or not len(self.keys):
            return []
        found = set()
        for k, good, starts, text in self.windows(h, first):
            maybe = np.flatnonzero(good & self.present[(k >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(self.keys, k[maybe], side="left")
            hi = np.searchsorted(self.keys, k[maybe], side="right")
            for w, a, z in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                t = int(text[w])
                for x in range(a, z):
                    found.add((t, int(self.refs[x]), int(starts[w]) - int(first[t]) - int(self.offs[x])))
        return sorted(found)

    def matches(self, h: np.ndarray, first: np.ndarray):
        """(text, item, distance, start, words) of the best place of every item in every text that is near enough."""
        best: dict = {}
        done: dict = {}
        for text, ref, place in self.candidates(h, first):
            item, limit = self.words[ref], self.limits[ref]
            doc = h[first[text]:first[text + 1]]
            lo, hi = max(0, place - limit), min(len(doc), place + len(item) + 2 * limit)
            tried = done.setdefault((text, ref), [])
            if hi <= lo or any(a <= lo and hi <= z for a, z in tried):
                continue
            lo, hi = max(0, lo - limit), min(len(doc), hi + limit)      # room for the next candidates of the same place
            tried.append((lo, hi))
            if np.isin(item, doc[lo:hi]).sum() < len(item) - limit:     # more words are missing than edits allowed
                continue
            distance, start, end = semi_global(item, doc[lo:hi])
            if distance <= limit and ((text, ref) not in best or (distance, lo + start) < best[text, ref][:2]):
                best[text, ref] = (distance, lo + start, end - start)
        return [(t, r, *v) for (t, r), v in sorted(best.items())]


def _match_rows(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            ids = batch.column(0)
            b, offs = tb.text_bytes(batch.column(1))
            for i, j in tb.doc_groups(offs):
                _, _, _, h, first = tb.words(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                rows = items.matches(h, first)
                if rows:
                    t, r, d, s, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i + x for x in t])), pa.array([items.ids[x] for x in r], pa.int64()),
                         pa.array(d, pa.int32()), pa.array(s, pa.int32()), pa.array(n, pa.int32()),
                         pa.array([len(items.words[x]) for x in r], pa.int32())],
                        ["doc_id", "item_id", "distance", "start", "n_words", "item_words"])
    return run


def item_blocks(items: DataFrame, item_col: str, text_col: str, similarity: float, min_words: int):
    """Broadcasts of the items' keys, ``ITEM_BLOCK`` items each, read a block at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body")).where("body is not null")
    part = []
    for row in rows.toLocalIterator():
        part.append((row["id"], bytes(row["body"])))
        if len(part) == ITEM_BLOCK:
            yield spark.sparkContext.broadcast(ItemKeys(part, similarity, min_words))
            part = []
    if part:
        yield spark.sparkContext.broadcast(ItemKeys(part, similarity, min_words))


def benchmark_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, distance, start (word), n_words, item_words: the best place of each item in each document that holds it."""
    spark = docs.sparkSession
    on_workers(spark)
    body = id_and_body(docs, id_col, text_col)
    out = None
    for shared in item_blocks(items, item_col, item_text_col, similarity, min_words):
        part = body.mapInArrow(_match_rows(shared), MATCH)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCH) if out is None else out


def _clean_rows(shared, at: int):
    def run(batches):
        items = shared.value
        for batch in batches:
            b, offs = tb.text_bytes(batch.column(at))
            bad = np.zeros(batch.num_rows, bool)
            for i, j in tb.doc_groups(offs):
                _, _, _, h, first = tb.words(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                bad[[i + m[0] for m in items.matches(h, first)]] = True
            yield batch.filter(pa.array(~bad))
    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the documents that hold an item, all columns as they were."""
    on_workers(docs.sparkSession)
    for shared in item_blocks(items, item_col, item_text_col, similarity, min_words):
        docs = docs.mapInArrow(_clean_rows(shared, docs.columns.index(text_col)), docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
