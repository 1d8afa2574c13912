"""Language-model scores from a weighted backoff automaton (operator 9).

Model. Tokens are words (A-Z lower-cased) and one end token per document.
Unigrams are smoothed by adding a half, over all distinct training words. Above
them, states of the automaton are contexts of one word (seen ``MIN_COUNT`` times) and of more
words (kept arcs). An arc is an n-gram seen at least ``MIN_COUNT`` times in the
training documents, a fixed number at any size of the corpus. All n-grams of all
training documents are counted before any is dropped. With discount D an arc weighs

    P(w | h) = (c(hw) - D) / c(h) + left(h) * P(w | shorter h),
    left(h)  = 1 - sum over kept arcs of (c(hw) - D) / c(h),

and the failure arc of h leads to its suffix with weight left(h). So every
context's probabilities sum to one. The automaton grows with the corpus and is
never in one place: its counts, and for every context the summed weights of its
arcs, are written tables, and a block of documents is brought the rows of its own
n-grams, from which it builds the part of the automaton that it can reach.
n-grams are compared by 64-bit hashes. ``min_state`` and ``min_arc`` (shares of
the training tokens, 0 by default) can ask for more of contexts and arcs.

Work. Documents become blocks of about ``BLOCK_TOKENS`` tokens, written once as a
table bucketed by block, so that no later step shuffles them. A step brings each
block the answers so far and has it send sorted, packed keys (a few bytes each) with
its own sums to the parts of the key space; a part adds them up over all blocks and
answers with totals in the order of the keys sent. Step 1 counts words and bigrams.
Step k counts the n-grams of k + 1 words of which both shorter ones are kept (an
n-gram seen twice has no other), and sums the arcs of the contexts of k - 1 words;
each kept arc is told to one of its blocks alone, which adds it to its context. The traversal
carries the longest state from token to token; states are suffixes of at most
``order - 1`` words, so a block's states are found with array shifts, all tokens at
once.

A null or empty text is the end token alone. Rows that share an id are scored
one by one. A null id is not held out and trains. A text longer than a block is
cut into parts that keep their context. An empty table gives no rows.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import cut, cut_buckets, held_out, on_workers, table

BLOCK_TOKENS = 1_500_000
PART_TOKENS = 2_000_000         # training tokens for each part of the key space
MIN_COUNT = 2
DISCOUNT = 0.75
ORDER = 3
END = np.uint64(0x5DEECE66D1234567)     # the end token's hash; words hash through tb.mix

BLOCK = "block long, ids binary, rids binary, held binary, sizes binary, leads binary, tokens binary, vocab binary, n_train long"
_KINDS = {"ids": np.int64, "rids": np.int64, "held": np.bool_, "sizes": np.int32, "leads": np.int8,
          "tokens": np.int32, "vocab": np.int64}
CELLS = "kind int, part long, block long, size int, body binary"
ANSWERS = CELLS + ", fresh long"
NO_ID = -(1 << 63)


def squeeze(values: np.ndarray) -> bytes:
    """An array as compressed bytes, equal bytes of its numbers side by side."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(body: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(body[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _trained(held: np.ndarray, sizes: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which tokens of a block train: those of documents not held out, without repeated context."""
    out, starts = np.repeat(~held, sizes), np.cumsum(sizes) - sizes
    for at, lead in zip(starts[leads > 0], leads[leads > 0]):
        out[at:at + lead] = False
    return out


def _blocks(order: int, block_tokens: int):
    def pack(number, parts):
        hashes = np.concatenate([p[3] for p in parts])
        sizes = np.array([len(p[3]) for p in parts], np.int32)
        leads = np.array([p[4] for p in parts], np.int8)
        held = np.array([p[2] for p in parts], np.bool_)
        # the end token is a context even where no document ends
        vocab, tokens = np.unique(np.append(hashes, END).view(np.int64), return_inverse=True)
        tokens = tokens[:-1]
        n_train = int(_trained(held, sizes, leads).sum())
        # frequent words get small numbers, which take fewer bytes
        by = np.argsort(-np.bincount(tokens, minlength=len(vocab)), kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        row = {"ids": np.array([p[0] for p in parts], np.int64), "rids": np.array([p[1] for p in parts], np.int64),
               "held": held, "sizes": sizes, "leads": leads, "tokens": rank[tokens], "vocab": vocab[by]}
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.array([squeeze(row[k])], pa.binary()) for k in _KINDS],
             pa.array([n_train], pa.int64())], ["block", *_KINDS, "n_train"])

    def run(batches):
        from pyspark import TaskContext

        base, rid, number = TaskContext.get().partitionId() << 40, 0, 0
        parts, held_tokens = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            held = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            b, offs = tb.text_bytes(batch.column(2))
            for i, j in tb.doc_groups(offs):
                _, _, _, h, first = tb.words(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                for r in range(j - i):
                    doc = np.append(h[first[r]:first[r + 1]], END)
                    at = 0
                    while at < len(doc):
                        lead = min(at, order - 1)
                        piece = doc[at - lead:at + block_tokens]
                        parts.append((ids[i + r], base + rid, held[i + r], piece, lead))
                        held_tokens += len(piece)
                        at += block_tokens
                        if held_tokens >= block_tokens:
                            yield pack(base + number, parts)
                            parts, held_tokens, number = [], 0, number + 1
                    rid += 1
        if parts:
            yield pack(base + number, parts)
    return run


def _unpack(row: dict) -> dict:
    """A block's arrays, its words in ascending order of their hashes."""
    out = {k: expand(row[k], kind) for k, kind in _KINDS.items()}
    by = np.argsort(out["vocab"])
    place = np.empty(len(by), np.int32)
    place[by] = np.arange(len(by), dtype=np.int32)
    return {**out, "vocab": out["vocab"][by], "tokens": place[out["tokens"]]}


class Automaton:
    """States and arcs as sorted arrays; level n holds contexts of n words.

    ``words`` are the hashes of the one-word states. ``arcs[n]`` has the sorted
    keys (context * number of words + word) of level n's arcs, their log10
    weights, and each key's number is the state of the next level it leads to.
    ``left[n]`` has the log10 weights of the failure arcs of level n's states.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, [counts]
        self.arcs: list[np.ndarray] = []

    def states(self, block: dict) -> list[np.ndarray]:
        """For each level the state after each token, -1 where there is none."""
        at = np.searchsorted(self.words, block["vocab"])
        at[at == len(self.words)] = 0
        known = self.words[at] == block["vocab"] if len(self.words) else np.zeros(len(at), bool)
        level = np.where(known, at, -1)[block["tokens"]]
        begins, out = self.begins(block), [level]
        for keys in self.arcs:
            out.append(_find(keys, self.keys(level, out[-1], begins, self.opening(len(out) - 1))))
        return out

    def keys(self, words: np.ndarray, states: np.ndarray, begins: np.ndarray, opening: int) -> np.ndarray:
        """Arc keys of each token from the state before it; -1 where the state or the word is none."""
        before = np.empty_like(states)
        before[1:] = states[:-1]
        before[begins] = opening
        return np.where((before >= 0) & (words >= 0), before * np.int64(len(self.words)) + words, -1)

    def begins(self, block: dict) -> np.ndarray:
        out = np.zeros(len(block["tokens"]), bool)
        out[np.cumsum(block["sizes"]) - block["sizes"]] = True
        return out

    def opening(self, level: int) -> int:
        """The state before a document's first token: the end token at level 1, none above."""
        if level or not len(self.words):
            return -1
        end = int(np.searchsorted(self.words, END.view(np.int64)))
        return end if end < len(self.words) and self.words[end] == END.view(np.int64) else -1


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Level:
    """The distinct n-grams of a block that may be kept: sorted keys, a place of each (of words: its number),
    training counts, and the key of every place (-1: none); with the answer, totals and which are this block's to add."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, counts: np.ndarray, number: np.ndarray):
        self.keys, self.first, self.counts, self.number = keys, first, counts, number
        self.total = self.own = None

    def answered(self, answer: np.ndarray) -> None:
        self.total, self.own = (answer >> np.uint64(1)).astype(np.int64), (answer & np.uint64(1)).astype(bool)


def levels(block: dict, answers: dict, order: int) -> list[Level]:
    """The levels of a block from words up to the first beyond the last answer (``order`` at most)."""
    words = block["vocab"].view(np.uint64)[block["tokens"]]
    begins = np.cumsum(block["sizes"]) - block["sizes"]
    trained = _trained(block["held"], block["sizes"], block["leads"])
    counts = np.bincount(block["tokens"][trained], minlength=len(block["vocab"]))
    out = [Level(block["vocab"], np.arange(len(counts)), counts, block["tokens"].astype(np.int64))]
    if 1 in answers:
        out[0].answered(answers[1][0])
    gram, whole = words, np.ones(len(words), bool)
    for n in range(2, order + 1):
        context, have = np.empty_like(gram), np.empty_like(whole)
        context[1:], have[1:] = gram[:-1], whole[:-1]
        context[begins], have[begins] = END, n == 2
        gram, whole = tb.mix(context * np.uint64(0x9E3779B97F4A7C15) + words), have
        possible = whole.copy()
        if n > 2:
            below = out[-1]
            kept = np.append(below.total > 0, False)[below.number]
            possible &= kept
            possible[1:] &= kept[:-1]
        at = np.flatnonzero(possible)
        keys, first, back = np.unique(gram[at].view(np.int64), return_index=True, return_inverse=True)
        number = np.full(len(words), -1, np.int64)
        number[at] = back
        out.append(Level(keys, at[first], np.bincount(back[trained[at]], minlength=len(keys)), number))
        if n not in answers:
            break
        out[-1].answered(answers[n][0])
    return out


def contexts(level: Level, n: int, least: float) -> np.ndarray:
    """Which of a level's n-grams are states."""
    return np.flatnonzero(level.total >= least if n == 1 else level.total > 0)


def _arc_sums(block: dict, levels_: list[Level], n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the states of n words, and of their arcs that are this block's to add: summed counts and number."""
    states, arcs = levels_[n - 1], levels_[n]
    first = arcs.first[arcs.own]
    begins = np.zeros(len(block["tokens"]) + 1, bool)
    begins[np.cumsum(block["sizes"]) - block["sizes"]] = True
    before = states.number[first - 1]
    if n == 1:
        before = np.where(begins[first], np.searchsorted(states.keys, END.view(np.int64)), before)
    size, keep = len(states.keys), contexts(states, n, least)
    sums = np.bincount(before, weights=arcs.total[arcs.own], minlength=size)
    return states.keys[keep], sums[keep].astype(np.int64), np.bincount(before, minlength=size)[keep]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space; ascending with the (signed) key."""
    high = (keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    return (high * np.uint64(parts)) >> np.uint64(32)


def _cells(kind: int, number: int, keys: np.ndarray, sums: list[np.ndarray], parts: int) -> pa.Table:
    """One row for each part that a block has keys of: differences of the sorted keys, and their sums."""
    part = part_of(keys, parts)
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else [], len(keys)).astype(np.int64)
    bodies = [squeeze(np.concatenate([np.diff(keys[i:j], prepend=np.int64(0)), *[x[i:j].astype(np.int64) for x in sums]]))
              for i, j in zip(edges[:-1], edges[1:])]
    n = len(bodies)
    return pa.table([pa.array(np.full(n, kind, np.int32)), pa.array(part[edges[:-1]].astype(np.int64)), pa.array(np.full(n, number, np.int64)),
                     pa.array(np.diff(edges).astype(np.int32)), pa.array(bodies, pa.binary())], names=["kind", "part", "block", "size", "body"])


def _sent(row: dict, answers: dict, kinds: list[int], parts: int, least: float) -> pa.Table:
    """What a block sends in a step: counts of its n-grams (kind n), arcs of its contexts of n words (kind -n)."""
    block, out = _unpack(row), []
    found = levels(block, answers, max(abs(k) + (k < 0) for k in kinds))
    for k in kinds:
        keys, *sums = (found[k - 1].keys, found[k - 1].counts) if k > 0 else _arc_sums(block, found, -k, least)
        out.append(_cells(k, row["block"], keys, sums, parts))
    return pa.concat_tables(out)


def _answers(replies: pa.Table) -> dict:
    """For each kind the columns of a block's answers, in the order of the keys it sent."""
    out: dict[int, list] = {}
    for row in replies.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist():
        out.setdefault(row["kind"], []).append(expand(row["body"], np.uint64).reshape(-1, row["size"]))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


def _none(columns: int) -> np.ndarray:
    return np.zeros((columns, 0), np.uint64)


def _first_step(kinds: list[int], parts: int, least: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(row, {}, kinds, parts, least).to_batches()
    return run


def _next_step(step: int, kinds: list[int], parts: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {**{n: _none(1) for n in range(1, step + 1)}, **_answers(right)}
        return pa.concat_tables([_sent(row, answers, kinds, parts, least) for row in left.to_pylist()])
    return run


def _added(floor: float):
    """The sums of a part's keys over all blocks; counts below ``floor`` (words: none) are answered by 0, the others
    by twice the total, plus one for the first of the blocks that hold the key."""
    def run(key, cells):
        kind = key[0].as_py()
        cells = cells.sort_by("block")
        sizes = cells.column("size").to_numpy()
        edges = np.append(0, np.cumsum(sizes))
        columns = 2 if kind > 0 else 3
        values = np.empty((columns, edges[-1]), np.int64)
        for i, body in enumerate(cells.column("body")):
            values[:, edges[i]:edges[i + 1]] = expand(body.as_py(), np.int64).reshape(columns, -1)
            values[0, edges[i]:edges[i + 1]] = np.cumsum(values[0, edges[i]:edges[i + 1]])
        keys, first, back = np.unique(values[0], return_index=True, return_inverse=True)
        totals = []
        for column in values[1:]:
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, column)
            totals.append(total)
        fresh = 0
        if kind > 0:
            total = np.where(totals[0] >= (floor if kind > 1 else 1), totals[0], 0)
            fresh = int((total > 0).sum())
            answer = 2 * total[back]
            answer[first[total > 0]] += 1
            replies = [answer]
        else:
            replies = [t[back] for t in totals]
        bodies = [squeeze(np.concatenate([r[i:j] for r in replies])) for i, j in zip(edges[:-1], edges[1:])]
        return pa.table([cells.column("kind"), cells.column("part"), cells.column("block"), cells.column("size"),
                         pa.chunked_array([pa.array(bodies, pa.binary())]), pa.chunked_array([pa.array([fresh] + [0] * (len(bodies) - 1), pa.int64())])],
                        names=["kind", "part", "block", "size", "body", "fresh"])
    return run


class Scorer:
    """The automaton's log10 weights."""

    def __init__(self, auto: Automaton, total: int, distinct: int, discount: float, masses: list[np.ndarray] | None = None):
        """``masses``: for each state the sum of c - discount over all its arcs, where ``auto`` holds but some of them."""
        self.auto = auto
        self.norm = total + 0.5 * (distinct + 1)
        self.fail, self.gain = [], []
        for n, keys in enumerate(auto.arcs):
            context, counts = keys // max(1, len(auto.words)), auto.counts[n + 1]
            share = (counts - discount) / auto.counts[n][context]
            if masses is None:
                used = np.bincount(context, weights=share, minlength=len(auto.counts[n]))
            else:
                used = masses[n] / np.maximum(auto.counts[n], 1.0)
            self.gain.append(share)
            self.fail.append(np.log10(np.maximum(1.0 - used, 1e-12)))

    def score(self, block: dict, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of each token: unigram and model."""
        auto = self.auto
        base = np.log10((counts + 0.5) / self.norm)[block["tokens"]]
        states = auto.states(block)
        begins = auto.begins(block)
        best = base
        for n, keys in enumerate(auto.arcs):
            before = np.empty_like(states[n])
            before[1:] = states[n][:-1]
            before[begins] = auto.opening(n)
            left = np.where(before >= 0, self.fail[n][before] if len(self.fail[n]) else 0.0, 0.0)
            arc = _find(keys, auto.keys(states[0], states[n], begins, auto.opening(n)))
            gain = np.where(arc >= 0, self.gain[n][arc] if len(keys) else 0.0, 0.0)
            down = left + best
            best = np.where(gain > 0, np.log10(gain + np.power(10.0, down)), down)
        return base, best


SCORED = "rid long, id long, n_tokens long, n_known long, base double, score double"


def reachable(block: dict, rows: dict, order: int, least: float) -> tuple[Automaton, list[np.ndarray]]:
    """The part of the automaton that a block can reach, and the masses of its states.

    ``rows[n]`` has place, count and mass of the block's kept n-grams; words seen
    less than ``least`` times are no context.
    """
    pos, total, mass = rows[1]
    counts, masses = np.zeros(len(block["vocab"])), [np.zeros(len(block["vocab"]))]
    counts[pos], masses[0][pos] = total, np.where(total >= least, mass, 0.0)
    auto = Automaton(block["vocab"], counts)
    words = last = block["tokens"].astype(np.int64)
    begins = auto.begins(block)
    for n in range(2, order + 1):
        pos, total, mass = rows[n]
        keys = auto.keys(words, last, begins, auto.opening(n - 2))
        own = keys[pos]
        good = own >= 0
        if n == 2:
            good &= counts[own // len(counts)] >= least
        kept = np.flatnonzero(good)
        by = kept[np.argsort(own[kept])]
        auto.arcs.append(own[by])
        auto.counts.append(total[by].astype(np.float64))
        masses.append(mass[by])
        last = _find(auto.arcs[-1], keys)
    return auto, masses


def _kept_rows(block: dict, answers: dict, discount: float, order: int, least: float) -> dict:
    """For each level places, counts and summed weights of arcs of what is kept."""
    rows = {}
    for n, level in enumerate(levels(block, answers, order), 1):
        mass = np.zeros(len(level.keys))
        if n < order:
            total, arcs = answers.get(-n, _none(2)).astype(np.float64)
            mass[contexts(level, n, least)] = total - discount * arcs
        kept = level.total > 0
        rows[n] = level.first[kept], level.total[kept], mass[kept]
    return rows


def _score_blocks(total: int, distinct: int, discount: float, order: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {**{n: _none(1) for n in range(1, order + 1)}, **_answers(right)}
        out = []
        for row in left.to_pylist():
            block = _unpack(row)
            auto, masses = reachable(block, _kept_rows(block, answers, discount, order, least), order, least)
            counts = auto.counts[0]
            base, best = Scorer(auto, total, distinct, discount, masses).score(block, counts)
            known = (counts > 0)[block["tokens"]]
            sizes, leads = block["sizes"].astype(np.int64), block["leads"].astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            sums = []
            for x in (known.astype(np.float64), base, best):
                s = np.add.reduceat(x, starts)
                for i in np.flatnonzero(leads):
                    s[i] -= x[starts[i]:starts[i] + leads[i]].sum()
                sums.append(s)
            out.append(pa.table([pa.array(block["rids"]), pa.array(block["ids"]), pa.array(sizes - leads),
                                 pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                                names=["rid", "id", "n_tokens", "n_known", "base", "score"]))
        return pa.concat_tables(out)
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1,
              order: int = ORDER, min_state: float = 0.0, min_arc: float = 0.0, discount: float = DISCOUNT,
              block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    on_workers(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds, fold).alias("held"),
                       F.col(text_col).cast("binary").alias("body"))
    blocks = cut_buckets(rows.mapInArrow(_blocks(order, block_tokens), BLOCK), "blocks", "block", rows.rdd.getNumPartitions())
    total = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    blocks = blocks.drop("n_train")
    least, floor = max(MIN_COUNT, min_state * total), max(MIN_COUNT, math.ceil(min_arc * total))
    parts = max(1, total // PART_TOKENS)

    answers: list[DataFrame] = []
    for step in range(1, order + 1):
        if step == 1:
            cells = blocks.mapInArrow(_first_step([n for n in (1, 2) if n <= order], parts, least), CELLS)
        else:
            kinds = ([step + 1] if step < order else []) + [1 - step]
            known = reduce(DataFrame.union, answers).where(F.col("kind").between(1, step)).drop("fresh")
            cells = (blocks.groupBy("block").cogroup(known.groupBy("block"))
                     .applyInArrow(_next_step(step, kinds, parts, least), CELLS))
        answers.append(cut(cells.groupBy("kind", "part").applyInArrow(_added(floor), ANSWERS), "answers", codec="uncompressed"))
    distinct = answers[0].where("kind = 1").agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
    score = _score_blocks(total, distinct, discount, order, least)
    scored = (blocks.groupBy("block").cogroup(reduce(DataFrame.union, answers).drop("fresh").groupBy("block"))
              .applyInArrow(score, SCORED))
    out = scored.groupBy("rid").agg(F.min("id").alias("id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    return out.select(doc_id.alias("doc_id"), F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out"),
                      "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
