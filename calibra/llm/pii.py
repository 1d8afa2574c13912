"""Personal data by patterns and bootstrapped contexts (operator 5).

Base spans come from the four patterns below (leftmost, without overlap per
kind, failing matches dropped). They are the seeds. Each seed and each other
word that looks like an identifier (it has a digit or an at sign, and any length) is
an instance, and so is a stretch of neighbouring words of digits and brackets, such
as a number written with spaces, as a whole; a word with neither sign is never one;
the word before it and the two words before it are its lexical patterns. Spark
scores the graph of patterns and instances in ``ROUNDS`` rounds:

    score(pattern, kind)  = sum of its occurrences, weighted by the instances' scores, / all its occurrences
    score(instance, kind) = 1 for seeds, else 1 - product of (1 - score) of its scored patterns

where all occurrences of a pattern, before whatever word, are counted over the
whole corpus, and a pattern is scored only with ``MIN_INSTANCES`` different
instances of a kind, seeds or scored ``MIN_SCORE`` in the round before (copies of
one document are no evidence). So identifiers found in one round back new patterns
in the next; all patterns that the rounds can reach from the seeds are counted.
Unseen identifiers behind a pattern that scores ``MIN_SCORE`` or more become spans
of its kind; base spans stay as they are.

Texts are read whole; spans are code points, end exclusive. A null or empty
text has no spans. Rows that share an id are treated one by one; a null id is
passed through. No text is shuffled: the contexts worth counting reach the
documents as a bitmap of fixed size.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import cut, on_workers, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_INSTANCES = 3
MIN_SCORE = 0.6
BITMAP_BITS = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends inside a run of digits, so starting only at the head of a run finds the same ones.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
# A word of digits and bracketed digits; the first of a stretch may open a bracket, the last may end a sentence.
_PART = r"(?:[0-9]++|\([0-9]++\)|\[[0-9]++\])"
_GROUP = re.compile(rf"\+?{_PART}(?:[./-]?{_PART})*+")
_FIRST_GROUP = re.compile(r"[\"'(\[{<]*" + _GROUP.pattern)
_LAST_GROUP = re.compile(_GROUP.pattern + r"[\"')\]}>,.;:!?]*")
_GAP = re.compile(r"[ \t]+")
_SPACES = frozenset(" \t\n\r\x0b\x0c")
_TRIM = "\"'()[]{}<>,.;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """Spans of the e-mail pattern, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The word that ends before ``at`` (white space skipped); (0, 0) if there is none."""
    end = at
    while end > 0 and text[end - 1] in _SPACES:
        end -= 1
    start = end
    while start > 0 and text[start - 1] not in _SPACES:
        start -= 1
    return start, end


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """[start, end) without punctuation around it; brackets that match one inside stay."""
    word = text[start:end]
    s = start + len(word) - len(word.lstrip(_TRIM))
    e = end - (len(word) - len(word.rstrip(_TRIM)))
    for left, right in ("()", "[]"):
        more = text.count(right, s, e) - text.count(left, s, e)
        if more > 0 and s > start and text[s - 1] == left:
            s -= 1
        elif more < 0 and e < end and text[e] == right:
            e += 1
    return s, e


def _marked_words(text: str, base: list[tuple[int, int, int]]):
    """(start, end) of the words with a digit or an at sign that touch no base span."""
    at, size = 0, len(text)
    spans, i = sorted((s, e) for s, _, e in base), 0
    while (m := _MARKED.search(text, at)) is not None:
        start, end = m.start(), m.end()
        while start > at and text[start - 1] not in _SPACES:
            start -= 1
        while end < size and text[end] not in _SPACES:
            end += 1
        at = end
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if not any(a < end and z > start for a, z in spans[i:i + 8]):
            yield start, end


def mentions(text: str, base: list[tuple[int, int, int]]):
    """(kind or -1, start, end): base spans and other identifier-like words and stretches of digit groups."""
    for s, k, e in base:
        yield k, s, e
    start = end = -1
    goes_on = False
    for a, z in _marked_words(text, base):
        if goes_on and _GAP.fullmatch(text, end, a) and _LAST_GROUP.fullmatch(text, a, z):
            end, goes_on = z, _GROUP.fullmatch(text, a, z) is not None
        else:
            if end >= 0:
                yield -1, *_core(text, start, end)
            start, end, goes_on = a, z, _FIRST_GROUP.fullmatch(text, a, z) is not None
    if end >= 0:
        yield -1, *_core(text, start, end)


_SPAN = "array<struct<start:int,k:int,end:int>>"
FOUND = f"rid long, id long, base {_SPAN}, mentions array<struct<k:int,start:int,end:int,inst:long,one:long,two:long>>"


def _hash_words(parts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    return tb.run_hashes(tb.LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)], ends - sizes, ends)


def pattern_one(h: np.ndarray) -> np.ndarray:
    return tb.mix(h ^ np.uint64(0x1F83D9ABFB41BD6B))


def pattern_two(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _find(batches):
    from pyspark import TaskContext

    rid = TaskContext.get().partitionId() << 40
    span = pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("inst", pa.int64()),
                         ("one", pa.int64()), ("two", pa.int64())])
    for batch in batches:
        b, offs = tb.text_bytes(batch.column(1))
        bases, rows, words = [], [], []
        for r in range(batch.num_rows):
            text = b[offs[r]:offs[r + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            found = []
            for k, s, e in mentions(text, base):
                head = s
                while head > 0 and text[head - 1] not in _SPACES:
                    head -= 1
                s1, e1 = _word_before(text, head)
                s2, e2 = _word_before(text, s1)
                found.append((k, s, e, e1 > s1, e2 > s2))
                words += [text[s:e].encode(), text[s1:e1].encode(), text[s2:e2].encode()]
            bases.append([{"start": s, "k": k, "end": e} for s, k, e in base])
            rows.append(found)
        h = _hash_words(words).reshape(-1, 3) if words else np.zeros((0, 3), np.uint64)
        ones, twos, inst = pattern_one(h[:, 1]).view(np.int64), pattern_two(h[:, 2], h[:, 1]).view(np.int64), h[:, 0].copy().view(np.int64)
        at, out = 0, []
        for found in rows:
            out.append([{"k": k, "start": s, "end": e, "inst": int(inst[at + i]), "one": int(ones[at + i]) if one else None,
                         "two": int(twos[at + i]) if two else None} for i, (k, s, e, one, two) in enumerate(found)])
            at += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + batch.num_rows)), batch.column(0), pa.array(bases, pa.list_(span)),
                                          pa.array(out, pa.list_(mention))], ["rid", "id", "base", "mentions"])
        rid += batch.num_rows


def _place(keys: np.ndarray) -> np.ndarray:
    return (tb.mix(keys.view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _places(batches):
    for batch in batches:
        at = _place(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])


def _count_patterns(shared):
    """Occurrences of the wanted patterns before any word, summed per task."""
    def run(batches):
        bits = shared.value
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            b, offs = tb.text_bytes(batch.column(0))
            for i, j in tb.doc_groups(offs):
                _, _, _, h, first = tb.words(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                if len(h) < 2:
                    continue
                opens = np.zeros(len(h) + 1, bool)
                opens[first] = True
                one = pattern_one(h[:-1])[~opens[1:-1]]
                two = pattern_two(h[:-2], h[1:-1])[~(opens[1:-2] | opens[2:-1])]
                for found in (one.view(np.int64), two.view(np.int64)):
                    at = _place(found)
                    found = found[(bits[at >> 6] >> (at & 63)) & 1 == 1]
                    both = np.concatenate([keys, found])
                    counts = np.concatenate([sums, np.ones(len(found), np.int64)])
                    keys, back = np.unique(both, return_inverse=True)
                    sums = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pattern", "n"])
                    keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pattern", "n"])
    return run


def pattern_totals(body: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): occurrences over all texts of the wanted patterns (and of few others)."""
    spark = body.sparkSession
    words = patterns.select("pattern").mapInArrow(_places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    counts = body.select("body").mapInArrow(_count_patterns(spark.sparkContext.broadcast(bits)), "pattern long, n long")
    return counts.groupBy("pattern").agg(F.sum("n").alias("total"))


def reachable_patterns(edges: DataFrame) -> DataFrame:
    """pattern: all that the rounds could score if every identifier behind a reachable pattern scored."""
    links = edges.select("pattern", "inst").distinct()
    seeds = edges.where("kind >= 0").select("inst", "kind").distinct()
    known = seeds
    for _ in range(ROUNDS):
        patterns = cut(links.join(known, "inst").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("instances"))
                       .where(F.col("instances") >= MIN_INSTANCES).select("pattern", "kind"), "reached")
        known = seeds.union(edges.where("kind < 0").select("pattern", "inst").join(patterns, "pattern").select("inst", "kind")).distinct()
    return patterns.select("pattern").distinct()


def scored_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, kind, score) after the rounds, from edges (pattern, inst, kind or -1, n)."""
    edges = cut(edges.join(totals, "pattern"), "edges")
    seeds = edges.where("kind >= 0").select("inst", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    patterns = None
    for _ in range(ROUNDS):
        weighed = edges.select("pattern", "inst", "n", "total").groupBy("pattern", "inst").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
        weighed = weighed.join(scores, "inst")
        patterns = cut(weighed.groupBy("pattern", "kind").agg(
            (F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("score"), F.count(F.lit(1)).alias("instances"))
            .where(F.col("instances") >= MIN_INSTANCES).select("pattern", "kind", F.least("score", F.lit(1.0)).alias("score")), "patterns")
        found = (edges.where("kind < 0").select("pattern", "inst").distinct().join(patterns, "pattern").groupBy("inst", "kind")
                 .agg((1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - F.col("score"), F.lit(1e-9)))))).alias("score"))
                 .where(F.col("score") >= MIN_SCORE))
        scores = seeds.union(found.join(seeds.select("inst", "kind"), ["inst", "kind"], "left_anti"))
    return patterns


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind number, end) of every row of ``docs``."""
    on_workers(docs.sparkSession)
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    found = cut(body.mapInArrow(_find, FOUND), "pii")
    said = found.select("rid", F.explode("mentions").alias("m")).select(
        "rid", F.col("m.k").alias("kind"), "m.start", "m.end", "m.inst", F.explode(F.array_distinct(F.array("m.one", "m.two"))).alias("pattern"))
    said = said.where("pattern is not null")
    edges = cut(said.groupBy("pattern", "inst", "kind").agg(F.count(F.lit(1)).alias("n")), "edges")
    reached = cut(reachable_patterns(edges), "reached")
    edges = edges.join(reached, "pattern", "left_semi")
    good = scored_patterns(edges, pattern_totals(body, reached)).where(F.col("score") >= MIN_SCORE)
    new = (said.where("kind < 0").select("rid", "start", "end", "pattern").join(good, "pattern")
           .groupBy("rid", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
           .groupBy("rid").agg(F.collect_list(F.struct("start", (-F.col("best.k")).alias("k"), "end")).alias("added")))
    added = F.coalesce(F.col("added"), F.array().cast(_SPAN))
    return found.join(new.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"), "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    out = personal_spans(table(spark, sf_dir, "documents"))
    counts = [_count(i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                      (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
