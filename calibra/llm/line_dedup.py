"""Line deduplication with levelled sorted runs of line hashes (operator 10).

Documents arrive in batches. A run is a table of (line hash, documents, largest
id), sorted by hash and written once to the shared folder. A new batch is
summed to the same form and merge-anti-joined with the runs: a line that the
runs already settle (enough documents, and a holder with an id at least as
large) needs no new entry, the others are added as the batch's own run of level
0. When a level holds ``fanout`` runs they are merged into one run of the next
level, so few runs exist at any time and each entry is rewritten a logarithmic
number of times. Sums and maxima do not depend on the order of the batches;
with the newest batch first a frequent line settles early and is never written
again.

A line's key is the line without white space at both ends, A-Z lower-cased, as
a 128-bit hash. Keys of at least ``min_chars`` code points in at least
``min_docs`` documents keep only the lines of the largest id that holds them.

In the last join a frequent line would meet all its documents in one task, so keys
that hold at least a 1024th of the rows are dealt by id over as many parts as they
hold 1024ths. There are at most 1024 such keys and 2048 parts whatever the corpus, so
their table is broadcast (:func:`hot_keys`).

Texts are split in whole; a null or empty text is one empty line. Each row
counts as one document for ``min_docs`` (a repeated row is one more); a row with
a null id counts too and is never the largest while another holds the line.
Rows with the largest id all keep their lines. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import cut, id_and_body, on_workers, table
from calibra.session import fresh_path

NO_ID = -(1 << 63)
RUN = "hi long, lo long, docs long, top long"
HOT_SHARE = 1024        # a key in more than 2 of so many rows is dealt over several tasks
_STRIP = b" \t\n\r\x0b\x0c"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a long enough line, else None."""
    key = line.strip(_STRIP)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def _row_lines(batch):
    b, offs = tb.text_bytes(batch.column(1))
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    for r in range(batch.num_rows):
        yield int(ids[r]), b[offs[r]:offs[r + 1]].tobytes().split(b"\n")


def _line_hashes(min_chars: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            parts, ids, sizes = [], [], []
            for doc, lines in _row_lines(batch):
                keys = {k for k in (line_key(x, min_chars) for x in lines) if k is not None}
                parts.extend(map(digest, keys))
                ids.append(doc)
                sizes.append(len(keys))
            h = np.frombuffer(b"".join(parts), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                                              pa.array(np.repeat(np.array(ids, np.int64), sizes))], ["hi", "lo", "id"])
    return run


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(hi, lo, id): the distinct long line keys of every document."""
    on_workers(docs.sparkSession)
    return id_and_body(docs, id_col, text_col).mapInArrow(_line_hashes(min_chars), "hi long, lo long, id long")


class LineRuns:
    """The levelled runs; the list of their paths is all that lives in the driver."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = [[]]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def _write(self, rows: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"llm-run{level}")
        rows.select("hi", "lo", "docs", "top").sortWithinPartitions("hi", "lo").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def settled(self) -> DataFrame | None:
        """Keys that are in enough documents so far, with their largest id."""
        return self._merged(self._read(self.paths())).where(F.col("docs") >= self.min_docs) if self.paths() else None

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (hi, lo, id)."""
        own = lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("top"))
        known = self.settled()
        if known is not None:
            known = known.select(F.col("hi").alias("khi"), F.col("lo").alias("klo"), F.col("top").alias("ktop"))
            own = own.join(known, (F.col("hi") == F.col("khi")) & (F.col("lo") == F.col("klo")) & (F.col("ktop") >= F.col("top")), "left_anti")
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(self._read(full)), level + 1)
            level += 1

    def duplicated(self) -> DataFrame:
        """(hi, lo, top) of all keys held by enough documents."""
        known = self.settled()
        if known is None:
            return self.spark.createDataFrame([], RUN).drop("docs")
        return known.select("hi", "lo", "top")


def _frequent_in_batch(share: int):
    """Keys with at least one of ``share`` rows of an Arrow batch, with their rows there."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = np.empty(batch.num_rows, dtype=[("hi", np.int64), ("lo", np.int64)])
            pairs["hi"], pairs["lo"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, held = np.unique(pairs, return_counts=True)
            often = held * share >= batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys["hi"][often])), pa.array(np.ascontiguousarray(keys["lo"][often])),
                                              pa.array(held[often].astype(np.int64))], ["khi", "klo", "held"])
    return run


def hot_keys(hashed: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """(khi, klo, parts): every key with at least 2 of ``share`` rows, and none with fewer than 1.

    A batch leaves out less than a ``share``-th of its rows for any key, so what all of them
    leave out of a key is less than a ``share``-th of all rows. At most ``share`` keys.
    """
    total = hashed.count()
    found = hashed.select("hi", "lo").mapInArrow(_frequent_in_batch(share), "khi long, klo long, held long")
    parts = F.floor(F.col("held") * F.lit(share) / F.lit(max(total, 1))).cast("int") + 1
    return (found.groupBy("khi", "klo").agg(F.sum("held").alias("held")).where(F.col("held") * F.lit(share) >= F.lit(max(total, 1)))
            .select("khi", "klo", parts.alias("parts")))


def doomed_lines(hashed: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key): the rows of ``hashed`` whose key is in ``keys`` (hi, lo, top) with a larger id; hot keys are salted."""
    hot = F.broadcast(cut(hot_keys(hashed), "hot-lines"))
    same = lambda df: (df["hi"] == hot["khi"]) & (df["lo"] == hot["klo"])
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts").cast("long")), F.lit(0).cast("long"))
    left = hashed.join(hot, same(hashed), "left").select("hi", "lo", "id", part.alias("part"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts").cast("long"), F.lit(1).cast("long")) - 1))
    right = keys.join(hot, same(keys), "left").select(F.col("hi").alias("of_hi"), F.col("lo").alias("of_lo"), "top", every.alias("of_part"))
    met = left.join(right, (F.col("hi") == F.col("of_hi")) & (F.col("lo") == F.col("of_lo")) & (F.col("part") == F.col("of_part"))
                    & (F.col("id") < F.col("top")))
    return met.select("id", F.concat(*[F.lpad(F.hex(x), 16, "0") for x in ("hi", "lo")]).alias("key"))


def _drop_lines(min_chars: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            drops = batch.column(2)
            total, gone, kept = [], [], []
            for r, (_, lines) in enumerate(_row_lines(batch)):
                raw = np.frombuffer(bytes.fromhex(drops[r].as_py() or ""), dtype=">u8").astype("<u8").tobytes()
                out = {raw[i:i + 16] for i in range(0, len(raw), 16)}
                if out:
                    stay = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in out]
                else:
                    stay = lines
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(total, pa.int64()),
                                              pa.array(gone, pa.int64())], ["doc_id", "kept", "n_lines", "n_dropped"])
    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, kept (UTF-8 bytes of the remaining lines), n_lines, n_dropped of every document.

    ``docs`` is fed to the runs in ``batches`` of equal id ranges, newest first
    (a feed of arriving batches calls :class:`LineRuns` itself).
    """
    spark = docs.sparkSession
    hashed_path = fresh_path(spark, "llm-lines")
    hashed = line_hashes(docs, id_col, text_col, min_chars)
    hashed.write.parquet(hashed_path)
    hashed = spark.read.schema("hi long, lo long, id long").parquet(hashed_path)
    low, high = hashed.where(F.col("id") > NO_ID).agg(F.min("id"), F.max("id")).first()
    runs = LineRuns(spark, min_docs, fanout)
    edges = [] if low is None else sorted({low + (high - low) * i // batches for i in range(1, batches)}, reverse=True)
    for upper, lower in zip([None, *edges], [*edges, None]):
        part = hashed
        if lower is not None:
            part = part.where(F.col("id") > lower)
        if upper is not None:
            part = part.where(F.col("id") <= upper)
        runs.add(part)
    drops = (doomed_lines(hashed, runs.duplicated()).distinct()
             .groupBy("id").agg(F.array_join(F.collect_list("key"), "").alias("drops")))
    drops = drops.withColumnRenamed("id", "of")
    body = id_and_body(docs, id_col, text_col)
    joined = body.join(drops, F.coalesce("id", F.lit(NO_ID)) == F.col("of"), "left").select("id", "body", "drops")
    return joined.mapInArrow(_drop_lines(min_chars), "doc_id long, kept binary, n_lines long, n_dropped long")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
