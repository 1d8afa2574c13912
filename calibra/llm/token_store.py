"""Token ids in ORC files (operator 3).

Documents are range-partitioned by id, sorted, encoded and written as ORC:
integer run-length encoded id lists, row indexes every ``ROW_INDEX`` rows and
Bloom filters on ``doc_id``, so a reader takes stripes in parallel and a lookup
by id skips stripes and row groups from their metadata. Each file holds one
block (a range of ids); a row carries its block and its start inside the block,
and the start over all documents is that plus the tokens of the blocks before.

Encoding calls the tokenizer once per distinct piece of text and worker, not
once per occurrence. A piece is a run between white space, split further only
between a Latin letter and an ASCII digit or punctuation mark other than the
apostrophe; the normaliser and the splitter of the tokenizer act inside such
pieces only, so the ids equal those of the whole text (tested over whole
tables). A text that holds the first characters of a special token is encoded
whole.

A null or empty text has only the end id. Null ids come first; rows that share
an id are all written, ordered by a hash of their text. Very long texts are
encoded a few megabytes at a time with others and alone beyond that.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm import textbytes as tb
from calibra.llm.common import id_and_body, on_workers, table
from calibra.session import fresh_path

END_ID = 1
ROW_INDEX = 1000
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
               "orc.row.index.stride": str(ROW_INDEX), "orc.stripe.size": str(16 << 20)}
STORED = "block int, doc_id long, at long, n_tokens long, ids array<int>"
CACHED_IDS = 12_000_000      # ids that a worker remembers before it starts its memory anew

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) != "'"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_LATIN2 = np.zeros(256, dtype=bool)      # second bytes of the letters U+00C0 to U+00FF
_LATIN2[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def pieces(b: np.ndarray, offs: np.ndarray):
    """Pieces of each row: A-Z lower-cased bytes, starts, ends, hashes, first piece of each row."""
    low = tb.LOWER[b]
    letter, punct = _LETTER[low], _PUNCT[low]
    head = np.zeros(len(low) + 1, dtype=bool)       # first byte of a two-byte letter
    head[:-1][:-1] = (low[:-1] == 0xC3) & _LATIN2[low[1:]] if len(low) else False
    ends_letter = letter.copy()
    ends_letter[1:] |= head[:-1][:-1]
    begins_letter = letter | head[:-1]
    breaks = np.zeros(len(low), dtype=bool)
    breaks[1:] = (ends_letter[:-1] & punct[1:]) | (punct[:-1] & begins_letter[1:])
    starts, ends = tb.run_bounds(~tb.SPACE[low], offs, breaks)
    return low, starts, ends, tb.run_hashes(low, starts, ends), np.searchsorted(starts, offs)


class PieceEncoder:
    """Ids of pieces, remembered by hash in sorted arrays that grow by merging."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        kept = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
        moved = [c for c in range(256) if c not in kept]
        self.visible = {c: 256 + i for i, c in enumerate(moved)}     # byte-level names of the other bytes
        self._model_pieces = self._byte_level()
        self.forget()

    def _byte_level(self) -> bool:
        """Whether plain lower-case words may go straight to the model (checked on samples)."""
        samples = ["the", "tionst", "über", "éàüß", "straße", "ñandú", "ÿþ".lower()]
        try:
            return all(self._word(w.encode()) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in samples)
        except Exception:  # noqa: BLE001  another kind of model: every piece goes through the whole tokenizer
            return False

    def _word(self, raw: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.visible))]

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        ids: list = [None] * len(raw)
        rest = []
        for i, piece in enumerate(raw):
            if self._model_pieces and _PLAIN.fullmatch(piece):
                ids[i] = self._word(piece)
            else:
                rest.append(i)
        texts = [raw[i].decode("utf-8", "replace") for i in rest]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter((x for part in ids for x in part), np.int32, int(sizes.sum()))
        slots = np.arange(len(keys)) + len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, new])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)

    def encode(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of ids of each row."""
        low, starts, ends, h, first = pieces(b, offs)
        keys, index, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.flat) > CACHED_IDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            data = low.tobytes()
            where = index[~known]
            self.learn(keys[~known], [data[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            at = np.searchsorted(self.keys, keys)
        slot = self.slots[at][back]
        sizes = self.offsets[slot + 1] - self.offsets[slot]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(stop[-1]) + np.repeat(self.offsets[slot] - stop[:-1], sizes)
        ids = self.flat[take]
        counts = stop[first[1:]] - stop[first[:-1]]
        marked = [t for t in self.specials if t[:2] in b.tobytes()] if len(b) else []
        return self._with_specials(b, offs, ids, counts, marked) if marked else (ids, counts)

    def _with_specials(self, b, offs, ids, counts, marked):
        stop = np.concatenate([[0], np.cumsum(counts)])
        parts, sizes = [], counts.copy()
        for r in range(len(counts)):
            raw = b[offs[r]:offs[r + 1]].tobytes()
            part = ids[stop[r]:stop[r + 1]]
            if any(t[:2] in raw for t in marked):
                part = np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                sizes[r] = len(part)
            parts.append(part)
        return np.concatenate(parts), sizes


_ENCODERS: dict[int, PieceEncoder] = {}      # one per worker process and tokenizer


def encoder(tokenizer_json: str) -> PieceEncoder:
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(tokenizer_json)
    return _ENCODERS[key]


def _encode_rows(shared, end_id: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        block, at, enc = TaskContext.get().partitionId(), 0, encoder(shared.value)
        for batch in batches:
            b, offs = tb.text_bytes(batch.column(1))
            for i, j in tb.doc_groups(offs):
                ids, counts = enc.encode(b[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                stop = np.concatenate([[0], np.cumsum(counts + 1)])
                out = np.full(int(stop[-1]), end_id, dtype=np.int32)
                inside = np.ones(len(out), dtype=bool)
                inside[stop[1:] - 1] = False
                out[inside] = ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, block, np.int32)), batch.column(0).slice(i, j - i), pa.array(at + stop[:-1]),
                     pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(out))],
                    ["block", "doc_id", "at", "n_tokens", "ids"])
                at += int(stop[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to ORC files at ``path`` in ascending id order."""
    spark = docs.sparkSession
    on_workers(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    body = id_and_body(docs, id_col, text_col).withColumn("tie", F.xxhash64("body"))
    ranged = body.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "body")
    ranged.mapInArrow(_encode_rows(shared, end_id), STORED).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents with ``start``, the ids of all documents before each (from the files' own columns)."""
    rows = spark.read.schema(STORED).orc(path)
    bases = read_bases(rows)
    return rows.join(bases, F.col("block") == F.col("of_block")).withColumn("start", F.col("base") + F.col("at")).drop("of_block", "base")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Stored rows of a few ids; the filter reaches the ORC reader, which skips by row index and Bloom filter."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        stop = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        crc = [zlib.crc32(values[stop[i]:stop[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], ["block", "doc_id", "at", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, read from the files."""
    rows = spark.read.schema(STORED).orc(path)
    crc = rows.select("block", "doc_id", "at", "n_tokens", "ids").mapInArrow(
        _checksums, "block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    bases = read_bases(rows)
    return crc.join(bases, F.col("block") == F.col("of_block")).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_bases(rows: DataFrame) -> DataFrame:
    """Tokens before each block: one row per file, from the narrow columns alone."""
    totals = rows.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("block").alias("of_block"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "llm-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return token_digest(spark, path)
