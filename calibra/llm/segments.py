"""Texts cut into segments that a subword tokenizer codes alike alone and in place.

A segment begins at a row's start or at a space that follows something other
than white space, and holds what comes before the next such space. Byte-level
BPE splits its input there before it merges, and a piece model merges across it
only with a piece that has a space mark behind another character; both are
checked in the tokenizer's own files, and a tokenizer that fails the check gets
whole rows. A space that ends a row stays with what precedes it.

Every distinct segment is coded once per worker and remembered by a 64-bit hash
in sorted arrays, which start anew beyond ``CACHED_IDS`` ids. White space that
may end in a multi-byte character is never a cut.
"""
from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np

from calibra.llm import textbytes as tb

CACHED_IDS = 8_000_000
JOINED = 1 << 14             # bytes of segments coded as one text
CODED_AT_ONCE = 1 << 16      # bytes handed to a tokenizer in one call

_WIDE_LEADS = np.zeros(256, dtype=bool)     # first bytes of three-byte characters among which white space is found
_WIDE_LEADS[[0xE1, 0xE2, 0xE3]] = True
_NARROW = np.zeros(256, dtype=bool)         # second bytes of two-byte white space
_NARROW[[0x85, 0xA0]] = True


def bounds(b: np.ndarray, offs: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the segments, and the index of each row's first (one more entry than rows)."""
    begins = np.zeros(len(b) + 1, dtype=bool)
    if len(b) and not whole:
        space = tb.SPACE[b]
        space[1:] |= (b[:-1] == 0xC2) & _NARROW[b[1:]]
        space[2:] |= _WIDE_LEADS[b[:-2]]
        begins[1:-1] = (b[1:] == 0x20) & ~space[:-1]
        last = offs[1:] - 1
        begins[last[last >= 0]] = False
    begins[offs[:-1][offs[1:] > offs[:-1]]] = True
    starts = np.flatnonzero(begins[:-1])
    first = np.searchsorted(starts, offs)
    ends = np.append(starts[1:], len(b)) if len(starts) else starts
    return starts, ends, first


def take_runs(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[begin[i]:begin[i] + sizes[i]]`` one after the other."""
    stop = np.cumsum(sizes)
    total = int(stop[-1]) if len(stop) else 0
    return values[np.arange(total) + np.repeat(begin - (stop - sizes), sizes)]


class Coder:
    """Ids of segments by a tokenizer, remembered by the segments' hashes."""

    whole = False
    checked = True       # whether ``good`` is wanted

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def code(self, raw: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def check(self, raw: bytes, ids: list[int]) -> bool:
        """Whether the ids' bytes are those of the segment."""
        return True

    def coded(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some segments, where each segment's begin, how many they are, and whether their bytes are the segment's."""
        ids: list[list[int]] = []
        part, held = [], 0
        for x in raw:
            part.append(x)
            held += len(x)
            if held >= CODED_AT_ONCE:
                ids.extend(self.code(part))
                part, held = [], 0
        if part:
            ids.extend(self.code(part))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        good = np.fromiter(map(self.check, raw, ids), bool, len(ids)) if self.checked else np.ones(len(ids), bool)
        return new, np.cumsum(sizes) - sizes, sizes, good

    def learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        new, begin, sizes, good = self.coded(raw)
        slots = np.arange(len(keys)) + len(self.sizes)
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.good = np.concatenate([self.good, good])
        self.flat = np.concatenate([self.flat, new])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)

    def find(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Slot of every segment; unknown ones are coded first."""
        keys, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.flat) > CACHED_IDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            data, where = b.tobytes(), index[~known]
            self.learn(keys[~known], [data[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][back]

    def rows(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        starts, ends, first = bounds(b, offs, self.whole)
        slot = self.find(b, starts, ends, tb.run_hashes(b, starts, ends))
        sizes = self.sizes[slot]
        stop = np.concatenate([[0], np.cumsum(sizes)])
        return take_runs(self.flat, self.begin[slot], sizes), stop[first[1:]] - stop[first[:-1]]


def byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies (printable ones for themselves, the rest from U+0100 on)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [c for c in range(256) if c not in set(own)]
    return {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(rest)}


class ByteLevel(Coder):
    """A byte-level BPE of the tokenizers library; ``plain_specials``: special strings in texts are plain text."""

    def __init__(self, tokenizer_json: str, plain_specials: bool):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = self.checked = plain_specials
        spec = json.loads(tokenizer_json)
        splitter = spec.get("pre_tokenizer") or {}
        spaced = [t["content"] for t in spec.get("added_tokens", []) if " " in t["content"] or t.get("lstrip") or t.get("rstrip")]
        self.whole = not (spec.get("normalizer") is None and splitter.get("type") == "ByteLevel"
                          and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not spaced)
        names, size = byte_names(), self.tokenizer.get_vocab_size()
        self.bytes = [bytes(names[c] for c in t) if t and all(c in names for c in t) else (t or "").encode()
                      for t in (self.tokenizer.id_to_token(i) for i in range(size))]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def code(self, raw):
        texts = [x.decode("utf-8", "replace") for x in raw]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def check(self, raw, ids):
        return b"".join([self.bytes[i] for i in ids]) == raw

    def coded(self, raw):
        """Segments that may follow each other are coded as one text of some kilobytes, and its ids are dealt out by their bytes;
        where those are not the text's, one by one."""
        if self.whole:
            return super().coded(raw)
        sizes, begin, good = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), np.zeros(len(raw), bool)
        alone, flats, total = [], [], 0
        joined: list[list[int]] = [[]]
        held = 0
        for i, x in enumerate(raw):
            if x[0] != 0x20 or len(x) < 2 or not 0x20 < x[-1] < 0x7F:
                alone.append(i)
                continue
            joined[-1].append(i)
            held += len(x)
            if held >= JOINED:
                joined.append([])
                held = 0
        for k in range(0, len(joined), CODED_AT_ONCE // JOINED):
            some = [j for j in joined[k:k + CODED_AT_ONCE // JOINED] if j]
            texts = [b"".join([raw[i] for i in j]) for j in some]
            for j, text, ids in zip(some, texts, self.code(texts)):
                ids = np.array(ids, np.int32)
                token_ends, ends = np.cumsum(self.lengths[ids]), np.cumsum([len(raw[i]) for i in j])
                stop = np.searchsorted(token_ends, ends, side="right")
                if not len(ids) or stop[0] == 0 or (token_ends[stop - 1] != ends).any() or b"".join([self.bytes[t] for t in ids.tolist()]) != text:
                    alone += j
                    continue
                start = np.concatenate([[0], stop[:-1]])
                begin[j], sizes[j], good[j] = total + start, stop - start, True
                flats.append(ids)
                total += len(ids)
        if alone:
            new, at, many, fine = super().coded([raw[i] for i in alone])
            begin[alone], sizes[alone], good[alone] = total + at, many, fine
            flats.append(new)
        return np.concatenate(flats) if flats else np.zeros(0, np.int32), begin, sizes, good


class PieceModel(Coder):
    """A sentencepiece model that sets a space before its input; segments begin with that space."""

    def __init__(self, model: bytes):
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, mark = spec.normalizer_spec, "▁"
        crossing = any(mark in p.piece.lstrip(mark) for p in spec.pieces)
        self.whole = crossing or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
        single = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        self.bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == single else p.piece.replace(mark, " ").encode() for p in spec.pieces]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def code(self, raw):
        return self.model.encode([x.decode("utf-8", "replace")[1:] for x in raw], num_threads=1)

    def check(self, raw, ids):
        return b"".join([self.bytes[i] for i in ids]) == raw


_CODERS: dict = {}       # one per worker process and tokenizer


def byte_level(tokenizer_json: str, plain_specials: bool) -> ByteLevel:
    key = (zlib.crc32(tokenizer_json.encode()), plain_specials)
    if key not in _CODERS:
        _CODERS[key] = ByteLevel(tokenizer_json, plain_specials)
    return _CODERS[key]


def piece_model(model: bytes) -> PieceModel:
    key = zlib.crc32(model)
    if key not in _CODERS:
        _CODERS[key] = PieceModel(model)
    return _CODERS[key]
