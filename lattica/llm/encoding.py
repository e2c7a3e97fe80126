"""Token ids of texts by a public tokenizer, one library call per distinct span.

A text is cut into spans that the tokenizer never joins, each distinct span is encoded once
by the ``tokenizers`` library, and the ids of a text are gathered from those of its spans.
A Python worker remembers spans across batches in a table of bounded size. Texts in which
the cuts would not be safe go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lattica.llm.textkit import NOT_SPACE, blocks, packed, ragged, same_spans, span_hashes, spans

SPAN_LIMIT = 1_200_000
_SLOT_BITS = 21
#: White space outside ASCII, and the special token that the byte-level vocabulary cuts out first.
_UNSAFE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|endoftext\|>"
)


def load(path: str):
    """A tokenizer that works on one thread, as each task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class SpanMemory:
    """Values of spans: a direct-mapped table by hash in front of a dictionary by hash.

    The bytes of every entry are kept and compared with those asked for, so two spans of one
    hash never share an entry: the second is kept by its bytes.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = SPAN_LIMIT):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.odd: dict[bytes, int] = {}
        self.slot_key = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.slot_entry = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.values = np.zeros(0, np.uint32)
        self.begins = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.spans = np.zeros(1, np.int64)

    def _add(self, pieces: list[bytes]) -> int:
        """Encode new spans; the entry of the first of them."""
        values, lengths = self.encode(pieces)
        base = len(self.begins) - 1
        self.values = np.concatenate([self.values, values.astype(np.uint32)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths)])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        self.spans = np.concatenate([self.spans, self.spans[-1] + np.cumsum([len(p) for p in pieces])])
        return base

    def lookup(self, hashes: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each span of ``raw``, given its hash."""
        if len(self.index) > self.limit:
            self.clear()
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        entry = np.where(self.slot_key[slot] == hashes, self.slot_entry[slot], -1)
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            get = self.index.get
            found = np.array([get(h, -1) for h in hashes[missed].tolist()], np.int64)
            new = missed[found < 0]
            if len(new):
                keys, first = np.unique(hashes[new], return_index=True)
                base = self._add([raw[begin[i] : end[i]].tobytes() for i in new[first].tolist()])
                self.index.update(zip(keys.tolist(), range(base, base + len(keys)), strict=True))
                found = np.where(found < 0, base + np.searchsorted(keys, hashes[missed]).clip(0, len(keys) - 1), found)
            entry[missed] = found
            self.slot_key[slot[missed]] = hashes[missed]
            self.slot_entry[slot[missed]] = found
        same = same_spans(raw, begin, end, self.bytes, self.spans[entry], self.spans[entry + 1])
        for i in np.flatnonzero(~same).tolist():
            piece = raw[begin[i] : end[i]].tobytes()
            if piece not in self.odd:
                self.odd[piece] = self._add([piece])
            entry[i] = self.odd[piece]
        return entry


def byte_level_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts no byte-level pre-token crosses: a word with one space before it, and what is left of white space."""
    begin, end, before = spans(raw, starts, NOT_SPACE)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(before))
    previous = np.concatenate([[0], end[:-1]]) if len(end) else end
    first = np.zeros(len(begin), bool)
    first[before[:-1][np.diff(before) > 0]] = True
    previous = np.where(first, starts[:-1][text], previous) if len(begin) else previous
    gap = begin - previous
    last = np.maximum(begin - 1, 0)
    joined = (gap > 0) & (raw[last] == 32) if len(begin) else np.zeros(0, bool)
    single = (gap > 0) & ~joined
    lead = gap - 1
    tail_from = starts[:-1].copy()
    has = np.diff(before) > 0
    tail_from[has] = end[before[1:][has] - 1]
    tail = starts[1:] > tail_from
    b = np.concatenate([begin - joined, previous[lead > 0], begin[single] - 1, tail_from[tail]])
    e = np.concatenate([end, begin[lead > 0] - 1, begin[single], starts[1:][tail]])
    order = np.argsort(b, kind="stable")
    b, e = b[order], e[order]
    return b, e, np.searchsorted(b, starts)


class Encoder:
    """Ids of whole texts by one vocabulary file; ``byte_level`` as the file's pre-tokenizer has it."""

    def __init__(self, path: str, byte_level: bool):
        self.tokenizer, self.byte_level = load(path), byte_level
        self.memory = SpanMemory(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [x.ids for x in found]
        lengths = np.array([len(x) for x in ids], np.int64)
        return np.array([i for x in ids for i in x], np.uint32), lengths

    def block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts end to end, and where each text's begin."""
        begin, end, before = byte_level_spans(raw, starts) if self.byte_level else spans(raw, starts, NOT_SPACE)
        data = raw.tobytes()
        entry = self.memory.lookup(span_hashes(raw, begin, end), raw, begin, end)
        sizes = np.diff(self.memory.begins)[entry] if len(entry) else np.zeros(0, np.int64)
        ids = self.memory.values[np.repeat(self.memory.begins[entry], sizes) + ragged(sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = total[before]
        whole = self._whole(data, starts) if self.byte_level else {}
        if whole:
            parts = [whole.get(k, ids[at[k] : at[k + 1]]) for k in range(len(starts) - 1)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at

    def _whole(self, data: bytes, starts: np.ndarray) -> dict[int, np.ndarray]:
        texts = {int(np.searchsorted(starts, m.start(), "right")) - 1 for m in _UNSAFE.finditer(data)}
        return {k: self._encode([data[starts[k] : starts[k + 1]]])[0] for k in texts}


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, byte_level: bool) -> Encoder:
    """The worker's encoder for a file; kept so that its memory serves later tasks."""
    key = (path, byte_level)
    if key not in _encoders:
        _encoders[key] = Encoder(path, byte_level)
    return _encoders[key]


def encoded(batch: pa.RecordBatch, text: str, tool: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, begins) for blocks of a batch."""
    raw, starts = packed(batch.column(text))
    for first, last in blocks(starts):
        base = starts[first]
        yield first, last, *tool.block(raw[base : starts[last]], starts[first : last + 1] - base)
