"""Token counts by rank-synchronous merging of ragged symbol arrays.

Pre-tokens of a batch lie end to end in one symbol array. In each round every pre-token that
still has a known pair merges its lowest-rank pair, all of them in the same array operations;
symbols left at the end are its tokens. Each distinct span of a batch is merged once, and a
worker remembers the counts of spans it has seen in a table of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattica.llm.encoding import _UNSAFE, SpanMemory, byte_level_spans, tokenizer_path
from lattica.llm.textkit import blocks, packed, span_hashes

SPECIAL = b"<|endoftext|>"
_NO_RANK = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class RankMerger:
    """Byte pair merging of many sequences at once."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.size = max(vocab.values()) + 1
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in rules], np.int64)
        made = np.array([vocab[a + b] for a, b in rules], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.searchsorted(self.keys, pair).clip(0, len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NO_RANK)

    def counts(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each byte sequence; ``raw`` holds them end to end."""
        left_over = np.zeros(len(lengths), np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        symbols = self.first[raw]
        while len(symbols):
            rank = np.full(len(symbols), _NO_RANK)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(begins, append=len(symbols))
            lowest = np.minimum.reduceat(rank, begins)
            done = lowest == _NO_RANK
            left_over[owner[begins[done]]] = sizes[done]
            alive = np.repeat(~done, sizes)
            chosen = alive & (rank == np.repeat(lowest, sizes))
            place = np.flatnonzero(chosen)
            if len(place) == 0:
                break
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)  # a a a: the first two merge
            nth = np.arange(len(place)) - np.repeat(run, np.diff(run, append=len(place)))
            place = place[nth % 2 == 0]
            symbols = symbols.copy()
            symbols[place] = self.made[rank[place]]
            alive[place + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        return left_over

    def spans(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token count of each span, as one value per span."""
        words: dict[bytes, int] = {}
        parts = []
        for piece in pieces:
            for k, text in enumerate(piece.split(SPECIAL)):
                if k:
                    parts.append(-1)
                parts += [words.setdefault(w.encode(), len(words)) for w in self.pattern.findall(text.decode())]
            parts.append(-2)
        sizes = np.array([len(w) for w in words], np.int64)
        known = np.append(self.counts(np.frombuffer(b"".join(words), np.uint8), sizes), [0, 1])
        parts = np.array(parts, np.int64)
        total = np.concatenate([[0], np.cumsum(known[parts])])  # -1 is the special token, -2 the end of a span
        ends = np.flatnonzero(parts == -2)
        return np.diff(total[ends], prepend=0), np.ones(len(pieces), np.int64)


_mergers: dict[str, tuple[RankMerger, SpanMemory]] = {}


def _merger(path: str) -> tuple[RankMerger, SpanMemory]:
    if path not in _mergers:
        tool = RankMerger(path)
        _mergers[path] = (tool, SpanMemory(tool.spans))
    return _mergers[path]


def _block_counts(raw: np.ndarray, starts: np.ndarray, tool: RankMerger, memory: SpanMemory) -> np.ndarray:
    data = raw.tobytes()
    begin, end, before = byte_level_spans(raw, starts)
    entry = memory.lookup(span_hashes(raw, begin, end), raw, begin, end)
    total = np.concatenate([[0], np.cumsum(memory.values[memory.begins[entry]].astype(np.int64))])
    found = np.diff(total[before])
    for k in {int(np.searchsorted(starts, m.start(), "right")) - 1 for m in _UNSAFE.finditer(data)}:
        found[k] = tool.spans([data[starts[k] : starts[k + 1]]])[0][0]
    return found


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, as the library counts them for a byte-level vocabulary file.

    Null text counts as empty: 0 bytes, 0 tokens. Rows with null or repeated ids are kept as
    they are; the special string inside a text is one token. Columns: doc_id, n_bytes,
    n_tokens, over_limit (more than ``limit`` tokens).
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, memory = _merger(path)
        for batch in batches:
            raw, starts = packed(batch.column("text"))
            found = [np.zeros(0, np.int64)]
            for first, last in blocks(starts):
                base = starts[first]
                found.append(_block_counts(raw[base : starts[last]], starts[first : last + 1] - base, tool, memory))
            tokens = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
