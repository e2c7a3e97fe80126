"""Array views of text columns shared by the operators: packing, words, hashes.

All of it works on UTF-8 bytes of a batch of texts laid end to end, so that a task handles
millions of words with a few array operations. Nothing here looks across documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15 | 1
#: Spans over this many bytes are digested one by one by the library instead of in rounds.
LONG_SPAN = 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first 0 to 8 bytes of a little-endian word.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


NOT_SPACE = ~byte_set(SPACES)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array end to end, and where each value begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def blocks(starts: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def spans(raw: np.ndarray, starts: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes inside each text: begin, end, and the number before each text."""
    inside = member[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return begin, end, np.searchsorted(begin, starts)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as little-endian words (zeros past the end), without a copy per place."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans of one block, after mapping bytes by ``letters``.

    Eight bytes a round are mixed in, all spans together; each round is a keyed bijection of
    the state and none is linear in the bytes, so no pattern of bytes cancels out. Spans of
    up to eight bytes and one length never collide. Where a result must be exact, callers
    still compare bytes (``same_spans``).
    """
    raw = raw if letters is None else letters[raw]
    view, length = words_at(raw), end - begin
    found = mixed(length.astype(np.uint64) + np.uint64(_BASE))
    live, at, left = np.arange(len(begin)), begin, length
    long_ = np.flatnonzero(length > LONG_SPAN)
    if len(long_):
        keep = length <= LONG_SPAN
        live, at, left = live[keep], at[keep], left[keep]
        for k in long_.tolist():
            digest = hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest()
            found[k] = np.uint64(int.from_bytes(digest, "little"))
    while len(live):
        word = view[at] & _HEAD[np.minimum(left, 8)]
        found[live] = mixed(found[live] ^ word) + np.uint64(_BASE)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return found


def same_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether span i of ``raw`` and span i of ``other`` hold the same bytes."""
    same = (end - begin) == (last - first)
    mine, theirs = words_at(raw), words_at(other)
    live = np.flatnonzero(same)
    a, b, left = begin[live], first[live], (end - begin)[live]
    while len(live):
        differ = ((mine[a] ^ theirs[b]) & _HEAD[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        more = (left > 8) & ~differ
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def distinct_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every span, equal where the bytes are equal, and a span of each number. Exact."""
    hashes = span_hashes(raw, begin, end)
    order = np.argsort(hashes)
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order][1:] != hashes[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    if same_spans(raw, begin, end, raw, begin[first][number], end[first][number]).all():
        return number, first
    data, seen, first_of = raw.tobytes(), {}, []
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        number[k] = seen.setdefault(data[a:b], len(seen))
        if number[k] == len(first_of):
            first_of.append(k)
    return number, np.array(first_of, np.int64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive word hashes (one block, edges not checked)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= np.uint64(_BASE)
        total += words[k : k + n]
    return mixed(total)


def owners(before: np.ndarray) -> np.ndarray:
    """The text of each item, from the number of items before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)
