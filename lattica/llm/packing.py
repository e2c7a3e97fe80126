"""Pattern packing of token sequences by non-negative least squares.

Documents are tokenized once in parallel and cut into pieces of at most the sequence length;
only the piece lengths matter then, and their histogram has at most that many rows. On it:
patterns of two, three or four pieces that fill a sequence are enumerated, repeat counts that
reproduce the histogram best are fitted by non-negative least squares, rounded down to what
the histogram holds, and the pieces left over are packed best-fit-decreasing. Spark then
deals the pieces of each length to the places found for that length, by rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.encoding import encoded, encoder, tokenizer_path
from lattica.llm.tables import ranked, staged
from lattica.llm.textkit import ragged

LIMIT = 2048
PATTERN_LIMIT = 400_000
ROWS_PER_BUCKET = 50_000


def patterns(lengths: np.ndarray, counts: np.ndarray, limit: int = LIMIT, most: int = PATTERN_LIMIT) -> np.ndarray:
    """Rows of four indices into ``lengths`` (-1: none) whose lengths add up to the sequence exactly.

    All pairs and triples, then fours whose smallest three lengths are frequent; ``most``
    bounds the columns of the fit, not the pieces packed: the rest are packed afterwards.
    """
    place = np.full(limit + 1, -1, np.int64)
    place[lengths] = np.arange(len(lengths))
    found = []
    a = np.arange(len(lengths))
    b = place[limit - lengths]
    keep = (b >= 0) & (lengths >= limit - lengths) & (lengths < limit)
    found.append(np.stack([a[keep], b[keep], np.full(keep.sum(), -1), np.full(keep.sum(), -1)], 1))
    if place[limit] >= 0:
        found.append(np.array([[place[limit], -1, -1, -1]]))
    first, second = np.triu_indices(len(lengths))
    rest = limit - lengths[first] - lengths[second]
    ok = rest >= lengths[second]
    first, second, rest = first[ok], second[ok], rest[ok]
    third = place[rest]
    ok = third >= 0
    found.append(np.stack([first[ok], second[ok], third[ok], np.full(ok.sum(), -1)], 1))
    often = np.sort(np.argsort(-counts, kind="stable")[:64])
    for x in often:
        p, q = np.triu_indices(len(often))
        p, q = often[p], often[q]
        ok = lengths[p] >= lengths[x]
        rest = limit - lengths[x] - lengths[p] - lengths[q]
        ok &= rest >= lengths[q]
        fourth = place[np.where(ok, rest, 0)]
        ok &= fourth >= 0
        found.append(np.stack([np.full(ok.sum(), x), p[ok], q[ok], fourth[ok]], 1))
    every = np.concatenate(found)
    if len(every) > most:
        weight = np.where(every >= 0, counts[every], np.iinfo(np.int64).max).min(1)
        every = every[np.argsort(-weight, kind="stable")[:most]]
    return every


def fit_repeats(columns: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares ``|A x - counts|`` by accelerated projected gradients."""
    used = columns >= 0
    safe = np.where(used, columns, 0)
    n = len(counts)

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(safe[:, k], x * used[:, k], n) for k in range(4))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[safe] * used).sum(1)

    degree = np.maximum(back(forward(np.ones(len(columns)))), 1.0)  # bounds the curvature of each coordinate
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(y - back(forward(y) - counts) / degree, 0.0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def pack_histogram(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, list[int]]]:
    """(first sequence, how many sequences, lengths in order) runs that hold every piece."""
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    runs: list[tuple[int, int, list[int]]] = []
    used = 0
    if len(lengths):
        columns = patterns(lengths, counts, limit)
        if len(columns):
            repeats = fit_repeats(columns, counts.astype(float))
            for k in np.argsort(-repeats, kind="stable"):
                if repeats[k] < 0.5:
                    break
                row = columns[k][columns[k] >= 0]
                kinds, needs = np.unique(row, return_counts=True)
                n = int(min(round(repeats[k]), (counts[kinds] // needs).min()))
                if n > 0:
                    counts[kinds] -= n * needs
                    runs.append((used, n, lengths[row].tolist()))
                    used += n
    return runs + best_fit_rest(lengths, counts, used, limit)


def best_fit_rest(lengths: np.ndarray, counts: np.ndarray, used: int, limit: int) -> list[tuple[int, int, list[int]]]:
    """Best-fit-decreasing on a histogram; open sequences with the same content move together."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, n: int, content: list[int]) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((n, content))

    for size, count in zip(lengths.tolist(), counts.tolist(), strict=True):
        while count:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = limit // size
                full, rest = divmod(count, each)
                if full:
                    put(limit - each * size, full, [size] * each)
                if rest:
                    put(limit - rest * size, 1, [size] * rest)
                count = 0
                continue
            room = rooms[at]
            n, content = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full = min(n, count // each)
            if full:
                put(room - each * size, full, content + [size] * each)
            count, left = count - full * each, n - full
            if left and count:
                put(room - count * size, 1, content + [size] * count)
                count, left = 0, left - 1
            if left:
                put(room, left, content)
    runs = []
    for groups in open_.values():
        for n, content in groups:
            runs.append((used, n, content))
            used += n
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, path: str, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, False)
        for batch in batches:
            names = batch.column("doc_id").cast(pa.int64())
            for first, last, ids, at in encoded(batch, "text", tool):
                n = last - first
                sizes = np.diff(at) + 1
                out = np.full(len(ids) + n, end_id, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(n), sizes - 1)] = ids
                each = -(-sizes // limit)
                piece = ragged(each)
                begin = np.repeat(np.cumsum(sizes) - sizes, each)
                length = np.minimum(np.repeat(sizes, each) - piece * limit, limit)
                sums = [zlib.crc32(out[b:e]) for b, e in zip((begin + piece * limit).tolist(), (begin + piece * limit + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, n).take(pa.array(np.repeat(np.arange(n), each))),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * limit),
                        pa.array(length),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, limit: int = LIMIT) -> DataFrame:
    """Pack every document's tokens, each document ended by ``end_id``, into sequences of ``limit``.

    Only documents above ``limit`` tokens are cut, into pieces of ``limit``; the last piece may
    be shorter. Null text packs as the end id alone; rows with null or repeated ids pack like
    any other; an empty table packs into nothing. Columns: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = staged(tokenized_pieces(docs, path, end_id, limit), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    runs = pack_histogram(histogram, limit)
    places: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for first, n, content in runs:
        at = 0
        for size, same in groupby(content):
            times = len(list(same))
            mine = places.setdefault(size, [])
            low = mine[-1][0] + mine[-1][4] if mine else 0
            mine.append((low, first, times, at, n * times))
            at += size * times
    rows = sorted((size, low, first, times, at) for size, mine in places.items() for low, first, times, at, _ in mine)
    # One row per pattern and length in it: at most four times PATTERN_LIMIT rows, and the rest's.
    runs_sent = docs.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, first, times, at = runs_sent.value.T
        key = size * _RANKS + low
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            run = np.searchsorted(key, length * _RANKS + rank, "right") - 1
            inside = rank - low[run]
            found = [first[run] + inside // times[run], at[run] + inside % times[run] * length]
            yield pa.RecordBatch.from_arrays([*(batch.column(c.split()[0]) for c in PIECES.split(", ")), *map(pa.array, found)], _PACKED)

    buckets = max(16, sum(histogram.values()) // ROWS_PER_BUCKET)
    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", buckets)
    return numbered.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


_RANKS = 1 << 44
_PACKED = [*(c.split()[0] for c in PIECES.split(", ")), "sequence_id", "offset"]
