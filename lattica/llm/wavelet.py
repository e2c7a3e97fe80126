"""Token ids in wavelet-matrix files, one per shard of consecutive documents.

A shard's ids become one bit-plane per bit of the vocabulary, highest bit first; each plane
lists the ids in the order left by the stable partitions of the planes above it. Planes with
counts of ones before every 512th bit answer access, rank (count before a place) and select
(n-th occurrence) in one pass over the planes. A file is a header, the zeros of each plane,
document ids and lengths, and the planes; it is compressed as a whole and opened as a whole.

Documents are range-partitioned by id, encoded in order, and cut into shards of bounded size;
each shard is one row of a written table with the file's bytes, so that executors need no
folder but the shared one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.encoding import encoded, encoder, tokenizer_path
from lattica.llm.tables import partitions, staged, text_bytes
from lattica.llm.textkit import ragged

MAGIC = b"WVM1"
PLANE_STEP = 512
SHARD_TOKENS = 2_000_000
TARGET_BYTES = 32 << 20
_HEADER = struct.Struct("<4sBQQ")


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros, self.bits = n, planes, zeros, len(planes)
        self.ones = []
        for plane in planes:
            padded = np.zeros(-(-len(plane) // (PLANE_STEP // 8)) * (PLANE_STEP // 8), np.uint8)
            padded[: len(plane)] = plane
            sums = np.bitwise_count(padded).reshape(-1, PLANE_STEP // 8).sum(1, dtype=np.int64)
            self.ones.append(np.concatenate([[0], np.cumsum(sums)]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        planes, zeros, order = [], [], np.asarray(ids, np.uint32)
        for bit in range(bits - 1, -1, -1):
            one = (order >> np.uint32(bit)) & np.uint32(1) == 1
            planes.append(np.packbits(one, bitorder="little"))
            order = np.concatenate([order[~one], order[one]])
            zeros.append(int(len(one) - np.count_nonzero(one)))
        return cls(len(ids), planes, zeros)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        at = np.atleast_1d(np.asarray(at, np.int64))
        step = at // PLANE_STEP
        total = self.ones[level][step].copy()
        bytes_from, full = step * (PLANE_STEP // 8), (at % PLANE_STEP) // 8
        plane = self.planes[level]
        flat = np.repeat(bytes_from, full) + ragged(full)
        if len(flat):
            np.add.at(total, np.repeat(np.arange(len(at)), full), np.bitwise_count(plane[flat]).astype(np.int64))
        rest = (at % 8).astype(np.uint8)
        some = np.flatnonzero(rest)
        part = plane[at[some] >> 3] & ((np.uint8(1) << rest[some]) - np.uint8(1))
        total[some] += np.bitwise_count(part)
        return total

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, np.int64).copy()
        value = np.zeros(len(at), np.uint32)
        for level in range(self.bits):
            bit = self._bit(level, at)
            value = (value << np.uint32(1)) | bit
            ones = self._ones_before(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.bits):
            a, b = self._ones_before(level, np.array([low, high]))
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + int(a), self.zeros[level] + int(b)
            else:
                low, high = low - int(a), high - int(b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before place ``end``."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, in order."""
        low, high = self._range(token, self.n)
        at = np.arange(low, high, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little")
            if token >> (self.bits - 1 - level) & 1:
                at = np.flatnonzero(bits)[at - self.zeros[level]]
            else:
                at = np.flatnonzero(bits == 0)[at]
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: the stable partitions undone from the last plane up."""
        order = np.zeros(self.n, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            back = np.empty(self.n, np.uint32)
            back[~one] = order[: self.zeros[level]]
            back[one] = order[self.zeros[level] :] | np.uint32(1 << (self.bits - 1 - level))
            order = back
        return order


def file_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    parts = [
        _HEADER.pack(MAGIC, matrix.bits, matrix.n, len(doc_ids)),
        np.array(matrix.zeros, "<u8").tobytes(),
        doc_ids.astype("<i8").tobytes(),
        lengths.astype("<u4").tobytes(),
        *(plane.tobytes() for plane in matrix.planes),
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def open_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix of a file, its document ids (in order) and their token counts."""
    data = zstandard.ZstdDecompressor().decompress(data)
    magic, bits, n, docs = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet-matrix token file")
    at = _HEADER.size
    zeros = np.frombuffer(data, "<u8", bits, at)
    at += 8 * bits
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    lengths = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    size = -(-n // 8)
    planes = [np.frombuffer(data, np.uint8, size, at + k * size) for k in range(bits)]
    return WaveletMatrix(n, planes, [int(z) for z in zeros]), doc_ids, lengths


FILES = "part int, shard int, n_docs long, n_tokens long, has_null boolean, file binary"


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending id order into wavelet-matrix files.

    Returns the written table: one row per file, (part, shard) in document order. Null text
    encodes as empty (only the end id); documents with a null id come first, and repeated ids
    stay side by side, in the order of their texts. A file holds about ``shard_tokens`` ids, a longer document by itself.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        tool = encoder(path, True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, shard
            names, ids, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            nulls = bool((names == _NULL).any())
            matrix = WaveletMatrix.build(ids, 16 if ids.max(initial=0) < 1 << 16 else 32)
            row = [part, shard, len(names), len(ids), nulls, file_bytes(matrix, names, lengths)]
            held, shard = [], shard + 1
            return pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in FILES.split(", ")], row, strict=True))], _FILES_ARROW)

        for batch in batches:
            names = batch.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
            for first, last, ids, at in encoded(batch, "text", tool):
                sizes = np.diff(at) + 1
                out = np.full(len(ids) + last - first, end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(last - first), sizes - 1)] = ids
                held.append((names[first:last], out, sizes))
                if sum(len(x[1]) for x in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    _, total = text_bytes(docs)
    n = partitions(docs.sparkSession, total, TARGET_BYTES)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(build, FILES), "token-files")


_NULL = np.iinfo(np.int64).min
_FILES_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("has_null", pa.bool_()), ("file", pa.binary())]
)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is that of the decoded
    ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, nulls, data in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "has_null", "file")), strict=True):
                matrix, names, lengths = open_file(data)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[b:e]) for b, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, mask=(names == _NULL) & nulls),
                        pa.array(ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                        pa.array(np.full(len(names), part, np.int32)),
                        pa.array(np.full(len(names), shard, np.int32)),
                    ],
                    ["doc_id", "_start", "n_tokens", "ids_crc32", "part", "shard"],
                )

    schema = "doc_id long, _start long, n_tokens long, ids_crc32 long, part int, shard int"
    rows = files.select("part", "shard", "has_null", "file").mapInArrow(read, schema)
    sizes = files.select("part", "shard", "n_tokens")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per task, at most
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_part_start"))
    shift = (
        sizes.withColumn("_shard_start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
        .join(before, "part")
        .select("part", "shard", (F.col("_part_start") + F.col("_shard_start")).alias("_shift"))
    )
    return rows.join(shift, ["part", "shard"]).select("doc_id", (F.col("_shift") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of all documents and report what they hold.

    Empty table: no file, no row. See ``write_token_files`` for nulls and repeated ids.
    """
    return read_token_files(write_token_files(docs, path))
