"""Removal of repeated passages with a logarithmic family of suffix arrays.

The index holds suffixes cut at the match length (50 bytes), in lexicographic order, with the
least document that has each. It is partitioned by content: every suffix belongs to the bucket
of its anchor, the 16-gram of least hash in its first 50 bytes, which equal suffixes share
wherever they stand. In each bucket the batches (hash chunks of documents) arrive one after
the other as small sorted arrays; equal-sized levels merge, so a suffix is rewritten a
logarithmic number of times. After the last batch all levels are merged into one array and
every batch is scanned against it, so levels serve the building, not the scans; bytes of a
suffix that a smaller document has are removed. The family lives inside one task and is not
kept for later batches.

Three rounds keep what is shuffled small and exact:

1. batches send the distinct anchor hashes of their texts, and learn which occur elsewhere;
2. only suffixes under a shared anchor are sent, consecutive ones as one string; those of an
   anchor found very often are sent one by one, dealt by their own content;
3. buckets answer with the runs of suffixes that a smaller document has.

The texts are dealt to batches once; all rounds read that same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import partitions, text_bytes
from lattica.llm.textkit import mixed, packed, ragged, span_hashes

LENGTH, GRAM = 50, 16
#: For two tasks on an executor of 3 GB. A chunk sends one row to each bucket, so raise both with the executors' memory.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
SEGMENT = 4 << 20
HOT = 10_000
#: A level of the family begins with so many strings at least, unless they are the last.
FEWEST = 1 << 12
_PLACE = np.uint64((1 << 24) - 1)
_LAST = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Runs of consecutive suffixes of one anchor: global first place, number, document, anchor hash."""

    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    key: np.ndarray


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    data = raw.tobytes()
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=data, strides=(1,))
    return mixed(words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F))


def anchor_runs(raw: np.ndarray, starts: np.ndarray) -> Runs:
    """Cut the suffixes of all texts (those with 50 bytes left) into runs of one anchor.

    The anchor is the leftmost least 16-gram hash inside the first 50 bytes, so it depends on
    nothing else. Least hashes crowd at the low end, so keys are mixed once more before
    they are dealt. Long texts are handled in overlapping segments.
    """
    found: list[tuple[np.ndarray, ...]] = []
    low, high, text = [], [], []
    for t in np.flatnonzero(np.diff(starts) >= LENGTH).tolist():
        for a in range(int(starts[t]), int(starts[t + 1]) - LENGTH + 1, SEGMENT):
            low.append(a)
            high.append(min(a + SEGMENT + LENGTH - 1, int(starts[t + 1])))
            text.append(t)
    low, high, text = (np.array(x, np.int64) for x in (low, high, text))
    group = 0
    while group < len(low):
        last = max(group + 1, int(np.searchsorted(high, low[group] + (1 << 20), "right")))
        base = int(low[group])
        part = raw[base : int(high[last - 1])]
        hashes = _gram_hashes(part)
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        span = LENGTH - GRAM + 1
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & _PLACE).astype(np.int64)
        a, b = low[group:last] - base, high[group:last] - base - LENGTH + 1  # suffixes begin in [a, b)
        edge = np.zeros(len(anchor) + 1, np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        valid = np.cumsum(edge)[: len(anchor)] > 0
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        cut = np.zeros(len(anchor) + 1, bool)
        cut[a] = True
        fresh |= valid & cut[:-1]
        first = np.flatnonzero(fresh)
        stop = np.concatenate([first[1:], [len(anchor)]])
        until = b[np.searchsorted(a, first, "right") - 1]
        found.append((first + base, np.minimum(stop, until) - first, text[group:last][np.searchsorted(a, first, "right") - 1], mixed(hashes[anchor[first]])))
        group = last
    if not found:
        nothing = np.zeros(0, np.int64)
        return Runs(nothing, nothing, nothing, np.zeros(0, np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Key ranges: buckets in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Batch:
    """The texts of one chunk."""

    raw: np.ndarray
    starts: np.ndarray
    docs: np.ndarray  # ids; a null id comes after all others

    @classmethod
    def of(cls, table: pa.Table) -> Batch:
        raw, starts = packed(table.column("text"))
        return cls(raw, starts, table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False))

    def runs(self) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        """Runs; distinct anchor hashes in order; their first run in key order; the key order."""
        runs = anchor_runs(self.raw, self.starts)
        order = np.argsort(runs.key, kind="stable")
        keys = runs.key[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return runs, keys[head], head, order

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes; occurrences (to 127), plus 128 where two documents have it."""
        runs, keys, head, order = self.runs()
        if len(keys) == 0:
            return keys, np.zeros(0, np.uint8)
        docs = self.docs[runs.text][order]
        several = np.minimum.reduceat(docs, head) != np.maximum.reduceat(docs, head)
        return keys, (np.minimum(np.diff(head, append=len(order)), 127) + 128 * several).astype(np.uint8)

    def strings(self, codes: np.ndarray, buckets: int) -> Strings:
        """Distinct strings under shared anchors (code 1; code 2: one suffix each)."""
        runs, keys, head, order = self.runs()
        code = np.zeros(len(order), np.uint8)
        code[order] = np.repeat(codes, np.diff(head, append=len(order)))
        some, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        each = runs.count[hot]
        first = np.concatenate([runs.first[some], np.repeat(runs.first[hot], each) + ragged(each)])
        count = np.concatenate([runs.count[some], np.ones(int(each.sum()), np.int64)])
        text = np.concatenate([runs.text[some], np.repeat(runs.text[hot], each)])
        order = np.argsort(first, kind="stable")
        first, count, text = first[order], count[order], text[order]
        key = np.concatenate([runs.key[some], np.zeros(int(each.sum()), np.uint64)])[order]
        alone = np.concatenate([np.zeros(len(some), bool), np.ones(int(each.sum()), bool)])[order]
        hashes = self._hashes(first, count + LENGTH - 1, text)
        bucket = bucket_of(np.where(alone, hashes, key), buckets)
        order = np.lexsort((hashes, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        entry = np.zeros(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        head = np.flatnonzero(fresh)
        docs = self.docs[text][order]
        least = np.minimum.reduceat(docs, head) if len(head) else docs
        most = np.maximum.reduceat(docs, head) if len(head) else docs
        return Strings(first, text, entry, bucket[order][head], first[order][head], count[order][head], least, most)

    def _hashes(self, first: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
        found = np.zeros(len(first), np.uint64)
        at = 0
        while at < len(first):
            base = int(first[at])
            last = max(at + 1, int(np.searchsorted(first, base + (1 << 20), "left")))
            part = self.raw[base : int((first[at:last] + length[at:last]).max())]
            found[at:last] = span_hashes(part, first[at:last] - base, first[at:last] - base + length[at:last])
            at = last
        return found


@dataclass
class Strings:
    """Occurrences (place, text, entry) of distinct strings, and the strings in bucket order."""

    first: np.ndarray
    text: np.ndarray
    entry: np.ndarray
    bucket: np.ndarray
    at: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray


def suffixes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All 50-byte strings inside strings laid end to end, as rows."""
    begin = np.cumsum(length) - length
    count = length - LENGTH + 1
    places = np.repeat(begin, count) + ragged(count)
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[places] if len(places) else np.zeros((0, LENGTH), np.uint8)


def _text_view(rows: np.ndarray) -> np.ndarray:
    """Rows as strings of one length: ordered, and equal, byte by byte."""
    return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


def sorted_suffixes(rows: np.ndarray, docs: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of distinct rows in lexicographic order, each with its least document."""
    if len(rows) == 0:
        return rows, docs
    rows, docs = rows[order], docs[order]
    fresh = np.ones(len(rows), bool)
    view = _text_view(rows)
    fresh[1:] = view[1:] != view[:-1]
    head = np.flatnonzero(fresh)
    return rows[head], np.minimum.reduceat(docs, head)


def _places(level: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted rows stand in a sorted level, and whether they are there."""
    level, view = _text_view(level), _text_view(rows)
    at = np.searchsorted(level, view)
    return at, (at < len(level)) & (level[np.minimum(at, len(level) - 1)] == view)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two suffix arrays as one: the smaller's places in the larger are looked up in order."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    (rows, docs), (more, more_docs) = a, b
    if len(more) == 0:
        return rows, docs
    at, same = _places(rows, more)
    docs = docs.copy()
    docs[at[same]] = np.minimum(docs[at[same]], more_docs[same])
    new = np.flatnonzero(~same)
    put = at[new] + np.arange(len(new))
    old = np.ones(len(rows) + len(new), bool)
    old[put] = False
    out, out_docs = np.empty((len(old), LENGTH), np.uint8), np.empty(len(old), np.int64)
    out[old], out[put] = rows, more[new]
    out_docs[old], out_docs[put] = docs, more_docs[new]
    return out, out_docs


class LevelFamily:
    """Suffix arrays of geometrically growing levels; level k holds 2**k batches."""

    def __init__(self):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Insert a batch's suffix array; two levels of one size become one of the next.

        Returns the order of the batch's rows, for its scan.
        """
        order = np.argsort(_text_view(rows), kind="stable")
        level, held = 0, sorted_suffixes(rows, docs, order)
        while level in self.levels:
            held = merged(self.levels.pop(level), held)
            level += 1
        self.levels[level] = held
        return order

    def compact(self) -> None:
        """Merge all levels, smallest first, before many scans."""
        held = None
        for level in sorted(self.levels):
            held = self.levels[level] if held is None else merged(self.levels[level], held)
        self.levels = {} if held is None else {max(self.levels): held}

    def scan(self, rows: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        """The least document of the family with each suffix (the largest integer: none)."""
        found = np.full(len(rows), _LAST)
        if len(rows) == 0:
            return found
        order = np.argsort(_text_view(rows), kind="stable") if order is None else order
        for level, docs in self.levels.values():
            at, same = _places(level, rows[order])
            found[order[same]] = np.minimum(found[order[same]], docs[at[same]])
        return found


def distinct_strings(batches: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of a bucket, laid end to end in the order in which they first come; their lengths; the number of each batch's strings, one batch after the other. Told apart by 64-bit hashes, as in a batch."""
    data = [np.frombuffer(r["data"], np.uint8) for r in batches]
    length = [np.frombuffer(r["length"], np.uint8).astype(np.int64) for r in batches]
    hashes = [span_hashes(d, np.cumsum(n) - n, np.cumsum(n)) for d, n in zip(data, length, strict=True)]
    _, head, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    order = np.argsort(head)
    rank = np.empty(len(head), np.int64)
    rank[order] = np.arange(len(head))
    kept = np.zeros(len(number), bool)
    kept[head] = True
    ends = np.cumsum([len(n) for n in length])
    first = [kept[b - len(n) : b] for n, b in zip(length, ends, strict=True)]
    return np.concatenate([d[np.repeat(k, n)] for d, n, k in zip(data, length, first, strict=True)]), np.concatenate(length)[head[order]], rank[number]


def answered(batches: list[dict]) -> Iterator[tuple[int, list[bytes]]]:
    """For each batch of a bucket that has any: the runs of suffixes that a smaller document has (entry, first, stop, document).

    What copies have in common comes as the same strings in many batches; a batch adds to the
    family the strings that no batch before it had, each with the least document of all batches.
    Small batches are added together.
    """
    data, length, number = distinct_strings(batches)
    least = np.full(len(length), _LAST)
    np.minimum.at(least, number, np.frombuffer(b"".join(r["least"] for r in batches), np.int64))
    count = length - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(length)])
    ends = np.cumsum([len(r["length"]) for r in batches])
    known = np.maximum.accumulate(number)[ends - 1] + 1 if len(number) else ends  # distinct strings up to each batch
    family, parts, low = LevelFamily(), [], 0
    for high in known.tolist():
        if high > low and (high - low >= FEWEST or high == known[-1]):
            rows = suffixes(data[begin[low] : begin[high]], length[low:high])
            parts.append((low, high, family.add(rows, np.repeat(least[low:high], count[low:high]))))
            low = high
    family.compact()
    owner, place, size, smallest = [], [], [], []
    for low, high, order in parts:
        held = family.scan(suffixes(data[begin[low] : begin[high]], length[low:high]), order)
        entry, at = np.repeat(np.arange(low, high), count[low:high]), ragged(count[low:high])
        head = np.flatnonzero((at == 0) | np.concatenate([[True], held[1:] != held[:-1]]))
        owner.append(entry[head])
        place.append(at[head])
        size.append(np.diff(head, append=len(held)))
        smallest.append(held[head])
    if not parts:
        return
    owner, place, size, smallest = (np.concatenate(x) for x in (owner, place, size, smallest))
    runs = np.bincount(owner, minlength=len(length))
    start = np.cumsum(runs) - runs
    for k, (row, high) in enumerate(zip(batches, ends.tolist(), strict=True)):
        mine = number[high - len(row["length"]) : high]
        each = runs[mine]
        run = np.repeat(start[mine], each) + ragged(each)
        useful = smallest[run] < np.repeat(np.frombuffer(row["most"], np.int64), each)
        run, entry = run[useful], np.repeat(np.arange(len(mine)), each)[useful]
        if len(run):
            yield k, [entry.astype(np.uint32).tobytes(), place[run].astype(np.uint8).tobytes(), (place[run] + size[run]).astype(np.uint8).tobytes(), smallest[run].tobytes()]


_ANCHORS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("codes", pa.binary())])
_STRINGS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("data", "length", "least", "most"))])
_ANSWERS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("answer", pa.bool_()), *((c, pa.binary()) for c in ("codes", "entry", "first", "stop", "docs"))])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of the runs of a sorted array of buckets."""
    if len(bucket) == 0:
        return
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(head, [*head[1:], len(bucket)], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _codes_of(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["codes"] for r in sorted(rows, key=lambda r: r["bucket"])), np.uint8)


def _chunk_name(docs: DataFrame) -> str:
    name = "_chunk"
    while name in docs.columns:
        name += "_"
    return name


def _texts(dealt: DataFrame, own: str) -> DataFrame:
    """The one shape in which every round reads the chunks, so that they share an exchange."""
    return dealt.select("doc_id", "text", F.col(own).alias("chunk")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _rounds(docs: DataFrame, hot: int, chunk_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents with their chunk in one more column, what the chunks are told, the number of buckets."""
    spark = docs.sparkSession
    _, total = text_bytes(docs)
    chunks, buckets = partitions(spark, total, chunk_bytes), partitions(spark, total, bucket_bytes)
    own = _chunk_name(docs)
    dealt = docs.withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        keys, codes = Batch.of(table).anchors()
        parts = list(_by_bucket(bucket_of(keys, buckets)))
        return pa.table(
            [
                pa.array([key[0].as_py()] * len(parts), pa.int64()),
                pa.array([p[0] for p in parts], pa.int64()),
                pa.array([keys[a:b].tobytes() for _, a, b in parts], pa.binary()),
                pa.array([codes[a:b].tobytes() for _, a, b in parts], pa.binary()),
            ],
            schema=_ANCHORS,
        )

    def find_shared(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        codes = [np.frombuffer(c, np.uint8) for c in table.column("codes").to_pylist()]
        every, seen = np.concatenate(keys), np.concatenate(codes)
        order = np.argsort(every, kind="stable")
        every, seen = every[order], seen[order]
        head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        times = np.add.reduceat((seen & 127).astype(np.int64), head)
        shared = (np.diff(head, append=len(every)) > 1) | (np.maximum.reduceat(seen, head) >= 128)
        verdict = np.where(shared, np.where(times > hot, 2, 1), 0).astype(np.uint8)
        found = [verdict[np.searchsorted(every[head], k)].tobytes() for k in keys]
        nothing = pa.array([None] * len(keys), pa.binary())
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array([False] * len(keys)), pa.array(found, pa.binary()), *[nothing] * 4], schema=_ANSWERS)

    texts = _texts(dealt, own)
    anchors = texts.groupBy("chunk").applyInArrow(send_anchors, _ddl(_ANCHORS))
    shared = anchors.groupBy("bucket").applyInArrow(find_shared, _ddl(_ANSWERS))

    def send_strings(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and told.num_rows:
            batch = Batch.of(table)
            s = batch.strings(_codes_of(told.select(["bucket", "codes"]).to_pylist()), buckets)
            length = s.count + LENGTH - 1
            for bucket, a, b in _by_bucket(s.bucket):
                data = batch.raw[np.repeat(s.at[a:b], length[a:b]) + ragged(length[a:b])]
                rows.append([key[0].as_py(), bucket, data.tobytes(), length[a:b].astype(np.uint8).tobytes(), s.least[a:b].tobytes(), s.most[a:b].tobytes()])
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STRINGS)], schema=_STRINGS)

    strings = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_strings, _ddl(_STRINGS))

    def answer(table: pa.Table) -> pa.Table:
        found = answered(table.select(["data", "length", "least", "most"]).to_pylist())
        sent = [[table.column(c)[k].as_py() for c in ("chunk", "bucket")] + [True, None, *answer] for k, answer in found]
        return pa.table([pa.array([r[i] for r in sent], f.type) for i, f in enumerate(_ANSWERS)], schema=_ANSWERS)

    answers = strings.groupBy("bucket").applyInArrow(answer, _ddl(_ANSWERS))
    return dealt, shared.unionByName(answers), buckets


def _cut(table: pa.Table, told: pa.Table, buckets: int) -> tuple[Batch, np.ndarray]:
    """A batch and its removed bytes, from the codes of its anchors and the buckets' answers."""
    batch = Batch.of(table)
    edge = np.zeros(len(batch.raw) + 1, np.int64)
    rows = told.to_pylist()
    answers = [r for r in rows if r["answer"]]
    if answers:
        s = batch.strings(_codes_of([r for r in rows if not r["answer"]]), buckets)
        base = {b: a for b, a, _ in _by_bucket(s.bucket)}
        entry = np.concatenate([np.frombuffer(r["entry"], np.uint32).astype(np.int64) + base[r["bucket"]] for r in answers])
        first, stop = (np.concatenate([np.frombuffer(r[c], np.uint8) for r in answers]).astype(np.int64) for c in ("first", "stop"))
        least = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in answers])
        order = np.argsort(s.entry, kind="stable")  # occurrences by entry
        times = np.bincount(s.entry, minlength=len(s.at))
        begin = np.cumsum(times) - times
        place = order[np.repeat(begin[entry], times[entry]) + ragged(times[entry])]
        run = np.repeat(np.arange(len(entry)), times[entry])
        gone = least[run] < batch.docs[s.text[place]]
        place, run = place[gone], run[gone]
        np.add.at(edge, s.first[place] + first[run], 1)
        np.add.at(edge, s.first[place] + stop[run] + LENGTH - 1, -1)
    return batch, np.cumsum(edge[:-1]) > 0


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What is removed from each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string over it also begins in a document of smaller id; strings
    are judged on the input. Null and shorter texts keep all they have. Rows that share an id
    do not remove from one another. A null id counts as larger than all ids.
    """
    dealt, told, buckets = _rounds(docs.select("doc_id", "text"), hot, chunk_bytes, bucket_bytes)

    def report(table: pa.Table, told: pa.Table) -> pa.Table:
        batch, gone = _cut(table, told, buckets)
        n = len(batch.starts) - 1
        before = np.concatenate([[0], np.cumsum(gone)])
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        if len(gone):
            inside = batch.starts[:-1][np.diff(batch.starts) > 0]
            head[inside] = gone[inside]
        heads = np.concatenate([[0], np.cumsum(head)])
        kept = batch.raw[~gone].tobytes()
        at = np.arange(len(gone) + 1) - before
        cut = at[batch.starts].tolist()
        sums = [hashlib.sha256(kept[cut[k] : cut[k + 1]]).hexdigest() for k in range(n)]
        return pa.table(
            [table.column("doc_id").cast(pa.int64()), pa.array(np.diff(batch.starts)), pa.array(np.diff(before[batch.starts])), pa.array(np.diff(heads[batch.starts])), pa.array(sums, pa.string())],
            names=[c.split()[0] for c in REPORT.split(", ")],
        )

    texts = _texts(dealt, _chunk_name(docs.select("doc_id", "text")))
    return texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(report, REPORT)


def without_repeats(docs: DataFrame, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; other columns as they were.

    ``n_chars``, where there is such a column, is counted anew. A code point of which a byte
    was removed goes whole; null texts stay null.
    """
    dealt, told, buckets = _rounds(docs, hot, chunk_bytes, bucket_bytes)
    schema, own = docs.schema, _chunk_name(docs)

    def rewrite(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.drop_columns([own])
        batch, gone = _cut(table, told, buckets)
        old = table.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        texts = []
        for k in range(len(old)):
            a, b = int(batch.starts[k]), int(batch.starts[k + 1])
            texts.append(None if old[k] else batch.raw[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore"))
        place = table.column_names.index("text")
        table = table.set_column(place, "text", pa.array(texts, pa.string()))
        if "n_chars" in table.column_names:
            place = table.column_names.index("n_chars")
            table = table.set_column(place, "n_chars", pa.array([None if t is None else len(t) for t in texts], table.column(place).type))
        return table

    return dealt.groupBy(own).cogroup(told.groupBy("chunk")).applyInArrow(rewrite, schema)
