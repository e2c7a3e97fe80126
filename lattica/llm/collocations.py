"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word that has a next word in its piece is a suffix of up to three words. Suffixes are
routed by their two leading words, so that a bucket holds all occurrences of its phrases.
There the pointers are split three ways around a pivot word: the equal part moves on to the
next word, the other two are split again, and a part that holds fewer occurrences than a
phrase needs is abandoned at once, whatever is in it. The size of an equal part is the count
of its phrase. All parts of one depth are split together, so a round is a few array passes.

Equal suffixes of a chunk are sent once with their number. Leading pairs that would fill a
bucket by themselves (a bounded list, found exactly from chunk counts) are routed by all
three words; what their buckets count of the pair is added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tables import staged, text_bytes
from lattica.llm.textkit import LOWER, blocks, byte_set, distinct_spans, mixed, packed, ragged, span_hashes, spans

#: Bytes that end a piece, and those between the words of one (fixed values).
_BREAKS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
_BREAK, _WORD = byte_set(_BREAKS), ~byte_set(_BREAKS + b" \t")
DEPTH = 3
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
#: The list of leading pairs that are routed by three words has at most so many entries.
HOT_BOUND = 1 << 20
_ROUTE = np.uint64(0xC2B2AE3D27D4EB4F)


class Chunk:
    """The words of some texts of one language, numbered by their bytes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        self.raw = raw = LOWER[raw]
        self.begin, self.end, before = spans(raw, starts, _WORD)
        n = len(self.begin)
        breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(_BREAK[raw], dtype=np.int32)])
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = breaks[self.end[:-1]] == breaks[self.begin[1:]]
        last = before[1:][np.diff(before) > 0] - 1
        goes_on[last] = False
        self.word, self.first = distinct_spans(raw, self.begin, self.end)
        self.hashes = span_hashes(raw, self.begin[self.first], self.end[self.first])
        here = np.flatnonzero(goes_on)
        third = np.where(goes_on[np.minimum(here + 1, n - 1)], self.word[np.minimum(here + 2, n - 1)] + 1, 0)
        self.suffix = (self.word[here], self.word[here + 1], third)

    def text(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of distinct words end to end, and their lengths."""
        begin = self.begin[self.first[words]]
        size = self.end[self.first[words]] - begin
        return self.raw[np.repeat(begin, size) + ragged(size)], size

    def pair_hashes(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return mixed(self.hashes[one] * _ROUTE + self.hashes[two])


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, Chunk]]:
    """(language, chunk) for the texts of a batch."""
    langs = batch.column("lang").dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        raw, starts = packed(batch.column("text").take(pa.array(np.flatnonzero(code == k))))
        for first, last in blocks(starts, CHUNK_BYTES):
            base = starts[first]
            yield lang, Chunk(raw[base : starts[last]], starts[first : last + 1] - base)


def _counted(order: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first pointer of each run of equal keys, and the run's length."""
    head = np.flatnonzero(fresh)
    return order[head], np.diff(np.append(head, len(order)))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    return order, fresh


def _distinct_suffixes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """One pointer for each distinct suffix of a chunk, and how often it occurs there."""
    one, two, three = chunk.suffix
    order, fresh = _runs(one * (len(chunk.first) + 1) + two)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(fresh)
    return _counted(*_runs(pair * (len(chunk.first) + 1) + three))


_COUNTS = "lang string, word string, pair long, f long"


def _count(hot: int):
    """Per chunk: its words (word null: their total), and leading pairs that may be hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, chunk in _chunks(batch):
                n = len(chunk.word)
                raw, size = chunk.text(np.arange(len(chunk.first)))
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())])
                one, two, _ = chunk.suffix
                pair, often = _counted(*_runs(one * (len(chunk.first) + 1) + two))
                some = often * 2 * hot >= n
                pair = chunk.pair_hashes(one[pair[some]], two[pair[some]]).astype(np.int64)
                rows = len(size) + 1 + len(pair)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), rows),
                        pa.concat_arrays([words.cast(pa.string()), pa.nulls(rows - len(size), pa.string())]),
                        pa.concat_arrays([pa.nulls(len(size) + 1, pa.int64()), pa.array(pair)]),
                        pa.array(np.concatenate([np.bincount(chunk.word, minlength=len(size)), [n], often[some]]).astype(np.int64)),
                    ],
                    ["lang", "word", "pair", "f"],
                )

    return count


_ROUTED = "lang string, hot boolean, bucket int, words binary, sizes binary, ids binary, counts binary"


def _route(buckets: int, hot: np.ndarray):
    """Per chunk and bucket: the distinct suffixes dealt to it, over a word list of their own."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, chunk in _chunks(batch):
                pointers, often = _distinct_suffixes(chunk)
                one, two, three = (column[pointers] for column in chunk.suffix)
                key = chunk.pair_hashes(one, two)
                split = np.isin(key.astype(np.int64), hot)
                ahead = np.append(np.zeros(1, np.uint64), chunk.hashes)[three]
                key = np.where(split, mixed(key + ahead * _ROUTE), key)
                to = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) + split * buckets
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                rows = []
                for rest in np.split(order, cuts[1:]) if len(order) else []:
                    ids = np.concatenate([one[rest] + 1, two[rest] + 1, three[rest]])
                    used, ids = np.unique(ids, return_inverse=True)
                    if used[0] > 0:
                        ids = ids + 1  # 0 is the end of a piece
                    raw, size = chunk.text(used[used > 0] - 1)
                    ids = ids.astype("<u2" if len(size) < 1 << 16 else "<u4")
                    rows.append((lang, bool(to[rest[0]] >= buckets), int(to[rest[0]]) % buckets, raw.tobytes(), size.astype("<u4").tobytes(), ids.tobytes(), often[rest].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED_TYPES, strict=True)] if rows else [pa.nulls(0, t) for t in _ROUTED_TYPES], _ROUTED_NAMES)

    return send


_ROUTED_NAMES = [c.split()[0] for c in _ROUTED.split(", ")]
_ROUTED_TYPES = [pa.string(), pa.bool_(), pa.int32(), *[pa.binary()] * 4]


def _equal_parts(value: np.ndarray, weight: np.ndarray, pointers: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Split every part of ``pointers`` into parts of equal value; those of weight ``least`` or more.

    One round splits all open parts three ways around a pivot each. Equal parts are done,
    the others are open again unless they hold too little.
    """
    done, done_sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    value, weight = value[pointers], weight[pointers]
    while len(sizes):
        begin = np.cumsum(sizes) - sizes
        enough = np.add.reduceat(weight, begin) >= least
        if not enough.all():
            keep = np.repeat(enough, sizes)
            value, weight, pointers, sizes = value[keep], weight[keep], pointers[keep], sizes[enough]
            if len(sizes) == 0:
                break
            begin = np.cumsum(sizes) - sizes
        a, b, c = value[begin], value[begin + sizes // 2], value[begin + sizes - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), sizes)
        less, equal = value < pivot, value == pivot
        n_less, n_equal = np.add.reduceat(less, begin, dtype=np.int64), np.add.reduceat(equal, begin, dtype=np.int64)
        heavy = np.add.reduceat(np.where(equal, weight, 0), begin) >= least
        done.append(pointers[equal & np.repeat(heavy, sizes)])
        done_sizes.append(n_equal[heavy])
        rest = np.concatenate([np.flatnonzero(less), np.flatnonzero(~(less | equal))])
        value, weight, pointers = value[rest], weight[rest], pointers[rest]
        sizes = np.concatenate([n_less, sizes - n_less - n_equal])
        sizes = sizes[sizes > 0]
    return np.concatenate(done), np.concatenate(done_sizes)


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Multikey quicksort of suffix pointers: per depth, a pointer and the weight of every
    partition of suffixes that agree up to there and weigh ``least[depth]`` or more.

    ``columns[d]`` is the word at depth d (from 1; 0: the suffix has ended).
    """
    found = []
    pointers = np.arange(len(weight))
    sizes = np.array([len(weight)] if len(weight) else [], np.int64)
    for column, enough in zip(columns, least, strict=True):
        on = column[pointers] > 0
        if len(sizes):
            sizes = np.add.reduceat(on, np.cumsum(sizes) - sizes, dtype=np.int64)
            pointers, sizes = pointers[on], sizes[sizes > 0]
        pointers, sizes = _equal_parts(column, weight, pointers, sizes, enough)
        begin = np.cumsum(sizes) - sizes
        found.append((pointers[begin], np.add.reduceat(weight[pointers], begin) if len(sizes) else sizes))
    return found


def _mine(least: int):
    def mine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, hot = key[0].as_py(), key[1].as_py()
        columns = {c: table.column(c).to_pylist() for c in ("words", "sizes", "ids", "counts")}
        sizes = [np.frombuffer(b, "<u4").astype(np.int64) for b in columns["sizes"]]
        raw = np.frombuffer(b"".join(columns["words"]), np.uint8)
        end = np.cumsum(np.concatenate(sizes))
        number, first = distinct_spans(raw, end - np.concatenate(sizes), end)
        parts, base = [], 0
        for ids, size in zip(columns["ids"], sizes, strict=True):
            known = np.append(np.zeros(1, np.int32), number[base : base + len(size)].astype(np.int32) + 1)
            parts.append(known[np.frombuffer(ids, "<u2" if len(size) < 1 << 16 else "<u4")].reshape(DEPTH, -1))
            base += len(size)
        suffix = np.concatenate(parts, 1)
        weight = np.concatenate([np.frombuffer(b, "<u4") for b in columns["counts"]]).astype(np.int64)
        # A hot pair is spread over buckets: what this one holds of it counts however little.
        _, pairs, triples = equal_partitions(list(suffix), weight, [1, 1, least] if hot else [least] * DEPTH)
        data, begin = raw.tobytes(), end - np.concatenate(sizes)

        def text(column: np.ndarray) -> list[str]:
            k = first[column - 1]
            return [data[a:b].decode() for a, b in zip(begin[k].tolist(), end[k].tolist(), strict=True)]

        at = np.concatenate([pairs[0], triples[0]])
        third = [*[None] * len(pairs[0]), *text(suffix[2][triples[0]])]
        return pa.table(
            [pa.array([lang] * len(at), pa.string()), pa.array(text(suffix[0][at]), pa.string()), pa.array(text(suffix[1][at]), pa.string()), pa.array(third, pa.string()), pa.array(np.concatenate([pairs[1], triples[1]]))],
            names=["lang", "w1", "w2", "w3", "f"],
        )

    return mine


def phrase_counts(docs: DataFrame, least: int = 10, bucket_bytes: int = BUCKET_BYTES, hot_bound: int = HOT_BOUND) -> tuple[DataFrame, DataFrame]:
    """What occurs ``least`` times or more in a language: (words, phrases), both whole.

    ``words``: lang, word, f, and per lang a row with a null word and the total of all words.
    ``phrases``: lang, w1, w2, w3 (null for two words), f. A null text is empty, a null lang
    is ``und``; repeated rows count each. Both are tables in the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    buckets = max(1, -(-text_bytes(texts)[1] // bucket_bytes))
    hot = min(4 * buckets, hot_bound)
    total = F.col("word").isNull() & F.col("pair").isNull()
    counts = texts.mapInArrow(_count(hot), _COUNTS).groupBy("lang", "word", "pair").agg(F.sum("f").alias("f"))
    counts = staged(counts.where(total | (F.col("f") >= least)), "word-counts")
    words = counts.where("pair is null").select("lang", "word", "f")
    every = words.where("word is null").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    # At most ``hot`` pairs can each hold that share of all words.
    heavy = counts.where("pair is not null").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") * hot >= every)
    sent = np.sort(np.array([r[0] for r in heavy.select("pair").collect()], np.int64))
    routed = texts.mapInArrow(_route(buckets, sent), _ROUTED)
    mined = routed.groupBy("lang", "hot", "bucket").applyInArrow(_mine(least), "lang string, w1 string, w2 string, w3 string, f long")
    phrases = mined.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words, staged(phrases, "phrases")


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = "cast({} as decimal(18, 0))"
    return F.expr(f"({wide.format(a)} * {wide.format(a)} * cast(1000000 as decimal(7, 0))) div ({wide.format(l)} * {wide.format(r)})")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """The best phrases of two and three words of every language.

    A phrase that occurs ``least`` times scores floor(1000000 a a / (l r)) at its worst cut
    (decimals of 38 digits, exact up to 10**15 occurrences); one that a longer candidate holds
    and of whose occurrences that candidate has ``covered`` percent is left out. Null texts
    are empty, a null lang is ``und``, repeated rows count each, an empty table gives no rows.
    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    words, phrases = phrase_counts(docs, least)
    pairs = phrases.where("w3 is null").drop("w3")
    triples = phrases.where("w3 is not null")
    word = words.where("word is not null")

    def named(df: DataFrame, *names: str) -> DataFrame:
        return df.toDF("lang", *names)

    twos = pairs.join(named(word, "w1", "l"), ["lang", "w1"]).join(named(word, "w2", "r"), ["lang", "w2"])
    longer = triples.select("lang", "w1", "w2", "f").unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longest"))
    twos = twos.join(longer, ["lang", "w1", "w2"], "left").where(f"longest is null or 100 * longest < {covered} * f")
    twos = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r", _score("f", "l", "r").alias("score"))
    threes = triples.join(named(pairs, "w1", "w2", "l2"), ["lang", "w1", "w2"]).join(named(pairs, "w2", "w3", "r1"), ["lang", "w2", "w3"])
    threes = threes.join(named(word, "w1", "l1"), ["lang", "w1"]).join(named(word, "w3", "r2"), ["lang", "w3"])
    threes = threes.withColumn("s1", _score("f", "l1", "r1")).withColumn("s2", _score("f", "l2", "r2"))
    later = F.col("s2") < F.col("s1")
    best = [F.when(later, b).otherwise(a).alias(name) for a, b, name in ((F.col("l1"), F.col("l2"), "l"), (F.col("r1"), F.col("r2"), "r"), (F.col("s1"), F.col("s2"), "score"))]
    threes = threes.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), *best)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = words.where("word is null").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
