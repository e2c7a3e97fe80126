"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets are sorted by one global order, rare
shingles first, so that two sets with the wanted similarity must share at least k of their
first (p + k - 1) shingles, for any k. Each document picks its own k: it lengthens its prefix
as long as the candidates it expects, from an estimate of how often its prefix shingles occur,
cost more than the longer prefix; a pair needs the smaller k of the two in common.

Equal sets are one class with one representative. Candidates are first taken only between a
shingle's documents and its leaders, verified and contracted to components; after that only
shingles whose documents are still in different components are joined pair by pair. A pair comes
out of that join where no shingle just before is shared too, so about once however much the two
have in common, and only if it can still reach the similarity by what their prefixes show.
Parity sketches, which bound from below how many shingles only one of two sets holds, then rule
out most pairs that just miss the similarity, so that few whole sets are sent. So a group of near copies costs its links to a few leaders, not the square of its size, while
no link between different components is lost. Links are verified on whole shingle sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.tables import last_stays, ranked, staged
from lattica.llm.textkit import LOWER, NOT_SPACE, blocks, mixed, packed, shingle_hashes, span_hashes, spans

SKETCH_BITS, SKETCH_SLICES = 19, 64
MOST_MATCHES = 8
PREDECESSORS = 4
FILTER_BITS = 23
MARKS = ("mark_0", "mark_1", "mark_2", "mark_3")


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column.

    A text of fewer words than ``width`` is one shingle of all its words; without words the
    set is empty. A-Z are lower-cased; words are cut at ASCII white space.
    """
    raw, starts = packed(column)
    for first, last in blocks(starts):
        base = starts[first]
        part, at = raw[base : starts[last]], starts[first : last + 1] - base
        begin, end, before = spans(part, at, NOT_SPACE)
        words = span_hashes(part, begin, end, LOWER)
        whole = shingle_hashes(words, width)
        for k in range(last - first):
            low, high = before[k], before[k + 1]
            if high - low >= width:
                found = np.sort(whole[low : high - width + 1])
                fresh = np.ones(len(found), bool)
                fresh[1:] = found[1:] != found[:-1]
                yield first + k, found[fresh]
            elif high > low:
                yield first + k, mixed(shingle_hashes(words[low:high], int(high - low)) + np.uint64(high - low))
            else:
                yield first + k, np.zeros(0, np.uint64)


def shingle_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle in each of 2**19 hash classes, over all documents.

    The sketch has that fixed size at any scale; frequent shingles stand out of the even load.
    """
    size = 1 << SKETCH_BITS
    step = size // SKETCH_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint64)
        for batch in batches:
            for _, found in shingle_sets(batch.column("text"), width):
                np.add.at(total, (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint64(1))
        pieces = [zlib.compress(total[k * step : (k + 1) * step].tobytes(), 1) for k in range(SKETCH_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_SLICES, dtype=np.int32)), pa.array(pieces, pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint64)
        for piece in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(piece), np.uint64)
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).collect()  # 64 rows
    sketch = np.zeros(size, np.uint64)
    for r in rows:
        sketch[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return sketch


def chosen_prefix(found: np.ndarray, classes: np.ndarray, extra: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix codes of a set in the global order, and how many of them a pair must share.

    A code holds the frequency class above 56 bits of the hash, so codes sort in the global
    order. ``extra`` estimates the other documents that hold each shingle.
    """
    n = len(found)
    code = (classes.astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
    order = np.argsort(code)
    p = n - -(-n * percent // 100) + 1
    most = min(MOST_MATCHES, n - p + 1)
    scanned = np.cumsum(extra[order][: p + most - 1])[p - 1 :]
    matches = np.arange(1, most + 1)
    cost = scanned + n * scanned / matches  # reading the lists, and verifying who matches often enough
    k = int(np.argmin(cost)) + 1
    return code[order][: p + k - 1].astype(np.int64), k


def prefix_marks(prefix: np.ndarray) -> np.ndarray:
    """256 bits in which each prefix shingle sets one; what one set marks and another does not, it alone has."""
    marks = np.zeros(len(MARKS), np.uint64)
    code = prefix.astype(np.uint64)
    np.bitwise_or.at(marks, (code >> np.uint64(6) & np.uint64(3)).astype(np.int64), np.uint64(1) << (code & np.uint64(63)))
    return marks.view(np.int64)


def parity_sketch(found: np.ndarray) -> bytes:
    """Which of 2**b classes, at least twice as many as shingles, hold an odd number of the set's shingles.

    Two sketches differ in at most as many bits as there are shingles that only one set holds.
    """
    bits = 1 << max(6, int(2 * len(found) - 1).bit_length())
    at = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def least_apart(one: np.ndarray, two: np.ndarray) -> int:
    """Bits in which two parity sketches differ, the longer folded onto the length of the shorter."""
    if len(one) < len(two):
        one, two = two, one
    if len(one) > len(two):
        one = np.bitwise_xor.reduce(one.reshape(-1, len(two)), axis=0)
    return int(np.bitwise_count(one ^ two).sum())


#: The two halves of a set's 128-bit fingerprint.
fingerprint = (lambda found: int(found.sum().astype(np.int64)), lambda found: int(mixed(found).sum().astype(np.int64)))


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2 (a 128-bit fingerprint of the set), need, prefix and its 256 marks, parity sketch; written to the shared folder."""
    sketch = shingle_sketch(docs, width)
    load = np.median(sketch)
    extra = np.maximum(sketch.astype(float) - load - 4 * np.sqrt(load + 1), 0).astype(np.float32)
    levels = np.minimum(np.log2(1 + extra).astype(np.uint8), 120)
    sent = docs.sparkSession.sparkContext.broadcast((levels, extra))  # 2**19 entries of 5 bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, extra = sent.value
        for batch in batches:
            rows = {"n": [], "k1": [], "k2": [], "need": [], "prefix": [], "marks": [], "parity": []}
            for _, found in shingle_sets(batch.column("text"), width):
                at = (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                prefix, need = chosen_prefix(found, levels[at], extra[at], percent) if len(found) else (np.zeros(0, np.int64), 0)
                values = (len(found), *(f(found) for f in fingerprint), need, prefix, prefix_marks(prefix), parity_sketch(found))
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)
            arrays = [pa.array(rows["n"], pa.int64()), pa.array(rows["k1"], pa.int64()), pa.array(rows["k2"], pa.int64()), pa.array(rows["need"], pa.int32())]
            marks = np.array(rows["marks"], np.int64).reshape(-1, len(MARKS))
            arrays += [pa.array(rows["prefix"], pa.list_(pa.int64())), *(pa.array(marks[:, k]) for k in range(len(MARKS))), pa.array(rows["parity"], pa.binary())]
            names = ["doc_id", "n", "k1", "k2", "need", "prefix", *MARKS, "parity"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names)

    schema = "doc_id long, n long, k1 long, k2 long, need int, prefix array<long>, " + ", ".join(f"{m} long" for m in MARKS) + ", parity binary"
    return staged(docs.select("doc_id", "text").mapInArrow(sign, schema), "signatures")


def _overlap_needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def _unseen(n: Column, need: Column, percent: int) -> Column:
    """Shingles of a set behind its prefix."""
    return F.ceil(n * percent / F.lit(100.0) - 1e-9) - need


def _enough(common: Column, percent: int) -> Column:
    """Can sets with so many prefix shingles in common (at most) still have the overlap?

    Behind the shorter prefix lie no more shingles than one of the two sets has behind its own.
    """
    rest = F.greatest(_unseen(F.col("n_a"), F.col("need_a"), percent), _unseen(F.col("n_b"), F.col("need_b"), percent))
    return (common >= F.least("need_a", "need_b")) & (common + rest >= _overlap_needed(F.col("n_a"), F.col("n_b"), percent))


def _marked_common(side: str, other: str, percent: int) -> Column:
    """At most so many of a side's prefix shingles can be in the other's prefix."""
    n, need = F.col(f"n_{side}"), F.col(f"need_{side}")
    own = F.lit(0)
    for m in MARKS:
        own = own + F.bit_count(F.col(f"{m}_{side}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{other}"))))
    return n - _unseen(n, need, percent) - own


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their parity sketches, a thirty-second of the sets' size, do not rule out."""
    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"s_{side}")), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c) for c in ("s_a", "s_b"))
            apart = [least_apart(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(*sides, strict=True)]
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            common = (total - np.array(apart, np.int64)) // 2
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * (total - common)))

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def _spot(number: Column) -> Column:
    return F.pmod(F.xxhash64(number.cast("long")), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame) -> Broadcast:
    """The spots of the numbers in ``id`` as 2**23 bits, at any number of them, sent to all tasks."""
    spot = ids.select((_spot(F.col("id")) + 1).alias("s"))  # bitmaps count from 1
    bits = spot.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in bits.collect():  # 256 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(r["bits"], np.uint8)[: max(0, len(table) - at)]
        table[at : at + len(part)] = part
    return ids.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which spots have their bit in the table of an ``id_filter``."""
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity.

    A class is read from the text of its document that has its fingerprint. Texts of candidates are found by a bit filter of fixed size and an exact join, so texts
    of other documents are not shuffled.
    """
    pairs = staged(_alike(pairs, classes, percent), "alike")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = staged(classes.select("rep", "k1", "k2", "n", F.col("least").alias("id")).join(wanted, "rep", "left_semi"), "wanted")
    ids = wanted.select("id").distinct()
    sent = id_filter(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column("_spot").to_numpy()
            mine = batch.filter(pa.array(passes(sent.value, spot)))
            found = [s for _, s in shingle_sets(mine.column("text"), width)]
            marks = [pa.array([f(s) for s in found], pa.int64()) for f in (len, *fingerprint)]
            yield pa.RecordBatch.from_arrays([mine.column("doc_id"), *marks, pa.array([s.tobytes() for s in found], pa.binary())], ["id", "n", "k1", "k2", "shingles"])

    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _spot(F.col("doc_id")).alias("_spot"))
    texts = keyed.mapInArrow(sets, "id long, n long, k1 long, k2 long, shingles binary")
    texts = texts.join(wanted, ["id", "n", "k1", "k2"]).select("rep", "shingles")
    texts = staged(texts.dropDuplicates(["rep"]), "sets")  # equal sets
    left = texts.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select("token", *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "token")) for side in ("a", "b"))


def _star_pairs(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a shingle's documents with its least and its greatest document, if they promise a link.

    What is left out here is met again by ``_crossing_pairs``.
    """
    stars = shared.where("rep <> one").select(F.least("rep", "one").alias("a"), F.greatest("rep", "one").alias("b"))
    stars = stars.unionByName(shared.where("rep <> two and rep <> one").select(F.least("rep", "two").alias("a"), F.greatest("rep", "two").alias("b")))
    pairs = stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_common")).where("_common > 1")
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("need").alias(f"need_{side}")), side)
    return pairs.where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent) & _enough(F.col("_common"), percent)).select("a", "b")


def _crossing_pairs(contested: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share prefix shingles and can reach the similarity.

    What two of them share is contested, so the least of it is in the contested part of both
    prefixes and has no shared shingle before it: there the pair comes out. Each row carries its
    last few contested shingles, and a pair that shares one of those came out before. At the
    least shared shingle both sets must still have the whole overlap before them.
    """
    held = contested.groupBy("rep", "component", "n", "need").agg(F.sort_array(F.collect_list("token")).alias("held"))  # part of a prefix
    held = held.join(classes.select("rep", *MARKS), "rep").withColumn("n_held", F.size("held"))
    rows = held.select("rep", "component", "n", "need", "n_held", *MARKS, "held", F.posexplode("held").alias("at", "token"))
    before = F.slice("held", F.greatest(F.col("at") - PREDECESSORS, F.lit(0)) + 1, F.least("at", F.lit(PREDECESSORS)))
    a, b = _sides(rows.withColumn("before", before).drop("held"))
    n, m = F.col("n_a"), F.col("n_b")
    apart = (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & _sizes_fit(n, m, percent)
    ahead = F.least(n - F.col("at_a"), m - F.col("at_b")) >= _overlap_needed(n, m, percent)
    # no pair has more in common than one of its sides holds, or than their marks allow
    possible = _enough(F.least("n_held_a", "n_held_b", _marked_common("a", "b", percent), _marked_common("b", "a", percent)), percent)
    first = ~F.arrays_overlap("before_a", "before_b")
    return a.join(b, "token").where(apart & ahead & possible & first).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _named(classes: DataFrame, usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with an id of their own (rep), and links between classes that have a document id in common.

    A class is named by its least document. Where an id with several texts is the least of
    several classes, one has its name and the others get numbers above all document ids; they
    are linked to the first, so the least name of a component is still its least document.
    """
    own = ["k1", "k2", "n"]
    mark = F.struct(*own)
    ids = usable.groupBy("doc_id").agg(F.min(mark).alias("_low"), F.max(mark).alias("_high")).where("_low <> _high").select("doc_id")
    several = staged(usable.select("doc_id", *own).join(ids, "doc_id", "left_semi").distinct(), "several")
    if not several.limit(1).count():
        named = classes.withColumn("rep", F.col("least"))
        return named, classes.select(F.col("least").alias("a"), F.col("least").alias("b")).limit(0)
    top = classes.agg(F.max("least")).first()[0]
    firsts = classes.groupBy("least").agg(F.min(mark).alias("_first"))
    later = classes.select("least", *own).join(firsts, "least").where(mark != F.col("_first")).select(F.lit(0).alias("_all"), *own)
    buckets = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = ranked(later, ["_all"], own, "_number", buckets).select(*own, (F.lit(top) + 1 + F.col("_number")).alias("_other"))
    named = staged(classes.join(numbers, own, "left").withColumn("rep", F.coalesce("_other", "least")).drop("_other"), "named")
    held = several.join(named.select(*own, "rep"), own).select("doc_id", "rep")
    same = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")
    return named, staged(same, "same")


def linked_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, components of class representatives that have links)."""
    signed = signatures(docs, width, percent)
    usable = signed.where("n > 0 and doc_id is not null")
    grouped = usable.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "need", "prefix", *MARKS, "parity")).alias("_first"))
    parts = (f"_first.{c}" for c in ("need", "prefix", *MARKS, "parity"))
    classes = staged(grouped.select("k1", "k2", "n", F.col("_first.doc_id").alias("least"), *parts), "classes")
    classes, same = _named(classes, usable)
    tokens = classes.select("rep", "n", "need", F.explode("prefix").alias("token"))
    leaders = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("rep").alias("one"), F.max("rep").alias("two"))
    shared = staged(tokens.join(leaders.where("holders > 1").drop("holders"), "token"), "shared")

    near = staged(_star_pairs(shared, classes, percent), "near")
    links = staged(_verified(near, classes, docs, width, percent), "links")
    first = components(links).withColumnRenamed("node", "rep")

    placed = shared.drop("one", "two").join(first, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = staged(placed, "placed")
    split = placed.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("token")
    contested = staged(placed.join(split, "token", "left_semi"), "contested")
    crossing = staged(_crossing_pairs(contested, classes, percent), "crossing")
    return signed, classes, components(links.unionByName(same).unionByName(_verified(crossing, classes, docs, width, percent)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest id reachable. Null or wordless texts have empty sets and link
    with nothing. Rows that share an id are one node. Rows with a null id link with nothing
    and have a null component. Empty tables give empty results. The result is a written table;
    what was written on the way is deleted.
    """
    with last_stays(docs.sparkSession):
        return staged(_grouped(docs, width, percent), "groups")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    signed, classes, found = linked_classes(docs, width, percent)
    names = classes.select("k1", "k2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    names = names.select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", "n", "k1", "k2").join(names, ["k1", "k2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest id of each near-duplicate group; all columns as they were.

    Rows with a null id are kept; of rows that repeat an id, those of the kept id stay. Texts are
    not shuffled but for rows that a bit filter of fixed size cannot tell from those that go.
    """
    groups = near_duplicates(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    sent = id_filter(groups.select(F.col("_gone").alias("id")))

    @F.arrow_udf("boolean")
    def perhaps(spot: pa.Array) -> pa.Array:
        return pa.array(passes(sent.value, spot.to_numpy()))

    doubtful = perhaps(_spot(docs["doc_id"]))
    exact = docs.where(doubtful).join(groups, docs["doc_id"] == groups["_gone"], "left_anti")
    return docs.where(~doubtful).unionByName(exact)
