"""Quality rules with a language-model band: counted text rules and n-gram perplexity.

The language model of each language is an interpolated modified Kneser-Ney model over UTF-8
bytes. Tasks count the highest-order n-grams of their texts in sorted arrays, Spark sums them
over the corpus, and everything else follows from the sums: continuation counts of the lower
orders, counts of counts, discounts, probabilities and back-off weights. A model is one sorted
array of keys (order and packed bytes) beside its values, searched by bisection.

A language's models are cut into cells by the byte before the predicted one. No lookup of a
position leaves its cell, so scoring sends as many cells at once as fit a fixed bound and
adds the rounds up; one round does for alphabets met in practice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import staged
from lattica.llm.textkit import NOT_SPACE, blocks, byte_set, mixed, owners, packed, shingle_hashes, span_hashes, spans

ORDER = 5
MODEL_BOUND = 6_000_000  # entries sent at once: 12 bytes each
#: The symbols that the contract counts (fixed values).
SYMBOLS = byte_set(b"#*$%&|<>")
MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: Deviations from the median to either edge of the band, and the length from which a text's spread shrinks no more.
BAND_WIDTH, STEADY_BYTES = 3.0, 4000
UNKNOWN = "und"

_COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
_CELL = "lang string, cell int, keys binary, vals binary, n long"


def _seen_before(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes inside groups: is it found twice or more; is it a repeat of an earlier one."""
    key = mixed(hashes + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    again, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order], any_[order] = same, twice
    return any_, again


def text_rules(raw: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of one block of texts: words, their code points, symbols, repeated lines and words."""
    n = len(starts) - 1
    begin, end, before = spans(raw, starts, NOT_SPACE)
    words = np.diff(before)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[starts])

    inside = NOT_SPACE[raw]
    found = {
        "n_words": words,
        "word_chars": per_text(inside & (raw & 0xC0 != 0x80)),
        "n_symbols": per_text(SYMBOLS[raw]),
    }
    lines_from, lines_to, lines_before = spans(raw, starts, raw_not_newline)
    count = np.concatenate([[0], np.cumsum(inside)])
    real = count[lines_to] > count[lines_from]
    text = owners(lines_before)[real]
    _, again = _seen_before(text, span_hashes(raw, lines_from[real], lines_to[real]))
    found["n_dup_lines"] = np.bincount(text[again], minlength=n)
    covered = np.zeros(len(begin) + 1, np.int64)
    if len(begin) >= WINDOW:
        windows = shingle_hashes(span_hashes(raw, begin, end), WINDOW)
        text = owners(before)
        whole = text[: len(windows)] == text[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        twice, _ = _seen_before(text[at], windows[at])
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    hit = np.cumsum(covered[:-1]) > 0
    found["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(hit)])[before])
    return {k: v.astype(np.int64) for k, v in found.items()}


raw_not_newline = ~byte_set(b"\n")


def _codes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The packed n-gram that ends at each byte; bytes before a text's first count as 0."""
    code = raw.astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, ORDER):
        earlier = np.zeros(len(raw), np.uint64)
        earlier[back:] = raw[:-back]
        earlier[place < back] = 0
        code |= earlier << np.uint64(8 * back)
    return code


def _tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often (or with what weight) each occurs."""
    if weights is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.diff(codes, prepend=codes[:1] + np.uint64(1)) != 0) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(first, append=len(codes))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] + np.uint64(1)) != 0) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """How often each n-gram of the highest order occurs in each language, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            codes, n = _tally(np.concatenate([c for c, _ in held[lang]]), np.concatenate([n for _, n in held[lang]]))
            held[lang] = []
            return pa.RecordBatch.from_arrays([pa.repeat(lang, len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], schema=_COUNTS)

        for batch in batches:
            raw, starts = packed(batch.column("text"))
            langs = np.array(batch.column("lang").fill_null(UNKNOWN).to_pylist(), object)
            for first, last in blocks(starts):
                base = starts[first]
                part, at = raw[base : starts[last]], starts[first : last + 1] - base
                codes, lang = _codes(part, at), np.repeat(langs[first:last], np.diff(at))
                for name in set(langs[first:last]):
                    mine = held.setdefault(name, [])
                    mine.append(_tally(codes[lang == name]))
                    if len(mine) > 1 and sum(len(c) for c, _ in mine[1:]) > 2 * len(mine[0][0]) + 100_000:
                        held[name] = [_tally(np.concatenate([c for c, _ in mine]), np.concatenate([n for _, n in mine]))]
                        if len(held[name][0][0]) > MODEL_BOUND:
                            yield rows(name)
        for name in list(held):
            if held[name]:
                yield rows(name)

    return docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _orders(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, n-grams, counts): raw counts at the top, distinct left extensions below."""
    yield ORDER, codes, counts
    for order in range(ORDER - 1, 0, -1):
        shorter = codes & np.uint64((1 << 8 * order) - 1)
        codes, counts = _tally(shorter)
        yield order, codes, counts


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts (1 to 4); plain fractions where those are missing."""
    n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, d1), (2, d2), (3, d3)))


def _discounted(order_codes: np.ndarray, counts: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Share of each n-gram after its discount, its context's place, contexts, and what they give away."""
    context = order_codes >> np.uint64(8)
    heads = np.flatnonzero(np.diff(context, prepend=context[:1] + np.uint64(1)) != 0)
    own = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(context)))
    total = np.add.reduceat(counts, heads).astype(float)
    cut = np.array([0.0, *d])[np.minimum(counts, 3)]
    return (counts - cut) / total[own], own, context[heads], np.add.reduceat(cut, heads) / total


def fit_models(counts: DataFrame) -> DataFrame:
    """Models as rows (lang, cell, keys, vals, n): sorted keys and natural-log values.

    A key's top byte is the order of an n-gram, or 128 more for a context's back-off weight.
    """
    counted = staged(counts.withColumn("cell", F.shiftright("code", 8).bitwiseAND(255).cast("int")), "ngrams")

    def count_counts(table: pa.Table) -> pa.Table:
        codes, n = _sorted_cell(table)
        rows = []
        for order, _, k in _orders(codes, n):
            if order > 1:
                size, times = np.unique(np.minimum(k, 5), return_counts=True)
                rows += [(table.column("lang")[0].as_py(), order, int(s), int(t)) for s, t in zip(size, times, strict=True)]
            else:
                rows += [(table.column("lang")[0].as_py(), -1 - int(c), int(v), 1) for c, v in zip(_, k, strict=True)]
        names = ("lang", "order", "size", "times")
        return pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}, pa.schema([("lang", pa.string()), ("order", pa.int32()), ("size", pa.int64()), ("times", pa.int64())]))

    grouped = counted.groupBy("lang", "cell").applyInArrow(count_counts, "lang string, order int, size long, times long")
    # Per language: at most 4 orders x 5 sizes, and 256 bytes for the lowest order.
    tally = grouped.withColumn("key", F.when(F.col("order") > 0, F.col("size")).otherwise(F.lit(0)))
    summed = tally.groupBy("lang", "order", "key").agg(F.sum(F.when(F.col("order") > 0, F.col("times")).otherwise(F.col("size"))).alias("times")).collect()
    of: dict[str, dict[int, dict[int, int]]] = {}
    lowest: dict[str, np.ndarray] = {}
    for r in summed:
        if r["order"] > 0:
            of.setdefault(r["lang"], {}).setdefault(r["order"], {})[r["key"]] = r["times"]
        else:
            lowest.setdefault(r["lang"], np.zeros(256))[-1 - r["order"]] += r["times"]
    cuts = {lang: {order: discounts(sizes) for order, sizes in orders.items()} for lang, orders in of.items()}
    base = {lang: 0.999 * n / n.sum() + 0.001 / 256 for lang, n in lowest.items()}

    def estimate(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        codes, n = _sorted_cell(table)
        keys, vals = [], []
        lower_codes, lower_p = np.arange(256, dtype=np.uint64), base[lang]
        for order, grams, k in reversed(list(_orders(codes, n))[:-1]):
            share, own, context, spare = _discounted(grams, k, cuts[lang][order])
            shorter = grams & np.uint64((1 << 8 * (order - 1)) - 1)
            p = share + spare[own] * lower_p[np.searchsorted(lower_codes, shorter)]
            keys += [grams | np.uint64(order << 56), context | np.uint64((order + 128) << 56)]
            vals += [np.log(p), np.log(spare)]
            lower_codes, lower_p = grams, p
        keys, vals = np.concatenate(keys), np.concatenate(vals).astype(np.float32)
        order = np.argsort(keys)
        return pa.table(
            {"lang": [lang], "cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "keys": [keys[order].tobytes()], "vals": [vals[order].tobytes()], "n": [len(keys)]},
            pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("n", pa.int64())]),
        )

    models = staged(counted.groupBy("lang", "cell").applyInArrow(estimate, _CELL), "models")
    models.lowest = {lang: np.log(p).astype(np.float32) for lang, p in base.items()}
    return models


def _sorted_cell(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes = table.column("code").to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return codes[order], table.column("n").to_numpy()[order]


class SentModel:
    """The cells of one language that a round has: sorted keys and values, and the lowest order."""

    def __init__(self, cells: list[tuple[int, np.ndarray, np.ndarray]], lowest: np.ndarray):
        self.has = np.zeros(256, bool)
        self.has[[c for c, _, _ in cells]] = True
        keys = np.concatenate([k for _, k, _ in cells]) if cells else np.zeros(0, np.uint64)
        vals = np.concatenate([v for _, _, v in cells]) if cells else np.zeros(0, np.float32)
        order = np.argsort(keys)
        self.keys, self.vals, self.lowest = keys[order], vals[order], lowest

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) == 0:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.searchsorted(self.keys, keys).clip(0, len(self.keys) - 1)
        return self.keys[at] == keys, self.vals[at]

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of the last byte of each (sorted) code."""
        total = np.zeros(len(codes))
        left = np.arange(len(codes))
        for order in range(ORDER, 1, -1):
            gram = codes[left] & np.uint64((1 << 8 * order) - 1)
            known, value = self.find(gram | np.uint64(order << 56))
            total[left[known]] += value[known]
            left, gram = left[~known], gram[~known]
            known, value = self.find((gram >> np.uint64(8)) | np.uint64((order + 128) << 56))
            total[left[known]] += value[known]
        total[left] += self.lowest[(codes[left] & np.uint64(255)).astype(np.int64)]
        return total


def scored(docs: DataFrame, models: DataFrame, bound: int = MODEL_BOUND) -> DataFrame:
    """doc_id, lang, the counted rules, and the sum of log probabilities of each text."""
    sizes = [(r["lang"], r["cell"], r["n"]) for r in models.select("lang", "cell", "n").collect()]  # 256 a language at most
    rounds: list[list[tuple[str, int]]] = [[]]
    filled = 0
    for lang, cell, n in sorted(sizes):
        if rounds[-1] and filled + n > bound:
            rounds.append([])
            filled = 0
        rounds[-1].append((lang, cell))
        filled += n
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "lang", "text")
    if len(rounds) > 1:  # every round must see the same ids
        keyed = staged(keyed, "numbered")
    spark, parts = docs.sparkSession, None
    for number, cells in enumerate(rounds):
        wanted = spark.createDataFrame(cells, "lang string, cell int") if cells else None
        rows = models.join(F.broadcast(wanted), ["lang", "cell"]).collect() if cells else []
        sent: dict[str, list] = {}
        for r in rows:
            sent.setdefault(r["lang"], []).append((r["cell"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["vals"], np.float32)))
        model = spark.sparkContext.broadcast({lang: SentModel(sent.get(lang, []), low) for lang, low in models.lowest.items()})
        part = _scored_round(keyed, model, number == 0)
        parts = part if parts is None else parts.unionByName(part)
    if len(rounds) == 1:
        return parts
    sums = ["_log_p", "n_bytes", *RULES]
    return parts.groupBy("_row", "doc_id", "lang").agg(*(F.sum(c).alias(c) for c in sums))


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored_round(keyed: DataFrame, model, with_rules: bool) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = packed(batch.column("text"))
            names = batch.column("lang").fill_null(UNKNOWN)
            langs = np.array(names.to_pylist(), object)
            n = len(langs)
            found = {c: np.zeros(n, np.int64) for c in RULES}
            log_p = np.zeros(n)
            for first, last in blocks(starts):
                base = starts[first]
                part, at = raw[base : starts[last]], starts[first : last + 1] - base
                if with_rules:
                    for c, v in text_rules(part, at).items():
                        found[c][first:last] = v
                codes, text = _codes(part, at), np.repeat(np.arange(last - first), np.diff(at))
                for lang in set(langs[first:last]):
                    known = model.value.get(lang)
                    if known is None:  # none of the language's texts has a byte
                        continue
                    mine = np.flatnonzero((langs[first:last] == lang)[text] & known.has[(codes >> np.uint64(8) & np.uint64(255)).astype(np.int64)])
                    order = mine[np.argsort(codes[mine])]
                    distinct, times = _tally(codes[order])
                    log_p[first:last] += np.bincount(text[order], np.repeat(known.log_probs(distinct), times), last - first)
            size = np.diff(starts) if with_rules else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id").cast(pa.int64()), names, pa.array(log_p), pa.array(size), *(pa.array(found[c]) for c in RULES)],
                ["_row", "doc_id", "lang", "_log_p", "n_bytes", *RULES],
            )

    schema = "_row long, doc_id long, lang string, _log_p double, n_bytes long, " + ", ".join(f"{c} long" for c in RULES)
    return keyed.mapInArrow(score, schema)


def quality_rules(docs: DataFrame, width: float = BAND_WIDTH, bound: int = MODEL_BOUND) -> DataFrame:
    """Counted rules of every whole text and the verdict of its language's perplexity band.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated 8-word windows. The
    band of a language is measured on all its texts that pass the counted rules, each distinct
    score once, so that a group of copies does not narrow it. The spread of a text grows as it
    gets shorter by the root of its length, so offsets from the median log perplexity are
    scaled by it; the lower edge lies ``width`` deviations below the median and the upper one
    ``width`` above, each with the deviation that the quartile of its own side gives. A text
    outside is not kept. Null text has no words; null languages share one model; rows with
    null or repeated ids are judged like any other. Columns: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity.
    """
    docs = docs.select("doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    models = fit_models(ngram_counts(docs))
    rows = staged(scored(docs, models, bound), "scored")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    level = F.when(F.col("n_bytes") > 0, -F.col("_log_p") / F.col("n_bytes"))
    rows = rows.withColumn("base_failed", failed).withColumn("log_perplexity", level)
    usable = rows.where(~F.col("base_failed")).select("lang", "n_bytes", F.round("log_perplexity", 9).alias("log_perplexity")).distinct()
    middle = usable.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("_middle"))
    scale = F.sqrt(F.least("n_bytes", F.lit(STEADY_BYTES)) / F.lit(1000.0))
    off = (F.col("log_perplexity") - F.col("_middle")) * scale
    quartiles = usable.join(F.broadcast(middle), "lang").groupBy("lang").agg(F.percentile_approx(off, [0.25, 0.75], 10000).alias("_quartiles"))
    band = middle.join(quartiles, "lang")
    low, high = (F.greatest(width * 1.4826 * F.abs(F.col("_quartiles")[k]), F.lit(1e-6)) for k in (0, 1))
    inside = F.coalesce((off >= -low) & (off <= high), F.lit(True))
    return rows.join(F.broadcast(band), "lang", "left").select("doc_id", *RULES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity")
