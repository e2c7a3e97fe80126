"""Each operator against a plain version of its contract, on small tables with every oddity."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import decontaminate, encoding, htmltext, jaccard, packing, perplexity, pulearning, sharding, suffixdedup, tokencount, wavelet

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ASCII_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Columns of a user's own whose names the operators use inside.
EXTRA = ("size", "shard", "_bucket", "_chunk", "chunk", "token", "rep", "score", "n_words", "_gone", "features")


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), rng.integers(1, 6))) for _ in range(n))


def odd_rows():
    rng = np.random.default_rng(7)
    passage, base = sentence(rng, 30), sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = "\n".join(sentence(rng, 50) for _ in range(400))
    texts = [None, "", " ", "one", "one", "Two words", base, base, near, base.upper(), f"{sentence(rng, 20)} {passage} {sentence(rng, 9)}", passage]
    texts += [long, f"{passage} {long}", "same same same " * 40, "línea — ñandú 東京 😀 " * 8, "a\nb\na\nb\n\n \nb", "x" * 70_000, "<|endoftext|> in a  <|endoftext|>", "it's 12 we'll\tgo now"]
    texts += [sentence(rng, int(n)) for n in rng.integers(1, 60, 30)]
    rows = [(k, t, (None, "en", "de")[k % 3], f"src{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, (5, "Two words", "en", "src0", 9), (None, base, "en", "src0", len(base)), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    for name in EXTRA:
        frame = frame.selectExpr("*", f"'own' as {name}")
    return frame.cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def key(row):
    return tuple((v is None, v) for v in row)


def found(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def raw(text):
    return (text or "").encode()


# Suffix arrays


def plain_removal(rows):
    texts = [(float("inf") if i is None else i, raw(t)) for i, t, *_ in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], i), i)
    out = []
    for (i, t), row in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((row[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "chunk_bytes": 20_000, "bucket_bytes": 10_000}])
def test_repeated_bytes_are_removed(docs, settings):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(suffixdedup.removal_report(docs, **settings), columns) == plain_removal(odd_rows())


def test_repeats_leave_other_columns(docs, nothing):
    kept = suffixdedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r[0] for r in kept.select("_chunk").distinct().collect()} == {"own"}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())
    assert suffixdedup.removal_report(nothing).count() == 0


def test_levels_grow_geometrically():
    rng, family = np.random.default_rng(3), suffixdedup.LevelFamily()
    pool, least = rng.integers(0, 3, (40, suffixdedup.LENGTH)).astype(np.uint8), {}
    for batch in range(13):
        rows = pool[rng.integers(0, 40, 9)]
        family.add(rows, np.full(9, 100 - batch))
        for r in rows:
            least[r.tobytes()] = 100 - batch
    assert sorted(family.levels) == [0, 2, 3]
    for _ in range(2):
        assert family.scan(pool).tolist() == [least.get(r.tobytes(), np.iinfo(np.int64).max) for r in pool]
        family.compact()


# Positive-unlabelled learning


def test_classifier_learns_and_holds_out(spark, nothing):
    rng = np.random.default_rng(1)
    rows = [(k, sentence(rng, 80) if k % 4 else " ".join(w + "###" for w in sentence(rng, 80).split()), "en", "s", 1) for k in range(900)]
    rows += [(None, None, None, None, None), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 900, 3)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = pulearning.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.98 * len(held)
    kept = pulearning.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert pulearning.classify(nothing, labels).count() == 0
    assert {r.score for r in pulearning.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, sentence(rng, 30), "en", "s", 1) for k in range(90)], SCHEMA)
    rows = [(k, 1) for k in range(60)]
    changed = [(k, 0 if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, q in rows]
    scores = [found(pulearning.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")), ["doc_id", "score"]) for x in (rows, changed)]
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]]
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], atol=1e-9)


# Decontamination


def items():
    rng = np.random.default_rng(7)
    passage = sentence(rng, 30)
    return [(1, passage.upper()), (2, "one"), (10, "two WORDS"), (3, None), (None, "!!"), (4, sentence(np.random.default_rng(99), 25)), (1, "changed")]


def plain_contamination(rows):
    words = lambda t: ASCII_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items():
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add("" if i is None else str(i))
    out = []
    for i, t, *_ in rows:
        w, hit, mine = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    mine |= windows[tuple(w[j : j + n])]
        out.append((i, len(w), len(hit), len(mine), hashlib.sha256(",".join(sorted(mine)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


def test_items_are_found_whole_or_in_parts(spark, docs, nothing):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = plain_contamination(odd_rows())
    assert sum(r[5] for r in expected) >= 4
    for bound in (1 << 20, 100):
        assert found(decontaminate.contamination(docs, bench, bound), columns) == expected
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in expected)
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_longest_matches_are_maximal():
    text, item = "p q a b c d e f g h i j k r s".split(), "z a b c d e f g h i j k y".split()
    code = {w: np.uint64(n) for n, w in enumerate(sorted(set(text + item)), 1)}
    words = np.array([code[w] for w in text])
    test = decontaminate.Items(["7"], np.array([code[w] for w in item]), np.array([0, len(item)]))
    assert decontaminate.longest_matches(words, np.array([0, len(text)]), test) == [(0, 2, 0, 1, 11)]


# Sharding


def test_shards_are_even_and_groups_whole(docs, nothing):
    rows = sharding.shard_documents(docs, 4).collect()
    text = {i: t for i, t, *_ in odd_rows()}
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    by_text, slots, totals = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(raw(text[r.doc_id])) + 1, zlib.crc32(raw(text[r.doc_id])))
        by_text[(r.size, r.text_crc32)].add(r.shard)
        slots[r.shard].append(r.slot)
        totals[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_best_fit_decreasing_matches_one_by_one():
    rng = np.random.default_rng(5)
    for capacity in (50, 97):
        histogram = Counter(rng.integers(1, 60, 300).tolist())
        rooms: list[int] = []
        for size in sorted(histogram.elements(), reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(max(capacity, size) - size)
        runs = sharding.best_fit_decreasing(histogram.items(), capacity)
        fill = Counter()
        for size, n, shard in runs:
            fill[shard] += size * n
        assert sum(n for _, n, _ in runs) == 300
        assert sorted(max(capacity, f) - f for f in fill.values()) == sorted(rooms)


def test_balanced_shards():
    fill = Counter()
    for size, n, shard in sharding.balanced([(1000, 1), (7, 90), (3, 50), (1, 20)], 5):
        fill[shard] += size * n
    assert len(fill) == 5 and fill[0] == 1000 and max(fill[k] for k in range(1, 5)) - min(fill[k] for k in range(1, 5)) <= 2


# Quality rules


def plain_rules(text):
    text = text or ""
    words, lines, repeated = SPACED.findall(text), set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            repeated += line in lines
            lines.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(hit), failed


def test_rules_are_counted_exactly(docs, nothing):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = perplexity.quality_rules(docs)
    assert found(out, columns) == sorted(((i, *plain_rules(t)) for i, t, *_ in odd_rows()), key=key)
    assert out.where("base_failed and kept").count() == 0
    assert perplexity.quality_rules(nothing).count() == 0


def test_model_is_a_distribution_and_rounds_add_up(docs):
    texts = docs.select("doc_id", perplexity.F.coalesce("lang", perplexity.F.lit("und")).alias("lang"), "text")
    models = perplexity.fit_models(perplexity.ngram_counts(texts))
    cells = [r for r in models.where("lang = 'en'").collect()]
    sent = perplexity.SentModel([(r["cell"], np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["vals"], np.float32)) for r in cells], models.lowest["en"])
    for context in (b"\0\0\0\0", b"same", b"a b ", b"zzzz"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp(sent.log_probs(codes)).sum() - 1) < 1e-3
    once, often = (found(perplexity.scored(texts, models, bound), ["doc_id", "n_words", "_log_p"]) for bound in (10**7, 2000))
    assert [r[:2] for r in once] == [r[:2] for r in often]
    assert np.allclose([r[2] for r in once], [r[2] for r in often])


def test_rounds_keep_repeated_rows_apart(spark):
    rng = np.random.default_rng(8)
    one, two = sentence(rng, 15), sentence(rng, 25)
    rows = [(1, one, "en")] * 3 + [(None, one, "en")] * 2 + [(None, two, None)] * 2 + [(2, two, "de"), (None, None, "en"), (None, None, "en")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumn("lang", perplexity.F.coalesce("lang", perplexity.F.lit("und")))
    models = perplexity.fit_models(perplexity.ngram_counts(texts))
    once, often = (found(perplexity.scored(texts, models, bound), ["doc_id", "lang", "n_bytes", *perplexity.RULES, "_log_p"]) for bound in (10**7, 50))
    assert len(often) == len(rows) and [r[:-1] for r in once] == [r[:-1] for r in often]
    assert np.allclose([r[-1] for r in once], [r[-1] for r in often])
    assert sorted(r[3] for r in often) == [0, 0, 15, 15, 15, 15, 15, 25, 25, 25]


@pytest.mark.parametrize("others", [0, 30])
def test_language_of_only_empty_texts(spark, others):
    rng = np.random.default_rng(9)
    rows = [(1, None, "xx", "s", None), (2, "", "xx", "s", 0), (3, None, None, None, None)] + [(10 + k, sentence(rng, 40), "en", "s", 1) for k in range(others)]
    out = perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == len(rows)
    empty = found(out.where("doc_id < 10"), ["doc_id", *perplexity.RULES, "base_failed", "kept", "log_perplexity"])
    assert empty == [(k, 0, 0, 0, 0, 0, True, False, None) for k in (1, 2, 3)]


def test_band_rejects_gibberish_of_a_language(spark):
    rng = np.random.default_rng(4)
    rows = [(k, sentence(rng, 60), "en", "s", 1) for k in range(300)] + [(300, "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 900)).replace("倀", " ") + " x" * 30, "en", "s", 1)]
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not kept.pop(300) and all(kept.values())


def test_band_rejects_both_tails_in_the_languages_own_letters(spark):
    rng = np.random.default_rng(11)
    known = [sentence(rng, 1) for _ in range(400)]
    rows = [(k, " ".join(rng.choice(known, 150)), "en", "s", 1) for k in range(300)]
    shuffled = ["".join(rng.permutation(list(rows[k][1]))) for k in range(5)]
    poor = [" ".join(rng.choice(known[:12], 150)) for _ in range(5)]
    rows += [(1000 + k, t, "en", "s", 1) for k, t in enumerate(shuffled)] + [(2000 + k, t, "en", "s", 1) for k, t in enumerate(poor)]
    out = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    level = np.median([out[k].log_perplexity for k in range(300)])
    assert not any(r.base_failed for r in out.values())
    assert all(out[k].log_perplexity > level and not out[k].kept for k in range(1000, 1005))
    assert all(out[k].log_perplexity < level and not out[k].kept for k in range(2000, 2005))
    assert sum(out[k].kept for k in range(300)) >= 290


def test_band_is_not_narrowed_by_copies(spark):
    rng = np.random.default_rng(12)
    one = sentence(rng, 150)
    rows = [(k, sentence(rng, 150), "en", "s", 1) for k in range(100)] + [(1000 + k, one, "en", "s", 1) for k in range(400)]
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(kept[k] for k in range(100)) >= 95


# Packing, counting and writing tokens


def library(name, texts):
    tool = encoding.load(encoding.tokenizer_path(name))
    return [e.ids for e in tool.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_hold_the_library_ids_and_fill_sequences(docs, nothing):
    texts = [r[1] for r in odd_rows()]
    expected, sequences = [], defaultdict(list)
    for (i, *_), ids in zip(odd_rows(), library("word_bpe_49k.json", texts), strict=True):
        ids = np.array([*ids, 0], "<u4")
        expected += [(i, k, k * 2048, len(ids[k * 2048 :][:2048]), zlib.crc32(ids[k * 2048 :][:2048])) for k in range(-(-len(ids) // 2048))]
    out = packing.pack_documents(docs)
    assert found(out, ["doc_id", "piece", "start", "length", "ids_crc32"]) == sorted(expected, key=key)
    for r in out.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert packing.pack_documents(nothing).count() == 0


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(6)
    lengths = Counter(np.clip(rng.lognormal(6, 0.9, 20_000).astype(int), 1, 2048).tolist())
    runs = packing.pack_histogram(dict(lengths))
    held = Counter()
    for _, n, content in runs:
        assert sum(content) <= 2048
        for size in content:
            held[size] += n
    assert held == lengths
    assert sum(n for _, n, _ in runs) <= 1.01 * sum(k * v for k, v in lengths.items()) / 2048 + 1
    assert packing.pack_histogram({}) == [] and sum(n for _, n, _ in packing.pack_histogram({2048: 3, 1: 2})) == 4


def test_token_counts_match_the_library(docs, nothing):
    ids = library("byte_bpe_50k.json", [r[1] for r in odd_rows()])
    expected = [(i, len(raw(t)), len(x), len(x) > 1024) for (i, t, *_), x in zip(odd_rows(), ids, strict=True)]
    assert found(tokencount.token_counts(docs), ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == sorted(expected, key=key)
    assert tokencount.token_counts(nothing).count() == 0


def test_span_memory_may_overflow(docs):
    tool = encoding.Encoder(encoding.tokenizer_path("byte_bpe_50k.json"), True)
    tool.memory.limit = 5
    texts = [r[1] for r in odd_rows()]
    batch = encoding.pa.RecordBatch.from_arrays([encoding.pa.array(texts)], ["text"])
    got = [ids[at[k] : at[k + 1]].tolist() for a, b, ids, at in encoding.encoded(batch, "text", tool) for k in range(b - a)]
    assert got == library("byte_bpe_50k.json", texts)


def test_token_files_round_trip(docs, nothing):
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for (i, *_), ids in zip(order, library("byte_bpe_50k.json", [r[1] for r in order]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    files = wavelet.write_token_files(docs, shard_tokens=500)
    assert files.count() > 3
    assert found(wavelet.read_token_files(files), ["doc_id", "start", "n_tokens", "ids_crc32"]) == sorted(expected, key=key)
    assert wavelet.token_index(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 5000])
def test_wavelet_queries(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    matrix, names, lengths = wavelet.open_file(wavelet.file_bytes(wavelet.WaveletMatrix.build(ids), np.array([4]), np.array([n])))
    assert (matrix.decode() == ids).all() and names.tolist() == [4] and lengths.tolist() == [n]
    if n:
        at = np.arange(0, n, 7)
        assert (matrix.access(at) == ids[at]).all()
        for token in (int(ids[0]), 299, 300):
            assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == (ids == token).sum() and matrix.rank(token, n // 2) == (ids[: n // 2] == token).sum()


# Jaccard join


def plain_groups(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(sets[i]), None if i is None else find(i)) for i, *_ in rows), key=key)


def group_rows():
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for _ in range(6):
        words = sentence(rng, int(rng.integers(12, 90))).split()
        for _ in range(int(rng.integers(2, 40))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = sentence(rng, 1)
            rows.append((k, " ".join(copy), "en", "s", 1))
            k += 1
    return rows


@pytest.mark.parametrize("carried", [4, 1])
def test_groups_match_brute_force(spark, docs, nothing, monkeypatch, carried):
    monkeypatch.setattr(jaccard, "PREDECESSORS", carried)
    columns = ["doc_id", "n_shingles", "component_id"]
    copies = spark.createDataFrame(group_rows(), SCHEMA)
    for width, percent in ((3, 90), (5, 80)):
        assert found(jaccard.near_duplicates(copies, width, percent), columns) == plain_groups(group_rows(), width, percent)
    if carried == 4:
        found_rows = [r for r in found(jaccard.near_duplicates(docs, 3, 90), columns) if r[0] is not None]
        assert found_rows == [r for r in plain_groups(odd_rows(), 3, 90) if r[0] is not None]
        assert jaccard.near_duplicates(nothing).count() == 0
        kept = jaccard.one_of_each(docs)
        assert kept.columns == docs.columns
        groups = {c for i, _, c in plain_groups(odd_rows(), 5, 80) if i is not None}
        assert {r.doc_id for r in kept.collect()} - {None} == groups


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    from lattica.llm.tables import last_stays, staged

    monkeypatch.setattr("lattica.session.shared_dir", lambda spark: str(tmp_path))
    with last_stays(spark):
        once = staged(spark.range(5), "once")
        result = staged(once.selectExpr("id + 1 as id"), "result")
    outside = staged(spark.range(2), "outside")
    assert [p.name.split("-")[0] for p in sorted(tmp_path.iterdir())] == ["outside", "result"]
    assert result.count() == 5 and outside.count() == 2


def test_parity_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(31)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for gone, new in ((0, 0), (n // 10, 0), (n // 20, n // 20), (0, n // 9), (n // 2, n)):
            two = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            if not len(two):
                continue
            sketches = [np.frombuffer(jaccard.parity_sketch(s), np.uint64) for s in (one, two)]
            apart = len(np.setxor1d(one, two))
            assert apart // 3 <= jaccard.least_apart(*sketches) <= apart


def test_join_of_an_id_with_different_texts(spark):
    rng = np.random.default_rng(21)
    one, two, three = (sentence(rng, 100) for _ in range(3))
    near = [f"{t} more" for t in (one, two, three)]
    rows = [(5, one), (5, two), (5, three), (6, near[0]), (7, near[1]), (4, near[2]), (9, sentence(rng, 50)), (9, sentence(rng, 50)), (10, sentence(rng, 50))]
    out = found(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90), ["doc_id", "component_id"])
    assert out == [(4, 4), (5, 4), (5, 4), (5, 4), (6, 4), (7, 4), (9, 9), (9, 9), (10, 10)]



def test_components_of_chains(spark):
    from lattica.llm.components import components

    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7)] + [(k, 999) for k in range(200, 230)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {out[k] for k in range(41)} == {0} and {out[k] for k in (100, 101, 102)} == {100} and {out[k] for k in range(200, 230)} == {200}
    assert out[999] == 200


# HTML


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu entry</a></li></ul></nav><div id="cookie-notice">We use cookies on this site and you may say no to them.</div>
<main><article><h1>The title</h1><p>First   paragraph of the text, with <b>bold</b> and &amp; &lt;signs&gt;.<p>Short.<div class="ad">Buy it now in all of the shops</div>
<ul><li><a href="/r">Related entry</a></li></ul><p>Last one of the text.</p><section class="comments"><p>I think that this is not what it was in the past.</p></section>
</article></main><aside>On the side of the page</aside><form>Your name <input></form><footer>&copy; 2020 by the owner of all this</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes(spark):
    assert htmltext.main_text(PAGE) == "The title\nFirst paragraph of the text, with bold and & <signs>.\nShort.\nLast one of the text."
    junk = "THTHER!! ONERSTAN!! XX!! " * 9
    assert htmltext.main_text(f"<body><div class='ad'>buy</div><article><h1>XX!!</h1><p><b>{junk}<br></article><footer>f") == f"XX!!\n{junk.strip()}"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" * 2000 + "deep"), (4, "x", "a < b <"), (5, "y", "<nav>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as text", "1 as n_chars")
    out = htmltext.extract_pages(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.url): r for r in out.collect()}
    assert out.count() == 7 and got[(2, None)].text == "" and got[(None, "v")].n_chars == 0 and got[(5, "y")].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


RUSSIAN = "Вчера вечером жители города собрались на площади, чтобы послушать музыку и посмотреть на новый фонтан, который строили почти два года и наконец открыли для всех желающих гостей."
CHINESE = "昨天晚上城里的居民聚集在广场上听音乐并观看花了将近两年时间才建成的新喷泉终于向所有的游客开放大家都觉得非常高兴孩子们在水边玩耍到很晚才回家"


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE])
def test_languages_without_stop_words_go_by_length_and_links(text):
    links = "<ul>" + f"<li><a href=x>{text}</a></li>" * 3 + "</ul>"
    page = f"<body>{links}<div class='content'><p>{text}</p><p>{text[:12]}</p><p>{text}</p></div><div class='sidebar'><p>{text}</p></div>"
    assert htmltext.main_text(page) == f"{text}\n{text[:12]}\n{text}"
    assert htmltext.main_text(f"<nav>{text}</nav><article><p>{text}</p></article>") == text


def test_names_inside_an_article_and_of_layouts():
    body = "<h2 id='related-work'>Related work</h2><p class='share-price'>The share price of it was up.</p><p class='ad'>Buy this now.</p><div class='share-bar'><p>Share it</p></div>"
    assert htmltext.main_text(f"<article>{body}</article>") == "Related work\nThe share price of it was up."
    good = "<p>The cat sat on the mat and it was happy to be there with the dog and with the fish for a long time in the house.</p>"
    for name in ("content with-sidebar", "no-sidebar", "menu-open", "has-cookie-notice"):
        assert htmltext.main_text(f"<body><div class='{name}'>{good}</div>").startswith("The cat")
    for name in ("sidebar", "site-footer", "cookie-notice with-sidebar", "adSlot"):
        assert htmltext.main_text(f"<body><div class='{name}'>{good}</div>") == ""


def test_formulas_and_drawings_in_an_article_are_text():
    page = "<article><p>Let <math><mi>x</mi><annotation>x</annotation></math> be <object data=o>some</object> number.<svg><title>Icon</title><text>Axis</text></svg></p></article>"
    assert htmltext.main_text(page) == "Let x be some number.Axis"


def test_blocks_without_an_article_are_judged_by_words():
    good = "<p>The cat sat on the mat and it was happy to be there with the dog and with the fish for a long time in the house.</p>"
    links = "<div>" + "<a href=x>one two</a> " * 9 + "</div>"
    assert htmltext.main_text(f"<body>{links}<div>{good}<p>ok then</p>{good}</div>{links}").count("\n") == 2
