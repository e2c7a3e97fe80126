"""Spans that a linear hash cannot tell apart, through every operator that hashes spans."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lattica.llm import decontaminate, encoding, jaccard, packing, perplexity, textkit, tokencount, wavelet


def thue_morse(size, a, b):
    word = a
    while len(word) < size:
        word += word.translate(str.maketrans(a + b, b + a)) if len(word) > 1 else b
    return word, word.translate(str.maketrans(a + b, b + a))


SIZES = (1024, 2048, 4096, 8192)


def spans_of(pieces):
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(p) for p in pieces])
    return raw, end - [len(p) for p in pieces], end


@pytest.mark.parametrize("size", SIZES)
def test_patterned_spans_have_their_own_hash(size):
    words = [w.encode() for w in thue_morse(size, "a", "b")]
    raw, begin, end = spans_of(words)
    assert len(set(textkit.span_hashes(raw, begin, end).tolist())) == 2
    assert textkit.span_hashes(raw, begin, end, textkit.LOWER).tolist() == textkit.span_hashes(np.frombuffer(raw.tobytes().upper(), np.uint8), begin, end, textkit.LOWER).tolist()


def test_distinct_spans_are_exact_whatever_the_hash(monkeypatch):
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 3000)]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(textkit, "span_hashes", lambda raw, begin, end: (end - begin).astype(np.uint64))
        number, first = textkit.distinct_spans(*spans_of(pieces))
        assert len(first) == len(set(pieces)) and all(pieces[first[n]] == p for n, p in zip(number, pieces, strict=True))


def test_span_memory_compares_bytes():
    memory = encoding.SpanMemory(lambda pieces: (np.array([zlib.crc32(p) for p in pieces], np.uint32), np.ones(len(pieces), np.int64)))
    pieces = [b"one", b"two", b"a longer span than eight", b"a longer span than nine.", b"one", b""]
    for _ in range(2):
        entry = memory.lookup(np.full(len(pieces), 7, np.uint64), *spans_of(pieces))
        assert memory.values[memory.begins[entry]].tolist() == [zlib.crc32(p) for p in pieces]


@pytest.fixture(scope="module")
def pairs(spark):
    texts = [w for size in SIZES[:3] for w in thue_morse(size, "a", "b")]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_tokens_of_patterned_words(pairs):
    texts, docs = pairs
    for name, query in (("byte_bpe_50k.json", wavelet.token_index), ("word_bpe_49k.json", packing.pack_documents)):
        tool = Tokenizer.from_file(encoding.tokenizer_path(name))
        wanted = [np.array([*tool.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
        rows = {}
        for r in query(docs).collect():
            rows.setdefault(r.doc_id, {})[getattr(r, "piece", 0)] = r.ids_crc32
        for k, ids in enumerate(wanted):
            assert rows[k] == {p: zlib.crc32(ids[2048 * p : 2048 * p + 2048].tobytes()) for p in range(-(-len(ids) // 2048))} if query is packing.pack_documents else {0: zlib.crc32(ids.tobytes())}
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    tool = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    assert counts == {k: len(tool.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_patterned_words_are_not_duplicates(spark, pairs):
    texts, docs = pairs
    assert all(r.component_id == r.doc_id for r in jaccard.near_duplicates(docs, width=3, percent=90).collect())
    items = spark.createDataFrame([("item", texts[1])], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.contamination(docs, items).where("contaminated").collect()] == [1]
    lines = pa.array(["\n".join(texts[:2])])
    found = perplexity.text_rules(*textkit.packed(lines))
    assert found["n_dup_lines"].tolist() == [0]
