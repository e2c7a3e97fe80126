"""Phrases, license scans and ranked search against plain versions, on rows with every oddity."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import collocations, licenses, search
from tests.llm.test_llm_operators import EXTRA, LOWER, SCHEMA, key, odd_rows

PIECE, SPACED = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LICENSES = [
    "This work is licensed under the GNU General Public License, version 3.",
    "MIT\nlicense! and again MIT-License; then the Apache\tLicense (Version 2.0)",
    "cc by cc by cc-by; licensed under CC BY-NC 4.0",
    "SPDX-License-Identifier: BSD-3-Clause",
    "mit ohne lizenz, by the cc of a public license for gnu general things",
    "GNU Lesser General Public License 2.1 or any later version",
]


def rows():
    rng = np.random.default_rng(11)
    found = odd_rows()
    vocabulary = ["the", "Of", "new", "york", "city", "ñandú", "東京", "stock", "exchange", "a"]
    for k in range(120):
        words = [vocabulary[int(j)] for j in rng.zipf(1.6, 60) % len(vocabulary)]
        marks = rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " \r\n", "!"], 60)
        found.append((1000 + k, "".join(w + m for w, m in zip(words, marks, strict=True)) + "New York City " * (k % 5), ("en", "de", None, "und")[k % 4], "s", 1))
    found += [(2000 + k, t, "en", "s", 1) for k, t in enumerate(LICENSES)]
    return [*found, (7, "x1 " * 40_000 + "new york " * 20_000, "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in (*EXTRA, "rank", "w1", "word", "item", "labels", "hot", "f"):
        frame = frame.selectExpr("*", f"'own' as {name}")
    return frame.cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def listed(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


# Phrases


def plain_counts(table):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in table:
        for piece in PIECE.split((text or "").translate(LOWER)):
            words = SPACED.findall(piece)
            for size in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts


def plain_phrases(table, least, top, covered):
    out = []
    for lang, f in plain_counts(table).items():
        n, ranked = sum(v for k, v in f.items() if len(k) == 1), []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and b * 100 >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=key)


@pytest.mark.parametrize("least, top, covered", [(10, 2000, 50), (2, 25, 90)])
def test_phrases_equal_brute_force(docs, least, top, covered):
    found = listed(collocations.collocations(docs, least, top, covered), ["lang", "rank", "phrase", "a", "l", "r", "n", "score"])
    assert found and found == plain_phrases(rows(), least, top, covered)


@pytest.mark.parametrize("bucket_bytes, hot_bound", [(3000, 1 << 20), (3000, 3), (1 << 30, 1)])
def test_hot_pairs_are_split_and_added_up(docs, bucket_bytes, hot_bound):
    words, phrases = collocations.phrase_counts(docs, 5, bucket_bytes, hot_bound)
    wanted = plain_counts(rows())
    assert listed(phrases, ["lang", "w1", "w2", "w3", "f"]) == sorted(((lang, *p, *[None] * (3 - len(p)), n) for lang, f in wanted.items() for p, n in f.items() if len(p) > 1 and n >= 5), key=key)
    totals = {lang: sum(n for p, n in f.items() if len(p) == 1) for lang, f in wanted.items()}
    # A language without any word has a row in neither.
    assert {r.lang: r.f for r in words.where("word is null").collect() if r.f} == {k: n for k, n in totals.items() if n}


def test_partitions_equal_a_sort():
    rng = np.random.default_rng(5)
    columns = [rng.zipf(1.3, 4000) % 50 + 1, rng.zipf(1.3, 4000) % 50 + 1, rng.zipf(1.3, 4000) % 50]
    weight = rng.integers(1, 4, 4000)
    for least in (1, 7):
        for depth, (pointer, total) in enumerate(collocations.equal_partitions(columns, weight, [least] * 3)):
            wanted = Counter()
            for *words, w in zip(*columns[: depth + 1], weight, strict=True):
                if words[-1]:
                    wanted[tuple(map(int, words))] += int(w)
            assert {tuple(int(c[p]) for c in columns[: depth + 1]): int(t) for p, t in zip(pointer, total, strict=True)} == {k: n for k, n in wanted.items() if n >= least}


def test_no_phrases_without_texts(nothing, docs):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


# Licenses


def plain_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_base_places_equal_brute_force(docs, nothing):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert listed(licenses.license_report(docs), columns) == sorted(((i, *plain_base(t)) for i, t, *_ in rows()), key=key)
    assert licenses.license_report(nothing).count() == 0 and licenses.license_detections(nothing).count() == 0


def test_license_labels(docs):
    found = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    labels = [found[2000 + k].labels for k in range(len(LICENSES))]
    assert labels == ["gpl,gpl-3.0", "apache,apache-2.0,mit", "cc-by,cc-by-nc", "bsd-3-clause", "", "lgpl-2.1"]
    assert found[2003].score == 1.0 and found[2004].score == 0.0 and all(0 <= r.score <= 1 for r in found.values())
    assert all(set(r.base_labels.split(",")) <= {"", *r.labels.split(",")} for r in found.values())


def test_detections_equal_every_rule_tried_everywhere(docs):
    rules = licenses.signature_rules()
    assert len(rules) > 500 and len({r.name for r in rules}) == len(rules)
    wanted = []
    for i, text, *_ in rows():
        words = WORD.findall((text or "")[:20_000].translate(LOWER))
        if i == 7 or not words:
            continue
        form = " ".join(words).encode()
        places = {p: k for k, p in enumerate(np.cumsum([0, *(len(w.encode()) + 1 for w in words)]).tolist())}
        hits = [(places[m.start()], places[m.end() + 1] - 1, r) for r in rules for m in r.pattern.finditer(form)]
        for k, (a, b, r) in enumerate(hits):
            inside = any(c <= a and d >= b and (s.priority, d - c, -j) > (r.priority, b - a, -k) for j, (c, d, s) in enumerate(hits) if s.priority > r.priority or s.priority == r.priority)
            wanted.append((i, r.name, a, b, not inside))
    found = licenses.license_detections(docs).where("doc_id is null or doc_id <> 7")
    assert listed(found, ["doc_id", "rule", "first_word", "last_word", "kept"]) == sorted(wanted, key=key)


# Search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plain_ranking(table, items, k):
    texts = [(i, Counter(terms(t))) for i, t, *_ in table if terms(t)]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            norm = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * norm)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=key)


ITEMS = [("a", "the NEW york stock exchange; new"), ("b", None), ("c", ""), ("d", "never-seen-term"), ("e", "one two words 東京 ñandú x1"), ("e", "one"), (None, "abc city the the the"), ("z", " ".join(r[1] for r in odd_rows()[6:8]))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id string, text string").selectExpr("*", "'own' as rank", "0 as item", "0 as score")


@pytest.mark.parametrize("settings", [{}, {"k": 3, "bound": 40, "postings": 50}])
def test_ranking_equals_brute_force(docs, items, settings):
    found = listed(search.ranked_search(docs, items, **settings), ["item_id", "rank", "doc_id", "score"])
    assert found and found == plain_ranking(rows(), ITEMS, settings.get("k", 10))


def test_search_looks_at_part_of_the_documents():
    rng = np.random.default_rng(9)
    n_docs, n_terms = 3000, 40
    doc, term = np.nonzero(rng.random((n_docs, n_terms)) < 0.2)
    impact = (1000 * rng.pareto(2, len(doc)) + 1).astype(np.int64)
    gain = rng.integers(1, 50, n_terms)
    asked = [rng.choice(n_terms, 6, replace=False) for _ in range(5)]
    one = search.Search(search.Shard(n_docs, doc, term, impact), np.concatenate(asked), gain[np.concatenate(asked)], np.arange(6) * 6, 10)
    for mine, found in zip(asked, one.run(), strict=True):
        total = np.zeros(n_docs, np.int64)
        some = np.isin(term, mine)
        np.add.at(total, doc[some], gain[term[some]] * impact[some])
        tenth = np.sort(total)[-10]
        assert sorted(found) == sorted((int(total[d]), int(d)) for d in np.flatnonzero(total >= tenth))
    assert one.splits < 5 * n_docs / 4


def test_search_of_nothing(docs, nothing, items):
    assert search.ranked_search(nothing, items).count() == 0
    empty = search.ranked_search(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
