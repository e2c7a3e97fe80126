"""License scans by ordered signature rules.

A text is brought to its lower-case words with single spaces between, so rules see neither
markup nor line breaks. Rules are regular expressions over that form, written as license
names times the ways a text refers to a license. A rule is only tried on texts that hold its
keywords, found for a whole batch at once. Where detections overlap, an interval inside that
of a rule of higher priority, or of a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.textkit import LOWER, blocks, byte_set, distinct_spans, owners, packed, spans

#: Bytes of words after lower-casing A-Z, so both cases here (fixed values).
WORD = ~byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_VERSION = r"(?: v(?:ersion)?)?"


@dataclass(frozen=True)
class Name:
    """A license: its label, how prose names it, its short identifier in words, and words that must occur
    (``a|b``: one of them)."""

    label: str
    prose: str
    short: str
    keys: tuple[str, ...]


def _name(label: str, prose: str, short: str, keys: str) -> Name:
    return Name(label, prose, short, tuple(keys.split()))


NAMES = (
    _name("mit", r"(?:mit|expat)", r"mit", "mit|expat"),
    _name("mit-0", r"mit no attribution", r"mit 0", "mit"),
    _name("mit-cmu", r"(?:mit cmu|cmu mit)", r"mit cmu", "mit cmu"),
    _name("x11", r"x11", r"x11", "x11"),
    _name("isc", r"isc", r"isc", "isc"),
    _name("0bsd", r"(?:zero clause bsd|bsd zero clause)", r"0bsd", "bsd"),
    _name("bsd-1-clause", r"(?:1|one) clause bsd", r"bsd 1 clause", "bsd clause"),
    _name("bsd-2-clause", r"(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)", r"bsd 2 clause", "bsd|freebsd"),
    _name("bsd-3-clause", r"(?:new bsd|revised bsd|modified bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)", r"bsd 3 clause", "bsd"),
    _name("bsd-4-clause", r"(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause)", r"bsd 4 clause", "bsd"),
    _name("bsd", r"bsd(?: style)?", r"bsd", "bsd"),
    _name("apache-1.0", rf"apache(?: software)?(?: licen[sc]e)?{_VERSION} ?1 0", r"apache 1 0", "apache"),
    _name("apache-1.1", rf"apache(?: software)?(?: licen[sc]e)?{_VERSION} ?1 1", r"apache 1 1", "apache"),
    _name("apache-2.0", rf"apache(?: software)?(?: licen[sc]e)?{_VERSION} ?2(?: 0)?", r"apache 2 0", "apache"),
    _name("apache", r"apache(?: software)?", r"apache", "apache"),
    _name("gpl-1.0", rf"(?:gnu general public licen[sc]e|(?:gnu )?gpl){_VERSION} ?1(?: 0)?", r"gpl 1 0(?: only)?", "gpl|gnu"),
    _name("gpl-2.0", rf"(?:gnu general public licen[sc]e|(?:gnu )?gpl){_VERSION} ?2(?: 0)?", r"(?:gpl 2 0(?: only)?|gplv2)", "gpl|gnu"),
    _name("gpl-3.0", rf"(?:gnu general public licen[sc]e|(?:gnu )?gpl){_VERSION} ?3(?: 0)?", r"(?:gpl 3 0(?: only)?|gplv3)", "gpl|gnu"),
    _name("gpl", r"(?:gnu )?gpl", r"gpl", "gpl"),
    _name("gpl", r"gnu general public", r"gnu general public licen[sc]e", "gnu general public"),
    _name("lgpl-2.0", rf"(?:gnu )?(?:library general public licen[sc]e|lgpl){_VERSION} ?2 0", r"lgpl 2 0(?: only)?", "lgpl|lesser|library"),
    _name("lgpl-2.1", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_VERSION} ?2 1", r"lgpl 2 1(?: only)?", "lgpl|lesser|library"),
    _name("lgpl-3.0", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_VERSION} ?3(?: 0)?", r"lgpl 3 0(?: only)?", "lgpl|lesser|library"),
    _name("lgpl", r"(?:gnu )?(?:lesser|library) general public", r"lgpl", "general public"),
    _name("agpl-3.0", rf"(?:gnu )?(?:affero general public licen[sc]e|agpl){_VERSION} ?3(?: 0)?", r"agpl 3 0(?: only)?", "agpl|affero"),
    _name("agpl", r"(?:gnu )?affero general public", r"agpl", "affero"),
    _name("gfdl", r"gnu free documentation", r"gfdl(?: 1 [1-3])?", "documentation"),
    _name("mpl-1.1", rf"mozilla public licen[sc]e{_VERSION} ?1 1", r"mpl 1 1", "mozilla"),
    _name("mpl-2.0", rf"mozilla public licen[sc]e{_VERSION} ?2(?: 0)?", r"mpl 2 0", "mozilla"),
    _name("mpl", r"mozilla public", r"mpl", "mozilla"),
    _name("epl-1.0", rf"eclipse public licen[sc]e{_VERSION} ?1(?: 0)?", r"epl 1 0", "eclipse"),
    _name("epl-2.0", rf"eclipse public licen[sc]e{_VERSION} ?2(?: 0)?", r"epl 2 0", "eclipse"),
    _name("epl", r"eclipse public", r"epl", "eclipse"),
    _name("cddl-1.0", rf"common development and distribution licen[sc]e(?:{_VERSION} ?1(?: 0)?)?", r"cddl(?: 1 0)?", "distribution"),
    _name("eupl-1.2", rf"european union public licen[sc]e(?:{_VERSION} ?1 2)?", r"eupl(?: 1 2)?", "european"),
    _name("artistic-2.0", rf"artistic licen[sc]e(?:{_VERSION} ?2(?: 0)?)?", r"artistic 2 0", "artistic"),
    _name("zlib", r"(?:zlib|zlib libpng)", r"zlib", "zlib"),
    _name("libpng", r"libpng", r"libpng(?: 2 0)?", "libpng"),
    _name("bsl-1.0", rf"boost software(?: licen[sc]e{_VERSION} ?1 0)?", r"bsl 1 0", "boost"),
    _name("python-2.0", r"(?:python software foundation|psf)", r"(?:python|psf) 2 0", "python|psf"),
    _name("php-3.01", r"php", r"php 3 01", "php"),
    _name("ruby", r"ruby", r"ruby", "ruby"),
    _name("w3c", r"w3c(?: software)?(?: notice and)?", r"w3c", "w3c"),
    _name("ofl-1.1", r"(?:sil )?open font", r"ofl 1 1", "font"),
    _name("unicode", r"unicode(?: terms of use)?", r"unicode (?:dfs 2016|3 0)", "unicode"),
    _name("openssl", r"openssl", r"openssl", "openssl"),
    _name("postgresql", r"postgresql", r"postgresql", "postgresql"),
    _name("ncsa", r"(?:university of illinois ncsa|ncsa)(?: open source)?", r"ncsa", "ncsa"),
    _name("wtfpl", r"do what the fuck you want to public", r"wtfpl", "want"),
    _name("unlicense", r"unlicense", r"unlicense", "unlicense"),
    _name("ms-pl", r"microsoft public", r"ms pl", "microsoft"),
    _name("ms-rl", r"microsoft reciprocal", r"ms rl", "microsoft"),
    _name("cpl-1.0", r"common public", r"cpl 1 0", "common"),
    _name("ibm-pl", r"ibm public", r"ipl 1 0", "ibm"),
    _name("osl-3.0", r"open software", r"osl 3 0", "open software"),
    _name("afl-3.0", r"academic free", r"afl 3 0", "academic"),
    _name("ecl-2.0", r"educational community", r"ecl 2 0", "educational"),
    _name("cc0-1.0", r"(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?", "cc0|zero"),
    _name("cc-by-nc-nd", r"(?:creative commons attribution|cc by) (?:noncommercial|non commercial|nc) (?:noderivatives|no derivatives|noderivs|nd)(?: [1-4] [05])?", r"cc by nc nd(?: [1-4] [05])?", "cc|commons nc|noncommercial|non"),
    _name("cc-by-nc-sa", r"(?:creative commons attribution|cc by) (?:noncommercial|non commercial|nc) (?:sharealike|share alike|sa)(?: [1-4] [05])?", r"cc by nc sa(?: [1-4] [05])?", "cc|commons nc|noncommercial|non"),
    _name("cc-by-nc", r"(?:creative commons attribution|cc by) (?:noncommercial|non commercial|nc)(?: [1-4] [05])?", r"cc by nc(?: [1-4] [05])?", "cc|commons nc|noncommercial|non"),
    _name("cc-by-nd", r"(?:creative commons attribution|cc by) (?:noderivatives|no derivatives|noderivs|nd)(?: [1-4] [05])?", r"cc by nd(?: [1-4] [05])?", "cc|commons nd|noderivatives|noderivs|derivatives"),
    _name("cc-by-sa", r"(?:creative commons attribution|cc by) (?:sharealike|share alike|sa)(?: [1-4] [05])?", r"cc by sa(?: [1-4] [05])?", "cc|commons sa|sharealike|share"),
    _name("cc-by-4.0", r"cc by 4(?: 0)?", r"cc by 4 0", "cc by"),
    _name("cc-by-3.0", r"cc by 3(?: 0)?", r"cc by 3 0", "cc by"),
    _name("cc-by", r"creative commons attribution(?: [1-4] [05])?", r"cc by", "commons attribution"),
    _name("odbl-1.0", r"open (?:data commons open )?database", r"odbl(?: 1 0)?", "database"),
    _name("odc-by-1.0", r"open data commons attribution", r"odc by(?: 1 0)?", "commons attribution"),
    _name("pddl-1.0", r"public domain dedication and", r"pddl(?: 1 0)?", "dedication"),
    _name("openrail", r"(?:bigscience|creativeml)?(?: )?open ?rail(?: m)?", r"openrail(?: m)?", "openrail|rail"),
    _name("busl-1.1", r"business source", r"bu?sl 1 1", "business"),
    _name("sspl-1.0", r"server side public", r"sspl 1 0", "server"),
    _name("elastic-2.0", r"elastic", r"elastic 2 0", "elastic"),
)


@dataclass(frozen=True)
class Form:
    """A way to refer to a license, with the words of which one must occur."""

    name: str
    pattern: str
    priority: int
    confidence: float
    keys: tuple[str, ...]


FORMS = (
    Form("tag", r"spdx license identifier {short}(?: or later)?", 5, 1.0, ("spdx",)),
    Form("later", r"(?:the )?{prose}(?: licen[sc]e)?(?: as published by the free software foundation)?(?: either)?(?: version [1-3](?: [0-9])?)? (?:or|and) (?:at your option )?any later(?: version)?", 4, 0.95, ("later",)),
    Form("grant", r"(?:licen[sc]ed|released|distributed|available|provided|published|redistributed|covered|offered|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?{prose}(?: (?:public )?licen[sc]e)?(?: version [0-9](?: [0-9])?)?", 4, 0.95, ("under",)),
    Form("link", r"(?:opensource org licen[sc]es?|spdx org licenses|creativecommons org licenses|gnu org licenses|apache org licenses) (?:licen[sc]e )?{short}(?: html| txt| php)?", 4, 0.9, ("org",)),
    Form("terms", r"(?:terms|conditions|text|copy) of (?:the )?{prose}(?: public)? licen[sc]e(?: version [0-9](?: [0-9])?)?", 3, 0.9, ("license", "licence")),
    Form("cited", r"(?:the )?{prose}", 3, 0.85, ("license", "licence")),
    Form("field", r"licen[sc]e (?:is |type |name |id |identifier )?{short}", 2, 0.8, ("license", "licence")),
    Form("named", r"(?:the )?{prose} (?:public )?licen[sc]e(?: agreement)?(?: (?:v|version) ?[0-9](?: [0-9])?)?", 2, 0.8, ("license", "licence")),
    Form("german", r"unter (?:der |einer )?{prose}(?: public)?(?: license)? lizenz", 3, 0.85, ("lizenz",)),
    Form("french", r"sous (?:la )?licence {prose}", 3, 0.85, ("licence",)),
    Form("spanish", r"bajo (?:la |una )?licencia {prose}", 3, 0.85, ("licencia",)),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: re.Pattern
    priority: int
    confidence: float
    gates: tuple[tuple[str, ...], ...]  # of each, one word must occur


def _whole(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


def signature_rules() -> list[Rule]:
    """All rules in their order: base phrases last, as the least telling."""
    rules = []
    for form in FORMS:
        for k, name in enumerate(NAMES):
            if form.name == "cited" and "licen[sc]e" not in name.prose:
                continue  # only names that say themselves that they are a license
            pattern = form.pattern.format(prose=f"(?:{name.prose})", short=f"(?:{name.short})")
            gates = () if form.name in ("tag", "field", "link") else (tuple(key.split("|")) for key in name.keys)
            rules.append(Rule(f"{form.name}:{name.label}:{k}", name.label, _whole(pattern), form.priority, form.confidence, (form.keys, *gates)))
    rules += [Rule(f"base:{label}", label, _whole(phrase), 1, 0.5, tuple((w,) for w in phrase.split())) for phrase, label in BASE.items()]
    return rules


@dataclass
class Detection:
    rule: Rule
    first: int  # words
    last: int
    text: str
    kept: bool = True


def resolve(found: list[Detection]) -> None:
    """Mark detections that lie inside one of higher priority, or inside a longer one of the same.

    Of equal intervals of one priority the first rule stays.
    """
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for priority in sorted({d.rule.priority for d in found}, reverse=True):
        level = sorted((d for d in found if d.rule.priority == priority), key=lambda d: (d.first, -d.last))
        furthest = -1
        for d in level:
            k = int(np.searchsorted(starts, d.first, "right"))
            d.kept = d.last > furthest and not (k and reach[k - 1] >= d.last)
            furthest = max(furthest, d.last)
        mine = [d for d in level if d.kept]
        starts = np.concatenate([starts, [d.first for d in mine]]).astype(np.int64)
        ends = np.concatenate([reach, [d.last for d in mine]]).astype(np.int64)
        order = np.argsort(starts, kind="stable")
        starts, reach = starts[order], np.maximum.accumulate(ends[order])


class Scanner:
    """All rules, and the keywords that gate them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        known: dict[str, int] = {}
        gates = [[known.setdefault(w, len(known)) for w in gate] for r in rules for gate in r.gates]
        self.keywords = [w.encode() for w in known]
        self.gates = np.zeros((len(gates), len(known)), bool)
        for k, words in enumerate(gates):
            self.gates[k, words] = True
        self.first = np.cumsum([0, *(len(r.gates) for r in rules[:-1])])

    def candidates(self, held: np.ndarray) -> np.ndarray:
        """Rules all of whose gates a text with the ``held`` keywords passes."""
        return np.flatnonzero(np.logical_and.reduceat((self.gates & held).any(1), self.first))

    def block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, list[Detection]]]:
        """Words of every text of a block, and the detections of those that have any."""
        low = LOWER[raw]
        begin, end, before = spans(low, starts, WORD)
        front = np.frombuffer(b"".join(self.keywords), np.uint8)
        stop = np.cumsum([len(w) for w in self.keywords])
        n, size = len(self.keywords), len(front)
        first = np.concatenate([[0], stop[:-1]])
        number, _ = distinct_spans(np.concatenate([front, low]), np.concatenate([first, begin + size]), np.concatenate([stop, end + size]))
        place = np.full(int(number.max()) + 1, -1)
        place[number[:n]] = np.arange(n)
        key = place[number[n:]]
        hit = np.flatnonzero(key >= 0)
        held = np.zeros((len(starts) - 1, n), bool)
        held[owners(before)[hit], key[hit]] = True
        found = {}
        data = low.tobytes()
        sets, which = np.unique(held, axis=0, return_inverse=True) if len(held) else (held, np.zeros(0, np.int64))
        tried = [self.candidates(s) for s in sets]
        for t, k in enumerate(np.ravel(which).tolist()):
            if len(tried[k]):
                mine = self.text([data[a:b] for a, b in zip(begin[before[t] : before[t + 1]].tolist(), end[before[t] : before[t + 1]].tolist(), strict=True)], tried[k])
                if mine:
                    found[t] = mine
        return np.diff(before), found

    def text(self, words: list[bytes], tried: np.ndarray) -> list[Detection]:
        form = b" ".join(words)
        at = np.cumsum([0, *(len(w) + 1 for w in words)])
        found = []
        for k in tried.tolist():
            rule = self.rules[k]
            for m in rule.pattern.finditer(form):
                first, last = np.searchsorted(at, [m.start(), m.end()])
                found.append(Detection(rule, int(first), int(last) - 1, m.group().decode()))
        resolve(found)
        return found


_scanners: list[Scanner] = []


def _scanner() -> Scanner:
    if not _scanners:
        _scanners.append(Scanner(signature_rules()))
    return _scanners[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[list[Detection]]]]:
    tool = _scanner()
    for batch in batches:
        raw, starts = packed(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64())
        for first, last in blocks(starts):
            base = starts[first]
            n_words, found = tool.block(raw[base : starts[last]], starts[first : last + 1] - base)
            yield ids.slice(first, last - first), n_words, [found.get(k, []) for k in range(last - first)]


def license_detections(docs: DataFrame) -> DataFrame:
    """Every detection in every text: doc_id, rule, label, priority, confidence, first_word,
    last_word (words from 0), matched (lower-case words), kept (false: suppressed by another).

    Null and empty texts have none; repeated rows are scanned each.
    """

    def detections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _scan(batches):
            rows = [(i, d) for i, some in zip(ids.to_pylist(), found, strict=True) for d in some]
            values = [[i for i, _ in rows], *([f(d) for _, d in rows] for f in (lambda d: d.rule.name, lambda d: d.rule.label, lambda d: d.rule.priority, lambda d: d.rule.confidence, lambda d: d.first, lambda d: d.last, lambda d: d.text, lambda d: d.kept))]
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["doc_id", "rule", "label", "priority", "confidence", "first_word", "last_word", "matched", "kept"])

    schema = "doc_id long, rule string, label string, priority int, confidence double, first_word long, last_word long, matched string, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(detections, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: its words, the places of base phrases, base labels and all labels.

    ``labels`` joins the base labels with those of detections that no other suppressed;
    ``score`` is the highest confidence among the latter (0: none). Null and empty texts have
    no words, null places and empty labels; null and repeated ids are kept row by row.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n_words, found in _scan(batches):
            base = [[d for d in some if d.rule.name.startswith("base:")] for some in found]
            own = [{d.rule.label for d in some} for some in base]
            every = [{d.rule.label for d in some if d.kept} for some in found]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n_words, pa.int64()),
                    pa.array([len(some) for some in base], pa.int64()),
                    pa.array([min((d.first for d in some), default=None) for some in base], pa.int64()),
                    pa.array([max((d.first for d in some), default=None) for some in base], pa.int64()),
                    pa.array([",".join(sorted(s)) for s in own], pa.string()),
                    pa.array([",".join(sorted(a | b)) for a, b in zip(own, every, strict=True)], pa.string()),
                    pa.array([max((d.rule.confidence for d in some if d.kept), default=0.0) for some in found], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(report, schema)
