"""Quality classifier from positive and unlabelled text.

A linear scorer over statistics of the text is fitted by minimising the non-negative unbiased
risk: trusted positives stand for the good class, all web text of the training fold stands for
the mixture, and the estimated class prior ties them together. Features are computed once into
a narrow table; each step of the fit is one Spark aggregation over the whole of it, and only
the gradient (one number per feature) comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.perplexity import _seen_before, text_rules
from lattica.llm.tables import staged
from lattica.llm.textkit import NOT_SPACE, blocks, byte_set, owners, packed, span_hashes, spans

STEPS, RIDGE, PRIOR_LIMITS = 60, 1e-4, (0.05, 0.99)
_UPPER, _LOWER, _DIGIT = (byte_set(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True
_MARKS, _STOPS, _SHOUT = byte_set(b"#*$%&|<>@^~=_+\\/{}[]"), byte_set(b".,;:"), byte_set(b"!?")
BASE = 17
WIDTH = 3 * BASE + 1


def text_features(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ``BASE`` statistics per text of a block."""
    rules = text_rules(raw, starts)
    n_words, n_bytes = rules["n_words"], np.diff(starts)
    words, size = np.maximum(n_words, 1), np.maximum(n_bytes, 1)

    def share(member: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(member[raw], dtype=np.int64)])[starts])

    begin, end, before = spans(raw, starts, NOT_SPACE)
    text = owners(before)
    hashes = span_hashes(raw, begin, end)

    def per_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text, flags, len(words)) / words

    _, again = _seen_before(text, hashes)
    echo = np.zeros(len(begin), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int64)])
    length = end - begin
    n_letters = letters[end] - letters[begin]
    last = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    lines = share(byte_set(b"\n")) + 1
    return np.stack(
        [
            np.log1p(n_words),
            rules["word_chars"] / words,
            share(_UPPER) / np.maximum(share(_LETTER), 1),
            share(_MARKS) / words,
            share(_DIGIT) / size,
            share(_SHOUT) / words,
            per_words(again) * 10 / np.maximum(np.log1p(n_words), 1),
            per_words(echo),
            rules["n_repeat_words"] / words,
            rules["n_dup_lines"] / lines,
            per_words(n_letters == 0),
            per_words(length <= 3),
            per_words(_STOPS[last]),
            np.log1p(n_words / lines),
            per_words((n_letters > 1) & (upper[end] - upper[begin] >= n_letters)),
            np.log1p(np.bincount(text, length == 1, len(words))),
            per_words(_MARKS[last]),
        ],
        1,
    )


def batch_features(column: pa.Array) -> np.ndarray:
    raw, starts = packed(column)
    found = [np.zeros((0, BASE))]
    for first, last in blocks(starts):
        base = starts[first]
        found.append(text_features(raw[base : starts[last]], starts[first : last + 1] - base))
    return np.concatenate(found)


@dataclass
class Scorer:
    """A fitted classifier: how features are scaled, and their weights."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), x, x * x / 6, np.maximum(np.abs(x) - 1.5, 0)], 1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(features) @ self.weights, -50, 50)))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the packed statistics of every text, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch_features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "features"])

    return staged(docs.select("doc_id", "text").mapInArrow(build, "doc_id long, features binary"), "features")


def held_out(column: str = "doc_id"):
    """Rows kept from the fit: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, prior: float | None = None, steps: int = STEPS) -> Scorer:
    """Minimise the non-negative risk over all training rows of ``features``.

    Positives are the training rows that ``labels`` marks 1 (ids with contradicting labels
    are left out); the mixture is every training row. The prior is the share of 1 among the
    labelled training rows, or ``prior``. Without any positive the scorer is constant.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    marked = marked.agg(F.min("quality").alias("_low"), F.max("quality").alias("_high")).where("_low = _high")
    if prior is None:
        row = marked.agg(F.sum(F.when(F.col("_low") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
        prior = (row[0] or 0) / row[1] if row[1] else 0.5
    prior = float(np.clip(prior, *PRIOR_LIMITS))
    good = marked.where("_low = 1").select("doc_id", F.lit(True).alias("_good"))
    rows = features.where(~held_out()).join(good, "doc_id", "left")
    rows = staged(rows.select("features", F.coalesce("_good", F.lit(False)).alias("good")), "training")

    def summed(build) -> np.ndarray:
        """The sum over all rows of ``build(features, good)``, added up in Spark."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, BASE).astype(float)
                    total = total + build(x, batch.column("good").to_numpy(zero_copy_only=False))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        found = rows.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        values = np.zeros(max((r["i"] for r in found), default=-1) + 1)
        for r in found:
            values[r["i"]] = r["v"]
        return values

    moments = summed(lambda x, g: np.concatenate([[len(x), g.sum()], x.sum(0), (x * x).sum(0)]))
    if len(moments) == 0 or moments[1] == 0:
        return Scorer(np.zeros(BASE), np.ones(BASE), np.zeros(WIDTH), prior)
    n, n_good = moments[:2]
    mean = moments[2 : 2 + BASE] / n
    spread = np.sqrt(np.maximum(moments[2 + BASE :] / n - mean**2, 0))
    model = Scorer(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(WIDTH), prior)
    gram = summed(lambda x, g: (lambda z: (z.T @ z).ravel())(model.inputs(x))).reshape(WIDTH, WIDTH) / n
    bound = np.linalg.inv(0.25 * gram + RIDGE * np.eye(WIDTH))  # of the risk's curvature

    def risk_parts(weights: np.ndarray) -> np.ndarray:
        """Mixture and positives: summed loss as negatives and its gradient; and summed positive inputs."""

        def build(x: np.ndarray, g: np.ndarray) -> np.ndarray:
            z = model.inputs(x)
            margin = z @ weights
            loss, slope = np.logaddexp(0, margin), 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            return np.concatenate([[loss.sum(), loss[g].sum()], z.T @ slope, z[g].T @ slope[g], z[g].sum(0)])

        return summed(build)

    weights, previous, momentum = np.zeros(WIDTH), np.zeros(WIDTH), 1.0
    for _ in range(steps):
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = weights + (momentum - 1) / after * (weights - previous)
        parts = risk_parts(ahead)
        as_negative, good_slope = parts[2 : 2 + WIDTH] / n, parts[2 + WIDTH : 2 + 2 * WIDTH] / n_good
        good_mean = parts[2 + 2 * WIDTH :] / n_good
        negative_risk = parts[0] / n - prior * parts[1] / n_good
        if negative_risk >= 0:
            slope, after_next = prior * (good_slope - good_mean) + as_negative - prior * good_slope, after
        else:  # the non-negative part: step back from fitting negatives that the prior leaves none of
            slope, after_next = -(as_negative - prior * good_slope), 1.0
        step = ahead - bound @ (slope + RIDGE * ahead)
        previous, weights, momentum = weights, step, after_next
    model.weights = weights
    return model


def classify(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted (1 where score >= 0.5).

    Null and empty texts are scored by their (zero) statistics; a null id is not held out;
    repeated rows are scored alike. Without training labels every score is 0.5.
    """
    features = feature_table(docs)
    model = fit(features, labels, prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32).reshape(-1, BASE).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below the threshold; all columns as they were."""
    model = fit(feature_table(docs), labels, prior)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch_features(batch.column("text")).astype(np.float32).astype(float)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
