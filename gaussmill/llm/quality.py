"""Ordinal quality classifier on hashed text.

A cumulative-link (proportional-odds) regression: one weight vector w over
hashed features and ordered thresholds t_1 < ... < t_(K-1), with
P(grade >= j) = 1 - sigmoid(t_j - w.x).  It gives an expected grade and the tail
probability P(grade >= j) by which documents are selected.

Features of a text, all hashed into one space, are square roots of shares of its
tokens: those with a given word (case and outer punctuation aside), beginning of
a word, or shape; those that repeat the one before; and the distinct ones.  Tokens of more than 64
characters (text without spaces, code, encoded data) are replaced by all their
4-grams, each with the weight of a quarter.

The model is fitted on at most `most_labels` labelled documents (a documented
bound; those with the smallest hashes of their ids) and scores every document.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaussmill.llm.common import col, map_batches, slices, text_of, worker_cached

BITS, MOST_LABELS, EPOCHS = 18, 10_000, 12
MOST_TOKENS, BEGINNINGS, SCALE = 300_000, range(4, 9), 3.0
LONGEST, GRAM = 64, 4


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(token: str) -> str:
    out, last = [], ""
    for c in token:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            out.append(kind)
        last = kind
    return "".join(out)


class Featurizer(dict):
    """Token -> buckets of its word, the word's beginnings and its shape; only those in `live`, if given."""

    def __init__(self, live: frozenset[int] | None = None):
        super().__init__()
        self.live = live

    def _wanted(self, *names: str) -> tuple[int, ...]:
        buckets = dict.fromkeys(map(_bucket, names))
        return tuple(b for b in buckets if self.live is None or b in self.live)

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > MOST_TOKENS:
            self.clear()
        word = token.strip(".,;:!?*$%&#|()[]{}\"'-+/\\<>=_~^`@").lower()
        made = self[token] = self._wanted("w" + word, "s" + _shape(token), *("p" + word[:n] for n in BEGINNINGS if len(word) > n))
        return made

    def features(self, text: str) -> dict[int, float]:
        tokens = text.split()
        if not tokens:
            return dict.fromkeys(self._wanted("empty"), SCALE)
        distinct, counts, grams = Counter(tokens), Counter(), Counter()
        total = len(tokens)
        for token in [t for t in distinct if len(t) > LONGEST]:
            n = distinct.pop(token)
            for gram, times in Counter(token[i : i + GRAM] for i in range(len(token) - GRAM + 1)).items():
                grams[gram] += n * times
            total += n * ((len(token) - GRAM + 1) / GRAM - 1)
        for token, n in distinct.items():
            for bucket in self[token]:
                counts[bucket] += n
        for gram, n in grams.items():
            for bucket in self[gram]:
                counts[bucket] += n / GRAM
        for name, n in (("same", sum(map(eq, tokens, tokens[1:]))), ("distinct", len(distinct) + len(grams) / GRAM)):
            for bucket in self._wanted(name):
                counts[bucket] += n
        return {bucket: SCALE * math.sqrt(n / total) for bucket, n in counts.items() if n}


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


@dataclass
class OrdinalModel:
    grades: int
    thresholds: list[float]
    weights: dict[int, float] = field(default_factory=dict)

    def tails(self, features: dict[int, float]) -> list[float]:
        """P(grade >= 1), ..., P(grade >= K-1)."""
        score = sum(self.weights.get(i, 0.0) * v for i, v in features.items())
        return [_sigmoid(score - t) for t in self.thresholds]


def fit_rows(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, *, epochs: int = EPOCHS, rate: float = 0.5, l1: float | None = None, l2: float = 1e-3) -> OrdinalModel:
    """Follow-the-regularised-leader over rows (grade, buckets, values); the L1 term leaves few weights that aren't zero.

    It is the number of rows over 400, between 1 and 10, unless given.
    """
    l1 = min(10.0, max(1.0, len(rows) / 400)) if l1 is None else l1
    if not rows:
        return OrdinalModel(grades, [-30.0] * (grades - 1))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    t = np.arange(grades - 1, dtype=float) - (grades - 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((1 + np.sqrt(n[i])) / rate + l2))

    order = np.random.RandomState(7)
    for epoch in range(epochs):
        step = 0.1 / (1 + epoch)
        for k in order.permutation(len(rows)):
            grade, i, v = rows[k]
            w = weights(i)
            score = float(w @ v)
            upper = _sigmoid(t[grade] - score) if grade < grades - 1 else 1.0
            lower = _sigmoid(t[grade - 1] - score) if grade else 0.0
            mass = max(upper - lower, 1e-9)
            up, down = upper * (1 - upper) / mass, lower * (1 - lower) / mass
            g = (up - down) * v  # of the negative log likelihood
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rate
            z[i] += g - sigma * w
            n[i] += g * g
            if grade < grades - 1:
                t[grade] += step * up
            if grade:
                t[grade - 1] -= step * down
            t.sort()
    live = np.flatnonzero(np.abs(z) > l1)
    return OrdinalModel(grades, t.tolist(), dict(zip(live.tolist(), weights(live).tolist(), strict=True)))


def fit(docs: DataFrame, graded: DataFrame, grades: int, *, doc_id: str = "doc_id", text: str = "text", most_labels: int = MOST_LABELS, **options) -> OrdinalModel:
    """Fit on the documents that `graded` (doc_id, grade 0 to grades-1) covers, at most `most_labels` of its rows.

    Rows with a null id or a grade that is null or out of range are no labels.
    Of documents that share an id, the one whose text has the smallest hash is
    fitted, so that the bound holds for any table.  Without labels the model
    accepts everything.
    """
    rated = graded.select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade")).where(f"id is not null and grade between 0 and {grades - 1}")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(most_labels)
    rows = docs.select(col(doc_id).alias("id"), text_of(text).alias("text")).join(F.broadcast(rated), "id").select("id", "grade", "text")
    rows = rows.groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("id", "grade", "first.text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Featurizer()
        for batch in batches:
            for part in slices(batch, 2):
                found = [known.features(t) for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "grade", "at", "value"])

    table = map_batches(rows, work, f"id {dict(rows.dtypes)['id']}, grade int, at array<int>, value array<float>").toArrow()
    table = table.sort_by([("id", "ascending"), ("grade", "ascending")]).combine_chunks()
    if not table.num_rows:
        return fit_rows([], grades)
    at, value = (table.column(c).chunk(0) for c in ("at", "value"))
    ends, buckets, values = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
    spans = zip(ends, ends[1:], strict=False)
    return fit_rows([(g, buckets[a:b], values[a:b]) for g, (a, b) in zip(table.column("grade").to_pylist(), spans, strict=True)], grades, **options)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", *, carry: list[str] | None = None, least: float | None = None, tail: int | None = None) -> DataFrame:
    """The carried columns (all by default) with expected_grade and tail_probability = P(grade >= tail), tail the top grade by default.

    With `least`, only rows whose tail probability is at least that, and the
    carried columns alone.  Null and empty texts are scored as empty ones.
    """
    held = docs.columns if carry is None else carry
    rows = docs.select(text_of(text).alias("_"), *[col(c) for c in held])
    at, live = (tail or model.grades - 1) - 1, frozenset(model.weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cached(live, lambda: Featurizer(live))
        for batch in batches:
            for part in slices(batch, 0):
                tails = [model.tails(known.features(t)) for t in part.column(0).to_pylist()]
                rest = part.columns[1:]
                if least is not None:
                    keep = pa.array([t[at] >= least for t in tails], pa.bool_())
                    yield pa.RecordBatch.from_arrays([c.filter(keep) for c in rest], names=[f"c{i}" for i in range(len(rest))])
                else:
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[at] for t in tails], pa.float64())], names=[f"c{i}" for i in range(len(rest) + 2)])

    fields = [f"c{i} {rows.schema[i + 1].dataType.simpleString()}" for i in range(len(held))]
    if least is not None:
        return map_batches(rows, work, ", ".join(fields)).toDF(*held)
    return map_batches(rows, work, ", ".join([*fields, f"c{len(held)} double", f"c{len(held) + 1} double"])).toDF(*held, "expected_grade", "tail_probability")


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of the table `labels`: 0 for poor quality, 1 for good but toxic, 2 for good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2).alias("grade"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_clean = P(grade >= 2), keep (p_clean of one half or more)."""
    model = fit(docs, grades_of(labels), 3)
    scored = score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("p_clean"), (F.col("tail_probability") >= 0.5).alias("keep"))


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose probability of the top grade is at least `least`, with the input's columns."""
    return score(docs, fit(docs, grades_of(labels), 3), least=least)
