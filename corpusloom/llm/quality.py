"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score into grades: P(grade > k) = sigmoid(score - threshold k).
The expected grade and the tail probability of the best grade come from the same
score, and documents are selected by the tail probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, mix, sole_memory

BITS = 18
#: Labelled rows that the fit may read, spread evenly by a hash of the id.
TRAIN_ROWS = 10_000
KEEP_TAIL = 0.5
#: Words also count by their first bytes, so that unseen forms of a stem are recognised.
HEAD_BYTES = 4
#: Rows of a rare grade weigh up to this much in the fit.
RARE_WEIGHT = 4.0
#: Features in fewer documents of the sample than this take no part in the fit.
LEAST_DOCS = 3
PENALTY = 1.0
#: Features that one step of the fit works on at a time.
FIT_BLOCK = 1 << 18

#: Classes of bytes for the shape of a word: lower, upper, digit, beyond ASCII; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_SHAPE_TABLE = _SHAPE.tobytes()


def _shape(word: bytes) -> bytes:
    """The run-collapsed byte classes of a word, at most eight of them."""
    codes = np.frombuffer(word.translate(_SHAPE_TABLE), np.uint8)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])][:8].tobytes()


class Features:
    """Sparse hashed features of a text: (indices, values)."""

    def __init__(self, bits: int = BITS):
        sole_memory()
        self.words, self.shapes, self.shape_of = WordHashes(), WordHashes(), {}
        self.shift, self.size = np.uint64(64 - bits), 1 << bits

    def _shapes(self, words: list[bytes]) -> list[bytes]:
        if len(self.shape_of) > 200_000:
            self.shape_of.clear()
        out = []
        for word in words:
            shape = self.shape_of.get(word)
            if shape is None:
                shape = self.shape_of[word] = _shape(word)
            out.append(shape)
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(raw)
        if not n:
            return np.array([0], dtype=np.int64), np.ones(1, dtype=np.float32)
        words = [w.strip(b".,;:!?\"'()").lower() for w in raw]
        hashes = self.words.of(words)
        distinct = np.unique(hashes)
        heads = self.words.of(list({b"\0" + w[:HEAD_BYTES] for w in set(words)}))
        at = (mix(np.concatenate([distinct, heads])) >> self.shift).astype(np.int64)
        shapes, counts = np.unique(self.shapes.of(self._shapes(raw)), return_counts=True)
        shape_at = (mix(shapes ^ np.uint64(0xA5A5A5A5)) >> self.shift).astype(np.int64)
        extra = {
            1: len(distinct) / n,
            2: float(np.mean(hashes[1:] == hashes[:-1])) if n > 1 else 0.0,
            3: min(np.log1p(n), 10.0) / 10.0,
            4: 1.0 / n,
        }
        index = np.concatenate([at, shape_at, np.fromiter(extra, np.int64, len(extra))])
        value = np.concatenate(
            [np.full(len(at), 0.5), 3.0 * np.sqrt(counts / n), np.fromiter(extra.values(), float, len(extra)) * 2.0]
        )
        return index, value.astype(np.float32)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, one row per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _minimise(loss: Callable, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, gradient = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, factors = gradient.copy(), []
        for s, y, r in reversed(past):
            factors.append(r * (s @ q))
            q -= factors[-1] * y
        if past:
            s, y, r = past[-1]
            q /= r * (y @ y)
        else:
            q /= max(1.0, np.abs(q).max())
        for (s, y, r), factor in zip(past, reversed(factors), strict=True):
            q += (factor - r * (y @ q)) * s
        slope, rate = gradient @ q, 1.0
        for _ in range(20):
            new_value, new_gradient = loss(x - rate * q)
            if new_value <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = -rate * q, new_gradient - gradient
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1.0 / (s @ y))]
        done = value - new_value < 1e-6 * abs(value)
        x, value, gradient = x + s, new_value, new_gradient
        if done:
            break
    return x


def fit(
    index: np.ndarray, value: np.ndarray, start: np.ndarray, grade: np.ndarray, grades: int,
    size: int = 1 << BITS, steps: int = 40, penalty: float = PENALTY,
) -> OrdinalModel:
    """Penalised likelihood of the cumulative logit.

    ``start`` has the place of each row's first feature. The thresholds are kept
    in order by writing them as a first one plus positive steps.
    """
    n, every, bounds = len(start), np.arange(len(start)), np.append(start, len(index))
    counts = np.bincount(index, minlength=size)
    # Only features that take part are parameters: the others keep the weight 0.
    active, common = np.flatnonzero(counts >= LEAST_DOCS), counts[index] >= LEAST_DOCS
    bounds = np.concatenate([[0], np.cumsum(common)])[bounds]
    place = np.zeros(size, np.int32)
    place[active] = np.arange(len(active))
    index, value = place[index[common]], value[common].astype(np.float32)
    full_size, size = size, len(active)
    # Rows are worked through in blocks, so that the driver holds the features and little besides.
    cuts_of_rows = np.unique(np.concatenate([np.searchsorted(bounds, np.arange(0, len(index) + 1, FIT_BLOCK)), [0, n]]))
    blocks = list(zip(cuts_of_rows[:-1].tolist(), cuts_of_rows[1:].tolist(), strict=True))

    def parts() -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: its rows, and for each of their features the row, the parameter and the amount."""
        for first, last in blocks:
            held = slice(bounds[first], bounds[last])
            row = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
            yield slice(first, last), row, index[held], value[held].astype(float)

    seen = np.maximum(np.bincount(grade, minlength=grades), 1)
    weight = np.clip(n / (grades * seen), 1.0, RARE_WEIGHT)[grade]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, gaps = x[:size], np.exp(x[size + 1 :])
        cuts = x[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.concatenate([np.bincount(r, v * w[i], minlength=b.stop - b.start) for b, r, i, v in parts()])
        upper = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        above = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        p = np.maximum(above[every, grade] - above[every, grade + 1], 1e-12)
        slope = above * (1 - above)
        low, high = weight * slope[every, grade] / p, weight * slope[every, grade + 1] / p
        g_w = penalty * w
        for b, r, i, v in parts():
            g_w += np.bincount(i, v * (high - low)[b][r], minlength=size)
        g_cut = np.array([low[grade == k + 1].sum() - high[grade == k].sum() for k in range(grades - 1)])
        g_gap = np.array([gaps[k] * g_cut[k + 1 :].sum() for k in range(grades - 2)])
        return float(-(weight * np.log(p)).sum() + penalty / 2 * (w @ w)), np.concatenate([g_w, [g_cut.sum()], g_gap])

    x = np.zeros(size + grades - 1)
    x[size] = -1.0
    x = _minimise(loss, x, steps)
    cuts = x[size] + np.concatenate([[0.0], np.cumsum(np.exp(x[size + 1 :]))])
    weights = np.zeros(full_size, np.float32)
    weights[active] = x[:size]
    return OrdinalModel(weights, cuts)


def grades_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Rating from the label columns: 0 poor, 1 well written but toxic, 2 good; null where quality is null."""
    good, clean = F.col(quality) == 1, F.coalesce(F.col(toxic), F.lit(0)) == 0
    return F.when(F.col(quality).isNull(), None).when(good & clean, 2).when(good, 1).otherwise(0)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        found = [features.of(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
             pa.array([v.tobytes() for _, v in found], pa.binary())],
            ["grade", "indices", "amounts"],
        )


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
    grade: Column | None = None, grades: int = 3, train_rows: int = TRAIN_ROWS,
) -> OrdinalModel:
    """Fit on at most ``train_rows`` rated documents, those with the smallest hashes of their ids.

    Only their hashed features reach the driver. An id rated more than once has
    its lowest grade; of texts that share an id, the first in byte order counts.
    Ratings without a document and null grades are left out. Without any rating
    the model keeps every document.
    """
    rated = (
        labels.select(F.col(id_column).alias("id"), (grades_of() if grade is None else grade).cast("int").alias("grade"))
        .where("id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id").limit(train_rows)
    )
    rows = (
        docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
        .join(F.broadcast(rated), "id")  # at most ``train_rows`` rows of two numbers
        .groupBy("id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
        .select("grade", "text")
        .mapInArrow(_featurise, "grade int, indices binary, amounts binary")
        .collect()
    )
    size = 1 << BITS
    if not rows:
        return OrdinalModel(np.zeros(size, dtype=np.float32), np.full(grades - 1, -40.0))
    rows.sort(key=lambda r: (r.grade, bytes(r.indices)))
    index = np.concatenate([np.frombuffer(r.indices, np.int32) for r in rows])
    value = np.concatenate([np.frombuffer(r.amounts, np.float32) for r in rows])
    start, grade_of_row = np.cumsum([0] + [len(r.indices) // 4 for r in rows])[:-1], np.array([r.grade for r in rows])
    del rows
    return fit(index, value, start, grade_of_row, grades, size)


def scored(docs: DataFrame, model: OrdinalModel, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a column ``into``: struct of expected_grade and tail_probability (of the best grade).

    Null and blank texts have one feature of their own, so they are graded like
    any other text. A column named ``into`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.weights, model.thresholds)))
    kind = pa.struct([("expected_grade", pa.float64()), ("tail_probability", pa.float64())])

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, own = Features(), OrdinalModel(*pickle.loads(held.value))
        for texts in batches:
            scores = np.array([float(own.weights[i] @ v) for i, v in map(features.of, texts.to_pylist())])
            tails = own.tails(scores)
            yield pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], fields=list(kind))

    apply = F.arrow_udf(score, "expected_grade double, tail_probability double")
    return docs.withColumn(into, apply(F.col(text).cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", keep_tail: float = KEEP_TAIL
) -> DataFrame:
    """One row per input row: id, expected_grade (0 to 2), tail_probability, kept.

    Every whole text is scored; rows with null ids or repeated rows too. An
    empty table gives an empty result. Other columns are not read.
    """
    model = train(docs, labels, text, id_column)
    rows = scored(docs.select(F.col(id_column), F.col(text)), model, text, "graded_")
    return rows.select(
        F.col(id_column), "graded_.expected_grade", "graded_.tail_probability",
        (F.col("graded_.tail_probability") >= keep_tail).alias("kept"),
    )
