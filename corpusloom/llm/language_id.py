"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A letter trigram binds its letters by
multiplying their vectors, each permuted (rotated) by its place; a text bundles
(adds) its trigrams; a language prototype bundles the texts of that language. The
prediction is the prototype with the largest cosine.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20_261
UNDETERMINED = "und"
#: More languages than this raise: the model is held by the driver and every task.
MAX_LANGUAGES = 10_000
#: Remembered trigram vectors of a process.
REMEMBERED = 60_000
_BITS = np.uint64(21)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of the lower-cased text and their counts; anything else is one blank between words."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    keys = (codes[:-2] << (_BITS + _BITS)) | (codes[1:-1] << _BITS) | codes[2:]
    return np.unique(keys, return_counts=True)


class Vectors:
    """Vectors of trigrams, made on first use."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self._empty()

    def _empty(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.table, self.used = np.empty((1024, self.dimensions), np.int8), 0

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= REMEMBERED:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """One row of signs per trigram."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            if self.used > REMEMBERED:
                self._empty()
                return self.of(keys)
            new = keys[~known]
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            mask = (1 << int(_BITS)) - 1
            for k, key in enumerate(new.tolist()):
                a, b, c = key >> 42, key >> 21 & mask, key & mask
                self.table[self.used + k] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            rows = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            keys_all, rows_all = np.concatenate([self.keys, new]), np.concatenate([self.rows, rows])
            order = np.argsort(keys_all)
            self.keys, self.rows = keys_all[order], rows_all[order]
            at = np.searchsorted(self.keys, keys)
        return self.table[self.rows[at]]

    def bundle(self, keys: np.ndarray, counts: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.zeros(self.dimensions)
        for k in range(0, len(keys), block):
            out += counts[k : k + block].astype(np.float32) @ self.of(keys[k : k + block]).astype(np.float32)
        return out


_VECTORS: dict[tuple[int, int], Vectors] = {}


def vectors_of(dimensions: int, seed: int) -> Vectors:
    """The vectors of this process, so that later tasks find them made."""
    if (dimensions, seed) not in _VECTORS:
        _VECTORS[dimensions, seed] = Vectors(dimensions, seed)
    return _VECTORS[dimensions, seed]


def _profile(dimensions: int, seed: int) -> Callable:
    """Sums of the unit vectors of the texts of each language, one row per language and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = vectors_of(dimensions, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = trigrams(text)
                if len(keys):
                    vector = vectors.bundle(keys, counts)
                    norm = np.linalg.norm(vector)
                    if norm:
                        if lang not in sums:
                            sums[lang] = np.zeros(dimensions)
                        sums[lang] += vector / norm
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "total"]
        )

    return run


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED
) -> dict[str, np.ndarray]:
    """Prototype of every language: the sum of the unit vectors of all its texts.

    Rows without a language or without a letter teach nothing. The driver
    receives one vector per language and task.
    """
    source = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    parts = source.mapInArrow(_profile(dimensions, seed), "lang string, total array<double>")
    merged = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = merged.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {row.lang: np.array([x.v for x in row.v]) for row in sorted(rows, key=lambda r: r.lang)}


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves remainder 2 by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predicted(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", into: str = "language",
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """``docs`` with a column ``into``: struct of lang and score, the cosine (0 if negative).

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if there is no prototype. Equal scores go to the first language
    in code point order. A column named ``into`` is replaced.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]).reshape(-1, dimensions)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps((names, matrix)))

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (own, profiles), vectors = pickle.loads(held.value), vectors_of(dimensions, seed)
        for texts in batches:
            langs, scores = [], []
            for text_ in texts.to_pylist():
                keys, counts = trigrams(text_)
                vector = vectors.bundle(keys, counts)
                norm = np.linalg.norm(vector)
                if not own or not norm:
                    langs.append(UNDETERMINED if not len(keys) or not own else own[0])
                    scores.append(0.0)
                    continue
                cosines = profiles @ (vector / norm)
                best = int(np.argmax(cosines))
                langs.append(own[best])
                scores.append(float(np.clip(cosines[best], 0.0, 1.0)))
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
            )

    return docs.withColumn(into, F.arrow_udf(label, "lang string, score double")(F.col(text).cast("string")))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Prototypes are learned from all rows that are not held out and have a
    language. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(id_column).alias("out"))
    prototypes = learn(rows.where("NOT out"))
    return predicted(rows.select("id", "text", "out"), prototypes).select(
        F.col("id").alias(id_column), F.col("out").alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score"
    )
