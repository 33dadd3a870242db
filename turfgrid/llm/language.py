"""Language by string kernels.

The kernel of two texts is the share of n-grams of letters (n = 1 to 4, all lengths blended) that both
contain: |A and B| / sqrt(|A| |B|), presence only. Nyström: a text is described by its kernel with some
landmark texts; ridge regression on these, one language versus the rest, gives a score per language.
Scoring a batch is two matrix products: presence bits x landmark bits, then kernel values x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfgrid.llm import text as T

UNDETERMINED = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
SHARPNESS = 6.0
#: A score this close to that of a guess among the learned languages decides nothing.
UNDECIDED = 1.2


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. `per_language` labelled texts of each language are read, the first ones in hash order."""

    per_language: int = 300
    landmarks: int = 24
    longest_gram: int = 4
    bits: int = 18
    ridge: float = 1e-3


@dataclass(frozen=True)
class Model:
    """Landmark n-grams (columns of the presence row), landmark bits, and one coefficient column per language."""

    settings: Settings
    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    coefficients: np.ndarray

    def scores(self, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text and language, from presence bits of the landmark n-grams and n-gram counts."""
        kernel = (bits @ self.landmarks.T) / np.sqrt(np.outer(sizes, self.sizes) + 1e-9)
        return kernel @ self.coefficients


def presence(text: str, row: np.ndarray, settings: Settings) -> bool:
    """Set `row` to the n-grams of a whole text, each at its hash; True if the text has a letter.

    Runs of other characters count as one blank.
    """
    row[:] = 0
    found, shift, carry = False, np.uint32(32 - settings.bits), np.zeros(0, np.uint32)
    for piece in T.pieces(text):
        points = T.letters(piece)
        found = found or bool(points.any())
        # what is carried on has been through this already: its first symbol stays, also if it is a blank
        kept = points != 0
        kept[1:] |= points[:-1] != 0
        if points.size:
            kept[0] |= carry.size > 0 and carry[-1] != 0
        points = np.concatenate([carry, points[kept]])
        # a blank counts as a symbol of its own, also in front
        symbols = points + np.uint32(1)
        value = symbols
        for n in range(1, settings.longest_gram + 1):
            if n > 1:
                value = value[:-1] * np.uint32(0x01000193) + symbols[n - 1 :]
            row[(value * np.uint32(0x9E3779B1)) >> shift] = 1
        carry = points[max(0, points.size - settings.longest_gram + 1) :]
    return found


def fit(grams: list[np.ndarray], labels: list[str], settings: Settings = Settings()) -> Model:
    """Ridge regression on n-gram lists; the first texts of each language are the landmarks."""
    languages = sorted(set(labels))
    picked = [i for name in languages for i in [k for k, x in enumerate(labels) if x == name][: settings.landmarks]]
    columns = np.unique(np.concatenate([grams[i] for i in picked])) if picked else np.zeros(0, np.int64)
    place = np.full(1 << settings.bits, -1)
    place[columns] = np.arange(columns.size)

    def bits(rows: list[int]) -> np.ndarray:
        block = np.zeros((len(rows), columns.size), np.float32)
        for k, i in enumerate(rows):
            at = place[grams[i]]
            block[k, at[at >= 0]] = 1
        return block

    sizes = np.array([grams[i].size for i in range(len(grams))], float)
    landmarks, own = bits(picked), sizes[picked]
    empty = Model(settings, languages, columns, landmarks, own, np.zeros((len(picked), len(languages)), np.float32))
    if not picked:
        return empty
    blocks = [list(range(a, min(a + 64, len(grams)))) for a in range(0, len(grams), 64)]
    kernel = np.concatenate([(bits(b) @ landmarks.T) / np.sqrt(np.outer(sizes[b], own) + 1e-9) for b in blocks]).astype(float)
    between = kernel[picked]
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    system = kernel.T @ kernel + settings.ridge * len(grams) * between + 1e-8 * np.eye(len(picked))
    solved = np.linalg.solve(system, kernel.T @ target)
    return Model(settings, languages, columns, landmarks, own, solved.astype(np.float32))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) == 2


def _grams_of(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(1 << settings.bits, np.uint8)
        for batch in batches:
            names, lists = [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if presence(text, row, settings):
                    names.append(name)
                    lists.append(np.flatnonzero(row).astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum([x.size for x in lists])]).astype(np.int32)
            values = pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["lang", "grams"])

    return run


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on documents outside the held-out quarter with a known language.

    The rows are chosen by a hash of their id, so texts are read for the chosen rows only; at most
    `per_language` rows of each language reach the driver, as n-gram lists.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = T.first_by_hash(known.select("doc_id", "lang").distinct(), "lang", settings.per_language)
    texts = known.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = texts.select("lang", "text").mapInArrow(_grams_of(settings), "lang string, grams array<int>").toArrow()
    lists = rows.column("grams").combine_chunks()
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    labels = rows.column("lang").to_pylist()
    grams = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    # Spark may return rows in any order; the fit must not depend on it
    order = sorted(range(len(grams)), key=lambda i: (labels[i], hash_of(grams[i])))
    return fit([grams[i] for i in order], [labels[i] for i in order], settings)


def hash_of(grams: np.ndarray) -> int:
    """An order for texts that has nothing to do with their length or spelling."""
    return int(T.mix(grams.astype(np.uint64)).sum(dtype=np.uint64))


def _judge(texts: list[str | None], model: Model, row: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, by batched products; `row` is room for presence bits."""
    bits = np.zeros((len(texts), model.columns.size), np.float32)
    sizes, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if text and presence(text, row, model.settings):
            bits[i], sizes[i], lettered[i] = row[model.columns], row.sum(dtype=np.int64), True
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    values = SHARPNESS * model.scores(bits, sizes).astype(float)
    values = np.exp(values - values.max(axis=1, keepdims=True))
    best = values.argmax(axis=1)
    names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
    return names, np.where(lettered, values.max(axis=1) / values.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document.

    Null texts and texts without a letter are `und` with score 0, as is everything when no language was
    learned. Ties go to the first language in alphabetical order; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(1 << model.settings.bits, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                names, scores = _judge(part.column("text").to_pylist(), model, row)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, with a language.

    Rejected are null texts, texts without a letter, and texts whose score is at most `UNDECIDED` times
    that of a guess among several languages. Without any learned language nothing but the first two goes.
    """
    guess = UNDECIDED / len(model.languages) if len(model.languages) > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(1 << model.settings.bits, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                if model.languages:
                    names, scores = _judge(texts, model, row)
                    kept = [name != UNDETERMINED and score > guess for name, score in zip(names, scores, strict=True)]
                else:
                    kept = [bool(text) and any(map(str.isalpha, text)) for text in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
